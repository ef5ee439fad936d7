"""Nearest neighbours by a block matrix join.

Queries and candidates are dealt into blocks of bounded size; every query block meets every candidate block in one cell.
In a cell, vectors are rounded to int8 with one scale each. A product of int8 tiles gives each inner product up to a bound:
with x = x' + e and y = y' + f, |x.y - x'.y'| <= |x| |f| + |e| |y'|. Pairs whose upper bound reaches the k-th best known
lower bound survive, are recomputed in double precision on the original vectors, and are merged by a heap per query. No
pair of the true k nearest is dropped, so recall is 1.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorestack.llm.common import materialise

#: Products of int8 values over so many dimensions are exact in 32-bit floats.
_EXACT_DIMENSIONS = 1024
_TILE_QUERIES, _TILE_CANDIDATES = 512, 1024


def usable(vector: Column) -> Column:
    """Not null, with finite components that are not all zero."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Int8:
    """Vectors rounded to int8: values, scales, and the norms that the error bound needs."""

    def __init__(self, x: np.ndarray):
        self.scale = np.abs(x).max(axis=1) / 127
        self.values = np.rint(x / self.scale[:, None]).astype(np.int8)
        rounded = self.values * self.scale[:, None]
        self.norm = np.linalg.norm(x, axis=1)
        self.error = np.linalg.norm(x - rounded, axis=1)
        self.rounded_norm = np.linalg.norm(rounded, axis=1)


def _products(a: Int8, i: slice, b: Int8, j: slice) -> tuple[np.ndarray, np.ndarray]:
    """Approximate inner products of one tile, and their error bounds."""
    x, y = a.values[i], b.values[j]
    total = sum(x[:, d : d + _EXACT_DIMENSIONS].astype(np.float32) @ y[:, d : d + _EXACT_DIMENSIONS].astype(np.float32).T for d in range(0, x.shape[1], _EXACT_DIMENSIONS))
    near = total.astype(np.float64) * a.scale[i][:, None] * b.scale[j]
    bound = a.norm[i][:, None] * b.error[j] + a.error[i][:, None] * b.rounded_norm[j]
    return near, bound + 1e-9 * a.norm[i][:, None] * b.norm[j]


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x with the rows of y, summed in the order of the dimensions."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += x[:, d] * y[:, d]
    return total


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            qid, q = left.column("id").to_numpy(), _vectors(left.column("vector"))
            cid, c = right.column("id").to_numpy(), _vectors(right.column("vector"))
            qi, ci = Int8(q), Int8(c)
            heaps: list[list[tuple[float, int]]] = [[] for _ in qid]
            floor = np.full(len(qid), -np.inf)  # a score that k known candidates reach
            for j in (slice(s, s + _TILE_CANDIDATES) for s in range(0, len(cid), _TILE_CANDIDATES)):
                for i in (slice(s, s + _TILE_QUERIES) for s in range(0, len(qid), _TILE_QUERIES)):
                    near, bound = _products(qi, i, ci, j)
                    own = qid[i][:, None] == cid[j]
                    upper, lower = near + bound, np.where(own, -np.inf, near - bound)
                    if lower.shape[1] > k:
                        floor[i] = np.maximum(floor[i], np.partition(lower, -k, axis=1)[:, -k])
                    rows, columns = np.nonzero((upper >= floor[i][:, None]) & ~own)
                    for at in range(0, len(rows), 1 << 18):
                        r, col = rows[at : at + (1 << 18)] + i.start, columns[at : at + (1 << 18)] + j.start
                        for query, ident, score in zip(r.tolist(), cid[col].tolist(), _exact(q[r], c[col]).tolist(), strict=True):
                            heap = heaps[query]
                            if len(heap) < k:
                                heapq.heappush(heap, (score, -ident))
                            elif (score, -ident) > heap[0]:
                                heapq.heapreplace(heap, (score, -ident))
                    for query in np.unique(rows) + i.start:
                        if len(heaps[query]) == k:
                            floor[query] = max(floor[query], heaps[query][0][0])
            found = [(query, -ident, score) for query, heap in zip(qid.tolist(), heaps, strict=True) for score, ident in heap]
        return pa.table({"query_id": pa.array([x[0] for x in found], pa.int64()), "vec_id": pa.array([x[1] for x in found], pa.int64()), "score": pa.array([x[2] for x in found], pa.float64())})

    return run


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = 4096, candidate_block: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` candidates of largest inner product, ties to the smaller vec_id.

    A candidate with the query's identifier is the query's own and left out. Null identifiers and vectors that are null,
    empty, zero or hold null or non-finite components take no part; vectors meet those of their own length. A repeated
    row counts once. Other columns are not read. Fewer than ``k`` candidates are all returned; empty tables give none.

    Blocks are dealt by a hash of identifier and vector, ``query_block`` queries and ``candidate_block`` candidates in the
    mean, so a task's memory doesn't grow with the tables. The queries are copied once per candidate block, the candidates
    once per query block.
    """

    def ready(df: DataFrame) -> DataFrame:
        vector = F.col(vector_col).cast("array<double>")
        return df.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).filter(F.col("id").isNotNull() & usable(F.col("vector"))).distinct()

    q, c = materialise(ready(queries)), materialise(ready(candidates))
    parts = [max(1, math.ceil(df.count() / size)) for df, size in ((q, query_block), (c, candidate_block))]

    def dealt(df: DataFrame, own: int, other: int, first: bool) -> DataFrame:
        block = F.pmod(F.xxhash64("id", "vector"), F.lit(own))
        cell = block * other + F.col("other") if first else F.col("other") * own + block
        return df.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(other - 1)))).select("id", "vector", cell.alias("cell"), F.size("vector").alias("length"))

    left, right = dealt(q, parts[0], parts[1], True), dealt(c, parts[1], parts[0], False)
    found = left.groupBy("cell", "length").cogroup(right.groupBy("cell", "length")).applyInArrow(_search(k), "query_id long, vec_id long, score double")
    # A cell holds each query once, so its k best are there; over the cells the window keeps k per task before it shuffles.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest in all of ``embeddings`` of every row whose vec_id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors.filter("vec_id % 20 = 0"), vectors)


OP1_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY rank <= 20
"""
