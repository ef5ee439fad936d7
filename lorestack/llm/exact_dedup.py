"""Exact deduplication by content sort.

Sampled splitters range-partition the normalised texts, an external sort by the whole content places equal texts next to
each other, and neighbours are compared in full. Splitters are sampled through the driver, so they hold no whole texts: a
splitter is (first ``PREFIX`` normalised characters, a hash of the whole, identifier, row), and only texts that share their
beginning are dealt to ranges by the hash. Because identifier and row take part, a group of copies that holds a third of
all rows is cut into as many ranges as its size asks for, even where all of it has one identifier. A range's groups that
may go on in another range are those of its smallest and its largest splitter key; they are put together from one summary
row each. The text is shuffled once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorestack.llm.common import materialise, unused

SPACE = " \t\n\x0b\x0c\r"
#: Characters of a splitter. Inside a range the whole content decides.
PREFIX = 48
_RUNS = "doc_id long, sha binary, run_keep long, run_code int, run_size long, edge boolean, first boolean, at int"


def normalised(text):
    """The text without white space characters; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def _dealt(rows: DataFrame, bare: Column, content: str, hashed: str, codes: str, ident: str, row: str) -> DataFrame:
    """``rows`` with their normalised text in ``content``, sorted by it in each range, the row to keep of equal ones first."""
    numbered = rows.withColumn(row, F.monotonically_increasing_id())
    ranged = numbered.repartitionByRange(F.substring(bare, 1, PREFIX), F.col(hashed), F.col(ident).asc_nulls_last(), F.col(row)).drop(row)
    if content not in ranged.columns:
        ranged = ranged.withColumn(content, bare)
    return ranged.sortWithinPartitions(F.col(content), F.col(codes).desc(), F.col(ident).asc_nulls_last())


class _Edges:
    """Runs of one range in any order of keys: all but those of the smallest and the largest key are handed on at once."""

    def __init__(self):
        self.held: dict[tuple, list] = {}  # of two keys at most; different texts of one key (a collision) stay together

    def add(self, key: tuple, run) -> list:
        self.held.setdefault(key, []).append(run)
        return self.held.pop(sorted(self.held)[1]) if len(self.held) > 2 else []

    def rest(self) -> list:
        return [run for runs in self.held.values() for run in runs]


def _starts(batches: Iterator[pa.RecordBatch], content: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each sorted batch and the rows whose text differs from that of the row before, compared in full."""
    last = None
    for batch in batches:
        if batch.num_rows:
            text = batch.column(content)
            fresh = np.ones(batch.num_rows, dtype=bool)
            fresh[1:] = pc.not_equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False)
            fresh[0] = last is None or text[0].as_py() != last
            last = text[-1].as_py()
            yield batch, np.flatnonzero(fresh)


def _key(batch: pa.RecordBatch, i: int, content: str, hashed: str) -> tuple[tuple, bytes]:
    text = batch.column(content)[i].as_py()
    return (text[:PREFIX].encode(), batch.column(hashed)[i].as_py()), hashlib.sha256(text.encode()).digest()


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each run of equal texts in one sorted range; no more than three runs' identifiers wait."""
    at, edges, run, ready, waiting = TaskContext.get().partitionId(), _Edges(), None, [], 0

    def rows(found: list, edge: bool) -> pa.RecordBatch:
        size = np.array([sum(map(len, r["ids"])) for r in found])
        each = lambda x, kind: pa.array(x, kind).take(pa.array(np.repeat(np.arange(len(found)), size)))
        ids, nulls = (np.concatenate([a for r in found for a in r[k]]) for k in ("ids", "nulls"))
        first = np.zeros(len(ids), dtype=bool)
        first[np.cumsum(size) - size] = True
        keep = [None if r["nulls"][0][0] else int(r["ids"][0][0]) for r in found]
        columns = [pa.array(ids, mask=nulls), each([r["sha"] for r in found], pa.binary()), each(keep, pa.int64()), each([r["code"] for r in found], pa.int32())]
        columns += [each(size, pa.int64()), pa.array(np.full(len(ids), edge)), pa.array(first), pa.array(np.full(len(ids), at, dtype=np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "sha", "run_keep", "run_code", "run_size", "edge", "first", "at"])

    for batch, starts in _starts(batches, "bare"):
        column = batch.column("doc_id")
        nulls, ids = column.is_null().to_numpy(zero_copy_only=False), column.fill_null(0).to_numpy(zero_copy_only=False).copy()
        if run and (not len(starts) or starts[0]):
            end = starts[0] if len(starts) else batch.num_rows
            run["ids"].append(ids[:end])
            run["nulls"].append(nulls[:end])
        for begin, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            for done in edges.add(run["key"], run) if run else ():
                ready.append(done)
                waiting += sum(map(len, done["ids"]))
            key, sha = _key(batch, int(begin), "bare", "hash")
            run = {"key": key, "sha": sha, "ids": [ids[begin:end]], "nulls": [nulls[begin:end]], "code": batch.column("n_code")[int(begin)].as_py()}
            if waiting >= 20_000:
                yield rows(ready, False)
                ready, waiting = [], 0
    if run:
        ready += edges.add(run["key"], run)
    if ready:
        yield rows(ready, False)
    if run:
        yield rows(edges.rest(), True)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space (space and U+0009 to U+000D). Of equal texts the one with the
    most code points stays, then the smallest identifier; of repeated rows with one identifier, one. A null text counts
    as empty; empty texts form one group. A null identifier is the largest. Other columns are not read, whatever their
    names. An empty table gives an empty result.
    """
    bare = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), bare.alias("bare"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_code"), F.xxhash64(bare).alias("hash"))
    runs = materialise(_dealt(rows, F.col("bare"), "bare", "hash", "n_code", "doc_id", "row").mapInArrow(_compare, _RUNS))
    # At most two runs of a range reach these summaries. Rows meet them by range and digest, so a hot group stays dealt out.
    parts = runs.filter("edge and first").select("sha", "at", "run_size", F.struct(-F.col("run_code"), F.col("run_keep").isNull().alias("none"), F.col("run_keep").alias("keep"), F.col("at").alias("from")).alias("best"))
    groups = parts.groupBy("sha").agg(F.min("best").alias("best"), F.sum("run_size").alias("n"))
    placed = parts.select("sha", "at").join(groups, "sha")
    inner = runs.filter("not edge").select("doc_id", F.col("run_keep").alias("keep_id"), F.col("run_size").alias("group_size"), F.col("first").alias("kept"), "sha")
    outer = runs.filter("edge").join(placed, ["sha", "at"]).select("doc_id", F.col("best.keep").alias("keep_id"), F.col("n").alias("group_size"), (F.col("first") & (F.col("at") == F.col("best.from"))).alias("kept"), "sha")
    return inner.unionByName(outer).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def _leaders(content: str, hashed: str, codes: str, added: list[str]):
    """The first row of each run in a sorted range, with its digest, whether its group may go on elsewhere, and the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, edges = TaskContext.get().partitionId(), _Edges()

        def made(batch: pa.RecordBatch, shas: list[bytes], edge: bool) -> pa.RecordBatch:
            extra = [pa.array(shas, pa.binary()), pa.array([edge] * len(shas)), pa.array([at] * len(shas), pa.int32())]
            kept = [n for n in batch.schema.names if n not in (content, hashed)]
            return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *extra], names=[*kept, *added])

        for batch, starts in _starts(batches, content):
            inner, shas = [], []
            for i in starts.tolist():
                key, sha = _key(batch, i, content, hashed)
                for row in edges.add(key, (batch, i, sha)):
                    if row[0] is batch:
                        inner.append(row[1])
                        shas.append(row[2])
                    else:
                        yield made(row[0].take(pa.array([row[1]])), [row[2]], False)
            if inner:
                yield made(batch.take(pa.array(inner)), shas, False)
            for key, held in edges.held.items():  # a waiting row doesn't hold its batch
                edges.held[key] = [(rows.take(pa.array([i])), 0, sha) if rows is batch else (rows, i, sha) for rows, i, sha in held]
        for rows, i, sha in edges.rest():
            yield made(rows.slice(i, 1), [sha], True)

    return run


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every group of equal texts, all columns as they were, whatever their names.

    Which row stays is as for :func:`exact_dedup`: null and empty texts are one group, of repeated rows one stays, a null
    identifier goes last. An empty table gives an empty result. Rows are shuffled once, with all their columns.
    """
    content, hashed, codes, row, sha, edge, at = unused(docs.columns, "bare", "hash", "n_code", "row", "sha", "edge", "at")
    bare = normalised(F.col(text_col))
    rows = docs.withColumn(codes, F.length(F.coalesce(F.col(text_col), F.lit("")))).withColumn(hashed, F.xxhash64(bare))
    schema = docs.withColumn(codes, F.lit(0)).schema.add(sha, "binary").add(edge, "boolean").add(at, "integer")
    found = materialise(_dealt(rows, bare, content, hashed, codes, id_col, row).select(*docs.columns, codes, hashed, content).mapInArrow(_leaders(content, hashed, codes, [sha, edge, at]), schema))
    best = F.min(F.struct((-F.col(codes)).alias("a"), F.col(id_col).isNull().alias("b"), F.col(id_col).alias("c"), F.col(at).alias("d")))["d"]
    winners = found.filter(F.col(edge)).groupBy(sha).agg(best.alias(at))
    crossing = found.filter(F.col(edge)).join(winners, [sha, at], "left_semi")
    return found.filter(~F.col(edge)).select(*docs.columns).unionByName(crossing.select(*docs.columns))


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """All of ``documents``, dropped rows too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents
), g AS (
  SELECT n, arg_min(doc_id, {'a': -length(t), 'b': doc_id}) AS keep_id, count(*) AS group_size FROM d GROUP BY n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM d JOIN g USING (n)
"""
