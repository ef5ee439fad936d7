"""Retrieval: exact nearest chunks inside a namespace, pooled cutoffs, slots, neighbours and labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from lorestack.session import materialise

POSITION = ["namespace", "doc_id", "chunk_index"]
#: Chunks of small namespaces that are dealt to one task together.
_SHARED = 8192


def knn_search(chunks: DataFrame, questions: DataFrame, k: Column | int = 4, carry: list[str] = [], tile: int = 32768, block: int = 65536, tables: int = 0, width: float | None = None) -> DataFrame:
    """The ``k`` nearest chunks of each (question_id, namespace) by squared L2 distance, ties by position.

    The vectors of a namespace are dealt to tiles of about ``tile`` chunks and ``block`` questions; in each a matrix product
    finds what may be among the nearest, and only that is measured exactly. Small namespaces share a tile. Chunks are copied
    once a block of questions and questions once a tile, so large ones keep the shuffle low: with the defaults a task holds
    about 50 MB of vectors of 64 numbers, and all pairs are compared however they are cut. A window ranks
    what the tiles hand on, k rows a question, and ``carry`` joins the chunks' other columns to the nearest alone, by
    position, which is the key of a chunk. ``k`` may be a column of the questions. Vectors that are null or of another size
    have no score: distance NaN, after all others.

    ``tables`` above 0 is the approximate mode: only chunks that share one of so many buckets of random projections with the
    question are compared, see :func:`near_buckets`.
    """
    own = ["question_id", "namespace", "vector", *(["k"] if "k" in questions.columns else [])]
    stored, asked = chunks.select(*POSITION, "vector"), questions.select(*own)
    if tables:
        stored, asked = near_buckets(stored, asked, tables, width)
    if "k" not in questions.columns:
        asked = asked.withColumn("k", k if isinstance(k, Column) else F.lit(k))
    near = _tiled(stored, asked.withColumn("k", F.col("k").cast("int")), tile, block)
    if tables:
        near = near.dropDuplicates(["question_id", *POSITION])
    w = Window.partitionBy("question_id", "namespace").orderBy("distance", "doc_id", "chunk_index")
    ranked = near.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= F.col("k")).drop("k")
    return ranked.join(chunks.select(*POSITION, *carry), POSITION).select("question_id", *POSITION, "distance", *carry, "place") if carry else ranked


def _tiled(stored: DataFrame, asked: DataFrame, tile: int, block: int) -> DataFrame:
    """(question_id, namespace, doc_id, chunk_index, distance, k): the k nearest of each question in each tile.

    Only namespaces of over a tile or a block are listed, so the broadcast list has a row for every ``tile`` chunks or
    ``block`` questions at most.
    """
    part = [F.col("namespace"), *([F.col("_bucket")] if "_bucket" in stored.columns else [])]
    names = ["namespace", *(["_bucket"] if "_bucket" in stored.columns else [])]
    sizes = materialise(stored.groupBy(*names).agg(F.count("*").alias("_n")).join(asked.groupBy(*names).agg(F.count("*").alias("_q")), names))
    small = max(1, -(-(sizes.filter(F.col("_n") <= tile).agg(F.sum("_n").alias("n")).first().n or 0) // _SHARED))
    large = sizes.filter((F.col("_n") > tile) | (F.col("_q") > block)).select(*names, F.ceil(F.col("_n") / tile).alias("_tiles"), F.ceil(F.col("_q") / block).alias("_blocks"))
    one = F.lit(1).cast("long")
    count = lambda c: F.coalesce(F.col(c), one)
    cell = F.when(F.col("_tiles").isNull(), F.pmod(F.xxhash64(*part), F.lit(small))).otherwise(F.xxhash64(*part)).alias("_cell")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), count(n) - 1))
    left = stored.join(F.broadcast(large), names, "left").withColumn("_tile", F.pmod(F.xxhash64("doc_id", "chunk_index"), count("_tiles"))).withColumn("_block", every("_blocks"))
    right = asked.join(F.broadcast(large), names, "left").withColumn("_block", F.pmod(F.xxhash64("question_id"), count("_blocks"))).withColumn("_tile", every("_tiles"))
    vector = F.col("vector").cast("array<double>").alias("vector")
    left = left.select(cell, "_tile", "_block", F.concat_ws("\0", *part).alias("_space"), *POSITION, vector)
    right = right.select(cell, "_tile", "_block", F.concat_ws("\0", *part).alias("_space"), "question_id", vector, "k")
    kinds = [next(f for f in df.schema if f.name == c) for df, c in ((right, "question_id"), (left, "namespace"), (left, "doc_id"), (left, "chunk_index"))]
    schema = StructType([*(StructField(f.name, f.dataType) for f in kinds), StructField("distance", DoubleType()), StructField("k", IntegerType())])
    keys = ["_cell", "_tile", "_block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_nearest, schema)


def _matrix(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors by their size: the rows that have it and the matrix. Size -1: null vectors, and those with a null."""
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
    sizes = pc.fill_null(pc.list_value_length(flat), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    values = flat.flatten()
    numbers, starts = values.to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    if values.null_count:
        rows = np.repeat(np.arange(len(sizes)), np.maximum(sizes, 0))
        sizes[rows[values.is_null().to_numpy(zero_copy_only=False)]] = -1
    out = {}
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        out[int(n)] = rows, numbers[starts[rows, None] + np.arange(max(n, 0))]
    return out


def _exactly(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows, summed from the first component to the last."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += (x[:, j] - y[:, j]) ** 2
    return total


def _nearest(stored: pa.Table, asked: pa.Table) -> pa.Table:
    """The nearest chunks of the questions of one tile, each in its namespace."""
    names = ["question_id", "namespace", "doc_id", "chunk_index", "distance", "k"]
    q_at, c_at, far = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)], [np.empty(0)]
    spaces = {s: i for i, s in enumerate(pc.unique(asked["_space"]).to_pylist())}
    of = lambda t: np.array([spaces.get(s, -1) for s in t["_space"].to_pylist()], dtype=np.int64)
    of_chunk, of_question, ks = of(stored), of(asked), asked["k"].to_numpy()
    position = np.lexsort((stored["chunk_index"].to_numpy(), stored["doc_id"].to_numpy(), of_chunk))
    asking_in = np.argsort(of_question, kind="stable")
    ids = np.arange(len(spaces))
    own = [(at, np.searchsorted(of[at], ids, "left"), np.searchsorted(of[at], ids, "right")) for at, of in ((position, of_chunk), (asking_in, of_question))]
    for s in spaces.values():
        rows, mine = (at[start[s] : end[s]] for at, start, end in own)  # in order of position
        if not len(rows):
            continue
        by_size = _matrix(stored["vector"].take(pa.array(rows)))
        for size, (some, asking) in _matrix(asked["vector"].take(pa.array(mine))).items():
            same, matrix = by_size.get(size, (np.empty(0, dtype=np.int64), None)) if size >= 0 else (np.empty(0, dtype=np.int64), None)
            other = rows[np.setdiff1d(np.arange(len(rows)), same)]
            for at in range(0, len(some), 256):
                part, vectors = mine[some[at : at + 256]], asking[at : at + 256]
                most = int(ks[part].max())
                if len(same):
                    x, y = _candidates(vectors, matrix, most)
                    d = _exactly(vectors[x], matrix[y])
                    order = np.lexsort((y, d, x))
                    x, y, d = x[order], y[order], d[order]
                    rank = np.arange(len(x)) - np.searchsorted(x, x, "left")
                    kept = rank < ks[part[x]]
                    q_at.append(part[x[kept]])
                    c_at.append(rows[same[y[kept]]])
                    far.append(d[kept])
                if len(other):  # no score
                    q_at.append(np.repeat(part, min(most, len(other))))
                    c_at.append(np.tile(other[:most], len(part)))
                    far.append(np.full(len(q_at[-1]), np.nan))
    q, c = (pa.array(np.concatenate(v)) for v in (q_at, c_at))
    chosen = stored.take(c)
    columns = [asked["question_id"].take(q), chosen["namespace"], chosen["doc_id"], chosen["chunk_index"], pa.array(np.concatenate(far)), asked["k"].take(q)]
    return pa.table(columns, names=names)


def _candidates(asking: np.ndarray, stored: np.ndarray, k: int, group: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that hold the k nearest of each row of ``asking`` for certain, those of equal distance with them.

    Distances are rough, in single precision where the lengths allow it, with twice what rounding can shift them as slack.
    The k-th of the least of each group of rows is no nearer than the k-th nearest, so what is within it holds them all.
    """
    if len(stored) <= k or not (np.isfinite(asking).all() and np.isfinite(stored).all()):
        return np.repeat(np.arange(len(asking)), len(stored)), np.tile(np.arange(len(stored)), len(asking))
    a, b = (asking**2).sum(axis=1), (stored**2).sum(axis=1)
    n = stored.shape[1]
    single = max(a.max(), b.max()) < 1e30 and b.max() > 1e-20
    kind, unit = (np.float32, 2.0**-24) if single else (np.float64, 2.0**-53)
    rough = (-2 * asking).astype(kind) @ stored.astype(kind).T
    rough += b.astype(kind)[None, :]  # the question's own length is the same for all
    slack = (a + b.max()) * unit * 4 * (n + 8)  # more than rounding can shift a distance
    whole = len(stored) // group * group
    if whole // group >= k:
        least = rough[:, :whole].reshape(len(asking), group, -1).min(axis=1)
    else:
        least = rough
    limit = np.partition(least, k - 1, axis=1)[:, k - 1].astype(np.float64) + 2 * slack
    edge = limit.astype(kind)
    edge = np.where(edge < limit, np.nextafter(edge, kind(np.inf)), edge)
    return np.divmod(np.flatnonzero(rough <= edge[:, None]), len(stored))


def near_buckets(stored: DataFrame, asked: DataFrame, tables: int, width: float | None = None, together: int = 3, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """Chunks and questions with the buckets in which they meet, ``tables`` each: vectors are in one bucket when ``together``
    random projections of them fall into the same intervals of ``width``. Without a width it is the mean length of the
    vectors over the root of their size, which is how far projections of such vectors spread. Only vectors of the
    commonest size without nulls and NaN take part."""
    size = stored.filter("vector is not null").groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    n = size.n if size else 0
    if not n:
        return tuple(df.filter("false").withColumn("_bucket", F.lit("")) for df in (stored, asked))
    whole = lambda df: df.filter((F.size("vector") == n) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x.cast("double")))).withColumn("_v", array_to_vector(F.col("vector").cast("array<double>")))
    left, right = whole(stored), whole(asked)
    if width is None:
        norm = F.sqrt(F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda t, x: t + x * x))
        width = float(left.agg(F.avg(norm)).first()[0] or 1.0) / n**0.5 or 1.0
    model = BucketedRandomProjectionLSH(inputCol="_v", outputCol="_hashes", bucketLength=width, numHashTables=tables * together, seed=seed).fit(left)

    def hashed(df: DataFrame) -> DataFrame:
        each = [vector_to_array(F.col("_hashes")[i])[0].cast("long").cast("string") for i in range(tables * together)]
        names = [F.concat_ws(":", F.lit(str(t)), *each[t * together : (t + 1) * together]) for t in range(tables)]
        return model.transform(df).withColumn("_bucket", F.explode(F.array(*names))).drop("_v", "_hashes")

    return hashed(left), hashed(right)


def layers(questions: DataFrame, per_namespace: int = 4, memory_candidates: int = 8) -> DataFrame:
    """(question_id, namespace, k, vector): the chat's own, the global and the memory namespace, as switched on."""
    chat = F.col("chat_id").cast("string")
    wanted = F.array(
        F.struct(F.concat(F.lit("chat:"), chat).alias("namespace"), F.lit(per_namespace).alias("k"), F.lit(True).alias("on")),
        F.struct(F.lit("global").alias("namespace"), F.lit(per_namespace).alias("k"), F.col("use_global").alias("on")),
        F.struct(F.concat(F.lit("memory:"), chat).alias("namespace"), F.lit(memory_candidates).alias("k"), F.col("use_memory").alias("on")),
    )
    each = questions.select("question_id", "vector", F.explode(F.filter(wanted, lambda x: x["on"])).alias("layer"))
    return each.select("question_id", "layer.namespace", "layer.k", "vector")


def is_memory(namespace: Column) -> Column:
    return namespace.startswith("memory:")


def pool_cutoff(hits: DataFrame, factor: float = 3.0, least: float = 0.1) -> DataFrame:
    """Adds best (smallest distance of the question that is a number) and cutoff."""
    best = F.min(F.nanvl("distance", F.lit(None).cast("double"))).over(Window.partitionBy("question_id"))
    return hits.withColumn("best", best).withColumn("cutoff", F.greatest(F.col("best") * factor, F.lit(least)))


def rank_pool(hits: DataFrame, top: int | None = None, factor: float = 3.0, least: float = 0.1) -> DataFrame:
    """One pool over all namespaces of a question: within the cutoff or without a score, nearest first."""
    kept = pool_cutoff(hits, factor, least).filter(F.isnan("distance") | (F.col("distance") <= F.col("cutoff")))
    ranked = kept.withColumn("pool_rank", F.row_number().over(Window.partitionBy("question_id").orderBy("distance", *POSITION)))
    return ranked if top is None else ranked.filter(F.col("pool_rank") <= top)


def layer_slots(ranked: DataFrame, slots: int = 4) -> DataFrame:
    """Documents get ``slots`` places, one less where a memory hit survived; memory hits all stay."""
    memory = is_memory(F.col("namespace"))
    any_memory = F.max(memory).over(Window.partitionBy("question_id"))
    place = F.row_number().over(Window.partitionBy("question_id", memory).orderBy("pool_rank"))
    return ranked.withColumn("_any", any_memory).withColumn("_place", place).filter(memory | (F.col("_place") <= F.when(F.col("_any"), slots - 1).otherwise(slots))).drop("_any", "_place")


def best_per_layer(hits: DataFrame) -> DataFrame:
    """(question_id, best_memory, best_documents, memory_nearer): a missing layer is never the nearer one."""
    number = F.nanvl("distance", F.lit(None).cast("double"))
    memory = is_memory(F.col("namespace"))
    best = hits.groupBy("question_id").agg(F.min(F.when(memory, number)).alias("best_memory"), F.min(F.when(~memory, number)).alias("best_documents"))
    nearer = F.col("best_memory").isNotNull() & (F.col("best_documents").isNull() | (F.col("best_memory") < F.col("best_documents")))
    return best.withColumn("memory_nearer", nearer)


def expand_neighbours(hits: DataFrame, chunks: DataFrame, text: str = "text") -> DataFrame:
    """Each hit's text with that of the next chunk of its document, unless that one is a hit of the question too."""
    chosen = hits.select("question_id", *POSITION)
    following = hits.select("question_id", "namespace", "doc_id", (F.col("chunk_index") + 1).alias("chunk_index"))
    free = following.join(chosen, ["question_id", *POSITION], "left_anti").join(chunks.select(*POSITION, F.col(text).alias("_next")), POSITION)
    back = free.select("question_id", "namespace", "doc_id", (F.col("chunk_index") - 1).alias("chunk_index"), "_next")
    return hits.join(back, ["question_id", *POSITION], "left").withColumn("expanded", F.concat_ws("\n", F.col(text), F.col("_next"))).drop("_next")


def resolve_sources(hits: DataFrame, documents: DataFrame, attachments: DataFrame, unknown: str = "documento") -> DataFrame:
    """Adds label: the file name from the documents for the global namespace, else from the attachments."""
    named = hits.join(documents.select("doc_id", F.col("filename").alias("_doc")), "doc_id", "left").join(attachments.select("doc_id", F.col("filename").alias("_file")), "doc_id", "left")
    return named.withColumn("label", F.coalesce(F.when(F.col("namespace") == "global", F.col("_doc")).otherwise(F.col("_file")), F.lit(unknown))).drop("_doc", "_file")


def recall_not_in_prompt(recalled: DataFrame, history: DataFrame, top: int = 1) -> DataFrame:
    """Recalled turns whose answer isn't in the question's history already; the cap comes after that."""
    new = recalled.join(history.select("question_id", "answer_id").distinct(), ["question_id", "answer_id"], "left_anti")
    w = Window.partitionBy("question_id").orderBy("distance", "answer_id")
    return new.withColumn("recall_rank", F.row_number().over(w)).filter(F.col("recall_rank") <= top)


def retrieval_quality(hits: DataFrame, planted: DataFrame) -> DataFrame:
    """(question_id, relevant, best, planted_rank, found): how near the best chunk is, and where the planted one came."""
    best = hits.groupBy("question_id").agg(F.min("distance").alias("best"))
    w = Window.partitionBy("question_id").orderBy("distance", *POSITION)
    where = hits.withColumn("_rank", F.row_number().over(w)).join(planted, ["question_id", *POSITION], "left_semi").groupBy("question_id").agg(F.min("_rank").alias("planted_rank"))
    return best.join(where, "question_id", "left").withColumn("found", F.coalesce(F.col("planted_rank") <= 8, F.lit(False)))


def retrieval_report(hits: DataFrame, relevant: DataFrame, factor: float = 3.0, least: float = 0.1) -> DataFrame:
    """How well the nearest tell what belongs to a question from what doesn't: (question_id, best_relevant, worst_relevant,
    best_irrelevant, separation, kept, kept_irrelevant).

    ``relevant`` lists (question_id, namespace, doc_id, chunk_index). separation is best_irrelevant - worst_relevant: above 0
    where a floor could part them; null where either is missing. kept counts the hits within the pool's cutoff, which is
    relative to the best hit, so kept_irrelevant shows what a bad best lets through. Hits without a score count as
    irrelevant by their place only, not by distance.
    """
    marked = pool_cutoff(hits, factor, least).join(relevant.select("question_id", *POSITION).distinct().withColumn("_right", F.lit(True)), ["question_id", *POSITION], "left")
    right, number = F.coalesce("_right", F.lit(False)), F.nanvl("distance", F.lit(None).cast("double"))
    stays = F.isnan("distance") | (F.col("distance") <= F.col("cutoff"))
    each = marked.groupBy("question_id").agg(
        F.min(F.when(right, number)).alias("best_relevant"),
        F.max(F.when(right, number)).alias("worst_relevant"),
        F.min(F.when(~right, number)).alias("best_irrelevant"),
        F.count(F.when(stays, 1)).alias("kept"),
        F.count(F.when(stays & ~right, 1)).alias("kept_irrelevant"),
    )
    return each.withColumn("separation", F.col("best_irrelevant") - F.col("worst_relevant"))
