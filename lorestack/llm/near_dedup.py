"""Near-duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A signature has ``CHUNKS`` x ``CHUNK`` slots of 16 bits, each the minimum of one hash over the document's shingles. Its
distance is the number of slots that differ. By pigeonhole, of two signatures that differ in at most
``CHUNKS * (ERRORS + 1) - 1`` slots one chunk differs in at most ``ERRORS``; the places of the allowed errors are
enumerated by leaving out each set of ``ERRORS`` slots, so such a pair shares a key and cannot be missed. At a similarity
of 0.8 a chunk agrees this far with probability 0.737, so a pair shares no key with probability 0.263^10, 2 in a million.
Every link is confirmed on the full shingle sets.

Documents with one shingle set are one class. Inside a key, all pairs are never made: first each class is compared with
one centre of its keys, then only pairs whose components still differ are left, and of these only pairs whose bit sketches
allow the similarity. A sketch holds the parity of the shingles in each of ``SKETCH`` cells; the bits in which two sketches
differ are at most as many as the shingles in which the sets differ, so no link is lost by that either. A group of near
copies costs in proportion to its size, and no link that could join two components is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorestack.llm.common import discard, materialise, unused
from lorestack.llm.components import connected_components
from lorestack.llm.pieces import Cache, blocks, only

CHUNKS, CHUNK, ERRORS = 10, 5, 1
SLOTS = CHUNKS * CHUNK
SKETCH = 2048
_RNG = np.random.default_rng(20240229)
_MULTIPLY = _RNG.integers(1, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RNG.integers(0, 1 << 63, SLOTS, dtype=np.uint64)
_ORDER = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_WORDS = Cache(xxhash.xxh3_64_intdigest, 40 << 20)


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of ``k`` words; of fewer words, of the whole sequence."""
    words = text.lower().split()  # on bytes: lower-cases A-Z only, and parts at space and U+0009 to U+000D only
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b"\0" + b" ".join(words))], dtype=np.uint64)
    ids = np.array(list(map(_WORDS.__getitem__, words)), dtype=np.uint64)
    n = len(ids) - k + 1
    mixed = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        mixed = (mixed ^ ids[i : i + n]) * _ORDER[i % 4]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def signature(hashes: np.ndarray) -> bytes:
    """The slots of one set, 16 bits each."""
    least = np.full(SLOTS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 1024):
        part = (hashes[at : at + 1024, None] ^ _FLIP) * _MULTIPLY
        np.minimum(least, part.min(axis=0), out=least)
    return (least >> np.uint64(24)).astype("<u2").tobytes()


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of the hashes in each cell, as 64-bit numbers."""
    odd = np.bincount(((hashes >> np.uint64(17)) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def keys_of(signatures: np.ndarray) -> np.ndarray:
    """The keys of signatures (rows of slots): every chunk without each set of ``ERRORS`` slots."""
    out = []
    for chunk in range(CHUNKS):
        slots = signatures[:, chunk * CHUNK : (chunk + 1) * CHUNK].astype(np.uint64)
        for place, kept in enumerate(combinations(range(CHUNK), CHUNK - ERRORS)):
            key = np.full(len(slots), chunk * 64 + place + 1, dtype=np.uint64) * _ORDER[1]
            for i in kept:
                key = (key ^ slots[:, i]) * _ORDER[0]
                key ^= key >> np.uint64(31)
            out.append(key.view(np.int64))
    return np.stack(out, axis=1)


def _words_only() -> None:
    only(_WORDS)


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _words_only()
        for block in blocks(batches, "text", 8 << 20):
            n, keys, signs = [], [], []
            for text in block.column("text").cast(pa.binary()).to_pylist():
                found = shingles(text or b"", k)
                n.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                signs.append(signature(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())], names=["doc_id", "n_shingles", "set_key", "sign"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            if part.num_rows:
                signs = np.frombuffer(b"".join(part.column("sign").to_pylist()), dtype="<u2").reshape(-1, SLOTS)
                found = keys_of(signs)
                ids = np.repeat(part.column("id").to_numpy(zero_copy_only=False), found.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(found.reshape(-1)), pa.array(ids)], names=["key", "id"])


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _words_only()
        for block in blocks(batches, "text", 8 << 20):
            ids, keys, sets, sketches, seen = [], [], [], [], set()
            for i, key, text in zip(block.column("id").to_pylist(), block.column("set_key").to_pylist(), block.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if (i, key) in seen:
                    continue
                found = shingles(text or b"", k)
                if xxhash.xxh3_128_digest(found.tobytes()) == key:
                    seen.add((i, key))
                    ids.append(i)
                    keys.append(key)
                    sets.append(found.tobytes())
                    sketches.append(sketch(found))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(sets, pa.binary()), pa.array([len(x) // 8 for x in sets], pa.int64()), pa.array(sketches, pa.list_(pa.int64()))], names=["id", "set_key", "hashes", "size", "sketch"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = []
            for x, y in zip(batch.column("left_set"), batch.column("right_set"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                short, long = (x, y) if len(x) <= len(y) else (y, x)
                common = 0
                if 100 * len(short) >= percent * len(long):
                    at = np.minimum(np.searchsorted(long, short), len(long) - 1)
                    common = int((long[at] == short).sum())
                right.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(right, pa.bool_()))

    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Either join may be split where an end is common."""
    left = sets.select(F.col("id").alias("a"), F.col("hashes").alias("left_set"))
    right = sets.select(F.col("id").alias("b"), F.col("hashes").alias("right_set"))
    return materialise(pairs.select("a", "b").distinct().join(left, "a").join(right, "b").mapInArrow(_confirm(percent), "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    A set holds the distinct runs of ``shingle_words`` words of the whole text in lower-case A-Z; a text of fewer words is
    one run. Rows are linked when 100 * intersection >= ``percent`` * union. component_id is the smallest identifier
    reachable, the row's own included; kept marks rows whose identifier that is. Null, empty and blank texts have 0
    shingles and no link. Equal sets are linked whatever their number; rows with a null identifier come back unlinked with
    a null component. Repeated rows are equal sets. Other columns are not read. An empty table gives an empty result.
    """
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = materialise(text.mapInArrow(_sign(shingle_words), "doc_id long, n_shingles long, set_key binary, sign binary"))
    known = signed.filter("set_key is not null and doc_id is not null")
    classes = known.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("sign").alias("sign"), F.count("*").alias("n"))
    classes = materialise(classes)
    every = classes.select("sign", "id").mapInArrow(_keys, "key long, id long")
    # Keys of two classes or more. Near copies share most of their keys: of keys with the same members, by sums of hashes
    # of their identifiers, one is kept.
    sums = [F.sum(F.xxhash64("id", F.lit(i)).bitwiseAND(F.lit(0x7FFFFFFF))).alias(f"h{i}") for i in range(2)]
    shared = every.groupBy("key").agg(F.min("id").alias("centre"), F.max("id").alias("last"), F.count("*").alias("n"), *sums).filter("centre <> last")
    kept = shared.groupBy("centre", "last", "n", "h0", "h1").agg(F.min("key").alias("key")).select("key", "centre")
    members = materialise(every.join(kept, "key").select("key", "id", "centre"))
    involved = members.select("id").distinct().join(classes.select("id", "set_key"), "id")
    wanted = text.join(involved, text.doc_id == involved.id).select("id", "set_key", "text")
    built = materialise(wanted.mapInArrow(_sets(shingle_words), "id long, set_key binary, hashes binary, size long, sketch array<long>"))
    twice = built.groupBy("id", "set_key").count().filter("count > 1").select("id", "set_key")  # repeated rows: one set each
    sets = built.join(twice, ["id", "set_key"], "left_anti").unionByName(built.join(twice, ["id", "set_key"], "left_semi").dropDuplicates(["id", "set_key"])).drop("set_key")

    links = _links(members.filter("id <> centre").groupBy("id").agg(F.min("centre").alias("centre")).select(F.col("centre").alias("a"), F.col("id").alias("b")), sets, percent)
    first = materialise(connected_components(links))
    placed = members.select("key", "id").join(first, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    by_part = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = by_part.groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.count("*").alias("parts")).filter("parts > 1").select("key", "main")
    apart = materialise(placed.join(mixed, "key").join(sets.select("id", "size", "sketch"), "id"))
    # In each key, those outside its largest component meet the others of another component.
    one = apart.filter("component <> main").select("key", F.col("id").alias("a"), F.col("component").alias("of_a"), F.col("size").alias("size_a"), F.col("sketch").alias("sketch_a"))
    other = apart.select("key", "main", F.col("id").alias("b"), F.col("component").alias("of_b"), F.col("size").alias("size_b"), F.col("sketch").alias("sketch_b"))
    differ = sum((F.bit_count(F.col("sketch_a")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(SKETCH // 64)), F.lit(0))
    both = F.col("size_a") + F.col("size_b")  # linked sets differ in at most (100 - p) / (100 + p) of their sizes' sum
    near = (F.col("of_a") != F.col("of_b")) & ((F.col("of_b") == F.col("main")) | (F.col("a") < F.col("b"))) & (differ * (100 + percent) <= both * (100 - percent))
    pairs = one.join(other, (one.key == other.key) & near).select("a", "b")
    links = links.unionByName(_links(pairs, sets, percent))
    discard(members, built, first, apart)
    component = connected_components(links)

    # Only classes of several rows, or that are linked, differ from what a row says of itself.
    moved = classes.join(component, "id", "left").select("set_key", F.coalesce("component", "id").alias("component"), "id", "n").filter("n > 1 or component <> id").select("set_key", "component")
    own = F.coalesce(F.col("component"), F.col("doc_id"))
    return (
        signed.join(moved, "set_key", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), own))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows of a component whose identifier isn't the component's; all columns as they were.

    Null, empty and blank texts and rows with a null identifier are linked with nothing and stay; repeated rows of the
    identifier that stays all stay. Columns may have any names. An empty table gives an empty result.
    """
    (gone,) = unused(docs.columns, "gone")
    dropped = near_duplicates(docs, id_col, text_col, **options).filter("doc_id is not null and not kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(dropped, F.col(id_col) == F.col(gone), "left_anti")


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    """All of ``documents``, by shingles of four words."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle_words=4)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w
), n AS (
  SELECT doc_id, len(sh) AS n_shingles FROM s
), e AS (
  SELECT doc_id, unnest(sh) AS g FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n_shingles + y.n_shingles - c)
), u AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(doc_id, reach) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.reach
), c AS (
  SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id
)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""
