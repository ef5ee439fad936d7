"""Phrase collocations from suffix trees by vertical partitioning.

Texts are cut into words once and written as blocks of numbers, each with its own dictionary. A suffix is a word and the one
or two after it in its piece. Suffixes are grouped by their first words so that no group outgrows a memory budget: words fall
into buckets whose occurrences are counted over everything; buckets are packed into groups up to the budget; a bucket above
it is parted by the first two words, counted again, and what is still above it by all three. Each group's subtree, truncated
at three words, is built by itself: its sorted suffixes are the leaves in order, and a phrase's count is the total of the
leaves under its node. Only the nodes of buckets parted by three words are summed over groups.

Words are known by 64-bit hashes of language and word. The dictionary of all words is held against them; where two share a
hash all is hashed anew, so counts are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorestack.llm.common import discard, materialise, table
from lorestack.llm.pieces import blocks

BUCKETS = 1 << 16
BLOCK_BYTES = 6 << 20
_PLAIN = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ENCODED = "lang string, ids binary, n_ids long, words array<binary>, counts array<long>"


class _Numbers(dict):
    """Words to numbers in order of arrival; 0 parts pieces."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def encode(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The words of texts as numbers from 1, pieces parted by 0, and the words in the order of their numbers."""
    numbers = _Numbers({b"\n": 0, b"": 1})
    whole = b"\n".join(texts).lower().translate(_PLAIN)
    found = whole.replace(b"\n", b" \n ").split(b" ")
    ids = np.fromiter(map(numbers.__getitem__, found), dtype=np.uint32, count=len(found))
    ids = ids[ids != 1]
    return np.where(ids > 0, ids - 1, 0).astype(np.uint32), list(numbers)[2:]


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(of: dict[str, list[bytes]]) -> pa.RecordBatch:
        rows = []
        for lang, texts in of.items():
            ids, words = encode(texts)
            rows.append((lang, pa.compress(ids.tobytes(), "zstd", asbytes=True), len(ids), words, np.bincount(ids, minlength=len(words) + 1)[1:]))
        kinds = [pa.string(), pa.binary(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["lang", "ids", "n_ids", "words", "counts"])

    waiting: dict[str, list[bytes]] = {}
    size = 0
    for block in blocks(batches, "text", BLOCK_BYTES):
        for lang, text in zip(block.column("lang").to_pylist(), block.column("text").cast(pa.binary()).to_pylist(), strict=True):
            waiting.setdefault(lang, []).append(text)
            size += len(text)
        if size >= BLOCK_BYTES:
            yield made(waiting)
            waiting, size = {}, 0
    if waiting:
        yield made(waiting)


def _suffixes(batch: pa.RecordBatch, i: int, attempt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's hashes (0 first, for none), and its distinct suffixes: their three numbers and how often each occurs."""
    seed = xxhash.xxh64_intdigest((batch.column("lang")[i].as_py() + "\0" * attempt).encode(), 42)
    words = batch.column("words")[i].as_py()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words))
    hashes = np.concatenate([np.zeros(1, dtype=np.uint64), hashes])
    n = batch.column("n_ids")[i].as_py()
    ids = np.zeros(n + 2, dtype=np.uint64)
    ids[:n] = np.frombuffer(pa.decompress(batch.column("ids")[i].as_py(), 4 * n, "zstd"), dtype=np.uint32)
    one, two, three = ids[:-2], ids[1:-1], ids[2:]
    three = np.where(two > 0, three, np.uint64(0))
    there = one > 0
    places, counts = _counted([one[there], two[there], three[there]], len(hashes), np.ones(int(there.sum()), dtype=np.int64))
    return hashes, *places, counts


def _counted(columns: list[np.ndarray], vocabulary: int, counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of three columns of numbers below ``vocabulary``, sorted, with their counts summed."""
    if vocabulary <= 1 << 21:
        key = (columns[0] << np.uint64(42)) | (columns[1] << np.uint64(21)) | columns[2]
        order = np.argsort(key, kind="stable") if len(key) else np.empty(0, dtype=np.int64)
        columns = [c[order] for c in columns]
    else:
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
    if not len(order):
        return columns, counts
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    at = np.flatnonzero(fresh)
    return [c[at] for c in columns], np.add.reduceat(counts[order], at)


def _mixed(*hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(hashes[0]), dtype=np.uint64)
    for h in hashes:
        out = (out ^ h) * _ODD
        out ^= out >> np.uint64(31)
    return out


def _bucket(*hashes: np.ndarray) -> np.ndarray:
    return (_mixed(*hashes) & np.uint64(BUCKETS - 1)).astype(np.int64)


class Groups:
    """Which group a suffix belongs to. ``first`` and ``second`` give the group of each bucket of one and of two words, -1
    where it is parted by one word more; suffixes parted by all words follow from group ``deep`` on, ``spread`` groups."""

    def __init__(self, one: np.ndarray, two: np.ndarray | None, budget: int):
        self.first, n = self._packed(one, budget, 0)
        self.second, n = self._packed(two, budget, n) if two is not None else (np.empty(0, dtype=np.int64), n)
        self.deep, self.spread = n, max(1, -(-int(two[two > budget].sum()) // budget)) if two is not None else 1

    @staticmethod
    def _packed(counts: np.ndarray, budget: int, start: int) -> tuple[np.ndarray, int]:
        """Buckets in turn into groups, each closed as it reaches the budget, so below twice that."""
        light = np.where(counts > budget, 0, counts)
        group = start + (np.cumsum(light) - light) // budget
        return np.where(counts > budget, -1, group), int(group[-1]) + 1

    def of(self, h1: np.ndarray, h2: np.ndarray, h3: np.ndarray) -> np.ndarray:
        group = self.first[_bucket(h1)]
        more = np.flatnonzero(group < 0)
        if len(more):
            group[more] = self.second[_bucket(h1[more], h2[more])]
            more = more[group[more] < 0]
            group[more] = self.deep + (_mixed(h1[more], h2[more], h3[more]) % np.uint64(self.spread)).astype(np.int64)
        return group


def _second_counts(heavy: np.ndarray, attempt: int):
    """Occurrences in each bucket of two words, of suffixes whose first word's bucket is ``heavy``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                hashes, one, two, _, counts = _suffixes(batch, i, attempt)
                h1, h2 = hashes[one], hashes[two]
                mine = heavy[_bucket(h1)]
                total += np.bincount(_bucket(h1[mine], h2[mine]), weights=counts[mine], minlength=BUCKETS).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return run


def _deal(groups: Groups, attempt: int):
    """Each block's suffixes by group: hashes once, then three places among them and a count for each suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                hashes, one, two, three, counts = _suffixes(batch, i, attempt)
                group = groups.of(hashes[one], hashes[two], hashes[three])
                order = np.argsort(group, kind="stable")
                names, starts = np.unique(group[order], return_index=True)
                parts = []
                for rows in np.split(order, starts[1:]) if len(order) else ():
                    used, places = np.unique(np.concatenate([one[rows], two[rows], three[rows]]), return_inverse=True)
                    own = hashes[used]
                    parts.append(pa.compress(b"".join([np.array([len(own), len(rows)], dtype=np.uint64).tobytes(), own.tobytes(), places.astype(np.uint32).tobytes(), counts[rows].astype(np.uint64).tobytes()]), "zstd", asbytes=True))
                yield pa.RecordBatch.from_arrays([pa.array(names[: len(parts)], pa.int64()), pa.array(parts, pa.binary())], names=["grp", "part"])

    return run


def subtree(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], least: int, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of two and three words of a group's subtree with at least ``least`` occurrences: hashes (0: none) and count.

    Where the group holds but a share of a two-word node (``whole`` is false) all of these come back, to be summed.
    """
    hashes, index = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    starts = np.cumsum([0, *(len(p[0]) for p in parts)])
    places = np.concatenate([index[s + p[1]] for s, p in zip(starts, parts, strict=False)], axis=1).astype(np.uint64)
    leaves, counts = _counted(list(places), len(hashes), np.concatenate([p[2] for p in parts]))
    one, two, three = leaves
    none = np.searchsorted(hashes, 0) if len(hashes) and hashes[0] == 0 else len(hashes)
    often = (counts >= least) & (three != none)
    fresh = np.ones(len(one), dtype=bool)
    fresh[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    at = np.flatnonzero(fresh)
    totals = np.add.reduceat(counts, at) if len(at) else counts
    kept = (two[at] != none) & ((totals >= least) | (not whole))
    pairs = at[kept]
    first, second = np.concatenate([one[pairs], one[often]]), np.concatenate([two[pairs], two[often]])
    third = np.concatenate([np.zeros(len(pairs), dtype=np.uint64), hashes[three[often]]])
    return hashes[first], hashes[second], third, np.concatenate([totals[kept], counts[often]])


def _build(deep: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            columns = subtree(parts, least, group < deep)
            return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=["h1", "h2", "h3", "a"])

        group, parts = None, []
        for batch in batches:
            for g, part in zip(batch.column("grp").to_pylist(), batch.column("part"), strict=True):
                if g != group and parts:
                    yield made()
                    parts = []
                group = g
                parts.append(_unpacked(part.as_py()))
        if parts:
            yield made()

    return run


def _unpacked(part: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = pa.input_stream(pa.BufferReader(part), compression="zstd").read()
    n, m = np.frombuffer(raw, dtype=np.uint64, count=2).astype(int)
    hashes = np.frombuffer(raw, dtype=np.uint64, count=n, offset=16)
    places = np.frombuffer(raw, dtype=np.uint32, count=3 * m, offset=16 + 8 * n).reshape(3, m)
    return hashes, places, np.frombuffer(raw, dtype=np.int64, count=m, offset=16 + 8 * n + 12 * m)


def _dictionary(encoded: DataFrame) -> tuple[DataFrame, int]:
    """(lang, word, h, f) of all words, and the attempt at which no two hashes are equal, nor any 0."""
    each = encoded.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").alias("word"), F.col("w.counts").alias("f"))
    counted = materialise(each.groupBy("lang", "word").agg(F.sum("f").alias("f")))
    attempt = 0
    while True:
        hashed = counted.withColumn("h", F.xxhash64(F.concat("lang", F.lit("\0" * attempt)), "word"))
        if not hashed.groupBy("h").count().filter("count > 1 or h = 0").head(1):
            return hashed, attempt
        attempt += 1


def phrase_counts(docs: DataFrame, least: int = 10, budget: int = 1 << 20, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All words (lang, word, h, f), and the phrases of two and three words with at least ``least`` occurrences within
    pieces: (h1, h2, h3, a), h3 0 for two words. ``budget`` bounds the suffixes of a group (twice that, at most)."""
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    encoded = materialise(rows.mapInArrow(_encode, _ENCODED))
    words, attempt = _dictionary(encoded)

    def filled(rows: list) -> np.ndarray:
        out = np.zeros(BUCKETS, dtype=np.int64)
        for bucket, n in rows:
            out[bucket] = n
        return out

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            h, f = (batch.column(c).to_numpy() for c in ("h", "f"))
            np.add.at(total, _bucket(h.view(np.uint64)), f)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    summed = lambda df: filled(df.groupBy("bucket").agg(F.sum("n").alias("n")).collect())  # noqa: E731  BUCKETS rows at most
    one = summed(words.select("h", "f").mapInArrow(first, "bucket long, n long"))
    two = summed(encoded.mapInArrow(_second_counts(one > budget, attempt), "bucket long, n long")) if (one > budget).any() else None
    groups = Groups(one, two, budget)
    dealt = encoded.mapInArrow(_deal(groups, attempt), "grp long, part binary").repartition("grp").sortWithinPartitions("grp")
    nodes = materialise(dealt.mapInArrow(_build(groups.deep, least), "h1 long, h2 long, h3 long, a long"))
    pairs = nodes.filter("h3 = 0").groupBy("h1", "h2", "h3").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)
    discard(encoded)
    return words, nodes.filter("h3 <> 0").unionByName(pairs)


def _score(l: str, r: str) -> Column:
    d = lambda c: f"cast({c} as decimal(16, 0))"
    return F.expr(f"cast(({d('a')} * {d('a')} * cast(1000000 as decimal(7, 0))) div ({d(l)} * {d(r)}) as long)")


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, budget: int = 1 << 20, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Words are runs without space and tab in the text in lower-case A-Z, within pieces parted by ``.,;:!?`` and U+000A to
    U+000D. Phrases of two and three words with at least ``least`` occurrences are scored by their weakest cut, floor of
    1,000,000 a * a / (l * r), the first of equal ones; a pair that stands in a triple of at least half its count is left
    out. Order: score, a (both descending), phrase in byte order. A null language is ``und``; null and empty texts have no
    words; repeated rows count again; other columns are not read. An empty table gives an empty result. Exact up to 10^16
    occurrences.
    """
    words, phrases = phrase_counts(docs, least, budget, lang_col, text_col)
    phrases = materialise(phrases)
    single = words.filter(F.col("f") >= least).select("h", "f")
    pairs, triples = phrases.filter("h3 = 0").select("h1", "h2", "a"), phrases.filter("h3 <> 0")
    held = triples.select("h1", "h2", "a").unionByName(triples.select(F.col("h2").alias("h1"), F.col("h3").alias("h2"), "a")).groupBy("h1", "h2").agg(F.max("a").alias("most"))
    f = lambda h, name: single.select(F.col("h").alias(h), F.col("f").alias(name))
    p = lambda h1, h2, name: pairs.select(F.col("h1").alias(h1), F.col("h2").alias(h2), F.col("a").alias(name))
    free = pairs.join(held, ["h1", "h2"], "left").filter("most is null or 100 * most < 50 * a")
    of_two = free.join(f("h1", "l"), "h1").join(f("h2", "r"), "h2").select("h1", "h2", F.lit(0).cast("long").alias("h3"), "a", "l", "r", _score("l", "r").alias("score"))
    cut = triples.join(f("h1", "l1"), "h1").join(f("h3", "r2"), "h3").join(p("h2", "h3", "r1"), ["h2", "h3"]).join(p("h1", "h2", "l2"), ["h1", "h2"])
    cut = cut.withColumn("s1", _score("l1", "r1")).withColumn("s2", _score("l2", "r2"))
    either = lambda x, y: F.when(F.col("s1") <= F.col("s2"), F.col(x)).otherwise(F.col(y))
    of_three = cut.select("h1", "h2", "h3", "a", either("l1", "l2").alias("l"), either("r1", "r2").alias("r"), F.least("s1", "s2").alias("score"))
    scored = of_two.unionByName(of_three).join(words.select(F.col("h").alias("h1"), "lang", F.col("word").alias("w1")), "h1")
    # Ties at the end of a language's list stay until the phrases are spelled.
    near = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    left = scored.withColumn("place", F.rank().over(near)).filter(F.col("place") <= top).drop("place")
    spelled = left.join(words.select(F.col("h").alias("h2"), F.col("word").alias("w2")), "h2").join(words.select(F.col("h").alias("h3"), F.col("word").alias("w3")), "h3", "left")
    phrase = F.concat_ws(" ", *(F.col(w).cast("string") for w in ("w1", "w2", "w3")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelled.withColumn("phrase", phrase).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    """All of ``documents``."""
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), s AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p
), g AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM s
), t AS (
  SELECT lang, ws[i] AS a1, ws[i + 1] AS a2, ws[i + 2] AS a3 FROM g
), w AS (
  SELECT lang, a1 AS w, count(*) AS f FROM t GROUP BY ALL
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM w GROUP BY lang
), b AS (
  SELECT lang, a1, a2, count(*) AS a FROM t WHERE a2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), c AS (
  SELECT lang, a1, a2, a3, count(*) AS a FROM t WHERE a3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), k AS (
  SELECT lang, a1, a2, max(a) AS most FROM (SELECT lang, a1, a2, a FROM c UNION ALL SELECT lang, a2, a3, a FROM c) GROUP BY ALL
), x AS (
  SELECT b.lang, b.a1 || ' ' || b.a2 AS phrase, 1 AS cut, a, x.f AS l, y.f AS r FROM b JOIN w x ON x.lang = b.lang AND x.w = b.a1 JOIN w y ON y.lang = b.lang AND y.w = b.a2
    LEFT JOIN k ON k.lang = b.lang AND k.a1 = b.a1 AND k.a2 = b.a2 WHERE most IS NULL OR 100 * most < 50 * a
  UNION ALL SELECT c.lang, concat_ws(' ', c.a1, c.a2, c.a3), 1, c.a, x.f, y.a FROM c JOIN w x ON x.lang = c.lang AND x.w = c.a1 JOIN b y ON y.lang = c.lang AND y.a1 = c.a2 AND y.a2 = c.a3
  UNION ALL SELECT c.lang, concat_ws(' ', c.a1, c.a2, c.a3), 2, c.a, x.a, y.f FROM c JOIN b x ON x.lang = c.lang AND x.a1 = c.a1 AND x.a2 = c.a2 JOIN w y ON y.lang = c.lang AND y.w = c.a3
), z AS (
  SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM x
), q AS (
  SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), o AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM q
)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""
