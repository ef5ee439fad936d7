"""Toxicity by class-conditional Kneser-Ney models.

One model of toxic and one of ordinary text, over the characters of words, since an insult may carry any ending. The
highest order counts, for each class, the training texts that hold a word, and is discounted; it backs off to lower orders
that count the different contexts an ending continues in both classes together. These shared counts are the same for both
models, so an expression that is rare in both weighs nothing, and only what one class has often tells them apart. Counts
are gathered over all labelled rows of the training folds and summed in ``SLOTS`` places by a hash, so a model's size is
fixed whatever the corpus: expressions that share a place share their counts.

A document's evidence is the difference of the two log-likelihoods, normalised by length: over all its words, and over its
worst words, since a few words make a long text toxic. A logistic curve, fitted on a bounded sample of training rows that
the counts leave out, does no more than weigh these means against each other and turn them into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorestack.llm.common import discard, materialise
from lorestack.llm.labelled import fold, label_rows, per_class_rows
from lorestack.llm.pieces import Cache, blocks, only

ORDER = 7
#: The evidence also has the mean of so many of a text's worst words.
WORST = (1, 2, 4)
#: Places of the counts of all orders: 50 MB of 32-bit numbers.
SLOTS = 1 << 21
_DISCOUNT = 0.75
#: A context of the highest order backs off as if it had been seen so many times more.
_DOUBT = 1.0
_START, _END = 2, 3
_TABLE = bytes(ord(" ") if i < 128 and not chr(i).isalnum() else i + 32 if 65 <= i < 91 else i for i in range(256))
_MASK = [np.uint64((1 << 8 * k) - 1) for k in range(ORDER + 1)]


def words(text: bytes) -> list[bytes]:
    """Lower-case words; ASCII marks part them."""
    return text.translate(_TABLE).split()


def _grams(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that end at each place of each word, ``ORDER`` of them as one number, and the lengths of the words with their end."""
    text = np.frombuffer(b"".join(bytes([_START]) * (ORDER - 1) + w + bytes([_END]) for w in found), dtype=np.uint8).astype(np.uint64)
    lengths = np.array([len(w) + 1 for w in found])
    key = np.zeros(len(text), dtype=np.uint64)
    for i in range(ORDER):
        key[ORDER - 1 :] |= text[ORDER - 1 - i : len(text) - i] << np.uint64(8 * i)
    inside = np.ones(len(text), dtype=bool)
    starts = np.concatenate([[0], np.cumsum(lengths + ORDER - 1)[:-1]])
    for i in range(ORDER - 1):
        inside[starts + i] = False
    return key[inside], lengths


def _slots(gram: np.ndarray, order: int) -> np.ndarray:
    """The places of ends (or contexts) of one order."""
    x = (gram ^ np.uint64(order * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(SLOTS)).astype(np.int64)


class KneserNey:
    """Two models of the characters of words; the columns of all counts are (ordinary, toxic)."""

    def __init__(self, grams: np.ndarray | None = None, contexts: np.ndarray | None = None):
        """By place: discounted counts of ends; totals, then discounts, of contexts."""
        self.grams, self.contexts, self.cache, self.lower = grams, contexts, None, None
        self.curve = np.zeros(3 + len(WORST))

    def ratios(self, found: list[bytes]) -> np.ndarray:
        """log p(word | toxic) - log p(word | ordinary) of each word."""
        if self.grams is None or not found:
            return np.zeros(len(found))
        key, lengths = _grams(found)
        if self.lower is None:
            self.lower = np.ascontiguousarray(self.grams[:, 0]), np.ascontiguousarray(self.contexts[:, 0]), np.ascontiguousarray(self.contexts[:, 2])
        ends, totals, discounts = self.lower
        p = np.full(len(key), 1 / 256, dtype=np.float32)
        for k in range(1, ORDER):  # the same for both classes
            here = key & _MASK[k]
            n, at = ends[_slots(here, k)], _slots(here >> np.uint64(8), k)
            spread = discounts[at]
            total = np.maximum(totals[at], n + spread)
            seen = total > 0
            p = np.where(seen, (n + spread * p) / np.where(seen, total, 1), p)
        n, both = self.grams[_slots(key, ORDER)], self.contexts[_slots(key >> np.uint64(8), ORDER)].astype(float)
        p = (n + (both[:, 2:] + _DOUBT) * p[:, None].astype(float)) / (np.maximum(both[:, :2], n + both[:, 2:]) + _DOUBT)
        each = np.log(p[:, 1]) - np.log(p[:, 0])
        return np.add.reduceat(each, np.concatenate([[0], np.cumsum(lengths)[:-1]]))

    def learn(self, found: set[bytes]) -> None:
        """Ratios of words that the worker's cache lacks, in parts of bounded size."""
        part, size = [], 0
        for w in found:
            part.append(w)
            size += len(w) + ORDER
            if size > 1 << 19:
                self.cache.put(dict(zip(part, self.ratios(part).tolist(), strict=True)))
                part, size = [], 0
        self.cache.put(dict(zip(part, self.ratios(part).tolist(), strict=True)))

    def evidence(self, texts: list[bytes], cache_bytes: int = 100 << 20) -> list[list[float]]:
        """Of each text: the ratio a word, the mean of its worst words, and the logarithm of its length. Without words, zeros."""
        if self.cache is None:
            self.cache = Cache(lambda w: float(self.ratios([w])[0]), cache_bytes)
        only(self.cache)
        cut = [words(t) for t in texts]
        self.learn({w for w in set().union(*cut) if w not in self.cache and w not in self.cache.old})
        known, out = self.cache.__getitem__, []
        for x in cut:
            ratio = np.fromiter(map(known, x), dtype=float, count=len(x))
            if not len(ratio):
                out.append([0.0] * (2 + len(WORST)))
                continue
            most = max(WORST)
            top = np.sort(np.partition(ratio, len(ratio) - most)[-most:] if len(ratio) > most else ratio)[::-1]
            out.append([float(ratio.mean()), *(float(top[:k].mean()) for k in WORST), float(np.log1p(len(ratio)))])
        return out

    def __getstate__(self):
        return self.__dict__ | {"cache": None, "lower": None}

    def calibrate(self, evidence: np.ndarray, y: np.ndarray) -> None:
        """The logistic curve by Newton's method, each class weighing the same, with a little ridge."""
        x = np.column_stack([np.ones(len(y)), evidence])
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        theta = np.zeros(x.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            gradient = x.T @ (weight * (p - y)) + 1e-1 * theta
            theta -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-1 * np.eye(len(theta)), gradient)
        self.curve = theta


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different words of each text, parted by spaces."""
    for block in blocks(batches, "text", 4 << 20):
        bags = [b" ".join(sorted(set(words(t or b"")))) for t in block.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([block.column("_id"), block.column("hash"), pa.array(bags, pa.binary())], names=["_id", "hash", "bag"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and how many bags of each label hold them, added up batch by batch."""
    for batch in batches:
        seen: dict[bytes, list[int]] = {}
        for y, bag in zip(batch.column("label").to_pylist(), batch.column("bag").to_pylist(), strict=True):
            for w in bag.split():
                seen.setdefault(w, [0, 0])[y] += 1
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.binary()), *(pa.array([n[y] for n in seen.values()], pa.int64()) for y in (0, 1))], names=["word", "n0", "n1"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ends of the highest order in each word, with the word's counts, added up part by part."""
    for block in blocks(batches, "word", 1 << 19):
        found = block.column("word").to_pylist()
        if found:
            key, lengths = _grams(found)
            gram, of = np.unique(key, return_inverse=True)
            n = [np.bincount(of, np.repeat(block.column(c).to_numpy(), lengths)).astype(np.int64) for c in ("n0", "n1")]
            yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int64)), *map(pa.array, n)], names=["gram", "n0", "n1"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each end adds to its place, and to that of its context: kind, place and four numbers."""
    for batch in batches:
        if not batch.num_rows:
            continue
        order, gram = batch.column("order").to_numpy(), batch.column("gram").to_numpy().astype(np.uint64)
        n = np.stack([batch.column(c).to_numpy() for c in ("n0", "n1")], axis=1).astype(float)
        kept = np.maximum(n - _DISCOUNT, 0)
        values = np.concatenate([np.concatenate([kept, np.zeros_like(n)], axis=1), np.concatenate([n, n - kept], axis=1)])
        at = np.empty(2 * len(gram), dtype=np.int64)
        for k in np.unique(order).tolist():
            here = order == k
            at[: len(gram)][here] = _slots(gram[here], k)
            at[len(gram) :][here] = _slots(gram[here] >> np.uint64(8), k) + SLOTS  # contexts follow the ends
        place, of = np.unique(at, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(place), *(pa.array(np.bincount(of, values[:, c])) for c in range(4))], names=["place", "a", "b", "c", "d"])


def count(counted: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """The counts by place of (word, n0, n1); None without words.

    A lower order counts each different longer context that an end continues once, of whichever class.
    """
    level = materialise(counted.mapInArrow(_ends, "gram long, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    levels = [level]
    for k in range(ORDER - 1, 0, -1):
        shorter = levels[-1].select(F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n0"))
        levels.append(materialise(shorter.withColumn("n1", F.col("n0"))))
    every = [x.withColumn("order", F.lit(ORDER - i)) for i, x in enumerate(levels)]
    for x in every[1:]:
        every[0] = every[0].unionByName(x)
    sums = every[0].mapInArrow(_placed, "place long, a double, b double, c double, d double").groupBy("place").agg(*(F.sum(c).cast("float").alias(c) for c in "abcd"))
    found = sums.toArrow()  # at most 2 * SLOTS rows
    discard(*levels)
    if not found.num_rows:
        return None
    both = np.zeros((2 * SLOTS, 4), dtype=np.float32)
    both[found.column("place").to_numpy()] = np.stack([found.column(c).to_numpy() for c in "abcd"], axis=1)
    return both[:SLOTS, :2].copy(), both[SLOTS:]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", curve_rows: int = 2_000, id_col: str = "doc_id", text_col: str = "text") -> KneserNey:
    """Models from all labelled rows outside the held-out fold, a repeated text counting once.

    Spark counts the texts that hold a word over three quarters of the training texts (by a hash of the text). The curve is
    fitted on at most ``curve_rows`` texts of each class of the rest. Without rows of both classes all scores are 0.5.
    """
    text = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    chosen = materialise(text.select("_id", "hash").join(label_rows(labels, label), "_id").groupBy("label", "hash").agg(F.min("_id").alias("_id")))
    apart = F.pmod("hash", F.lit(4)) == 0
    # What is shuffled of a text is the set of its words; rows of one identifier and text count once.
    bags = text.mapInArrow(_bags, "_id long, hash long, bag binary").join(chosen.filter(~apart), ["_id", "hash"]).dropDuplicates(["_id", "hash", "label"])
    counted = materialise(bags.select("label", "bag").mapInArrow(_counted, "word binary, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    counts = count(counted)
    model = KneserNey(*counts) if counts else KneserNey()
    picked = F.broadcast(per_class_rows(chosen.filter(apart), curve_rows))  # at most 2 * curve_rows rows of numbers
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed by SLOTS
    fitted = text.join(picked, ["_id", "hash"]).dropDuplicates(["_id", "hash", "label"]).select("label", "text").mapInArrow(_evidence(shared, "label"), "label long, evidence array<double>").collect()
    shared.unpersist()
    discard(counted)
    fitted.sort()
    y = np.array([r.label for r in fitted], dtype=float)
    if len(set(y)) == 2 and chosen.filter(~apart).select("label").distinct().count() == 2:
        model.calibrate(np.array([r.evidence for r in fitted]), y)
    return model


def _evidence(shared, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for block in blocks(batches, "text", 4 << 20):
            found = model.evidence([t or b"" for t in block.column("text").cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([block.column(id_col).cast(pa.int64()), pa.array(found, pa.list_(pa.float64()))], names=[id_col, "evidence"])

    return run


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **training) -> DataFrame:
    """doc_id, held_out, score, predicted, and the two log-likelihood ratios, of every row of ``docs``.

    The score looks at the whole text alone. A text without words (null, empty, blank) has no evidence either way and gets
    the curve's value there; repeated rows score alike; a null identifier is carried and not held out. Other columns are
    not read. An empty table gives an empty result.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col, **training)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed by SLOTS
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_evidence(shared, "doc_id"), "doc_id long, evidence array<double>")
    bias, *slopes = (F.lit(float(x)) for x in model.curve)
    raw = bias + sum(slope * F.col("evidence")[i] for i, slope in enumerate(slopes))
    return found.withColumn("score", 1 / (1 + F.exp(-raw))).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.col("evidence")[0].alias("llr_text"), F.col("evidence")[1].alias("llr_worst"))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all of ``documents``, learned from ``labels.toxic``."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
