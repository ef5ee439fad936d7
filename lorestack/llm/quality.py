"""Quality classification by a factorisation machine.

The inputs of a document are hashed words (term frequency, unit length), shares of word shapes, and bins of structure
statistics. The only metadata are what the text itself says of its size, the bins of its bytes and lines: language, source
and identifier may not be inputs. The score is the logistic of a bias, a linear part, and all pairwise interactions through
vectors of low rank, summed in linear time as half of the squared sums less the sums of squares.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorestack.llm.labelled import fold, training_rows
from lorestack.llm.pieces import Cache, blocks, only

WORDS, SHAPES, BINS = 1 << 14, 256, 8
#: Structure statistics, each cut into ``BINS`` bins between the two bounds.
STATS = {
    "upper": (0.0, 0.6), "digit": (0.0, 0.2), "punctuation": (0.0, 0.3), "space": (0.0, 0.4), "word_length": (2.0, 12.0), "distinct": (0.0, 1.0),
    "top_word": (0.0, 0.5), "repeated_next": (0.0, 0.5), "line_length": (0.0, 500.0), "repeated_line": (0.0, 1.0), "end_marks": (0.0, 0.5), "log_bytes": (2.0, 12.0), "log_lines": (0.0, 6.0),
}
SIZE = WORDS + SHAPES + len(STATS) * (BINS + 1)
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SPACE = b" \t\n\x0b\x0c\r"
_MARKS = bytes(i for i in range(33, 127) if not chr(i).isalnum())
_SHAPE = bytes(ord("A") if 65 <= i < 91 else ord("0") if 48 <= i < 58 else ord("a") if i >= 128 or 97 <= i < 123 else i for i in range(256))


def _places(word: bytes) -> tuple[int, int]:
    """The hashed places of a word and of its shape: classes of characters, runs written once."""
    shape, last = bytearray(), -1
    for c in word.translate(_SHAPE):
        if c != last:
            shape.append(c)
        last = c
    return zlib.crc32(word.lower()) % WORDS, zlib.crc32(bytes(shape)) % SHAPES


_CACHE = Cache(_places, 40 << 20)


def _places_only() -> None:
    only(_CACHE)


def _share(text: bytes, chars: bytes) -> float:
    return (len(text) - len(text.translate(None, chars))) / max(len(text), 1)


def inputs(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of one text; an empty text has its structure bins alone."""
    words = text.split()
    places = np.array([_CACHE[w] for w in words], dtype=np.int64).reshape(-1, 2)
    word, n_word = np.unique(places[:, 0], return_counts=True)
    shape, n_shape = np.unique(places[:, 1], return_counts=True)
    norm = np.sqrt((n_word.astype(float) ** 2).sum()) or 1.0
    lines = text.split(b"\n")
    n = max(len(words), 1)
    values = {
        "upper": _share(text, _UPPER), "digit": _share(text, _DIGIT), "punctuation": _share(text, _MARKS), "space": _share(text, _SPACE), "word_length": len(text) / n,
        "distinct": len(word) / n, "top_word": float(n_word.max(initial=0)) / n, "repeated_next": float((places[1:, 0] == places[:-1, 0]).sum()) / n,
        "line_length": len(text) / max(len(lines), 1), "repeated_line": 1 - len(set(lines)) / max(len(lines), 1), "end_marks": sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / max(len(lines), 1) / 2,
        "log_bytes": np.log1p(len(text)), "log_lines": np.log1p(len(lines)),
    }
    bins = []
    for i, (name, (low, high)) in enumerate(STATS.items()):
        at = int(np.clip((values[name] - low) / (high - low) * BINS, 0, BINS))
        bins.append(WORDS + SHAPES + i * (BINS + 1) + at)
    index = np.concatenate([word, WORDS + shape, bins]).astype(np.int32)
    value = np.concatenate([n_word / norm, n_shape / n, np.full(len(bins), 0.5)]).astype(np.float32)
    return index, value


class FactorisationMachine:
    """Bias, weights and rank-``k`` vectors over hashed inputs."""

    def __init__(self, k: int = 8, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.b, self.w = 0.0, np.zeros(SIZE, dtype=np.float32)
        self.v = rng.normal(0, 0.02, (SIZE, k)).astype(np.float32)

    def raw(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores before the logistic of documents whose inputs begin at ``starts``; none is empty."""
        x = value[:, None] * self.v[index]
        total, squares = np.add.reduceat(x, starts, axis=0), np.add.reduceat(x * x, starts, axis=0)
        return self.b + np.add.reduceat(self.w[index] * value, starts) + 0.5 * (total * total - squares).sum(axis=1)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.02, decay: float = 1e-5, seed: int = 5) -> FactorisationMachine:
        """Adagrad on the logistic loss; each class weighs the same, whatever its share of the rows."""
        rng = np.random.default_rng(seed)
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        sw, sv, sb = np.full(SIZE, 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                index = np.concatenate([rows[i][0] for i in part])
                value = np.concatenate([rows[i][1] for i in part])
                lengths = np.array([len(rows[i][0]) for i in part])
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                p = 1 / (1 + np.exp(-np.clip(self.raw(index, value, starts), -30, 30)))
                g = (p - y[part]) * weight[part] / len(part)
                each = np.repeat(g, lengths)
                x = value[:, None] * self.v[index]
                total = np.repeat(np.add.reduceat(x, starts, axis=0), lengths, axis=0)
                gw = np.bincount(index, each * value, minlength=SIZE) + decay * self.w
                gv = np.zeros_like(self.v, dtype=np.float64)
                np.add.at(gv, index, each[:, None] * value[:, None] * (total - x))
                gv += decay * self.v
                sw += gw * gw
                sv += gv * gv
                sb += g.sum() ** 2
                self.w -= (rate * 5 * gw / np.sqrt(sw)).astype(np.float32)
                self.v -= (rate * gv / np.sqrt(sv)).astype(np.float32)
                self.b -= rate * 5 * g.sum() / np.sqrt(sb)
        return self


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 2_500, epochs: int = 6, id_col: str = "doc_id", text_col: str = "text") -> FactorisationMachine:
    """A machine from at most ``per_class`` labelled rows of each class outside the held-out fold.

    Their inputs (not their texts) are gathered for the fit. Without rows of both classes the scores are all 0.5.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _places_only()
        for batch in batches:
            found = [inputs(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())], names=["label", "at", "value"])

    rows = training_rows(docs, labels, label, per_class, id_col, text_col).mapInArrow(run, "label int, at binary, value binary").collect()
    rows.sort(key=lambda r: (bytes(r.at), r.label))  # the order that tasks finish in mustn't matter
    machine, y = FactorisationMachine(), np.array([r.label for r in rows], dtype=float)
    if len(set(y)) < 2:
        return machine
    return machine.fit([(np.frombuffer(r.at, dtype=np.int32), np.frombuffer(r.value, dtype=np.float32)) for r in rows], y, epochs)


def score(docs: DataFrame, machine: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row by its whole text; a null text counts as empty. Other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # SIZE * (k + 1) numbers, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _places_only()
        machine = shared.value
        for block in blocks(batches, "text", 1 << 20):
            found = [inputs(t or b"") for t in block.column("text").cast(pa.binary()).to_pylist()]
            starts = np.concatenate([[0], np.cumsum([len(i) for i, _ in found])[:-1]])
            raw = machine.raw(np.concatenate([i for i, _ in found]), np.concatenate([v for _, v in found]), starts)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(raw.astype(float), -30, 30))), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **training) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    The score looks at the text alone. Empty, null and very long texts are scored like others, repeated rows alike; a null
    identifier is carried and not held out. An empty table gives an empty result.
    """
    scored = score(docs, train(docs, labels, id_col=id_col, text_col=text_col, **training), id_col, text_col)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text_col: str = "text", **training) -> DataFrame:
    """``docs`` without the rows that the machine rejects, in one pass: the rows' columns go through as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, text_col=text_col, **training))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _places_only()
        machine = shared.value
        for block in blocks(batches, text_col, 1 << 20):
            found = [inputs(t or b"") for t in block.column(text_col).cast(pa.binary()).to_pylist()]
            starts = np.concatenate([[0], np.cumsum([len(i) for i, _ in found])[:-1]])
            raw = machine.raw(np.concatenate([i for i, _ in found]), np.concatenate([v for _, v in found]), starts)
            yield block.filter(pa.array(1 / (1 + np.exp(-np.clip(raw.astype(float), -30, 30))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Scores of all of ``documents``, learned from ``labels.quality``."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
