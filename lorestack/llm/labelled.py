"""A bounded sample of labelled training rows for the classifiers of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorestack.llm.common import materialise

FOLDS = 5


def fold(id_col) -> F.Column:
    """The fold of a document: CRC-32 of its identifier as text, modulo 5; fold 0 is held out. A null identifier is in fold 1."""
    return F.coalesce(F.crc32(id_col.cast("string")) % FOLDS, F.lit(1))


def label_rows(labels: DataFrame, label: str) -> DataFrame:
    """(_id, label) of the labelled identifiers outside the held-out fold; 1 where marks differ. Nulls are left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("label")).filter("_id is not null and label in (0, 1)").filter(fold(F.col("_id")) != 0)
    return known.groupBy("_id").agg(F.max("label").alias("label"))


def per_class_rows(marks: DataFrame, per_class: int) -> DataFrame:
    """At most ``per_class`` rows of each label, by a hash of their identifiers: 2 * ``per_class`` rows of numbers."""
    chosen = [marks.filter(F.col("label") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)]
    return chosen[0].unionByName(chosen[1])


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(label, text) of at most ``per_class`` labelled documents of each class, outside the held-out fold.

    The identifiers are chosen by their hash from the label table alone, so only the chosen texts are moved; their number
    is bounded by ``per_class``, whatever the corpus. Null labels and identifiers are left out.
    """
    picked = F.broadcast(per_class_rows(label_rows(labels, label), per_class))  # at most 2 * per_class rows of two numbers
    return materialise(docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text")).join(picked, "_id").select("label", "text"))
