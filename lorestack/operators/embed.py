"""Batch embedding with a model from the caller, built once per worker and name."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Model = Callable[[list[str]], np.ndarray]
_MODELS: dict = {}


def hashing_model(dimensions: int = 64) -> Model:
    """Words hashed to signed places, unit length: deterministic, for tests and for want of a trained model. Where the signs
    cancel each other out, and where there is no word, the text as a whole has one place."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions))
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                out[i, h % dimensions] += 1 if h & 0x10000 else -1
        for i in np.flatnonzero(~out.any(axis=1)):
            out[i, zlib.crc32(texts[i].encode()) % dimensions] = 1
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    return embed


def model(name: str, factory: Callable[[], Model]) -> Model:
    """This worker's model of a name, built at the first call. (Found through the module: a dict that a shipped function
    names directly would come to each task as a new copy.)"""
    if name not in _MODELS:
        _MODELS[name] = factory()
    return _MODELS[name]


def embed(text: Column, factory: Callable[[], Model] = hashing_model, kind: str = "passage", name: str | None = None) -> Column:
    """The vector of each text, prefixed by its kind (passage or query); null for null.

    ``name`` tells models apart in a worker; without it, that of a plain function is its own, and a lambda or a local
    function is built for each task.
    """
    plain = f"{factory.__module__}.{factory.__qualname__}"
    known = name or ("" if "<" in plain else plain)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = model(known, factory) if known else factory()
        for batch in batches:
            vectors = made([f"{kind}: {t}" for t in batch.fillna("")]) if len(batch) else []
            yield pd.Series([None if t is None else v.tolist() for t, v in zip(batch, vectors, strict=True)], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.ArrayType(T.DoubleType()))(text)


def index_turns(turns: DataFrame, chats: DataFrame, factory: Callable[[], Model] = hashing_model) -> DataFrame:
    """Chunk rows of turns (chat_id, answer_id, question, answer) in the memory namespace of chats that keep one."""
    from lorestack.functions.text import chunks, turn_text

    on = turns.join(chats.filter("use_memory").select("chat_id"), "chat_id", "left_semi")
    each = on.select(F.concat(F.lit("memory:"), F.col("chat_id").cast("string")).alias("namespace"), F.col("answer_id").alias("doc_id"), F.posexplode(chunks(turn_text(F.col("question"), F.col("answer")))).alias("chunk_index", "text"))
    return each.select(F.concat_ws("#", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("id"), "namespace", "doc_id", "chunk_index", "text", embed(F.col("text"), factory).alias("vector"))
