"""Packing token sequences by minimum bin slack.

Each document's ids, with an end id, are cut every ``window`` ids; full windows stand alone. The remainders of a
partition form a multiset of lengths. A window is filled by taking the largest remainder and then, by a bitset
subset-sum over the counted lengths that are left, the multiset that comes closest to the capacity; backtracking through
the bitsets gives how many of each length it takes. Everything is done on the map side: no shuffle, and a partition
holds one small record per remainder, not the texts.
"""

from __future__ import annotations

import json
import os
import sys
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorestack.llm.pieces import Cache, blocks, cut, cut_odd, is_odd, only

_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_WORKER: dict = {}
assert array("I").itemsize == 4 and sys.byteorder == "little"


def _fast_encoder(tokenizer):
    """The encoder of a byte-level BPE of the usual pattern by its ranks, which is quicker on short pieces; None for another.

    Ranks serve where every merge makes the next identifier, so that the lowest identifier is the earliest merge.
    """
    import public_tokenizers
    import tiktoken

    spec = json.loads(tokenizer.to_str())
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or spec.get("normalizer") or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256
    byte_of = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}
    pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
    made = [model["vocab"][a + b] for a, b in pairs]
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    if made != list(range(256, 256 + len(made))) or sorted(ranks.values()) != list(range(len(ranks))) or len(ranks) != 256 + len(made):
        return None
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class IdBytes:
    """The ids of a text as little-endian unsigned 32-bit bytes; pieces are encoded once per worker."""

    built = 0

    def __init__(self, path: str, cache_bytes: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        IdBytes.built += 1
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.library = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        ids = _fast_encoder(tokenizer) or self.library
        pack = lambda x: array("I", x).tobytes()
        self.encode = lambda text: pack(self.library(text))
        self.whole = Cache(lambda piece: pack(ids(piece)), cache_bytes // 8)
        self.after_space = Cache(lambda piece: pack(ids(" " + piece)), cache_bytes)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):  # such a string parts the text before the pattern does
            return self.encode(text)
        if is_odd(text):
            return b"".join(map(self.whole.__getitem__, cut_odd(text)))
        lines = []
        for first, *rest in cut(text):
            lines.append(self.whole[first])
            lines.extend(map(self.after_space.__getitem__, rest))
            lines.append(self.newline)
        return b"".join(lines[:-1])

    @property
    def newline(self) -> bytes:
        return self.whole["\n"]


def id_bytes(path: str, cache_bytes: int) -> IdBytes:
    """This worker's encoder of a file, built once and kept from task to task. (A dict that a shipped function names
    directly would come to each task as a new copy; a function of a module is looked up where the task runs.)"""
    if path not in _WORKER:
        _WORKER[path] = IdBytes(path, cache_bytes)
    only(_WORKER[path].whole, _WORKER[path].after_space)
    return _WORKER[path]


def fill(counts: Counter, capacity: int) -> list[int]:
    """Lengths for one window: the largest, and the multiset of the others that leaves least slack. ``counts`` stays as it is."""
    seed = max(counts)
    target = capacity - seed
    layers: list[tuple[int, int]] = []  # the length, and the sums that could be reached before it
    reach, mask = 1, (1 << (target + 1)) - 1
    for length in sorted((n for n in counts if n <= target), reverse=True):
        layers.append((length, reach))
        left = min(counts[length] - (length == seed), target // length)
        step = 1
        while left > 0:  # binary split of the count: sums of up to ``left`` copies
            take = min(step, left)
            reach |= (reach << (take * length)) & mask
            left -= take
            step *= 2
        if reach >> target & 1:
            break
    best = reach.bit_length() - 1
    chosen = [seed]
    for length, before in reversed(layers):
        while not before >> best & 1:
            best -= length
            chosen.append(length)
    return chosen


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices of ``lengths`` by window; each window's sum is at most ``capacity``. Equal lengths go in the order given."""
    at: dict[int, list[int]] = {}
    for i in reversed(range(len(lengths))):
        at.setdefault(lengths[i], []).append(i)
    counts = Counter({n: len(x) for n, x in at.items()})
    windows = []
    while counts:
        window = []
        for n in fill(counts, capacity):
            window.append(at[n].pop())
            counts[n] -= 1
            if not counts[n]:
                del counts[n]
        windows.append(window)
    return windows


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", cache_bytes: int = 60 << 20) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every row lies in one piece; a sequence holds at most ``window`` ids, its pieces gapless from offset 0. A
    null or empty text is the end id alone. Repeated rows are packed each for itself, a null identifier stays null, other
    columns are not read. Sequences are numbered by partition, so the result is the same when a task runs again. An empty
    table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = id_bytes(tokenizer_path, cache_bytes), np.array([end_id], dtype="<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 36
        tails = []

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for block in blocks(batches, "text", 8 << 20):
            full = []
            for doc, text in zip(block.column("doc_id").to_pylist(), block.column("text").to_pylist(), strict=True):
                data = memoryview(ids_of(text or "") + end)
                n = len(data) // 4
                for start in range(0, n, window):
                    piece = data[4 * start : 4 * (start + window)]
                    row = (doc, start, len(piece) // 4, zlib.crc32(piece), n)
                    if row[2] == window:
                        full.append((*row, sequence, 0))
                        sequence += 1
                    else:
                        tails.append(row)
            if full:
                yield rows(full)
        tails.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3]))
        packed = []
        for members in pack([r[2] for r in tails], window):
            offset = 0
            for i in members:
                packed.append((*tails[i], sequence, offset))
                offset += tails[i][2]
            sequence += 1
            if len(packed) >= 50_000:
                yield rows(packed)
                packed = []
        if packed:
            yield rows(packed)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` packed into sequences of 1024 ids."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
