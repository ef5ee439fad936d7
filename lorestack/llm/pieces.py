"""Cutting a text where a byte-level tokenizer always cuts, so that pieces can be encoded once and remembered.

The split pattern of byte-level BPE gives a single space to the word that follows it and never lets a match run over the
edge between a non-space and that space. A piece between such places is therefore encoded alike inside any text.
"""

from __future__ import annotations

import re
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: White space next to white space or at an end of the text, where the plain cuts below don't hold; other white space than
#: spaces and newlines counts too.
_OTHER = re.compile(r"[^\S \n]")
_ODD = ("  ", " \n", "\n ", "\n\n")
_BEFORE_SPACE = re.compile(r"(?= \S)")


def cut(text: str) -> list[list[str]]:
    """Lines, each a list of pieces; every piece but a line's first lost one leading space.

    Lines are parted by one newline that is a match of its own. A text with odd white space comes back as a list of
    whole pieces under the single key line, see :func:`cut_odd`.
    """
    return [line.split(" ") for line in text.split("\n")]


def is_odd(text: str) -> bool:
    return any(x in text for x in _ODD) or text[:1].isspace() or text[-1:].isspace() or _OTHER.search(text) is not None


def cut_odd(text: str) -> list[str]:
    """Pieces of a text with runs of white space; joined they give the text."""
    return [p for p in _BEFORE_SPACE.split(text) if p]


_CACHES: list[weakref.ref] = []


class Cache(dict):
    """Key to value, filled by ``make``. Two generations of ``most_bytes`` each: when the young one is full it becomes the
    old one, and what is used again moves back, so frequent keys stay. An entry counts for 300 bytes and 12 for each
    character of its key, since values are of a size with their keys; one of over a quarter of the bound is made anew each
    time. To be held by a module, not by a function that Spark ships: that would give each task a copy."""

    def __init__(self, make: Callable, most_bytes: int):
        super().__init__()
        self.make, self.most_bytes, self.size, self.old = make, most_bytes, 0, {}
        _CACHES[:] = [r for r in _CACHES if r() is not None] + [weakref.ref(self)]

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        weight = 300 + 12 * len(key)
        if weight > self.most_bytes // 4:
            return value
        if self.size + weight > self.most_bytes:
            self.old = dict(self)
            self.empty(keep_old=True)
        self[key] = value
        self.size += weight
        return value

    def put(self, items: dict) -> None:
        """Take in many entries at once, under the same bound."""
        weight = 300 * len(items) + 12 * sum(map(len, items))
        if weight > self.most_bytes // 2:
            for key in items:
                self.make_from(items, key)
            return
        if self.size + weight > self.most_bytes:
            self.old = dict(self)
            self.empty(keep_old=True)
        self.update(items)
        self.size += weight

    def make_from(self, items: dict, key) -> None:
        own, self.make = self.make, items.__getitem__
        try:
            self[key]
        finally:
            self.make = own

    def empty(self, keep_old: bool = False) -> None:
        self.clear()
        self.size = 0
        if not keep_old:
            self.old = {}


def only(*used: Cache) -> None:
    """Empty this worker's other caches: a worker that goes from one operator to the next keeps the caches of one."""
    for cache in filter(None, [r() for r in _CACHES]):
        if not any(cache is u for u in used):
            cache.empty()


def blocks(batches: Iterator[pa.RecordBatch], text_col: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Record batches cut into slices of about ``most_bytes`` of text, at least one row each."""
    for batch in batches:
        start = size = 0
        column = batch.column(text_col)
        lengths = pa.compute.binary_length(column.cast(pa.binary())).fill_null(0).to_pylist()
        for i, n in enumerate(lengths):
            if i > start and size + n > most_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if batch.num_rows > start:
            yield batch.slice(start)
