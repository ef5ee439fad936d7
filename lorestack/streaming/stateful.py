"""Processors that keep state by key across batches: turns of a chat, texts of streamed answers.

Both take rows in any order: what comes before its turn waits in the state, and what never comes is given up after a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a line of a text is: one with or without a delta, the end mark, a cancellation, a broken one.
_LINE, _DONE, _CANCELLED, _BROKEN = range(4)


def _in_order(rows: Iterable[tuple], at: int) -> tuple[list, list, int]:
    """Rows from place ``at`` on without a gap, the later ones, and the place that is missing. The first value of a row is
    its place; repeated places are one, the first that came."""
    by_place: dict = {}
    for r in rows:
        if r[0] is not None and r[0] >= at:
            by_place.setdefault(r[0], r)
    now = []
    while at in by_place:
        now.append(by_place.pop(at))
        at += 1
    return now, [by_place[p] for p in sorted(by_place)], at


class _Ordered(StatefulProcessor):
    """Rows of a key in order of a place that counts from 0, over batches; ``gap_ms`` after a gap it is passed over.

    A key has one state, read and written once a batch: the place that it waits for, what came early as JSON, and what
    ``take`` holds, columns of ``held`` that begin as ``blank``.
    """

    held, blank = "", ()
    fields: list[str] = []
    columns: list[str] = []

    def __init__(self, gap_ms: int | None):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", ", ".join(filter(None, ["place long, late string", self.held])))
        self.made = Row(*self.columns)

    def take(self, key: tuple, rows: list[tuple], held: tuple) -> tuple[list[tuple], tuple]:
        """What is given out for rows in order, and what is held from now on."""
        raise NotImplementedError

    def needed(self, later: list[tuple], held: tuple) -> list[tuple]:
        """Of the rows that came early those that can still be of use."""
        return later

    def _run(self, key: tuple, rows: Iterable[tuple], skip: bool, now_ms: int) -> Iterator[Row]:
        at, late, *held = self.state.get() or (0, None, *self.blank)
        early = json.loads(late) if late else []
        if skip and early:
            at = max(at, early[0][0])
        now, later, at = _in_order([*early, *rows], at)
        out, held = self.take(key, now, tuple(held))
        later = self.needed(later, held)
        if later and self.gap_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(now_ms + self.gap_ms)
        self.state.update((at, json.dumps(later) if later else None, *held))
        return iter([self.made(*r) for r in out])

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        some = [tuple(getattr(r, f) for f in self.fields) for r in rows]
        return self._run(key, some, False, 0 if self.gap_ms is None else timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._run(key, [], True, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


class Turns(_Ordered):
    """A question waits until its answer comes; a newer one takes its place, and after ``ttl_ms`` it is forgotten."""

    fields = ["pos", "id", "role", "content"]
    columns = ["chat_id", "answer_id", "question", "answer"]

    def __init__(self, gap_ms: int | None, ttl_ms: int | None):
        super().__init__(gap_ms)
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.question = handle.getValueState("question", "content string", self.ttl_ms)

    def take(self, key: tuple, rows: list[tuple], held: tuple) -> tuple[list[tuple], tuple]:
        if not rows:
            return [], held
        had = (self.question.get() or (None,))[0]
        waiting, out = had, []
        for _, ident, role, content in rows:
            if role == "user":
                waiting = content
            elif role == "assistant":
                if waiting is not None:
                    out.append((key[0], ident, waiting, content))
                waiting = None
        if waiting is None and had is not None:
            self.question.clear()
        elif waiting is not None and waiting is not had:
            self.question.update((waiting,))
        return out, held


class Texts(_Ordered):
    """An answer's text as its lines come, given out after each batch; the end mark or a cancellation ends it, and what comes
    after that is left out and not kept. A cancelled text keeps what came."""

    fields = ["seq", "delta", "mark"]
    held, blank = "text string, errors long, lines long, done boolean, cancelled boolean", ("", 0, 0, False, False)
    columns = ["message_id", "text", "done", "cancelled", "errors", "lines"]

    def take(self, key: tuple, rows: list[tuple], held: tuple) -> tuple[list[tuple], tuple]:
        text, errors, lines, done, cancelled = held
        if done or not rows:
            return [], held
        parts = [text]
        for _, delta, mark in rows:
            lines += 1
            if mark in (_DONE, _CANCELLED):
                done, cancelled = True, mark == _CANCELLED
                break
            parts.append(delta or "")
            errors += mark == _BROKEN
        text = "".join(parts)
        # A text that is given out whole isn't kept.
        return [(key[0], text, done, cancelled, errors, lines)], ("" if done else text, errors, lines, done, cancelled)

    def needed(self, later: list[tuple], held: tuple) -> list[tuple]:
        if held[3]:
            return []
        end = next((i for i, r in enumerate(later) if r[2] in (_DONE, _CANCELLED)), len(later))
        return later[: end + 1]


def _by_key(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str | StructType, timed: bool) -> DataFrame:
    """A stream with timers never ends by itself, so ``availableNow`` is for those without. Processors of this kind need the RocksDB state store, which is set where the session has the default one."""
    conf = rows.sparkSession.conf
    if conf.get("spark.sql.streaming.stateStore.providerClass", "").rpartition(".")[2] in ("", "HDFSBackedStateStoreProvider"):
        conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    return rows.groupBy(key).transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode="Update", timeMode="ProcessingTime" if timed else "None")


def stream_turns(messages: DataFrame, gap_ms: int | None = None, ttl_ms: int | None = None) -> DataFrame:
    """(chat_id, answer_id, question, answer) as the answers arrive. Positions count from 0 in each chat; messages may come in
    any order and twice. A position that hasn't come after ``gap_ms`` is passed over; a question older than ``ttl_ms`` has
    no turn. Without these it is waited for as long as the stream runs."""
    return _by_key(messages.select("chat_id", "id", "pos", "role", "content"), "chat_id", Turns(gap_ms, ttl_ms), "chat_id long, answer_id long, question string, answer string", gap_ms is not None or ttl_ms is not None)


def stream_texts(tokens: DataFrame, gap_ms: int | None = None) -> DataFrame:
    """(message_id, text, done, cancelled, errors, lines) after each batch in which a message got on: its text so far. Of
    tokens see :func:`lorestack.streaming.jobs.parse_tokens` with every line; ``seq`` counts from 0."""
    mark = F.when(F.col("done"), _DONE).when(F.col("cancelled"), _CANCELLED).when(F.col("error").isNotNull(), _BROKEN).otherwise(_LINE)
    return _by_key(tokens.select("message_id", "seq", "delta", mark.alias("mark")), "message_id", Texts(gap_ms), "message_id long, text string, done boolean, cancelled boolean, errors long, lines long", gap_ms is not None)
