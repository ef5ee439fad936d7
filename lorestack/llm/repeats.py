"""Removal of repeated passages by an interval tree of common prefixes.

Every passage of ``length`` bytes holds an anchor: a place whose next ``gram`` bytes hash to the least value among all places
of the passage where that many bytes fit. Equal passages have equal anchors at equal offsets, so the suffixes that start at
anchors, with the bytes to their left, tell all repeated passages. Anchors are grouped by their gram; those whose whole
surroundings are equal are one class, of which one member goes on. The right sides of a group's classes, sorted, are its
suffix array; a stack scan over the common prefixes of neighbours gives the tree of intervals. In each interval the members'
left sides are compared as well: where members of two children of the interval share enough to the left, the passage can be
extended neither way and is a maximal repeat of all of them, not just of neighbours.

A gram that is very frequent is dealt out, its classes are counted before they meet, and where even these are too many for
one task its intervals are counted passage by passage, by sums that start on the map side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorestack.llm.common import discard, materialise, table
from lorestack.llm.pieces import blocks

SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_ANCHORS = "gram long, ctx long, d long, h long, pos long, last long, times long, salt int"
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def gram_of(length: int) -> int:
    """Bytes of an anchor: fewer bring more anchors by chance, more of them bring more anchors in all."""
    return max(1, 3 * length // 8)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 12, 1 << (n - 1).bit_length())
    if size not in _POWERS:
        up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _POWERS.clear()
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


def _slid(values: np.ndarray, width: int, pick: np.ufunc, rest: int) -> np.ndarray:
    """``pick`` over each window of ``width`` values from a place on; beyond the end stands ``rest``."""
    n = len(values)
    padded = np.full(-(-n // width) * width + width, rest, dtype=values.dtype)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = pick.accumulate(rows, axis=1).ravel()
    behind = pick.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Places of anchors in texts that stand one after another; every passage of ``length`` bytes in one text holds one, at
    an offset that follows from its bytes alone."""
    gram, n = gram_of(length), len(data)
    if n < length:
        return np.empty(0, dtype=np.int64)
    width, most = length - gram + 1, np.uint32(0xFFFFFFFF)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    rolled = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    rolled = ((rolled ^ (rolled >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], ends[:-1]])

    def across(size: int) -> np.ndarray:
        """Places from which ``size`` bytes run into the next text."""
        change = np.zeros(n + 1, dtype=np.int32)
        np.add.at(change, np.maximum(starts, ends - size + 1), 1)
        np.add.at(change, ends, -1)
        return np.cumsum(change)[: n - gram + 1] > 0

    no_gram = across(gram)
    rolled[no_gram] = most
    least = _slid(rolled, width, np.minimum, most)
    least[across(length)] = 0
    reached = _slid(np.concatenate([np.zeros(width - 1, dtype=np.uint32), least]), width, np.maximum, 0)[: len(rolled)]
    return np.flatnonzero((reached == rolled) & ~no_gram)


def _found(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]], bytes]:
    """Of a block of texts: owner and place of each anchor, (gram's hash, surroundings' hash) and the bytes."""
    whole = b"".join(texts)
    data, ends = np.frombuffer(whole, dtype=np.uint8), np.cumsum([len(t) for t in texts])
    at = []
    for s in range(0, max(1, len(data)), SEGMENT):
        part = data[s : s + SEGMENT + length - 1]
        inside = ends[(ends > s) & (ends < s + len(part))] - s
        at.append(s + anchors(part, np.append(inside, len(part)), length))
    at = np.unique(np.concatenate(at))
    own = np.searchsorted(ends, at, "right")
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    # A text's end inside a segment is known, its own end may lie beyond: no gram crosses either.
    kept = (sizes[own] >= length) & (at + gram_of(length) <= ends[own])
    at, own = at[kept], own[kept]
    return own, at - (ends - sizes)[own], ends, whole


def _surroundings(pos: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """How far an anchor's surroundings reach to its left and right: all passages with it as anchor lie in them."""
    return np.minimum(pos, length - gram_of(length)), np.minimum(size - pos, length)


def _anchored(length: int, heavy: np.ndarray, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, digest = gram_of(length), xxhash.xxh3_64_intdigest
        for block in blocks(batches, "text", 4 << 20):
            texts = block.column("text").cast(pa.binary()).to_pylist()
            own, pos, ends, whole = _found(texts, length)
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            left, right = _surroundings(pos, sizes[own], length)
            at = (ends - sizes)[own] + pos
            places = list(zip(at.tolist(), (at - left).tolist(), (at + right).tolist(), strict=True))
            grams = np.fromiter((digest(whole[a : a + gram]) for a, _, _ in places), dtype=np.uint64, count=len(places)).view(np.int64)
            around = np.fromiter((digest(whole[b:c], a - b) for a, b, c in places), dtype=np.uint64, count=len(places)).view(np.int64)
            salt = np.where(np.isin(grams, heavy), 1 + (at + own) % parts, 0).astype(np.int32)
            # Neighbours with equal surroundings that overlap, as in a run of one character, are one row.
            fresh = np.ones(len(pos), dtype=bool)
            fresh[1:] = (own[1:] != own[:-1]) | (grams[1:] != grams[:-1]) | (around[1:] != around[:-1]) | (np.diff(pos) > length)
            begin = np.flatnonzero(fresh)
            end = np.append(begin[1:], len(pos)) - 1
            rows = pa.array(own[begin])
            columns = [grams[begin], around[begin], block.column("d").take(rows), block.column("h").take(rows), pos[begin], pos[end], end - begin + 1, salt[begin]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["gram", "ctx", "d", "h", "pos", "last", "times", "salt"])

    return run


_CLASSED = "gram long, ctx long, d long, h long, pos long, last long, times long, n long, rep boolean, mixed boolean, heavy boolean"


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by gram, salt and surroundings: those of grams with two rows or more, with the size of their class, whether
    they stand for it, and whether the gram has several classes. Rows of dealt-out grams come back as they are."""

    def made(rows: pa.RecordBatch) -> pa.RecordBatch:
        gram, ctx, salt = (rows.column(c).to_numpy() for c in ("gram", "ctx", "salt"))
        new_gram, new_class = np.ones(len(gram), dtype=bool), np.ones(len(gram), dtype=bool)
        new_gram[1:] = gram[1:] != gram[:-1]
        new_class[1:] = new_gram[1:] | (ctx[1:] != ctx[:-1])
        of_gram, of_class = np.cumsum(new_gram) - 1, np.cumsum(new_class) - 1
        n, many = np.bincount(of_class, weights=rows.column("times").to_numpy()).astype(np.int64)[of_class], np.bincount(of_gram, weights=new_class)[of_gram] > 1
        heavy = salt > 0
        kept = np.flatnonzero(heavy | (n > 1) | many)
        found = rows.select(["gram", "ctx", "d", "h", "pos", "last", "times"]).take(pa.array(kept))
        more = [pa.array(n[kept]), pa.array(new_class[kept] & ~heavy[kept]), pa.array(many[kept]), pa.array(heavy[kept])]
        return pa.RecordBatch.from_arrays([*found.columns, *more], names=["gram", "ctx", "d", "h", "pos", "last", "times", "n", "rep", "mixed", "heavy"])

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        gram, salt = batch.column("gram").to_numpy(), batch.column("salt").to_numpy()
        edge = np.flatnonzero((gram != gram[-1]) | (salt != salt[-1]))
        cut = int(edge[-1]) + 1 if len(edge) else 0
        if not cut and salt[-1] == 0 and (not waiting or waiting[-1].column("gram")[-1].as_py() == gram[-1]):
            waiting.append(batch)
            continue
        before = [*waiting, batch.slice(0, cut)]
        if any(b.num_rows for b in before):
            yield made(pa.concat_batches(before))
        waiting = [batch.slice(cut)] if cut < batch.num_rows else []
    if waiting:
        yield made(pa.concat_batches(waiting))


def _sides(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of a matrix, zeros behind, and their lengths."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    size = np.diff(offsets)
    out = np.zeros((len(size), width), dtype=np.uint8)
    values = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    out[np.arange(width) < size[:, None]] = values[offsets[0] : offsets[-1]]
    return out, size.astype(np.int64)


def _common(rows: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common beginning of rows x and rows y."""
    out = np.empty(len(x), dtype=np.int64)
    for s in range(0, len(x), 1 << 15):
        a, b = x[s : s + (1 << 15)], y[s : s + (1 << 15)]
        differ = rows[a] != rows[b]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        out[s : s + (1 << 15)] = np.minimum(first, np.minimum(sizes[a], sizes[b]))
    return out


def intervals(common: list[int]) -> list[tuple[int, int, int]]:
    """(depth, first, end) of the intervals of a suffix array, from the common prefix of each row with the row before it."""
    out, stack = [], []
    for i, depth in enumerate([*common[1:], 0], 1):
        start = i - 1
        while stack and stack[-1][0] > depth:
            d, start = stack.pop()
            out.append((d, start, i))
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, start))
    return out


def tree(grams: np.ndarray, left: pa.Array, right: pa.Array, length: int) -> dict[str, np.ndarray]:
    """Maximal repeats of at least ``length`` bytes around anchors.

    Rows are sorted by gram and right side; left sides are backwards. Comes back as one entry a member of each repeat: the row,
    ``reach`` (the most that it shares to its left with another row of the interval), ``depth`` (what all of the interval
    share to the right), ``shared`` (what all of the repeat share to the left) and the repeat's number.
    """
    rights, right_size = _sides(right, length)
    lefts, left_size = _sides(left, length - gram_of(length))
    n = len(grams)
    common = np.zeros(n, dtype=np.int64)
    at = np.arange(1, n)
    common[1:] = np.where(grams[1:] == grams[:-1], _common(rights, right_size, at, at - 1), 0)
    nodes = np.array(intervals(common.tolist()), dtype=np.int64).reshape(-1, 3)
    by_size = np.argsort(left_size, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[by_size[np.argsort(np.ascontiguousarray(lefts[by_size]).view(f"S{lefts.shape[1]}").ravel(), kind="stable")]] = np.arange(n)
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("row", "reach", "depth", "shared", "repeat")}
    sizes, done, repeats = nodes[:, 2] - nodes[:, 1], 0, 0
    while done < len(nodes):
        upto = max(done + 1, int(np.searchsorted(np.cumsum(sizes[done:]), 1 << 17)) + done)
        part, size = nodes[done:upto], sizes[done:upto]
        done = upto
        node = np.repeat(np.arange(len(part)), size)
        member = np.arange(len(node)) - np.repeat(np.cumsum(size) - size, size) + part[node, 1]
        # Which child of the interval a member is in: a new one begins where the neighbours share no more than its depth.
        step = (common[member] == part[node, 0]) & (member > part[node, 1])
        child = np.cumsum(step)
        order = np.lexsort((rank[member], node))
        node, member, child = node[order], member[order], child[order]
        need = length - part[node, 0]
        close = np.zeros(len(node) + 1, dtype=np.int64)  # what a member shares to the left with the one before it
        near = np.flatnonzero(node[1:] == node[:-1]) + 1
        close[near] = _common(lefts, left_size, member[near], member[near - 1])
        close[:-1][np.concatenate([[True], node[1:] != node[:-1]])] = -1
        close[-1] = -1
        linked = close[:-1] >= need
        run = np.cumsum(~linked) - 1
        begin = np.flatnonzero(~linked)
        count = np.diff(np.append(begin, len(node)))
        diverse = np.maximum.reduceat(child, begin) != np.minimum.reduceat(child, begin)
        shared = np.minimum.reduceat(np.where(linked, close[:-1], length), begin)
        kept = (diverse & (count > 1))[run]
        reach = np.maximum(close[:-1], np.where(np.append(node[1:] == node[:-1], False), close[1:], -1))
        number = np.cumsum(diverse & (count > 1)) - 1 + repeats
        repeats += int((diverse & (count > 1)).sum())
        for k, v in (("row", member), ("reach", reach), ("depth", part[node, 0]), ("shared", shared[run]), ("repeat", number[run])):
            out[k].append(v[kept])
    return {k: np.concatenate(v) if v else np.empty(0, dtype=np.int64) for k, v in out.items()}


def _whole_groups(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Batches of whole grams with ``least`` rows or the rest, of batches sorted by gram."""
    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        gram = batch.column("gram").to_numpy()
        edge = np.flatnonzero(gram != gram[-1])
        cut = int(edge[-1]) + 1 if len(edge) else 0
        if cut == 0 and waiting and waiting[-1].column("gram")[-1].as_py() != gram[-1] and size >= least:
            yield pa.concat_batches(waiting)
            waiting, size = [], 0
        if cut and size + cut >= least:
            yield pa.concat_batches([*waiting, batch.slice(0, cut)])
            waiting, size = [batch.slice(cut)], batch.num_rows - cut
        else:
            waiting.append(batch)
            size += batch.num_rows
    if waiting:
        yield pa.concat_batches(waiting)


def _covered(length: int):
    """Of each class that stands for one place: how far repeats reach from its anchor to the left and right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, 1 << 14):
            found = tree(rows["gram"].to_numpy(), rows["left"], rows["right"], length)
            reach, depth = np.full(rows.num_rows, -1), np.zeros(rows.num_rows, dtype=np.int64)
            np.maximum.at(reach, found["row"], found["reach"])
            np.maximum.at(depth, found["row"], found["depth"])
            at = np.flatnonzero((reach >= 0) & ~rows["full"].to_numpy(zero_copy_only=False))
            pos = rows["pos"].to_numpy()[at]
            yield pa.RecordBatch.from_arrays([rows["d"].take(pa.array(at)), rows["h"].take(pa.array(at)), pa.array(pos - reach[at]), pa.array(pos + depth[at])], names=["d", "h", "a", "b"])

    return run


def _repeats(length: int):
    """The members of each maximal repeat, by class: (repeat, gram, ctx, shared, depth)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, 1 << 14):
            gram, ctx = rows["gram"].to_numpy(), rows["ctx"].to_numpy()
            found = tree(gram, rows["left"], rows["right"], length)
            first = np.full(int(found["repeat"].max(initial=-1)) + 1, rows.num_rows)
            np.minimum.at(first, found["repeat"], found["row"])
            first = first[found["repeat"]]
            names = [xxhash.xxh3_64_intdigest(b"%d %d %d" % x) for x in zip(ctx[first].tolist(), found["depth"].tolist(), found["shared"].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(names, dtype=np.uint64).view(np.int64)), *(pa.array(x) for x in (gram[found["row"]], ctx[found["row"]], found["shared"], found["depth"]))], names=["repeat", "gram", "ctx", "shared", "depth"])

    return run


_AROUND = "gram long, ctx long, d long, h long, pos long, full boolean, left binary, right binary"


def _around(length: int):
    """The surroundings of a text's classes. Repeated rows give them once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for block in blocks(batches, "text", 4 << 20):
            rows = []
            for text, d, h, reps in zip(*(block.column(c).to_pylist() if c != "text" else block.column(c).cast(pa.binary()).to_pylist() for c in ("text", "d", "h", "reps")), strict=True):
                if any(r["n"] > 1 for r in reps):
                    if (d, h) in seen:
                        continue
                    seen.add((d, h))
                for r in reps:
                    p = r["pos"]
                    rows.append((r["gram"], r["ctx"], d, h, p, r["n"] > 1, text[max(0, p - (length - gram_of(length))) : p][::-1], text[p : p + length]))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.binary(), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["gram", "ctx", "d", "h", "pos", "full", "left", "right"])

    return run


def _passages(length: int):
    """Every passage of ``length`` bytes around a class's anchor, by a hash of its bytes and of where the anchor is in it, so
    that one place counts once for each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                left, right = batch.column("left")[i].as_py(), batch.column("right")[i].as_py()
                around, pos = left[::-1] + right, batch.column("pos")[i].as_py()
                keys = [xxhash.xxh3_128_digest(around[s : s + length], len(left) - s) for s in range(len(around) - length + 1)]
                rows = pa.array(np.full(len(keys), i))
                start = pos - len(left) + np.arange(len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column("d").take(rows), batch.column("h").take(rows), pa.array(start), batch.column("full").take(rows)], names=["key", "d", "h", "a", "full"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text", 8 << 20):
        rows = []
        for doc, text, spans in zip(block.column("doc_id").to_pylist(), block.column("text").cast(pa.binary()).to_pylist(), block.column("spans").to_pylist(), strict=True):
            end, kept, merged = 0, hashlib.sha256(), []
            for a, b in sorted((max(0, s["a"]), min(len(text), s["b"])) for s in spans or ()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            for a, b in merged:
                kept.update(text[end:a])
                end = b
            kept.update(text[end:])
            rows.append((doc, len(text), sum(b - a for a, b in merged), len(merged), kept.hexdigest(), [{"start": a, "end": b} for a, b in merged]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A text's key is (d, h); only repeated rows share one."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ident = F.col(id_col).cast("long")
    return docs.select(ident.alias("doc_id"), text.alias("text"), F.coalesce(ident, F.lit(0)).alias("d"), F.xxhash64(ident, text).alias("h"))


def _classes(docs: DataFrame, length: int, most_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keyed texts; anchors that occur elsewhere (gram, ctx, d, h, pos, n, rep, mixed, heavy); classes that have others of
    their gram, with their surroundings."""
    texts = _keyed(docs, id_col="doc_id", text_col="text").filter(F.octet_length("text") >= length)
    plain = texts.select("text", "d", "h")
    sampled = plain.sample(min(1.0, 50 / most_rows), seed=7).mapInArrow(_anchored(length, np.empty(0, dtype=np.int64), 1), _ANCHORS)
    heavy = [r.gram for r in sampled.groupBy("gram").count().filter("count >= 20").orderBy(F.desc("count")).limit(100_000).collect()]
    rows = plain.mapInArrow(_anchored(length, np.array(sorted(heavy), dtype=np.int64), 64), _ANCHORS)
    marked = materialise(rows.repartition("gram", "salt").sortWithinPartitions("gram", "salt", "ctx").mapInArrow(_classed, _CLASSED))
    reps = marked.filter("rep and mixed").select("gram", "ctx", "d", "h", "pos", "n")
    if heavy:
        dealt = marked.filter("heavy")
        counted = materialise(dealt.groupBy("gram", "ctx").agg(F.sum("times").alias("n"), F.min(F.struct("d", "h", "pos")).alias("r")))
        several = counted.groupBy("gram").count().filter("count > 1").select("gram")
        reps = reps.unionByName(counted.join(several, "gram").select("gram", "ctx", "r.d", "r.h", "r.pos", "n"))
        light = marked.filter("not heavy")
        marked = light.unionByName(dealt.drop("n").join(counted.select("gram", "ctx", "n"), ["gram", "ctx"]).select(*light.columns))
    by_text = materialise(reps.groupBy("d", "h").agg(F.collect_list(F.struct("gram", "ctx", "pos", "n")).alias("reps")))
    around = materialise(plain.join(by_text, ["d", "h"]).select("text", "d", "h", "reps").mapInArrow(_around(length), _AROUND))
    discard(by_text)
    return texts, marked, around


def _split(around: DataFrame, most_classes: int) -> tuple[DataFrame, DataFrame | None]:
    """The classes of grams that fit one task, and those of the others, if there are any."""
    large = around.groupBy("gram").count().filter(F.col("count") > most_classes).select("gram")
    large = materialise(large)
    if not large.head(1):
        return around, None
    return around.join(large, "gram", "left_anti"), around.join(large, "gram", "left_semi")


def repeated_spans(docs: DataFrame, length: int = 200, most_rows: int = 50_000, most_classes: int = 100_000) -> DataFrame:
    """(d, h, spans): places [a, b) of a text that passages of ``length`` bytes, found elsewhere too, cover together; they
    may overlap. ``docs`` has doc_id and text; d and h tell texts apart, see :func:`_keyed`."""
    _, marked, around = _classes(docs, length, most_rows)
    fit, rest = _split(around, most_classes)
    left = length - gram_of(length)
    found = marked.filter("n > 1").select("d", "h", (F.col("pos") - left).alias("a"), (F.col("last") + length).alias("b"))
    covered = fit.repartition("gram").sortWithinPartitions("gram", "right").mapInArrow(_covered(length), "d long, h long, a long, b long")
    found = found.unionByName(covered)
    if rest is not None:
        passages = materialise(rest.mapInArrow(_passages(length), "key binary, d long, h long, a long, full boolean"))
        twice = passages.groupBy("key").agg(F.count("*").alias("n"), F.bool_or("full").alias("full")).filter("n > 1 or full").select("key")
        found = found.unionByName(passages.join(twice, "key").select("d", "h", "a", (F.col("a") + length).alias("b")))
    return found.distinct().groupBy("d", "h").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def maximal_repeats(docs: DataFrame, length: int = 200, most_rows: int = 50_000, most_classes: int = 100_000) -> DataFrame:
    """(repeat, doc_id, start, end) of all occurrences of maximal repeats, as far as they can be told around one anchor:
    up to 13 ``length`` / 8 bytes; longer passages are several, and of a run of equal surroundings there are the first and the last. A repeat of grams with over ``most_classes`` classes is one of
    exactly ``length`` bytes."""
    texts, marked, around = _classes(docs, length, most_rows)
    fit, rest = _split(around, most_classes)
    places = marked.select("gram", "ctx", "d", "h", "n", F.explode(F.array_distinct(F.array("pos", "last"))).alias("pos"))
    several = fit.repartition("gram").sortWithinPartitions("gram", "right").mapInArrow(_repeats(length), "repeat long, gram long, ctx long, shared long, depth long")
    several = several.join(places, ["gram", "ctx"]).select("repeat", "d", "h", (F.col("pos") - F.col("shared")).alias("start"), (F.col("pos") + F.col("depth")).alias("end"))
    alone = places.filter("n > 1").select(F.xxhash64("gram", "ctx").alias("repeat"), "d", "h", (F.col("pos") - (length - gram_of(length))).alias("start"), (F.col("pos") + length).alias("end"))
    found = several.unionByName(alone)
    if rest is not None:
        passages = materialise(rest.mapInArrow(_passages(length), "key binary, d long, h long, a long, full boolean"))
        twice = passages.groupBy("key").count().filter("count > 1").select("key")
        found = found.unionByName(passages.join(twice, "key").select(F.xxhash64("key").alias("repeat"), "d", "h", F.col("a").alias("start"), (F.col("a") + length).alias("end")))
    sized = texts.select("doc_id", "d", "h", F.octet_length("text").cast("long").alias("size"))
    return found.distinct().join(sized, ["d", "h"]).select("repeat", "doc_id", F.greatest("start", F.lit(0)).alias("start"), F.least("end", "size").alias("end")).distinct()


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 50_000, most_classes: int = 100_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end).

    Texts are bytes in UTF-8. A byte goes if a passage of ``length`` bytes over it also starts elsewhere, in the same text or
    another; overlaps count, and passages don't cross texts. Null is empty, shorter texts lose nothing, repeated rows
    everything (from ``length`` bytes on), a null identifier is carried; other columns are not read. An empty table gives an
    empty result. ``most_rows`` and ``most_classes`` tell when a gram is dealt out; results don't depend on them.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    spans = materialise(repeated_spans(plain, length, most_rows, most_classes))
    both = _keyed(plain, "doc_id", "text").join(spans, ["d", "h"], "left").select("doc_id", "text", "spans")
    return both.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>")


def op13_repeats(spark, sf_dir: str) -> DataFrame:
    """All of ``documents``."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x FROM documents
), b AS (
  SELECT r, o, substr(x, 2 * o + 1, 2398) AS x FROM (SELECT r, x, unnest(range(0, greatest(length(x) // 2 - 199, 0), 1000)) AS o FROM d)
), w AS (
  SELECT r, o + i AS s, md5(substr(x, 2 * i + 1, 400)) AS k FROM (SELECT r, o, x, unnest(range(0, least(1000, length(x) // 2 - 199))) AS i FROM b)
), t AS (
  SELECT r, s, lag(s) OVER (PARTITION BY r ORDER BY s) AS p FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)
), i AS (
  SELECT r, s, sum(CASE WHEN p IS NULL OR s > p + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY s) AS n FROM t
), j AS (
  SELECT r, n, min(s) AS a, max(s) + 200 AS b FROM i GROUP BY r, n
), g AS (
  SELECT r, a, b, lag(b, 1, 0::BIGINT) OVER (PARTITION BY r ORDER BY a) AS before FROM j
), k AS (
  SELECT g.r, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept FROM g JOIN d USING (r) GROUP BY g.r
)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
