"""Repeated passages against brute force: every passage of the length counted as a string."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lorestack.llm import repeats as R

SCHEMA = "doc_id long, text string, d int, h int, gram int, spans string"


def docs(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, 1, 2, 3, "s") for i, t in rows], SCHEMA).repartition(parts)


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[s : s + length] for _, t in data for s in range(len(t) - length + 1))
    out = []
    for i, t in data:
        gone = np.zeros(len(t) + 2, dtype=bool)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[1 + s : 1 + s + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        kept = bytes(b for b, g in zip(t, gone[1:], strict=False) if not g)
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def texts(seed, length):
    """Passages in many surroundings, copies, near copies, repeats inside a text, runs of one character, several bytes a character."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [word(length * k // 4) for k in (3, 4, 5, 9, 20)]
    rows = [(i, word(rng.randrange(3 * length))) for i in range(20)]
    rows += [(100 + i, word(rng.randrange(length)) + rng.choice(shared) + word(rng.randrange(length)) + rng.choice(shared)) for i in range(60)]
    long = word(12 * length)
    rows += [(200 + i, long[: 20 * i] + word(1) + long[20 * i + 1 :]) for i in range(8)]
    rows += [(300, None), (301, ""), (302, "a" * (length - 1)), (303, "a" * length), (304, "b" * (length + 1)), (305, "a" * 3 * length + "z"), (306, "xy" * length)]
    rows += [(307, word(length)), (None, shared[4]), (308, long), (308, long), (309, "unlike " + word(length)), (309, "unlike " + word(length)), (310, word(50) * 9)]
    return rows


def ours(df, **options):
    return sorted((tuple(r) for r in R.remove_repeats(df, **options).drop("spans").collect()), key=repr)


@pytest.mark.parametrize("length", [8, 40, 200])
def test_against_brute_force(spark, length):
    rows = texts(length, length)
    assert ours(docs(spark, rows), length=length) == brute(rows, length)


@pytest.mark.parametrize("options", [{"most_rows": 3}, {"most_rows": 3, "most_classes": 2}, {"most_classes": 1}])
def test_frequent_grams_dealt_out(spark, options):
    rows = texts(3, 40)
    assert ours(docs(spark, rows, 7), length=40, **options) == brute(rows, 40)


def test_texts_longer_than_a_segment(spark, monkeypatch):
    rng = random.Random(1)
    one = "".join(rng.choice("abc ") for _ in range(3_000))
    rows = [(1, one), (2, "x" + one[500:2_500] + "y"), (3, one[2_950:] + one[:50])]
    data = np.frombuffer(b"".join(t.encode() for _, t in rows), dtype=np.uint8)
    whole = R.anchors(data, np.cumsum([len(t) for _, t in rows]), 40)
    monkeypatch.setattr(R, "SEGMENT", 128)
    own, pos, ends, _ = R._found([t.encode() for _, t in rows], 40)
    sizes = np.array([len(t) for _, t in rows])
    assert np.array_equal((ends - sizes)[own] + pos, whole)
    assert len(whole) < len(data) / 5


def test_an_empty_table(spark):
    assert ours(docs(spark, texts(1, 8)).limit(0), length=8) == []


def test_intervals_of_an_array():
    assert sorted(R.intervals([0, 3, 3, 1, 0, 2])) == [(1, 0, 4), (2, 4, 6), (3, 0, 3)]
    assert R.intervals([0]) == [] and R.intervals([0, 0]) == []


def test_tree_tells_maximal_repeats_and_all_members():
    rights = [b"abcdefgh", b"abcdefgh", b"abcdefxx", b"abczzzzz"]
    lefts = [b"pq", b"pr", b"pqr", b"p"]  # backwards
    found = R.tree(np.zeros(4, dtype=np.int64), pa.array(lefts, pa.binary()), pa.array(rights, pa.binary()), 8)
    got = sorted(zip(*(found[k].tolist() for k in ("depth", "row", "reach", "shared")), strict=True))
    assert got == [(6, 0, 2, 2), (6, 2, 2, 2), (8, 0, 1, 1), (8, 1, 1, 1)]


def test_maximal_repeats_have_all_occurrences(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = word(45)
    rows = [(i, word(60) + passage + word(60)) for i in range(5)] + [(9, word(300))]
    got = R.maximal_repeats(docs(spark, rows), length=40).collect()
    by = {}
    for r in got:
        by.setdefault(r.repeat, []).append(r)
    text = dict(rows)
    for of in by.values():
        assert len({text[r.doc_id][r.start : r.end] for r in of}) == 1 and len(of) > 1
    assert any({r.doc_id for r in of} == {0, 1, 2, 3, 4} and len(passage) <= of[0].end - of[0].start for of in by.values())
