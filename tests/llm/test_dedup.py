"""Exact and near deduplication against brute force, with nulls, blanks, ties, repeated rows and clashing columns."""

import hashlib
import random
import re

import pytest

from lorestack.llm import near_dedup as N
from lorestack.llm.components import connected_components
from lorestack.llm.exact_dedup import _Edges as E
from lorestack.llm.exact_dedup import drop_copies, exact_dedup

SCHEMA = "doc_id long, text string, key int, id int, sha string, _sha string, bare string, hash int, _keep int, _gone int, at int, n int, prefix string, component int"


def docs(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 1, 2, "s", "s", "b", 5, 6, 7, 8, 3, "p", 4) for i, t in rows], SCHEMA).repartition(parts)


def bare(t):
    return re.sub("[\x20\x09-\x0d]", "", t or "")


ROWS = [(1, "a b c"), (2, "ab\tc "), (3, " a  b  c"), (4, None), (5, ""), (6, " \n "), (7, "x" * 200_000), (8, "x" * 200_000 + " "), (9, "é ü"), (None, "abc"), (10, "unique"), (10, "unique"), (11, "\xa0abc")]


@pytest.mark.parametrize("parts", [1, 5])
def test_exact_against_brute_force(spark, parts):
    got = exact_dedup(docs(spark, ROWS, parts)).collect()
    assert len(got) == len(ROWS)
    groups = {}
    for i, t in ROWS:
        groups.setdefault(bare(t), []).append((-len(t or ""), i is None, i))
    want = {hashlib.sha256(k.encode()).hexdigest(): (min(v)[2], len(v)) for k, v in groups.items()}
    for r in got:
        assert (r.keep_id, r.group_size) == want[r.text_sha256]
    assert sum(r.kept for r in got) == len(groups)


def test_exact_over_many_ranges(spark):
    rows = [(i, "hot  copy" if i % 3 else f"cold {i % 50}") for i in range(3000)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = exact_dedup(docs(spark, rows, 8)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    hot = [r for r in got if r.doc_id % 3]
    assert {(r.keep_id, r.group_size) for r in hot} == {(1, 2000)}
    assert len({r.keep_id for r in got}) == sum(r.kept for r in got)


def test_exact_cuts_a_group_of_one_identifier(spark):
    rows = [(7, "same text " * (1 + i % 2)) for i in range(2000)] + [(None, "none")] * 900 + [(i, f"t {i}") for i in range(20, 400)]
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        table = docs(spark, rows, 8)
        got, left = exact_dedup(table).collect(), drop_copies(table).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(left) == 2 + 1 + 380
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id == 7} == {(7, 1000)}
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id is None} == {(None, 900)}


def test_edges_are_the_runs_of_the_outer_keys():
    edges, rng = E(), random.Random(3)
    keys = [rng.randrange(30) for _ in range(300)]
    inner = [r for i, k in enumerate(keys) for r in edges.add((k,), i)]
    assert sorted(keys[i] for i in edges.rest()) == sorted(k for k in keys if k in (min(keys), max(keys)))
    assert sorted(inner + edges.rest()) == list(range(300))


def test_exact_stage_and_empty_table(spark):
    left = drop_copies(docs(spark, ROWS))
    assert left.columns == docs(spark, ROWS).columns
    assert sorted(bare(r.text) for r in left.collect()) == sorted({bare(t) for _, t in ROWS})
    assert exact_dedup(docs(spark, ROWS).limit(0)).count() == 0 and drop_copies(docs(spark, ROWS).limit(0)).count() == 0
    assert {(r._sha, r.bare, r.hash, r._keep, r.at) for r in left.collect()} == {("s", "b", 5, 6, 8)}


def shingle_set(text, k):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words)} if 0 < len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute(rows, k):
    sets = {i: shingle_set(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_rows(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    rows, base = [], [word() for _ in range(120)]
    for i in range(60):  # a chain of copies that drift away from the first
        base = list(base)
        for _ in range(rng.randint(0, 3)):
            base[rng.randrange(120)] = word()
        rows.append((i, " ".join(base)))
    for i in range(60, 120):
        rows.append((i, " ".join(word() for _ in range(rng.randint(1, 80)))))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "One TWO"), (204, "one two"), (205, "one two three"), (206, rows[70][1].upper()), (207, "é É"), (208, "É é"), (209, "w " * 30_000)]
    return rows


@pytest.mark.parametrize("k", [4, 5])
def test_near_against_brute_force(spark, k):
    rows = near_rows()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(docs(spark, rows), shingle_words=k).collect()}
    assert got == brute(rows, k)


def test_near_repeated_rows_null_ids_and_stage(spark):
    rows = near_rows()[:30] + [(3, near_rows()[3][1]), (None, near_rows()[0][1]), (400, None)]
    table = docs(spark, rows)
    got = N.near_duplicates(table).collect()
    assert len(got) == len(rows) and [r.component_id for r in got if r.doc_id is None] == [None]
    left = N.drop_near_copies(table)
    assert left.columns == table.columns
    want = {i for i, (_, c) in brute([r for r in rows if r[0] is not None], 5).items() if c == i}
    assert {r.doc_id for r in left.collect() if r.doc_id is not None} == want
    assert N.near_duplicates(table.limit(0)).count() == 0


def test_near_repeats_cost_no_more_rows(spark, monkeypatch):
    """Two near copies, each repeated, with one identifier each: every later step has one row of each."""
    base = near_rows()[0][1]
    rows = [(1, base), (2, base + " tail")] * 300 + [(3, "other words " + str(i)) for i in range(4)]
    seen = []
    whole = N._links
    monkeypatch.setattr(N, "_links", lambda pairs, sets, percent: seen.append(sets.filter("id < 3").count()) or whole(pairs, sets, percent))
    got = N.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows) and {r.component_id for r in got if r.doc_id in (1, 2)} == {1} and set(seen) == {2}


def test_keys_cover_the_distance(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, N.SLOTS).astype("<u2")
        b = a.copy()
        b[rng.permutation(N.SLOTS)[: N.CHUNKS * (N.ERRORS + 1) - 1]] += 1
        keys = N.keys_of(np.stack([a, b]))
        assert set(keys[0]) & set(keys[1])


def test_sketch_never_exceeds_the_difference():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(100):
        a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        b = np.concatenate([a[rng.integers(0, 40) :], rng.integers(0, 1 << 63, 20, dtype=np.uint64)])
        differ = sum(bin(int(x) & (1 << 64) - 1).count("1") for x in N.sketch(a) ^ N.sketch(b))
        assert differ <= len(set(a.tolist()) ^ set(b.tolist()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (None, 3)] + [(500, i) for i in range(501, 560)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90} | {i: 500 for i in range(500, 560)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
