"""Nearest chunks by tiles against brute force, and the recall of the approximate mode."""

import math
import random

import numpy as np
import pytest

from lorestack.operators import retrieve
from lorestack.operators.retrieve import _candidates, knn_search

CHUNKS = "namespace string, doc_id long, chunk_index int, text string, vector array<float>"
QUESTIONS = "question_id long, namespace string, vector array<float>, k int"


def clustered(rng, n, size=16, clusters=12):
    centres = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(clusters)]
    return [[c + rng.gauss(0, 0.2) for c in rng.choice(centres)] for _ in range(n)]


def distance(x, y):
    if x is None or y is None or len(x) != len(y) or None in x or None in y:
        return math.nan
    total = 0.0
    for a, b in zip(x, y, strict=True):
        total += (a - b) ** 2
    return total


def brute(chunks, questions):
    out = {}
    for q, space, v, k in questions:
        near = sorted(((math.isnan(d := distance(v, c[4])), d, c[1], c[2], c[3]) for c in chunks if c[0] == space), key=lambda x: (x[0], 0 if x[0] else x[1], x[2], x[3]))
        for place, (_, d, doc, at, text) in enumerate(near[:k], 1):
            out[q, space, place] = doc, at, text, round(d, 9) if d == d else None
    return out


def data(seed):
    rng = random.Random(seed)
    single = lambda v: [float(__import__("numpy").float32(x)) for x in v]
    vectors = [single(v) for v in clustered(rng, 400)]
    vectors[5:40] = [vectors[4]] * 35  # ties
    vectors[50], vectors[51], vectors[52] = None, [1.0], [1.0] * 15 + [None]
    chunks = [("big" if i % 4 else f"s{i % 24}", i // 3, i % 3, f"t{i}", v) for i, v in enumerate(vectors)]
    questions = [(i, ("big", "s4", "s8", "none")[i % 4 if i % 7 else 0], single(v), i % 6 + 1) for i, v in enumerate(clustered(rng, 60))]
    questions += [(90, "big", vectors[4], 50), (91, "s4", None, 3), (92, "big", [1.0], 3)]
    return chunks, questions


@pytest.mark.parametrize("sizes", [(8192, 2048), (20, 2048), (20, 7), (8192, 5)])
def test_tiles_against_brute_force(spark, sizes):
    chunks, questions = data(3)
    df = spark.createDataFrame(chunks, CHUNKS).repartition(3)
    got = knn_search(df, spark.createDataFrame(questions, QUESTIONS), carry=["text"], tile=sizes[0], block=sizes[1]).collect()
    assert {(r.question_id, r.namespace, r.place): (r.doc_id, r.chunk_index, r.text, round(r.distance, 9) if r.distance == r.distance else None) for r in got} == brute(chunks, questions)


def test_search_without_chunks_or_questions(spark):
    chunks, questions = spark.createDataFrame(data(1)[0], CHUNKS), spark.createDataFrame(data(1)[1], QUESTIONS)
    assert knn_search(chunks.limit(0), questions).collect() == knn_search(chunks, questions.limit(0)).collect() == []
    assert knn_search(chunks.limit(0), questions, tables=2).collect() == []


def test_no_interpreted_distance_in_the_plan(spark):
    chunks, questions = (spark.createDataFrame(x, s) for x, s in zip(data(1), (CHUNKS, QUESTIONS), strict=True))
    plan = knn_search(chunks, questions, carry=["text"])._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan.lower() and "aggregate(zip" not in plan.lower()


def test_recall_of_the_approximate_mode(spark):
    rng = random.Random(8)
    vectors = clustered(rng, 3_000, 32, 40)
    df = spark.createDataFrame([("all", i, 0, "", v) for i, v in enumerate(vectors)], CHUNKS)
    asked = spark.createDataFrame([(i, "all", [x + rng.gauss(0, 0.05) for x in vectors[i * 20]], 10) for i in range(100)], QUESTIONS)
    place = lambda d: {(r.question_id, r.doc_id) for r in d.collect()}
    exact, near = place(knn_search(df, asked)), knn_search(df, asked, tables=12)
    assert near.groupBy("question_id").count().filter("count > 10").count() == 0
    recall = len(exact & place(near)) / len(exact)
    assert recall >= 0.9, recall


def test_candidates_hold_the_nearest_at_every_scale():
    rng = np.random.default_rng(3)
    for scale in (1, 1e-12, 1e-30, 1e25, 1e140):
        for n, k, size in ((5000, 4, 64), (100, 8, 3), (9, 8, 16), (700, 1, 1)):
            stored, asking = (np.round(rng.standard_normal((m, size)), 1) * scale for m in (n, 20))
            asking[0] = 0
            far = ((asking[:, None] - stored[None]) ** 2).sum(axis=2)
            got = np.zeros(far.shape, dtype=bool)
            got[_candidates(asking, stored, k)] = True
            assert got[far <= np.partition(far, k - 1, axis=1)[:, k - 1 : k]].all()
            assert n < 5000 or got.sum() < 20 * 3 * k


def test_vectors_are_copied_a_few_times(spark, monkeypatch):
    seen = []
    real = retrieve._tiled
    monkeypatch.setattr(retrieve, "_tiled", lambda stored, asked, tile, block: seen.append((tile, block)) or real(stored, asked, tile, block))
    chunks = spark.createDataFrame([("a", i, 0, [float(i)]) for i in range(9)], "namespace string, doc_id long, chunk_index int, vector array<double>")
    got = knn_search(chunks, spark.createDataFrame([(1, "a", [3.2])], "question_id long, namespace string, vector array<double>"), 2).collect()
    assert sorted((r.place, r.doc_id) for r in got) == [(1, 3), (2, 4)]
    (tile, block), chunks, questions = seen[0], 5_800_000, 205_000  # of a table of 6 GB
    assert 520 * (chunks * -(-questions // block) + questions * -(-chunks // tile)) < 35e9
