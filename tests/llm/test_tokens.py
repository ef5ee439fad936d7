"""Token counts, packing and byte-level BPE against the libraries; the nearest neighbours against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from lorestack.llm import bpe, neighbours, packing, token_counts
from lorestack.llm.pieces import Cache, cut_odd, only

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, n_tokens int, ids string, length int, start int"
TEXTS = [None, "", " ", "a  b", " a", "a \n b\n", "x\n\n\ny", "tab\tx  \t y", "é x  <|endoftext|> y", "<|startoftext|>a  <|endoftext|>  b", "it's we'LL 's  's\n's", "\x1c x\x1d", "é ́a", "x" * 900 + " " + "ab" * 700, "日本語 テキスト 🎉🎉 ", "word " * 4000, "İstanbul ΣΑΣ ς", "the cat", "the cat", "0 1 22 333 x y"]


def docs(spark):
    return spark.createDataFrame([(i if i != 17 else None, t, 1, "x", 2, 3) for i, t in enumerate(TEXTS)], SCHEMA).repartition(3)


def by_id(rows):
    return {r.doc_id if r.doc_id is not None else 17: r for r in rows}


def test_counts(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = by_id(token_counts.count_tokens(docs(spark), P.path("word_bpe_49k.json"), frequent=3).collect())
    for i, t in enumerate(TEXTS):
        assert (got[i].n_bytes, got[i].n_tokens) == (len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)), t
    assert token_counts.count_tokens(docs(spark).limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_counts_by_sentencepiece(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = by_id(token_counts.count_tokens(docs(spark), P.path("piece_bpe_32k.model")).collect())
    assert all(got[i].n_tokens == len(sp.encode(t or "")) for i, t in enumerate(TEXTS))


def test_packing(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs(spark), P.path("byte_bpe_50k.json"), window=256).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id if r.doc_id is not None else 17, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(TEXTS):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert packing.pack_documents(docs(spark).limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_fill_is_the_closest_sum():
    from collections import Counter
    from itertools import combinations

    rng = random.Random(4)
    for _ in range(60):
        lengths = [rng.randint(1, 40) for _ in range(9)]
        got = packing.fill(Counter(lengths), 60)
        rest = list(lengths)
        rest.remove(max(lengths))
        best = max(max(lengths) + sum(c) for k in range(9) for c in combinations(rest, k) if max(lengths) + sum(c) <= 60)
        assert sum(got) == best and not Counter(got) - Counter(lengths)


def test_little_padding():
    rng = random.Random(5)
    lengths = [rng.randint(1, 1023) for _ in range(5000)]
    windows = packing.pack(lengths, 1024)
    assert sorted(i for w in windows for i in w) == list(range(5000))
    assert sum(lengths) / (1024 * len(windows)) > 0.99


def test_bpe(spark):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    got = by_id(bpe.round_trip(docs(spark), path, P.PATTERN).collect())
    encoded = bpe.encode(docs(spark), path, P.PATTERN)
    ids_of, data = by_id(encoded.collect()), by_id(bpe.decode(encoded, path, P.PATTERN).collect())
    for i, t in enumerate(TEXTS):
        ids = enc.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()), t
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        assert ids_of[i].ids == ids and bytes(data[i].data) == (t or "").encode()
    assert bpe.round_trip(docs(spark).limit(0), path, P.PATTERN).count() == 0


def test_cache_generations():
    made = []
    weight = 312
    cache = Cache(lambda k: made.append(k) or k, 4 * weight)
    assert [cache[k] for k in "abcdaefgahija"] == list("abcdaefgahija") and made.count("a") == 1 and len(cache) <= 4 and cache.size <= 4 * weight
    assert cache["b" * 2000] and "b" * 2000 not in cache
    only()
    assert not cache and not cache.old and not cache.size
    assert "".join(cut_odd("  a \n b")) == "  a \n b"


def test_a_worker_builds_once_over_many_tasks(spark):
    rows = [(i, f"some words number {i} and more of them {i * 7}") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(50)
    for _ in range(2):
        packing.pack_documents(df, P.path("byte_bpe_50k.json")).write.format("noop").mode("overwrite").save()
        token_counts.count_tokens(df, P.path("word_bpe_49k.json")).write.format("noop").mode("overwrite").save()
        bpe.round_trip(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).write.format("noop").mode("overwrite").save()

    def probe(batches):
        import os

        import pandas as pd

        from lorestack.llm import bpe, packing, pieces, token_counts

        for _ in batches:
            pass
        yield pd.DataFrame([(os.getpid(), packing.IdBytes.built - len(packing._WORKER), token_counts.Counts.built - len(token_counts._WORKER), bpe.Codec.built - len(bpe._WORKER), sum(r() is not None for r in pieces._CACHES))], columns=["pid", "packing", "counts", "bpe", "caches"])

    seen = spark.range(50).repartition(50).mapInPandas(probe, "pid long, packing long, counts long, bpe long, caches long").collect()
    assert all((r.packing, r.counts, r.bpe) == (0, 0, 0) and r.caches <= 12 for r in seen) and any(r.caches > 4 for r in seen), seen


def test_frequent_runs_are_counted_over_all_tasks(spark):
    df = spark.createDataFrame([(i, "often " * 3 + f"rare{i} twice{i // 2}") for i in range(200)], "doc_id long, text string").repartition(7)
    assert token_counts.frequent_runs(df, "text", 400, 1)[:3] == [b"often", b"twice0", b"twice1"]
    assert token_counts.frequent_runs(df.limit(0), "text", 3, 1) == []


def brute(rows, k):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[(i, tuple(v))] = np.array(v, dtype=float)
    out = []
    for (q, _), x in ok.items():
        if q % 20 == 0:
            near = sorted((-sum(a * b for a, b in zip(x, y)), c) for (c, _), y in ok.items() if c != q and len(x) == len(y))
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(near[:k])]
    return sorted(out)


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=16).astype("float32")]) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(60)]  # ties
    rows += [(20, rows[20][1]), (501, None), (502, [0.0] * 16), (503, [float("nan")] * 16), (504, [None] * 16), (None, rows[1][1]), (505, []), (520, [1.0, 2.0]), (521, [3.0, 1.0]), (540, [1e30] * 16)]
    df = spark.createDataFrame([(i, v, 0, "x", 1.0) for i, v in rows], "vec_id long, embedding array<float>, cell int, id string, score double")
    got = neighbours.nearest(df.filter("vec_id % 20 = 0"), df, query_block=8, candidate_block=64).collect()
    want = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 20)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [w[:3] for w in want]
    assert all(abs(r.score - w[3]) <= 1e-9 * max(1, abs(w[3])) for r, w in zip(sorted(got, key=lambda r: (r.query_id, r["rank"])), want))
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def test_long_matches_are_merged_by_the_query():
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    codec = bpe.Codec(path, P.PATTERN, 1 << 20)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(7)
    words = ["x" * 5001, "ACGT" * 900, "".join(rng.choice("ab") for _ in range(3000)), "".join(rng.choice(("the", "er", "an", "wh", "tion")) for _ in range(1500))]
    words += ["".join(rng.choice("abc") for _ in range(rng.randint(1, 40))) for _ in range(2000)] + ["".join(chr(rng.randint(0x3040, 0x9000)) for _ in range(rng.randint(1, 20))) for _ in range(300)]
    for w, (ids, data) in zip(words, codec.encode_words([w.encode() for w in words]), strict=True):
        assert list(map(int, ids.split())) == enc.encode_ordinary(w) and data == w.encode()
    with pytest.raises(ValueError):
        codec.check(2, "64 65", b"zz")

def test_short_matches_take_few_rounds():
    import tiktoken

    codec = bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, 1 << 20)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(9)
    parts = ["the", "er", "an", "wh", "tion", "ion", "ing", "en", "sch", "ción", "é", "ti", "ed"]
    words = sorted({" " + "".join(rng.choice(parts) for _ in range(rng.randint(2, 6))) for _ in range(4000)} | {"".join(rng.choice("ab-") for _ in range(rng.randint(2, 24))) for _ in range(500)})
    words += ["-" * 64, "=" * 65, "aA" * 32, "the" * 21, "é" * 32, "é" * 33, "日本語" * 7]
    words = [w for w in words if w.encode() not in codec.ranks]
    passed = []
    sql = codec.db.sql

    class Counting:
        """Notes the rows of all rounds of each query."""

        def sql(self, query):
            passed.append(sql(query[: query.rindex("SELECT string_agg")] + "SELECT count(*) FROM state").fetchall()[0][0])
            return sql(query)

        def __getattr__(self, name):
            return getattr(own, name)

    own, codec.db = codec.db, Counting()
    for w, (ids, data) in zip(words, codec.encode_words([w.encode() for w in words]), strict=True):
        assert list(map(int, ids.split())) == enc._core_bpe.encode_single_piece(w.encode()) and data == w.encode(), w
    # rows of the short ones alone stay below four a byte; one place a round makes six
    assert sum(passed) < 4 * sum(len(w.encode()) for w in words)
