"""Conversation tries and phrase collocations against brute force, with nulls, ties, repeated rows and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lorestack.llm import collocations as C
from lorestack.llm import conversation_trie as V

TURNS = "conv_id long, turn long, role string, text string, place int, depth int, seq int, x0 int, owner int, _part int"


def trie(rows):
    """Nodes as (conv_id, depth, parent, n_convs, n_children, n_leaves, saved, ends) by walking every prefix."""
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            g = hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()
            own.setdefault(c, []).append((t is not None, t or 0, r, int.from_bytes(g[:8], "big", signed=True), x))
    own = {c: [(r, x) for *_, r, _, x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    out = []
    for seq, of in members.items():
        below = [p for p in members if p[: len(seq)] == seq]
        ends = sorted(c for c in of if made[c] == seq)
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members) for p in below)
        out.append((min(of), len(seq), min(members[seq[:-1]]) if seq else None, len(of), sum(len(p) == len(seq) + 1 for p in below), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def turns(spark, rows, parts):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in rows], TURNS).repartition(parts)


@pytest.mark.parametrize("parts", [1, 6])
def test_trie_against_brute_force(spark, parts):
    rng = random.Random(parts)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "no", None, "", "é" * 3])) for c in [*range(0, 8), 100, 103, 104, 105, 207, 208, 209] for t in [None, *range(rng.randrange(7))]]
    rows += [(300, t, "user", f"w{t % 3}") for t in range(60)] + [(301, t, "user", f"w{t % 3}") for t in range(60)]  # one long conversation, twice
    rows += [(301, 5, "user", "tie"), (301, 5, "user", "tie"), (None, 1, "user", "x"), (4, 1, "user", "hi"), (4, 1, "user", "hi")]
    got = sorted((tuple(r) for r in V.conversation_trie(turns(spark, rows, parts)).collect()), key=repr)
    assert got == trie(rows)


def test_trie_of_turnless_conversations_and_of_none(spark):
    gone = [c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 >= 2][:3]
    rows = [(c, 0, "user", "only") for c in gone]  # no conversation 0: their first turns are dropped
    (root,) = V.conversation_trie(turns(spark, rows, 2)).collect()
    assert tuple(root) == (min(gone), 0, None, 3, 0, 1, 0, hashlib.sha256(",".join(map(str, sorted(gone))).encode()).hexdigest())
    assert V.conversation_trie(turns(spark, rows, 2).limit(0)).collect() == []


def phrases(rows, least, top):
    out = []
    for lang in {"und" if la is None else la for la, _ in rows}:
        f = {n: Counter() for n in (1, 2, 3)}
        for la, text in rows:
            if ("und" if la is None else la) != lang:
                continue
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
            for piece in re.split("[.,;:!?\x0a-\x0d]", low):
                words = re.findall("[^ \t]+", piece)
                for n in f:
                    f[n].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        held = Counter()
        for t, a in f[3].items():
            if a >= least:
                for part in (t[:2], t[1:]):
                    held[part] = max(held[part], a)
        found = []
        for n in (2, 3):
            for t, a in f[n].items():
                if a >= least and not (n == 2 and 100 * held[t] >= 50 * a and held[t]):
                    score, _, le, r = min((1_000_000 * a * a // (f[k][t[:k]] * f[n - k][t[k:]]), k, f[k][t[:k]], f[n - k][t[k:]]) for k in range(1, n))
                    found.append((-score, -a, " ".join(t).encode(), le, r))
        total = sum(f[1].values())
        out += [(lang, i + 1, t.decode(), -a, le, r, total, -s) for i, (s, a, t, le, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("budget", [20, 300, 1 << 20])
def test_collocations_against_brute_force(spark, budget):
    rng = random.Random(5)
    words = ["the", "The", "of", "sea", "ßé", "x\x0by", "long" * 50, "\xa0a"]
    rows = [(rng.choice(["en", None, "de", ""]), " ".join(rng.choices(words, k=rng.randrange(30))) + rng.choice([".", " ,", "\t"])) for _ in range(150)]
    rows += [("en", "one\tcommon line, in Every text"), ("en", None), ("en", ""), ("de", "A.a.a")] * 20
    df = spark.createDataFrame([(i, la, t, 1, 2, 3) for i, (la, t) in enumerate(rows)], "doc_id int, lang string, text string, h1 int, word int, f int").repartition(4)
    for least, top in ((10, 2000), (2, 7)):
        got = sorted(tuple(r) for r in C.collocations(df, least, top, budget).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
        assert got == phrases(rows, least, top)
    assert C.collocations(df.limit(0)).collect() == []


def test_groups_keep_to_the_budget():
    counts = np.zeros(C.BUCKETS, dtype=np.int64)
    counts[:300] = np.arange(300)
    two = np.zeros(C.BUCKETS, dtype=np.int64)
    two[[3, 9]] = 60, 5_000
    groups = C.Groups(counts, two, 100)
    load = Counter()
    for bucket in range(300):
        if groups.first[bucket] >= 0:
            load[groups.first[bucket]] += counts[bucket]
    assert max(load.values()) < 200 and (groups.first[:300] < 0).sum() == 199
    assert groups.second[3] >= 0 > groups.second[9] and groups.spread == 50


def test_hashes_of_tasks_are_those_of_the_dictionary(spark):
    import xxhash

    for lang, attempt in (("en", 0), ("", 1), ("pt é", 2)):
        seed = xxhash.xxh64_intdigest((lang + "\0" * attempt).encode(), 42)
        for word in (b"word", b"", "ßé".encode() * 40):
            df = spark.createDataFrame([(lang, word)], "lang string, word binary")
            h = df.selectExpr(f"xxhash64(concat(lang, repeat(decode(X'00', 'UTF-8'), {attempt})), word)").first()[0]
            assert h % (1 << 64) == xxhash.xxh64_intdigest(word, seed)


def test_equal_hashes_are_hashed_anew(spark, monkeypatch):
    real, calls = C.F.xxhash64, []

    def colliding(lang, word):
        calls.append(1)
        return C.F.lit(7).cast("long") if len(calls) == 1 else real(lang, word)

    encoded = spark.createDataFrame([("en", bytearray(b""), 0, [b"a", b"b"], [1, 2])], C._ENCODED)
    monkeypatch.setattr(C.F, "xxhash64", colliding)
    words, attempt = C._dictionary(encoded)
    assert attempt == 1 and words.select("h").distinct().count() == 2
