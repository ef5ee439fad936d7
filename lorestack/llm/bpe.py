"""Byte-level BPE encoding and decoding with recursive DuckDB queries inside Spark's tasks.

Spark partitions the documents. In a task, the distinct matches of the split pattern that the worker has not met become
rows (word, position, token) of bytes. A recursive query joins neighbours with the merge table, contracts the leftmost
minimum-rank pair of each word, and goes on with the words that changed until none does. In the same round it contracts
what would be contracted later all the same. In matches of up to ``SHORT`` bytes these are the pairs whose tokens no earlier
merge can take, whatever their neighbours grow to; a word takes about as many rounds as its merges are deep. In longer
ones, which may hold long runs of one pair, these are the next places of the minimum-rank pair, as long as a merge brings
forth no earlier one; a match takes about as many rounds as it has different merges, however long it is. Decoding joins
tokens with the vocabulary and concatenates their bytes in the order of position.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import sys
from collections.abc import Collection, Iterator
from itertools import islice

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorestack.llm.pieces import Cache, blocks, cut, cut_odd, is_odd, only

_WORKER: dict = {}
#: Bytes of a match up to which the rounds of ``_STATE_SHORT`` serve.
SHORT = 64

_STATE_SHORT = """
WITH RECURSIVE state(word, pos, token, next_token, done) AS (  -- a position is one of all the words together
  SELECT word, pos, token, CASE WHEN lead(word) OVER v = word THEN lead(token) OVER v END, false FROM words WINDOW v AS (ORDER BY pos)
  UNION ALL
  SELECT * FROM (
    WITH ranked AS MATERIALIZED (
      SELECT s.word, s.pos, s.token, s.next_token, CASE WHEN s.next_token IS NOT NULL THEN s.token END AS own, p.merged, p.from_left, p.from_right
      FROM state s LEFT JOIN pairs p ON p.pair = (s.token::BIGINT << 32) | s.next_token WHERE NOT s.done
    ), chosen AS (
      -- the lowest rank, then the leftmost position
      SELECT word, min((merged::BIGINT << 32) | pos) AS pick FROM ranked GROUP BY word
    ), near AS (
      SELECT word, pos, token, next_token, merged, lag(own) OVER v AS before, lead(next_token) OVER v AS beyond,
        merged IS NOT NULL AND coalesce(lag(from_left) OVER v > merged, true) AND coalesce(lead(from_right) OVER v >= merged, true) AS apart
      FROM ranked WINDOW v AS (ORDER BY pos)
    ), judged AS (
      -- a pair that none can take a token of, unless the new token may make an earlier pair with a neighbour
      SELECT n.word, pos, token, next_token, beyond, merged, pick IS NULL AS done, coalesce(pick & 4294967295 = pos, false)
        OR (apart AND coalesce((before::BIGINT << 32) | merged, -1) NOT IN (SELECT pair FROM early_left) AND coalesce((merged::BIGINT << 32) | beyond, -1) NOT IN (SELECT pair FROM early_right)) AS start
      FROM near n JOIN chosen USING (word)
    ), made AS (
      SELECT word, pos, start, CASE WHEN start THEN merged ELSE token END AS token, CASE WHEN start THEN beyond ELSE next_token END AS next_token, done FROM judged
    ), joined AS (
      SELECT word, pos, token, CASE WHEN next_token IS NULL THEN NULL WHEN start THEN lead(token, 2) OVER v ELSE lead(token) OVER v END AS next_token, coalesce(lag(start) OVER v, false) AS gone, done
      FROM made WINDOW v AS (ORDER BY pos)
    )
    SELECT word, pos, token, next_token, done FROM joined WHERE NOT gone
  )
)
"""

_STATE_LONG = """
WITH RECURSIVE state(word, pos, token, after, next_token, done) AS (  -- a position is one of all the words together
  SELECT word, pos, token, lead(pos) OVER v, lead(token) OVER v, false FROM words WINDOW v AS (PARTITION BY word ORDER BY pos)
  UNION ALL
  SELECT * FROM (
    WITH ranked AS (
      SELECT s.word, s.pos, s.token, s.after, s.next_token, m.merged FROM state s LEFT JOIN merges m ON m.pair = (s.token::BIGINT << 32) | s.next_token WHERE NOT s.done
    ), chosen AS (
      -- the lowest rank, then the leftmost position
      SELECT word, min((merged::BIGINT << 32) | pos) AS pick FROM ranked GROUP BY word
    ), picked AS MATERIALIZED (
      SELECT r.*, pick & 4294967295 AS here, (pick >> 32)::INTEGER AS made FROM ranked r JOIN chosen USING (word)
    ), found AS MATERIALIZED (
      SELECT word, pos, after, made, token = next_token AS twin FROM picked WHERE merged = made
    ), apart AS (
      -- only pairs of a token with itself can overlap: of a run of them every other one, from the left
      SELECT word, pos, after, made FROM found WHERE NOT twin
      UNION ALL
      SELECT word, pos, after, made FROM (SELECT *, sum(fresh) OVER (PARTITION BY word ORDER BY pos) AS run FROM (
        SELECT word, pos, after, made, CASE WHEN lag(after) OVER (PARTITION BY word ORDER BY pos) = pos THEN 0 ELSE 1 END AS fresh FROM found WHERE twin
      )) QUALIFY row_number() OVER (PARTITION BY word, run ORDER BY pos) % 2 = 1
    ), places AS MATERIALIZED (
      SELECT t.word, t.pos, t.made, t.after AS gone, p.after, p.next_token, t.made IN (SELECT id FROM unsafe) AS doubtful FROM apart t JOIN picked p ON p.pos = t.after
    ), doubted AS (
      SELECT *, lag(gone) OVER (PARTITION BY word ORDER BY pos) AS gone_before FROM places WHERE doubtful
    ), judged AS (
      -- whether the new token makes an earlier pair with a neighbour: then that one is next, and later places wait
      SELECT d.*, coalesce(r.merged < d.made, false) OR coalesce(l.merged < d.made, false) AS early
      FROM doubted d LEFT JOIN merges r ON r.pair = (d.made::BIGINT << 32) | d.next_token LEFT JOIN picked q ON q.after = d.pos
      LEFT JOIN merges l ON l.pair = (CASE WHEN q.pos = d.gone_before THEN d.made ELSE q.token END::BIGINT << 32) | d.made
    ), starts AS MATERIALIZED (
      SELECT word, pos, gone, after, next_token FROM places WHERE NOT doubtful
      UNION ALL
      SELECT word, pos, gone, after, next_token FROM judged QUALIFY NOT coalesce(bool_or(early) OVER (PARTITION BY word ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)
    ), edits AS (
      SELECT pos, false AS gone, after, next_token FROM starts UNION ALL SELECT gone, true, NULL, NULL FROM starts
    ), joined AS (
      SELECT p.word, p.pos, p.token, p.made, p.here, e.pos AS start, CASE WHEN e.pos IS NULL THEN p.after ELSE e.after END AS after, CASE WHEN e.pos IS NULL THEN p.next_token ELSE e.next_token END AS next_token
      FROM picked p LEFT JOIN edits e ON e.pos = p.pos WHERE e.gone IS DISTINCT FROM true
    )
    SELECT j.word, j.pos, CASE WHEN start IS NULL THEN token ELSE made END, j.after, CASE WHEN n.pos IS NULL THEN j.next_token ELSE made END, here IS NULL
    FROM joined j LEFT JOIN starts n ON n.pos = j.after
  )
)
"""

_ENCODED = """
SELECT string_agg(token::VARCHAR, ' ' ORDER BY pos) AS ids, unhex(string_agg(v.hex, '' ORDER BY pos)) AS data FROM state JOIN vocabulary v ON v.id = token WHERE done GROUP BY word ORDER BY word
"""

_DECODE = """
SELECT word, unhex(string_agg(v.hex, '' ORDER BY pos)) AS data FROM tokens t JOIN vocabulary v ON v.id = t.token GROUP BY word ORDER BY word
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Merges and vocabulary of one rank file in an in-memory DuckDB of one thread, and what a worker has encoded."""

    built = 0

    def __init__(self, path: str, pattern: str, cache_bytes: int):
        Codec.built += 1
        self.ranks = read_ranks(path)
        pair, merged, from_left, from_right = self._pairs()
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
        self._table("merges", pair=pair, merged=merged)
        # Tokens that some earlier merge takes in: to make one of these may bring forth an earlier merge than its own.
        self._table("unsafe", id=sorted({t for p, m in zip(pair, merged, strict=True) for t in (p >> 32, p & 0xFFFFFFFF) if m < t}))
        self._table("lefts", pair=list(from_left), first=list(from_left.values()))
        self._table("rights", pair=list(from_right), first=list(from_right.values()))
        self.db.execute("CREATE TABLE pairs AS SELECT pair, m.merged, l.first AS from_left, r.first AS from_right FROM lefts l FULL JOIN rights r USING (pair) LEFT JOIN merges m USING (pair)")
        # Pairs in which a token has an earlier merge than the one that makes it, on its left or right.
        self.db.execute("CREATE TABLE early_left AS SELECT pair FROM lefts WHERE first < pair & 4294967295")
        self.db.execute("CREATE TABLE early_right AS SELECT pair FROM rights WHERE first < pair >> 32")
        self.db.execute("DROP TABLE lefts")
        self.db.execute("DROP TABLE rights")
        self._table("vocabulary", id=list(self.ranks.values()), hex=[t.hex() for t in self.ranks])
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        by_id = sorted((i, t) for t, i in self.ranks.items())
        self.n_bytes, self.first = np.zeros(by_id[-1][0] + 1, dtype=np.int64), np.zeros(by_id[-1][0] + 1, dtype=np.int64)
        known = np.array([i for i, _ in by_id])
        self.n_bytes[known] = [len(t) for _, t in by_id]
        self.first[known] = np.cumsum(self.n_bytes[known]) - self.n_bytes[known]
        self.vocabulary = np.frombuffer(b"".join(t for _, t in by_id), dtype=np.uint8)
        self.matches = regex.compile(pattern).findall
        # Letters after a space are one match, if what Python calls letters are such to the pattern.
        letters = " " + "".join(filter(str.isalpha, map(chr, range(sys.maxunicode + 1))))
        self.is_match = str.isalpha if self.matches(letters) == [letters] else lambda p: p.isascii() and p.isalpha()
        # Pieces as they stand, pieces after a space, and matches that are no such piece. A piece that gives way to others
        # while its block is read is learnt again.
        self.alone = [lambda p: self.learn([p], [])[0][p], lambda p: self.learn([], [p])[1][p], lambda w: self.encode_words([w.encode()])[0]]
        self.caches = tuple(Cache(make, cache_bytes // part) for make, part in zip(self.alone, (8, 1, 4), strict=True))
        self.pieces, self.words = self.caches[:2], self.caches[2]

    def _pairs(self) -> tuple[list, list, dict, dict]:
        """Merges: pairs and the tokens they make. Of two neighbours the earliest merge in which the left one, or what it may
        grow into, takes the right one as it is; and the earliest in which the right one, grown or not, takes the left one."""
        get = self.ranks.get
        pair, merged, from_left, from_right = [], [], {}, {}
        for rank, token in sorted((r, t) for t, r in self.ranks.items()):
            for k in range(1, len(token)):
                a, b = get(token[:k]), get(token[k:])
                if a is not None and b is not None:
                    pair.append(a << 32 | b)
                    merged.append(rank)
                    for j in range(k):
                        if (x := get(token[j:k])) is not None:
                            from_left.setdefault(x << 32 | b, rank)
                    for j in range(k + 1, len(token) + 1):
                        if (x := get(token[k:j])) is not None:
                            from_right.setdefault(a << 32 | x, rank)
        return pair, merged, from_left, from_right

    def _table(self, name: str, **columns) -> None:
        made = pa.table({k: pa.array(v, pa.string() if v and isinstance(v[0], str) else pa.int64() if k == "pair" else pa.int32()) for k, v in columns.items()})
        self.db.register("given", made)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def encode_words(self, words: list[bytes]) -> list[tuple[str, bytes]]:
        """The ids of each word in decimal, joined by one space, and the bytes that they decode to."""
        out = [(str(rank), w) if (rank := self.ranks.get(w)) is not None else ("", b"") for w in words]
        rest = [i for i, w in enumerate(words) if w and not out[i][0]]
        short = [i for i in rest if len(words[i]) <= SHORT]
        long = [i for i in rest if len(words[i]) > SHORT] if len(short) < len(rest) else []
        for state, rest in ((_STATE_SHORT, short), (_STATE_LONG, long)):
            if not rest:
                continue
            data = [words[i] for i in rest]
            token = self.of_byte[np.frombuffer(b"".join(data), dtype=np.uint8)]
            word = np.repeat(np.arange(len(rest), dtype=np.int32), np.fromiter(map(len, data), dtype=np.int64, count=len(data)))
            self.db.register("words", pa.table({"word": word, "pos": np.arange(len(token), dtype=np.int32), "token": token}))
            found = self.db.sql(state + _ENCODED).to_arrow_table()
            self.db.unregister("words")
            for i, *both in zip(rest, found.column("ids").to_pylist(), found.column("data").to_pylist(), strict=True):
                out[i] = tuple(both)
        return out

    def decode_words(self, ids: list[list[int]]) -> list[bytes]:
        """The bytes of each list of ids."""
        lengths = np.array([len(x) for x in ids], dtype=np.int64)
        token = np.fromiter((t for x in ids for t in x), dtype=np.int32, count=int(lengths.sum()))
        given = pa.table({"word": np.repeat(np.arange(len(ids), dtype=np.int32), lengths), "pos": np.arange(len(token), dtype=np.int64), "token": token})
        self.db.register("tokens", given)
        found = self.db.sql(_DECODE).to_arrow_table()
        self.db.unregister("tokens")
        out = [b""] * len(ids)
        for w, text in zip(found.column("word").to_pylist(), found.column("data").to_pylist(), strict=True):
            out[w] = text
        return out

    def check(self, count: int, ids: str, data: bytes) -> None:
        """Raise where a whole text's ids, read back from their decimals, don't decode to the bytes put together from its matches."""
        if count:
            at = np.fromstring(ids, dtype=np.int32, sep=" ")
            n = self.n_bytes[at]
            ends = np.cumsum(n)
            place = np.arange(ends[-1]) + np.repeat(self.first[at] - ends + n, n)
            if len(at) != count or self.vocabulary[place].tobytes() != data:
                raise ValueError("ids and decoded bytes of a text differ")
        elif data:
            raise ValueError("ids and decoded bytes of a text differ")

    def learn(self, whole: Collection[str], spaced: Collection[str]) -> tuple[dict, dict]:
        """The ids and bytes of pieces not met so far: as they stand, and without the space that goes before them."""
        parts: tuple[dict, dict] = ({}, {})
        alone = dict.fromkeys(filter(self.is_match, spaced))  # one match of the pattern with the space, and not met so far
        for space, pieces in enumerate((whole, spaced)):
            parts[space].update((p, self.matches(f" {p}" if space else p)) for p in pieces if not space or p not in alone)
        known, new, near = {}, [], self.pieces[1]
        for w in set().union(*parts[0].values(), *parts[1].values()):
            x = near.get(w[1:]) or near.old.get(w[1:]) if w[0] == " " else None
            x = x or self.words.get(w) or self.words.old.get(w)
            if x:
                known[w] = x
            elif w[0] != " " or w[1:] not in alone:
                new.append(w)
        made = self.encode_words([*(f" {p}".encode() for p in alone), *map(str.encode, new)])
        learned: tuple[dict, dict] = ({}, dict(zip(alone, made, strict=False)))
        if any(parts):
            known.update((f" {p}", x) for p, x in learned[1].items())
        known.update(fresh := dict(zip(new, made[len(alone) :], strict=True)))
        self.words.put({w: x for w, x in fresh.items() if w[0] != " "})
        learned[1].update((w[1:], x) for w, x in fresh.items() if w[0] == " ")
        for space, cut_up in enumerate(parts):
            for p, words in cut_up.items():
                if len(words) == 1:
                    learned[space][p] = known[words[0]]
                else:
                    texts, data = zip(*map(known.__getitem__, words), strict=True) if words else ((), ())
                    learned[space][p] = " ".join(texts), b"".join(data)
        return learned

    def texts(self, texts: list[str]) -> Iterator[tuple[int, str, bytes]]:
        """Of each text: number of ids, the ids in decimal joined by one space, the bytes decoded from them."""
        lines = [None if is_odd(t) else cut(t) for t in texts]
        odd = [cut_odd(t) if x is None else () for t, x in zip(texts, lines, strict=True)]
        wanted: tuple[set, set] = ({"\n"}, set())
        wanted[0].update(*odd)
        for line in (line for x in lines if x for line in x):
            wanted[0].add(line[0])
            wanted[1].update(islice(line, 1, None))
        missing = [{p for p in want if p not in cache and p not in cache.old} for want, cache in zip(wanted, self.pieces, strict=True)]
        for space, (want, cache, found) in enumerate(zip(wanted, self.pieces, self.learn(*missing), strict=True)):
            # What the old generation holds is wanted now, and stays at hand should it give way to another while this block is read.
            found.update({p: cache.old[p] for p in want if p in cache.old and p not in cache})
            cache.put(found)
            cache.make = lambda p, old=cache.old, alone=self.alone[space]: old.get(p) or alone(p)
        whole, spaced = (cache.__getitem__ for cache in self.pieces)
        for x, o in zip(lines, odd, strict=True):
            found = list(map(whole, o))
            for line in x or ():
                if line[0]:
                    found.append(whole(line[0]))
                found.extend(map(spaced, islice(line, 1, None)))
                found.append(whole("\n"))
            if x:
                found.pop()
            parts, data = zip(*found, strict=True) if found else ((), ())
            ids = " ".join(parts)
            yield ids.count(" ") + bool(ids), ids, b"".join(data)


def _codec(path: str, pattern: str, cache_bytes: int) -> Codec:
    key = path, pattern
    if key not in _WORKER:
        _WORKER[key] = Codec(path, pattern, cache_bytes)
    only(*_WORKER[key].caches)
    return _WORKER[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", cache_bytes: int = 150 << 20) -> DataFrame:
    """doc_id, ids array<int> of every row; a null text has no ids. Special tokens are not recognised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_path, pattern, cache_bytes)
        for block in blocks(batches, "text", 4 << 20):
            ids = [[int(i) for i in x[1].split()] for x in codec.texts([t or "" for t in block.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, cache_bytes: int = 150 << 20) -> DataFrame:
    """doc_id, data binary of every row of (doc_id, ids); null ids give no bytes. An unknown id is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_path, pattern, cache_bytes)
        known = set(codec.ranks.values())
        for batch in batches:
            ids = [x or [] for x in batch.column("ids").to_pylist()]
            if unknown := {i for x in ids for i in x} - known:
                raise ValueError(f"ids outside the vocabulary: {sorted(unknown, key=str)[:5]}")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(codec.decode_words(ids), pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", cache_bytes: int = 150 << 20, block_bytes: int = 6 << 20) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, in one pass on the map side.

    The digests are of the decimal ids joined by one space, and of the bytes that the ids decode to. A null text counts as
    empty: no ids, the digest of nothing. Repeated rows and null identifiers come back as they are; other columns are not
    read. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_path, pattern, cache_bytes)
        for block in blocks(batches, "text", block_bytes):
            n, ids, data = [], [], []
            gc.disable()  # the caches hold many small tuples and no cycles; collecting them costs a fifth of the time
            try:
                for count, text, decoded in codec.texts([t or "" for t in block.column("text").to_pylist()]):
                    codec.check(count, text, decoded)
                    n.append(count)
                    ids.append(hashlib.sha256(text.encode()).hexdigest())
                    data.append(hashlib.sha256(decoded).hexdigest())
            finally:
                gc.enable()
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(data, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` encoded and decoded."""
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
