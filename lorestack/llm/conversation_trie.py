"""Prefix trie of conversations by whole-sequence collapse.

Turns become digests, and a prefix of a conversation is the exclusive-or of its turns' digests, each bound to its place, so
prefixes are compared without carrying text. Equal conversations are collapsed into one weighted sequence with the list of
those that end there. A sequence that is a proper prefix of another is found by a join against all proper prefixes; the rest
are the leaves. What a node counts is then summed over the prefixes of weighted sequences. A sum over a subtree takes no pairs
of nodes and ancestors: each node belongs to the smallest leaf below it, a leaf owns the tail of its path, and a subtree is
the tail of its own leaf from there on, and the whole tails of the other leaves.

Running counts over a conversation go by ranges of its turns, so that one conversation that holds a third of all turns is
many tasks. The root, of which every conversation is a member, is summed on the map side first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorestack.llm.common import materialise, table

BLOCK, MOST_SHARED = 100, 6
_KEY = ["depth", "x0", "x1"]


def running(df: DataFrame, key: list[str], order: list[Column], sums: dict[str, tuple]) -> DataFrame:
    """``df`` with running aggregates of each key's rows in an order, the row's own included.

    ``sums`` names them: (aggregate, column aggregated, how two parts are put together). Rows are dealt to ranges of (key,
    order), what a range has is run over there, and what earlier ranges of the same key have is added: only keys that lie
    in several ranges, less than there are ranges, have such rows.
    """
    kept = df.columns
    ranged = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = materialise(ranged.repartitionByRange(*key, *order, "_tie").withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy(*key, "_part").orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, 0)
    totals = ranged.groupBy(*key, "_part").agg(*(agg(F.col(c)).alias(f"_all_{name}") for name, (agg, c, _) in sums.items()))
    wide = totals.join(totals.groupBy(*key).count().filter("count > 1").drop("count"), key, "left_semi")
    earlier = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    joined_up = {"count": F.sum, "sum": F.sum, "xor": F.bit_xor}
    before = wide.select(*key, "_part", *(joined_up[how](f"_all_{name}").over(earlier).alias(f"_had_{name}") for name, (_, _, how) in sums.items()))
    own = ranged.select(*kept, "_part", *(agg(F.col(c)).over(inside).alias(f"_own_{name}") for name, (agg, c, _) in sums.items()))
    both = own.join(before, [*key, "_part"], "left")

    def whole(name: str, how: str) -> Column:
        had = F.coalesce(F.col(f"_had_{name}"), F.lit(0))
        return (F.col(f"_own_{name}").bitwiseXOR(had) if how == "xor" else F.col(f"_own_{name}") + had).alias(name)

    return both.select(*kept, *(whole(name, how) for name, (_, _, how) in sums.items()))


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations' turns (conv_id, place from 1, d0, d1, chars), and all conversations (conv_id).

    Conversation c begins with the first h turns of conversation c - c % 100, all of them if it has fewer, none if it is
    absent, and goes on with its own turns after its first h; h is crc32(decimal c) % 6. Turns go by turn, null first;
    of one turn by role, then by the digest of both. A null role or text is empty; rows without conv_id take no part.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    half = lambda i: F.conv(F.substring(digest, 1 + 16 * i, 16), 16, -10).cast("long")
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), half(0).alias("d0"), half(1).alias("d1"), F.length(text).cast("long").alias("chars"), F.lit(1).alias("one"))
    placed = materialise(running(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("d0"), F.col("d1")], {"place": (F.count, "one", "count")}).select("conv_id", "place", "d0", "d1", "chars"))
    shared = F.crc32(F.col("conv_id").cast("string")) % MOST_SHARED
    convs = materialise(placed.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", shared.cast("long")).withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK))
    first = placed.filter(F.col("place") < MOST_SHARED).withColumnRenamed("conv_id", "base")
    begun = convs.select("conv_id", "h", "base").join(first.filter(F.col("base") % BLOCK == 0), "base").filter("place <= h").select("conv_id", "place", "d0", "d1", "chars")
    sizes = convs.filter(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    shifts = convs.join(sizes, "base", "left").select("conv_id", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("m"))
    own = placed.join(shifts, "conv_id").filter("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("m")).alias("place"), "d0", "d1", "chars")
    return begun.unionByName(own), convs.select("conv_id")


def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, x0, x1, p0, p1, chars): each prefix of each conversation, p the prefix before it."""
    bound = turns.select("conv_id", F.col("place").alias("depth"), "chars", *(F.xxhash64(F.lit(i), "place", "d0", "d1").alias(f"b{i}") for i in range(2)))
    found = running(bound, ["conv_id"], [F.col("depth")], {f"x{i}": (F.bit_xor, f"b{i}", "xor") for i in range(2)})
    return found.select("conv_id", *_KEY, *(F.col(f"x{i}").bitwiseXOR(F.col(f"b{i}")).alias(f"p{i}") for i in range(2)), "chars")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each sequence's sorted conv_ids; a sequence's list is hashed as it comes and never held."""
    last, sha = None, None
    for batch in batches:
        keys, values = [], []
        for seq, conv in zip(batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if seq != last:
                if sha is not None:
                    keys.append(last)
                    values.append(sha.hexdigest())
                last, sha = seq, hashlib.sha256(str(conv).encode())
            else:
                sha.update(b",%d" % conv)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.string())], names=["seq", "ends"])
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([sha.hexdigest()])], names=["seq", "ends"])


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie of conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    ``turns`` (conv_id, place, d0, d1, chars) with places from 1 without gaps, ``convs`` all conversations, those without
    turns included: they end at the root. A node is a distinct sequence of first turns, named by its smallest member; the
    root has depth 0 and no parent. n_convs counts members, n_leaves the childless nodes of the subtree (the node itself
    if it is one), saved_tokens sums (members - 1) * characters of the last text over the subtree. ends_sha256 is the
    SHA-256 of the conv_ids that end at the node, ascending, joined by commas; one digest has to be made in one go, so the
    conv_ids of one sequence stream through one task. No conversations, no nodes.
    """
    every = materialise(_prefixes(turns))
    last = every.groupBy("conv_id").agg(F.max(F.struct("depth", "x0", "x1")).alias("end"))
    zero = F.lit(0).cast("long")
    ends = convs.join(last, "conv_id", "left").select("conv_id", *(F.coalesce(F.col(f"end.{c}").cast("long"), zero).alias(c) for c in _KEY))
    ends = materialise(ends)
    sequences = ends.groupBy(*_KEY).agg(F.min("conv_id").alias("seq"), F.count("*").alias("w"))
    listed = ends.join(sequences.select(*_KEY, "seq"), _KEY).select("seq", "conv_id")
    digests = listed.repartition("seq").sortWithinPartitions("seq", "conv_id").mapInArrow(_digests, "seq long, ends string")
    # Proper prefixes of distinct sequences; the root is one if any sequence has turns.
    inner = every.join(sequences.select("seq", "w", F.col("depth").alias("len")), every.conv_id == F.col("seq"))
    inner = materialise(inner.select("seq", "w", "len", *_KEY, "p0", "p1", "chars"))
    root = sequences.select("seq", "w", F.col("depth").alias("len"), *(zero.alias(c) for c in [*_KEY, "p0", "p1", "chars"]))
    paths = inner.unionByName(root)
    proper = paths.filter("depth < len").select(*_KEY).distinct()
    leaves = sequences.join(proper, _KEY, "left_anti").select("seq", F.lit(True).alias("leaf"))
    paths = materialise(paths.join(leaves, "seq", "left").withColumn("leaf", F.coalesce("leaf", F.lit(False))))
    nodes = paths.groupBy(*_KEY).agg(
        F.sum("w").alias("n_convs"), F.min("seq").alias("conv_id"), F.min(F.when(F.col("leaf"), F.col("seq"))).alias("owner"), F.sum(F.col("leaf").cast("long")).alias("n_leaves"), F.min("p0").alias("p0"), F.min("p1").alias("p1"), F.min("chars").alias("chars")
    )
    nodes = materialise(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")))
    # From the deepest node of a leaf's tail upwards.
    tails = materialise(running(nodes.select("owner", *_KEY, "saved"), ["owner"], [F.col("depth").desc()], {"below": (F.sum, "saved", "sum")}))
    whole = tails.groupBy("owner").agg(F.sum("saved").alias("tail"))
    under = paths.filter("leaf").join(whole, F.col("seq") == F.col("owner"), "left").groupBy(*_KEY).agg(F.sum(F.coalesce("tail", F.lit(0))).alias("under"))
    parent = [(F.col("depth") - 1).alias("depth"), F.col("p0").alias("x0"), F.col("p1").alias("x1")]
    children = nodes.filter("depth > 0").select(*parent).groupBy(*_KEY).agg(F.count("*").alias("n_children"))
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x0").alias("p0"), F.col("x1").alias("p1"), F.col("conv_id").alias("parent_conv_id"))
    empty = hashlib.sha256(b"").hexdigest()
    return (
        nodes.join(up, ["depth", "p0", "p1"], "left")
        .join(children, _KEY, "left")
        .join(under, _KEY, "left")
        .join(tails.select(*_KEY, "below"), _KEY, "left")
        .join(whole, "owner", "left")
        .join(sequences.select(*_KEY, F.col("seq").alias("ending")).join(digests.withColumnRenamed("seq", "ending"), "ending"), _KEY, "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", (F.col("below") + F.col("under") - F.col("tail")).alias("saved_tokens"), F.coalesce("ends", F.lit(empty)).alias("ends_sha256"))
    )


def conversation_trie(turns: DataFrame) -> DataFrame:
    """:func:`prefix_trie` of the conversations rebuilt by :func:`rebuilt_turns` from (conv_id, turn, role, text).

    Null turns come first, null roles and texts are empty, rows without conv_id take no part, repeated rows are turns of
    their own, of equal turns the role and then the digest decides; other columns are not read. An empty table has no nodes.
    """
    return prefix_trie(*rebuilt_turns(turns.select("conv_id", "turn", "role", "text")))


def op11_conversation_trie(spark, sf_dir: str) -> DataFrame:
    """All of ``conversations``."""
    return conversation_trie(table(spark, sf_dir, "conversations"))


OP11_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS p,
    sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS g, length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL
), i AS (
  SELECT DISTINCT conv_id, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT) AS bytes FROM t
), h AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, bytes),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END))) % 6 AS h FROM i
), r AS (
  SELECT h.conv_id, 0 AS own, p, g, chars FROM h JOIN t ON t.conv_id = h.base AND p <= h
  UNION ALL SELECT conv_id, 1, p, g, chars FROM h JOIN t USING (conv_id) WHERE p > h
), s AS (
  SELECT h.conv_id, coalesce(list(g ORDER BY own, p) FILTER (g IS NOT NULL), []) AS seq, coalesce(list(chars ORDER BY own, p) FILTER (g IS NOT NULL), []) AS sizes
  FROM h LEFT JOIN r USING (conv_id) GROUP BY h.conv_id
), e AS (
  SELECT conv_id, len(seq) AS n, seq, sizes, unnest(range(0, len(seq) + 1)) AS d FROM s
), m AS (
  SELECT d AS depth, seq[:d] AS path, any_value(sizes[d]) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM e GROUP BY d, seq[:d]
), k AS (
  SELECT depth - 1 AS depth, path[:depth - 1] AS path, count(*) AS n_children FROM m WHERE depth > 0 GROUP BY ALL
), a AS (
  SELECT m.path, m.depth, coalesce((m.n_convs - 1) * m.chars, 0) AS saved, k.path IS NULL AS leaf, unnest(range(0, m.depth + 1)) AS d FROM m LEFT JOIN k USING (depth, path)
), u AS (
  SELECT d AS depth, path[:d] AS path, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (leaf) AS n_leaves FROM a GROUP BY d, path[:d]
)
SELECT m.conv_id, m.depth, p.conv_id AS parent_conv_id, m.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, m.ends_sha256
FROM m JOIN u USING (depth, path) LEFT JOIN k USING (depth, path) LEFT JOIN m p ON m.depth > 0 AND p.depth = m.depth - 1 AND p.path = m.path[:m.depth - 1]
"""
