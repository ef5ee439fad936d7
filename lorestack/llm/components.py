"""Connected components of a link table, with alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorestack.llm.common import discard, materialise


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Each node sends its larger (small star: its smaller) neighbours, and itself, to the smallest node it knows.

    The smallest neighbour is a pre-aggregated minimum; the join that follows may be split where a node is a hub.
    """
    both = edges.select(F.col("b").alias("u"), F.col("a").alias("v")) if small else edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    known = both.join(least, "u")
    sent = known.select("m", "v") if small else known.filter("v > u").select("m", "v")
    if small:
        sent = sent.unionByName(least.select("m", F.col("u").alias("v")))
    return sent.filter("m <> v").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def connected_components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(id, component) of every identifier in ``links`` (a, b): component is the smallest identifier reachable.

    Links may repeat, point either way or join an identifier with itself; null ends are dropped. The edges are written to
    the shared folder once per round, and the rounds end when they are stars, so after about the logarithm of a chain's
    length. Raises RuntimeError if ``most_rounds`` don't suffice.
    """
    ends = links.filter("a is not null and b is not null")
    edges = materialise(ends.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    state = None
    for _ in range(most_rounds):
        last, edges = edges, materialise(_star(_star(edges, small=False), small=True))
        discard(last)
        # Large and small stars leave the edges as they are only when every node hangs from its component's smallest.
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (now.n, now.h) == state:
            nodes = ends.select(F.explode(F.array("a", "b")).alias("id")).distinct()
            return nodes.join(edges.select(F.col("b").alias("id"), F.col("a").alias("component")), "id", "left").withColumn("component", F.coalesce("component", "id"))
        state = now.n, now.h
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
