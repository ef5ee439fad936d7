"""Conversations: turns, history windows and byte budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorestack.functions.text import truncate_utf8, utf16_length


def pair_turns(messages: DataFrame, chat: str = "chat_id", order: list[str] = ["pos"]) -> DataFrame:
    """(chat, answer_id, pos, question, answer): an assistant message directly after a user's, other roles set aside first."""
    spoken = messages.filter(F.col("role").isin("user", "assistant"))
    w = Window.partitionBy(chat).orderBy(*order)
    before = spoken.withColumn("_role", F.lag("role").over(w)).withColumn("question", F.lag("content").over(w))
    return before.filter("role = 'assistant' and _role = 'user'").select(chat, F.col("id").alias("answer_id"), *order, "question", F.col("content").alias("answer"))


def recent_history(messages: DataFrame, n: int = 20, chat: str = "chat_id", order: list[str] = ["pos"]) -> DataFrame:
    """The newest ``n`` messages of each chat, without the last one (the one being answered), numbered oldest first."""
    newest = Window.partitionBy(chat).orderBy(*(F.col(c).desc() for c in order))
    kept = messages.withColumn("_age", F.row_number().over(newest)).filter((F.col("_age") > 1) & (F.col("_age") <= n + 1))
    oldest = Window.partitionBy(chat).orderBy(*order)
    return kept.drop("_age").withColumn("place", F.row_number().over(oldest))


def budget_allocate(items: DataFrame, key: str, order: list[Column], budget: Column, text: str = "content") -> DataFrame:
    """Take texts in order while they fit in ``budget`` bytes; the first that doesn't is cut, those after it are dropped.

    A prefix sum says what is left before each text. Adds taken (the kept text) and left_before.
    """
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.octet_length(text)).over(w), F.lit(0))
    left = items.withColumn("left_before", (budget - before).cast("long"))
    taken = F.when(F.octet_length(text) <= F.col("left_before"), F.col(text)).otherwise(truncate_utf8(F.col(text), F.col("left_before").cast("int")))
    return left.filter("left_before > 0").withColumn("taken", taken).filter(F.octet_length("taken") > 0)


def fit_history(history: DataFrame, key: str, order: list[str], budget: Column, memory_on: Column, reserve_percent: int = 15, text: str = "content") -> DataFrame:
    """The newest messages within the budget, in the order of time, with a share held back for the memory.

    Adds taken and leftover: the bytes that later sections may use, the held share included.
    """
    held = F.when(memory_on, F.floor(budget * reserve_percent / 100)).otherwise(F.lit(0)).cast("long")
    marked = history.withColumn("_budget", budget.cast("long")).withColumn("_held", held)
    fit = budget_allocate(marked, key, [F.col(c).desc() for c in order], F.col("_budget") - F.col("_held"), text)
    used = F.sum(F.octet_length("taken")).over(Window.partitionBy(key))
    return fit.withColumn("leftover", F.greatest(F.col("_budget") - F.col("_held") - used, F.lit(0)) + F.col("_held")).drop("_budget", "_held", "left_before")


def merge_consecutive(messages: DataFrame, key: str, order: list[str], text: str = "content") -> DataFrame:
    """Neighbouring messages of one role as one, a blank line between them: (key, island, role, content)."""
    w = Window.partitionBy(key).orderBy(*order)
    change = F.when(F.lag("role").over(w).eqNullSafe(F.col("role")), 0).otherwise(1)
    islands = messages.withColumn("_new", change).withColumn("island", F.sum("_new").over(w))
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    return islands.groupBy(key, "island", "role").agg(F.concat_ws("\n\n", F.transform(ordered, lambda x: x["_text"])).alias(text))


def context_usage(messages: DataFrame, key: str, window: Column | None = None, default: int = 4096, text: str = "content") -> DataFrame:
    """(key, tokens, ratio, level) of each conversation: UTF-16 units by four against the window."""
    most = F.coalesce(F.max(window), F.lit(default)) if window is not None else F.lit(default)
    used = messages.groupBy(key).agg(F.ceil(F.sum(utf16_length(F.coalesce(F.col(text), F.lit("")))) / 4).alias("tokens"), most.alias("_most"))
    ratio = F.least(F.col("tokens") / F.col("_most"), F.lit(1.0))
    return used.withColumn("ratio", ratio).select(key, "tokens", "ratio", F.when(F.col("ratio") >= 1, "red").when(F.col("ratio") >= 0.75, "amber").otherwise("green").alias("level"))


def backfill_count(chats: DataFrame, turns: DataFrame, indexed: DataFrame, chat: str = "chat_id") -> DataFrame:
    """(chat, total, done): turns to index and turns indexed already; chats without turns have zeros."""
    total = turns.groupBy(chat).agg(F.count("*").alias("_total"))
    done = turns.join(indexed.select("answer_id").distinct(), "answer_id", "left_semi").groupBy(chat).agg(F.count("*").alias("_done"))
    joined = chats.select(chat).join(total, chat, "left").join(done, chat, "left")
    return joined.select(chat, F.coalesce("_total", F.lit(0)).cast("long").alias("total"), F.coalesce("_done", F.lit(0)).cast("long").alias("done"))
