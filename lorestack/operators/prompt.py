"""Prompts of many questions in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorestack.functions.text import answer_budget, attachment_route, joined_sections, prompt_budget, source_block, turn_text
from lorestack.operators.retrieve import best_per_layer, expand_neighbours, is_memory, knn_search, layer_slots, layers, rank_pool, recall_not_in_prompt, resolve_sources
from lorestack.operators.turns import budget_allocate, fit_history, merge_consecutive
from lorestack.session import materialise


def assemble_prompts(questions: DataFrame, chunks: DataFrame, messages: DataFrame, documents: DataFrame, attachments: DataFrame, turns: DataFrame, factor: float = 3.0) -> DataFrame:
    """(question_id, sources, history, memory, memory_nearer, question, answer_tokens, retrieval_error): the sections of each
    question's prompt, within its byte budget.

    questions: question_id, chat_id, question, vector, use_global, use_memory, context. The question is never cut. Attached
    texts that fit whole come first, then documents, then history with a share held for the memory, then recalled turns
    that the history doesn't hold already. Each stage hands what it left to the next as a column.
    """
    budget = F.greatest(prompt_budget(F.col("context")) - F.octet_length("question"), F.lit(0)).cast("long")
    everyone = questions.withColumn("budget", budget)
    asked = everyone.filter("budget > 0")  # a question that fills the budget alone cites nothing, but stays
    # A question that can't be searched for keeps everything else, and says so.
    hits = materialise(knn_search(chunks, layers(asked.filter("vector is not null")), carry=["text"]))
    unscored = hits.groupBy("question_id").agg(F.bool_and(F.isnan("distance")).alias("_unscored"))
    hits = hits.join(unscored.filter("_unscored"), "question_id", "left_anti")
    chosen = materialise(resolve_sources(expand_neighbours(layer_slots(rank_pool(hits, factor=factor)), chunks), documents, attachments))

    whole = attachments.filter(attachment_route(F.col("extracted_text"), F.col("status") == "error") == "injected_whole")
    given = asked.select("question_id", "chat_id", "budget").join(whole.select("chat_id", "doc_id", "filename", "extracted_text"), "chat_id")
    files = given.select("question_id", "budget", F.lit(0).alias("layer"), F.col("doc_id").alias("place"), source_block(F.col("filename"), F.col("extracted_text")).alias("content"))
    found = chosen.filter(~is_memory(F.col("namespace"))).join(asked.select("question_id", "budget"), "question_id").select("question_id", "budget", F.lit(1).alias("layer"), F.col("pool_rank").cast("long").alias("place"), source_block(F.col("label"), F.col("expanded")).alias("content"))
    taken = budget_allocate(files.unionByName(found), "question_id", [F.col("layer"), F.col("place")], F.col("budget"))
    sources = taken.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("layer", "place", "taken"))), lambda x: x["taken"]).alias("_sources"), F.sum(F.octet_length("taken")).alias("_used"))
    state = everyone.join(sources, "question_id", "left").withColumn("left", F.col("budget") - F.coalesce("_used", F.lit(0)))
    state = materialise(state)

    talk = messages.select("chat_id", F.col("id").alias("message_id"), "pos", "role", "content").join(state.select("question_id", "chat_id", "left", "use_memory"), "chat_id")
    recent = talk.withColumn("_age", F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("pos").desc()))).filter("_age <= 20")
    fit = materialise(fit_history(recent, "question_id", ["pos"], F.col("left"), F.col("use_memory")))
    kept = fit.select("question_id", F.col("message_id").alias("answer_id"))
    history = fit.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "role", "taken"))), lambda x: F.struct(x["role"].alias("role"), x["taken"].alias("content"))).alias("history"), F.min("leftover").alias("_left"))
    state = materialise(state.join(history, "question_id", "left").withColumn("left", F.coalesce("_left", "left")))

    recalled = recall_not_in_prompt(chosen.filter(is_memory(F.col("namespace"))).withColumn("answer_id", F.col("doc_id")), kept)
    memory = recalled.join(turns.select("answer_id", "question", "answer"), "answer_id").select("question_id", F.col("recall_rank").alias("place"), turn_text(F.col("question"), F.col("answer")).alias("content"))
    fits = budget_allocate(memory.join(state.select("question_id", "left"), "question_id"), "question_id", [F.col("place")], F.col("left")).groupBy("question_id").agg(F.first("taken").alias("memory"))
    joined = F.array_join("_sources", "\n\n---\n\n")
    nearer = best_per_layer(chosen).select("question_id", "memory_nearer")
    whole = state.join(fits, "question_id", "left").join(nearer, "question_id", "left").join(unscored, "question_id", "left")
    error = F.when(F.col("budget") <= 0, F.lit(None).cast("string")).when(F.col("vector").isNull(), "no_vector").when(F.col("_unscored"), "no_score")
    return whole.select("question_id", joined_sections(joined).alias("sources"), "history", "memory", F.coalesce("memory_nearer", F.lit(False)).alias("memory_nearer"), "question", answer_budget(F.col("context")).alias("answer_tokens"), error.alias("retrieval_error"))


def prompt_messages(prompts: DataFrame, system: str, sources_intro: str, memory_intro: str) -> DataFrame:
    """(question_id, position, role, content): the messages of each assembled prompt, in order.

    The system's text, the history, and the question with what was found before it, the nearer kind next to the question.
    Neighbours of one role become one message.
    """
    section = lambda intro, text: F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f"{intro}\n\n"), text))
    sources, memory, nearer = section(sources_intro, F.col("sources")), section(memory_intro, F.col("memory")), F.col("memory_nearer")
    asked = joined_sections(F.when(nearer, sources).otherwise(memory), F.when(nearer, memory).otherwise(sources), F.col("question"))
    message = lambda role, text: F.array(F.struct(F.lit(role).alias("role"), text.alias("content")))
    rows = F.concat(message("system", F.lit(system)), F.coalesce("history", F.array().cast("array<struct<role:string,content:string>>")), message("user", asked))
    merged = merge_consecutive(prompts.select("question_id", F.posexplode(rows).alias("at", "m")).select("question_id", "at", "m.*"), "question_id", ["at"])
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("island"))
    return merged.select("question_id", place.alias("position"), "role", "content")
