"""Queries of the relational, retrieval and conversation operators over whole driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorestack.operators import library as L
from lorestack.operators import retrieve as R
from lorestack.operators import store as S
from lorestack.operators import tables as B
from lorestack.operators import turns as U
from lorestack.plans.standins import standin, with_sql
from lorestack.session import shared_dir, table

_DIST = "list_sum(list_transform(list_zip(c.vector::DOUBLE[], q.vector::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
_SEARCH = f""", layered AS (
  SELECT question_id, vector, chat_id, 'chat:' || chat_id AS namespace, 4 AS k FROM questions
  UNION ALL SELECT question_id, vector, chat_id, 'global', 4 FROM questions WHERE use_global
  UNION ALL SELECT question_id, vector, chat_id, 'memory:' || chat_id, 8 FROM questions WHERE use_memory
), near AS (
  SELECT q.question_id, c.namespace, c.doc_id, c.chunk_index, {_DIST} AS distance, q.k, c.text FROM layered q JOIN chunks c ON c.namespace = q.namespace
), hits AS (
  SELECT * EXCLUDE (k), CAST(row_number() OVER (PARTITION BY question_id, namespace ORDER BY distance, doc_id, chunk_index) AS INTEGER) AS place FROM near QUALIFY place <= k
), pool AS (
  SELECT *, min(CASE WHEN NOT isnan(distance) THEN distance END) OVER (PARTITION BY question_id) AS best FROM hits
), others AS (
  SELECT * FROM pool WHERE distance > 0
), ranked AS (
  SELECT question_id, namespace, doc_id, chunk_index, distance, text, CAST(row_number() OVER (PARTITION BY question_id ORDER BY distance, namespace, doc_id, chunk_index) AS INTEGER) AS pool_rank
  FROM (SELECT * EXCLUDE (best), min(distance) OVER (PARTITION BY question_id) AS best FROM others) WHERE distance <= greatest(best * 1.1, 0.1)
), slotted AS (
  SELECT * FROM (SELECT *, namespace LIKE 'memory:%' AS mem, max(namespace LIKE 'memory:%') OVER (PARTITION BY question_id) AS any_mem,
    row_number() OVER (PARTITION BY question_id, namespace LIKE 'memory:%' ORDER BY pool_rank) AS pl FROM ranked) WHERE mem OR pl <= CASE WHEN any_mem THEN 3 ELSE 4 END
)"""


def _hits(spark, d):
    return R.knn_search(standin(spark, d, "chunks"), R.layers(standin(spark, d, "questions")), carry=["text"])


def _ranked(spark, d):
    return R.rank_pool(_hits(spark, d).filter("distance > 0"), factor=1.1)


def _slotted(spark, d):
    return R.layer_slots(_ranked(spark, d))


def r03_knn_search(spark, d):
    chunks = table(spark, d, "embeddings").select(F.lit("all").alias("namespace"), (F.col("vec_id") - F.col("vec_id") % 10).alias("doc_id"), (F.col("vec_id") % 10).cast("int").alias("chunk_index"), F.col("embedding").alias("vector"))
    asked = standin(spark, d, "questions").select("question_id", F.lit("all").alias("namespace"), "vector")
    return R.knn_search(chunks, asked, 4).select("question_id", "doc_id", "chunk_index", "place", F.round("distance", 6).alias("distance"))


def r04_search_layers(spark, d):
    return _hits(spark, d).select("question_id", "namespace", "doc_id", "chunk_index", "place", F.round("distance", 6).alias("distance"))


def a04_pool_cutoff(spark, d):
    some = F.when(F.col("doc_id") % 30 == 0, F.lit(float("nan"))).otherwise(F.col("distance"))
    return R.pool_cutoff(_hits(spark, d).withColumn("distance", some)).select("question_id", "namespace", "doc_id", "chunk_index", F.round("best", 6).alias("best"), F.round("cutoff", 6).alias("cutoff"))


def a05_best_per_layer(spark, d):
    return R.best_per_layer(_hits(spark, d)).select("question_id", F.round("best_memory", 6).alias("best_memory"), F.round("best_documents", 6).alias("best_documents"), "memory_nearer")


def a07_retrieval_quality(spark, d):
    chunks = standin(spark, d, "chunks")
    planted = chunks.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), *R.POSITION)
    return R.retrieval_quality(_hits(spark, d), planted).select("question_id", F.round("best", 6).alias("best"), F.col("planted_rank").cast("long").alias("planted_rank"), "found")


def a07b_retrieval_report(spark, d):
    """Of each question, the chunks of its own document are what it is after."""
    chunks = standin(spark, d, "chunks")
    relevant = chunks.select(F.col("doc_id").alias("question_id"), *R.POSITION)
    report = R.retrieval_report(_hits(spark, d), relevant)
    return report.select("question_id", *(F.round(c, 6).alias(c) for c in ("best_relevant", "worst_relevant", "best_irrelevant", "separation")), "kept", "kept_irrelevant")


def w06_rank_pool(spark, d):
    return _ranked(spark, d).select("question_id", "namespace", "doc_id", "chunk_index", "pool_rank")


def w07_layer_slots(spark, d):
    return _slotted(spark, d).select("question_id", "namespace", "doc_id", "chunk_index", "pool_rank")


def j02_resolve_sources(spark, d):
    documents, attachments = standin(spark, d, "kb_documents").select("doc_id", "filename"), standin(spark, d, "attachments").select("doc_id", "filename")
    return R.resolve_sources(_slotted(spark, d), documents, attachments).select("question_id", "namespace", "doc_id", "chunk_index", "label")


def j03_expand_neighbours(spark, d):
    return R.expand_neighbours(_slotted(spark, d), standin(spark, d, "chunks")).select("question_id", "namespace", "doc_id", "chunk_index", "expanded")


def j04_recall_not_in_prompt(spark, d):
    hits = _hits(spark, d).filter("namespace like 'memory:%'").select("question_id", (F.col("doc_id") + F.col("chunk_index")).alias("answer_id"), "distance")
    return R.recall_not_in_prompt(hits, hits.filter("answer_id % 3 = 0")).select("question_id", "answer_id", F.round("distance", 6).alias("distance"))


def u01_pool_union(spark, d):
    hits = _hits(spark, d)
    both = hits.filter(~R.is_memory(F.col("namespace"))).unionByName(hits.filter(R.is_memory(F.col("namespace"))))
    return both.groupBy("question_id").agg(F.count("*").alias("n"))


def w01_pair_turns(spark, d):
    return U.pair_turns(standin(spark, d, "messages")).select("chat_id", "answer_id", F.md5("question").alias("question_md5"), F.md5("answer").alias("answer_md5"))


def w02_recent_history(spark, d):
    return U.recent_history(standin(spark, d, "messages"), 3).select("chat_id", "id", F.col("place").cast("long").alias("place"))


def w03_budget_allocate(spark, d):
    taken = U.budget_allocate(standin(spark, d, "messages"), "chat_id", [F.col("pos")], F.lit(700))
    return taken.select("id", F.octet_length("taken").cast("long").alias("n_bytes"))


def w04_fit_history(spark, d):
    m = standin(spark, d, "messages").join(standin(spark, d, "chats"), "chat_id")
    return U.fit_history(m, "chat_id", ["pos"], F.lit(900), F.col("use_memory")).select("id", F.octet_length("taken").cast("long").alias("n_bytes"), "leftover")


def w05_merge_consecutive(spark, d):
    m = standin(spark, d, "messages").withColumn("role", F.when(F.col("role") == "system", "user").otherwise(F.col("role")))
    return U.merge_consecutive(m, "chat_id", ["pos"]).select("chat_id", F.col("island").cast("long").alias("island"), "role", F.md5("content").alias("content_md5"))


def a03_context_usage(spark, d):
    return U.context_usage(standin(spark, d, "messages"), "chat_id", default=400).select("chat_id", F.col("tokens").cast("long").alias("tokens"), F.round("ratio", 9).alias("ratio"), "level")


def a09_backfill_count(spark, d):
    turns = U.pair_turns(standin(spark, d, "messages"))
    return U.backfill_count(standin(spark, d, "chats"), turns, turns.filter("answer_id % 2 = 0"))


def a06_latest_status(spark, d):
    return S.latest_status(table(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_type", "value"])


def p01_list_newest_first(spark, d):
    return S.newest_first(standin(spark, d, "kb_documents").filter("namespace = 'global'"), "created_at", "doc_id", ["doc_id", "filename", "status", "created_at"])


def p02_resumable(spark, d):
    return S.resumable(standin(spark, d, "kb_documents")).select("doc_id", "status")


def s01_import_gate(spark, d):
    files = standin(spark, d, "kb_documents").select("doc_id", F.col("filename").alias("path"), F.when(F.col("doc_id") % 9 == 0, None).otherwise(F.col("size_bytes") * 20).alias("length"))
    return S.import_gate(files, most_bytes=50_000).select("doc_id", "status", "reason")


def s05_upsert_chunks(spark, d):
    chunks = standin(spark, d, "chunks").select("namespace", "doc_id", "chunk_index", "text")
    new = chunks.filter("doc_id % 30 = 0 and chunk_index < 4").withColumn("text", F.concat(F.lit("new "), F.col("text")))
    path = shared_dir(spark)
    B.upsert_table(spark, chunks, path)
    B.upsert_table(spark, new, path)
    return B.read_table(spark, path).drop("bucket")


def s06_delete_chunks(spark, d):
    chunks = standin(spark, d, "chunks").select("namespace", "doc_id", "chunk_index")
    path = shared_dir(spark)
    B.upsert_table(spark, chunks, path)
    B.delete_from_table(spark, chunks.filter("doc_id % 70 = 0"), path)
    B.delete_from_table(spark, B.read_table(spark, path).filter("namespace = 'chat:5'"), path)
    return B.read_table(spark, path).drop("bucket")


def j05_fail_interrupted(spark, d):
    fixed, kept = S.fail_interrupted(standin(spark, d, "attachments"), standin(spark, d, "kb_documents"))
    return fixed.select("doc_id", "status", F.lit("attachment").alias("kind")).unionByName(kept.select("doc_id", "status", F.lit("document").alias("kind")))


def j06_live_only(spark, d):
    return S.live_only(standin(spark, d, "chunks").select("doc_id", "chunk_index"), standin(spark, d, "kb_documents").filter("status = 'ready'"))


def l05_cascade_delete(spark, d):
    gone = standin(spark, d, "chats").filter("chat_id % 5 = 0").select("chat_id")
    m, a, c = S.cascade_delete_chats(gone, standin(spark, d, "messages"), standin(spark, d, "attachments"), standin(spark, d, "chunks"))
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(m, "messages").unionByName(count(a, "attachments")).unionByName(count(c, "chunks"))


def w09_unique_names(spark, d):
    """All files; every fortieth is stored already, and some have a numbered name of their own."""
    number = F.when(F.col("doc_id") % 97 == 5, F.concat(F.lit(" ("), (F.col("doc_id") % 4 + 2).cast("string"), F.lit(")."))).otherwise(".")
    docs = standin(spark, d, "kb_documents").select("doc_id", F.concat(F.substring_index("filename", ".", 1), number, F.substring_index("filename", ".", -1)).alias("filename"))
    return S.unique_names(docs.filter("doc_id % 40 > 0"), docs.filter("doc_id % 40 = 0").select("filename"), ["doc_id"])


def w10_keep_one_active(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", (F.col("event_type") == "click").alias("active"), "ts")
    return S.keep_one_active(e, ["user_id"], ["ts", "event_id"]).select("event_id", "active")


def l14_reset_interrupted(spark, d):
    return S.reset_interrupted(standin(spark, d, "books")).select("book_id", "status")


def l16_upgrade_tables(spark, d):
    books = standin(spark, d, "books").select("book_id", "filename", "last_page")
    return S.upgrade(S.upgrade(books, "books"), "books")


def l16b_version_ledger(spark, d):
    """Books that went through one step already, brought to the last version; then again, which changes nothing."""
    books = standin(spark, d, "books").select("book_id", "filename", "status")
    ledger = spark.createDataFrame([("books", 10, "status")], S.LEDGER)
    tables, ledger = S.migrate(*S.migrate({"books": books}, ledger))
    steps = ledger.groupBy("table_name").agg(F.max("version").alias("version"), F.count("*").alias("steps")).filter("table_name = 'books'")
    return tables["books"].withColumn("table_name", F.lit("books")).join(steps, "table_name").select("book_id", "status", "page_count", "reading_language", "version", "steps")


def l07c_repaginate_books(spark, d):
    """Every second book is cut anew; the books and the readings after it."""
    books, readings = standin(spark, d, "books"), standin(spark, d, "readings")
    counts = books.filter("book_id % 2 = 0").select("book_id", (F.col("book_id") % 12).cast("int").alias("page_count"))
    new, moved = L.repaginate(books, readings, counts)
    return new.select(F.lit("book").alias("kind"), F.col("book_id").alias("id"), "page_count", "last_page", "status").unionByName(moved.select(F.lit("reading").alias("kind"), F.col("reading_id").alias("id"), F.lit(None).cast("int").alias("page_count"), "last_page", F.lit(None).cast("string").alias("status")))


def r05_first_n_sorted(spark, d):
    return S.first_n(table(spark, d, "orders"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 20).select("o_orderkey")


def j01_reading_history(spark, d):
    return L.reading_history(standin(spark, d, "readings"), standin(spark, d, "books").select("book_id", "filename", "page_count")).select("reading_id", "book_id", "filename", "last_page", "last_opened_at")


def j09_save_positions(spark, d):
    r = standin(spark, d, "readings")
    new = r.filter("reading_id % 4 = 0").select("reading_id", (F.col("reading_id") % 90).cast("int").alias("page"))
    return L.save_positions(r, new, standin(spark, d, "books")).select("reading_id", "last_page")


def l07_clamp_after_repaginate(spark, d):
    counts = standin(spark, d, "books").filter("book_id % 2 = 0").select("book_id", (F.col("book_id") % 12).cast("int").alias("page_count"))
    return L.clamp_after_repaginate(standin(spark, d, "readings"), counts).select("reading_id", "last_page")


def l05b_cascade_books_documents(spark, d):
    gone = standin(spark, d, "books").filter("status = 'ready'").select("book_id")
    r, p = S.cascade_delete_books(gone, standin(spark, d, "readings"), standin(spark, d, "book_pages"))
    docs, c = S.cascade_delete_documents(standin(spark, d, "kb_documents").filter("status = 'error'").select("doc_id"), standin(spark, d, "kb_documents"), standin(spark, d, "chunks"))
    each = [r.select(F.lit("reading").alias("kind"), F.col("reading_id").alias("id")), p.select(F.lit("page"), F.col("book_id")), docs.select(F.lit("document"), F.col("doc_id")), c.select(F.lit("chunk"), F.col("vec_id"))]
    return each[0].union(each[1]).union(each[2]).union(each[3]).groupBy("kind", "id").agg(F.count("*").alias("n"))


def l07b_set_reading_language(spark, d):
    chosen = standin(spark, d, "books").filter("status <> 'ready'").select("book_id", F.element_at(F.array(F.lit("original"), F.lit("de")), (F.col("book_id") % 2 + 1).cast("int")).alias("language"))
    return L.set_reading_language(standin(spark, d, "books"), chosen).select("book_id", "reading_language")


def a08b_remove_languages(spark, d):
    removals = standin(spark, d, "books").filter("status <> 'ready'").select("book_id", F.lit("es").alias("language"))
    left, books = L.remove_languages(standin(spark, d, "book_pages"), standin(spark, d, "books"), removals)
    pages = left.groupBy("book_id").agg(F.count("*").alias("pages"))
    return books.join(pages, "book_id", "left").select("book_id", "reading_language", F.coalesce("pages", F.lit(0)).cast("long").alias("pages"))


def l15_positions_to_readings(spark, d):
    return L.positions_to_readings(standin(spark, d, "books"))


def a01_language_coverage(spark, d):
    return L.language_coverage(standin(spark, d, "book_pages"), standin(spark, d, "books")).select("book_id", "language", F.col("pages").cast("long").alias("pages"), "is_reading")


def _wanted(spark, d):
    return standin(spark, d, "books").select("book_id", F.explode(F.array(F.lit("en"), F.lit("original"))).alias("language"), "page_count")


def a02_next_missing_page(spark, d):
    return L.next_missing_page(standin(spark, d, "book_pages"), _wanted(spark, d))


def a08_removed_count(spark, d):
    return L.removed_count(standin(spark, d, "book_pages"), _wanted(spark, d).select("book_id", "language"))


def j07_page_with_fallback(spark, d):
    asked = table(spark, d, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("book_id"), F.when(F.col("event_id") % 2 == 0, "en").otherwise("es").alias("language"), (F.col("event_id") % 41).cast("int").alias("index"))
    return L.page_with_fallback(asked, standin(spark, d, "book_pages"), standin(spark, d, "books"))


def x02_mark_for_retranslation(spark, d):
    chosen = standin(spark, d, "book_pages").select("book_id", "language", ((F.col("page") * 7) % 43).alias("index")).distinct()
    kept, refused = L.mark_for_retranslation(standin(spark, d, "book_pages"), chosen, standin(spark, d, "books"))
    return kept.groupBy("book_id").agg(F.count("*").alias("kept")).join(refused.groupBy("book_id").agg(F.count("*").alias("refused")), "book_id", "left")


def u03_missing_languages(spark, d):
    return L.missing_languages(standin(spark, d, "books"), ["en", "es", "fr"], standin(spark, d, "book_pages"))


def j12_manifest_spine(spark, d):
    lines = table(spark, d, "lineitem")
    spine = lines.select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("idref"))
    manifest = lines.filter("l_partkey % 9 > 0").select(F.col("l_orderkey").alias("book_id"), F.col("l_partkey").alias("idref"), F.concat(F.lit("c"), F.col("l_partkey").cast("string")).alias("href")).distinct()
    return L.manifest_spine(spine, manifest)


def p06_catalog_search(spark, d):
    return L.catalog_search(standin(spark, d, "voices"), "HIGH", "en").select("voice")


def p07_distinct_languages(spark, d):
    return L.distinct_languages(standin(spark, d, "voices"))


def w11_quality_order(spark, d):
    return L.quality_order(standin(spark, d, "voices")).select("voice", L.quality_rank(F.col("quality")).alias("rank"))


def u02_catalog_union(spark, d):
    v = standin(spark, d, "voices")
    fixed = v.filter("pos % 10 = 0").withColumn("quality", F.lit("kokoro"))
    full, empty = L.catalog_union(v.filter("pos % 2 = 0"), v, fixed), L.catalog_union(v.filter("pos < 0"), v, fixed)
    return full.select("voice", "quality", F.lit("full").alias("kind")).unionByName(empty.select("voice", "quality", F.lit("empty").alias("kind")))


def u04_drop_low_unless_only(spark, d):
    return L.drop_low_unless_only(standin(spark, d, "voices")).select("voice")


def j10_resolve_preferred(spark, d):
    v = standin(spark, d, "voices")
    languages = standin(spark, d, "books").select(F.coalesce("reading_language", F.lit("original")).alias("language")).unionByName(v.select("language")).unionByName(v.select(L.voice_language(F.col("voice")).alias("language")))
    pins = v.filter("pos % 97 = 1").groupBy(L.voice_language(F.col("voice")).alias("language")).agg(F.max("voice").alias("voice"))
    return L.resolve_preferred(languages, pins, v.filter("pos % 3 > 0"))


def j11_match_limits(spark, d):
    entries = table(spark, d, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("id"), (F.col("n_regionkey") * 1024).alias("context"))
    models = table(spark, d, "nation").select(F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).when(F.col("n_nationkey") % 3 == 1, F.substring("n_name", 3, 50)).otherwise(F.lit("absent")).alias("model")).distinct()
    return L.match_limits(models, entries)


def t21_parse_manifest(spark, d):
    json = F.format_string('{"%s": {"name": "%s", "language": {"code": "%s"}, "files": {"a/%s.onnx": {"size_bytes": %d}, "a/%s.onnx.json": {"size_bytes": 1}}}, "x-bad": {"files": {"b.onnx": {"size_bytes": 2}}}}', "voice", "display_name", "language", "voice", "pos", "voice")
    return L.parse_manifest(standin(spark, d, "voices").select(json.alias("json"))).select("voice", "display_name", "language", "language_name", "quality", "model", "config", "size_bytes")


_SKIP = {"table", "standin", "with_sql"}
QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_") and k not in _SKIP}

_VL = "CASE language WHEN 'original' THEN 'pt' ELSE language END"
ORACLE_SQL = {
    "r03_knn_search": f"SELECT q.vec_id AS question_id, c.vec_id - c.vec_id % 10 AS doc_id, CAST(c.vec_id % 10 AS INTEGER) AS chunk_index, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST}, c.vec_id) AS INTEGER) AS place, round({_DIST}, 6) AS distance FROM (SELECT vec_id, embedding AS vector FROM embeddings WHERE vec_id % 50 = 0) q, (SELECT vec_id, embedding AS vector FROM embeddings) c QUALIFY place <= 4",
    "r04_search_layers": with_sql("chunks questions", _SEARCH + " SELECT question_id, namespace, doc_id, chunk_index, place, round(distance, 6) AS distance FROM hits"),
    "a04_pool_cutoff": with_sql("chunks questions", _SEARCH + " SELECT question_id, namespace, doc_id, chunk_index, round(b, 6) AS best, round(greatest(b * 3, 0.1), 6) AS cutoff FROM (SELECT *, min(CASE WHEN doc_id % 30 <> 0 THEN distance END) OVER (PARTITION BY question_id) AS b FROM hits)"),
    "a05_best_per_layer": with_sql("chunks questions", _SEARCH + " SELECT question_id, round(m, 6) AS best_memory, round(o, 6) AS best_documents, coalesce(m < o, m IS NOT NULL) AS memory_nearer FROM (SELECT question_id, min(CASE WHEN namespace LIKE 'memory:%' THEN distance END) AS m, min(CASE WHEN namespace NOT LIKE 'memory:%' THEN distance END) AS o FROM hits GROUP BY 1)"),
    "a07_retrieval_quality": with_sql("chunks questions", _SEARCH + ", r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, namespace, doc_id, chunk_index) AS rk FROM hits) SELECT question_id, round(min(distance), 6) AS best, min(CASE WHEN doc_id + chunk_index = question_id THEN rk END) AS planted_rank, coalesce(min(CASE WHEN doc_id + chunk_index = question_id THEN rk END) <= 8, false) AS found FROM r GROUP BY 1"),
    "a07b_retrieval_report": with_sql("chunks questions", _SEARCH + ", b AS (SELECT *, greatest(min(distance) OVER (PARTITION BY question_id) * 3, 0.1) AS cut, doc_id = question_id AS good FROM hits), g AS (SELECT question_id, min(distance) FILTER (good) AS br, max(distance) FILTER (good) AS wr, min(distance) FILTER (NOT good) AS bi, count(*) FILTER (distance <= cut) AS kept, count(*) FILTER (distance <= cut AND NOT good) AS kept_irrelevant FROM b GROUP BY 1) SELECT question_id, round(br, 6) AS best_relevant, round(wr, 6) AS worst_relevant, round(bi, 6) AS best_irrelevant, round(bi - wr, 6) AS separation, kept, kept_irrelevant FROM g"),
    "l16b_version_ledger": with_sql("books", "SELECT book_id, status, 0 AS page_count, CAST(NULL AS VARCHAR) AS reading_language, 10 AS version, CAST(4 AS BIGINT) AS steps FROM books"),
    "l07c_repaginate_books": with_sql("books readings", "SELECT 'book' AS kind, book_id AS id, CASE WHEN book_id % 2 = 0 THEN CAST(book_id % 12 AS INTEGER) ELSE page_count END AS page_count, CASE WHEN book_id % 2 = 0 THEN CASE WHEN last_page IS NULL THEN greatest(CAST(book_id % 12 AS INTEGER) - 1, 0) ELSE least(last_page, greatest(CAST(book_id % 12 AS INTEGER) - 1, 0)) END ELSE last_page END AS last_page, CASE WHEN book_id % 2 = 0 THEN 'ready' ELSE status END AS status FROM books UNION ALL SELECT 'reading', reading_id, NULL, CAST(CASE WHEN b.book_id IS NULL THEN r.last_page ELSE least(r.last_page, greatest(b.book_id % 12 - 1, 0)) END AS INTEGER), NULL FROM readings r LEFT JOIN (SELECT book_id FROM books WHERE book_id % 2 = 0) b ON b.book_id = r.book_id"),
    "w06_rank_pool": with_sql("chunks questions", _SEARCH + " SELECT question_id, namespace, doc_id, chunk_index, pool_rank FROM ranked"),
    "w07_layer_slots": with_sql("chunks questions", _SEARCH + " SELECT question_id, namespace, doc_id, chunk_index, pool_rank FROM slotted"),
    "j02_resolve_sources": with_sql("chunks questions kb_documents attachments", _SEARCH + " SELECT question_id, s.namespace, s.doc_id, chunk_index, coalesce(CASE WHEN s.namespace = 'global' THEN d.filename ELSE a.filename END, 'documento') AS label FROM slotted s LEFT JOIN kb_documents d ON d.doc_id = s.doc_id LEFT JOIN attachments a ON a.doc_id = s.doc_id"),
    "j03_expand_neighbours": with_sql("chunks questions", _SEARCH + " SELECT s.question_id, s.namespace, s.doc_id, s.chunk_index, s.text || CASE WHEN n.text IS NOT NULL AND t.question_id IS NULL THEN chr(10) || n.text ELSE '' END AS expanded FROM slotted s LEFT JOIN chunks n ON n.namespace = s.namespace AND n.doc_id = s.doc_id AND n.chunk_index = s.chunk_index + 1 LEFT JOIN slotted t ON t.question_id = s.question_id AND t.namespace = s.namespace AND t.doc_id = s.doc_id AND t.chunk_index = s.chunk_index + 1"),
    "j04_recall_not_in_prompt": with_sql("chunks questions", _SEARCH + " SELECT question_id, doc_id + chunk_index AS answer_id, round(distance, 6) AS distance FROM hits WHERE namespace LIKE 'memory:%' AND (doc_id + chunk_index) % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY distance, doc_id + chunk_index) = 1"),
    "u01_pool_union": with_sql("chunks questions", _SEARCH + " SELECT question_id, count(*) AS n FROM hits GROUP BY 1"),
    "w01_pair_turns": with_sql("messages", "SELECT chat_id, id AS answer_id, md5(q) AS question_md5, md5(content) AS answer_md5 FROM (SELECT *, lag(role) OVER w AS r, lag(content) OVER w AS q FROM messages WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY chat_id ORDER BY pos)) WHERE role = 'assistant' AND r = 'user'"),
    "w02_recent_history": with_sql("messages", "SELECT chat_id, id, row_number() OVER (PARTITION BY chat_id ORDER BY pos) AS place FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY pos DESC) AS age FROM messages) WHERE age BETWEEN 2 AND 4"),
    "w03_budget_allocate": with_sql("messages", ", b AS (SELECT *, 700 - coalesce(sum(strlen(content)) OVER (PARTITION BY chat_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rem FROM messages) SELECT id, n_bytes FROM (SELECT id, CASE WHEN strlen(content) <= rem THEN strlen(content) ELSE list_max(list_filter(list_transform(range(0, CAST(rem + 1 AS BIGINT)), lambda i: strlen(substr(content, 1, i))), lambda x: x <= rem)) END AS n_bytes FROM b WHERE rem > 0) WHERE n_bytes > 0"),
    "w04_fit_history": with_sql("messages chats", ", b AS (SELECT m.*, CASE WHEN use_memory THEN 135 ELSE 0 END AS held, 900 - CASE WHEN use_memory THEN 135 ELSE 0 END - coalesce(sum(strlen(content)) OVER (PARTITION BY chat_id ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rem FROM messages m JOIN chats c USING (chat_id)), t AS (SELECT id, chat_id, held, CASE WHEN strlen(content) <= rem THEN strlen(content) ELSE list_max(list_filter(list_transform(range(0, CAST(rem + 1 AS BIGINT)), lambda i: strlen(substr(content, 1, i))), lambda x: x <= rem)) END AS n_bytes FROM b WHERE rem > 0) SELECT id, n_bytes, CAST(greatest(900 - held - sum(n_bytes) OVER (PARTITION BY chat_id), 0) + held AS BIGINT) AS leftover FROM t WHERE n_bytes > 0"),
    "w05_merge_consecutive": with_sql("messages", ", r AS (SELECT chat_id, pos, content, CASE WHEN role = 'system' THEN 'user' ELSE role END AS role FROM messages), i AS (SELECT *, sum(CASE WHEN l IS NOT DISTINCT FROM role THEN 0 ELSE 1 END) OVER (PARTITION BY chat_id ORDER BY pos) AS island FROM (SELECT *, lag(role) OVER (PARTITION BY chat_id ORDER BY pos) AS l FROM r)) SELECT chat_id, CAST(island AS BIGINT) AS island, role, md5(string_agg(content, chr(10) || chr(10) ORDER BY pos)) AS content_md5 FROM i GROUP BY chat_id, island, role"),
    "a03_context_usage": with_sql("messages", "SELECT chat_id, t AS tokens, round(least(t / 400, 1), 9) AS ratio, CASE WHEN t / 400 >= 1 THEN 'red' WHEN t / 400 >= 0.75 THEN 'amber' ELSE 'green' END AS level FROM (SELECT chat_id, CAST(ceil(sum(length(coalesce(content, ''))) / 4) AS BIGINT) AS t FROM messages GROUP BY 1)"),
    "a09_backfill_count": with_sql("messages chats", ", t AS (SELECT chat_id, id FROM (SELECT *, lag(role) OVER (PARTITION BY chat_id ORDER BY pos) AS r FROM messages WHERE role IN ('user', 'assistant')) WHERE role = 'assistant' AND r = 'user') SELECT c.chat_id, count(t.id) AS total, count(CASE WHEN t.id % 2 = 0 THEN 1 END) AS done FROM chats c LEFT JOIN t ON t.chat_id = c.chat_id GROUP BY 1"),
    "a06_latest_status": "SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "p01_list_newest_first": with_sql("kb_documents", "SELECT doc_id, filename, status, created_at FROM kb_documents WHERE namespace = 'global'"),
    "p02_resumable": with_sql("kb_documents", "SELECT doc_id, status FROM kb_documents WHERE namespace = 'global' AND status IN ('queued', 'parsing', 'chunking', 'embedding')"),
    "s01_import_gate": with_sql("kb_documents", ", g AS (SELECT doc_id, CASE WHEN filename LIKE '%.png' THEN 'unsupported' WHEN doc_id % 9 = 0 THEN 'unreadable' WHEN size_bytes * 20 > 50000 THEN 'too_large' END AS reason FROM kb_documents) SELECT doc_id, CASE WHEN reason IS NULL THEN 'queued' ELSE 'rejected' END AS status, reason FROM g"),
    "s05_upsert_chunks": with_sql("chunks", "SELECT namespace, doc_id, chunk_index, text FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM chunks n WHERE n.doc_id % 30 = 0 AND n.chunk_index < 4 AND n.namespace = c.namespace AND n.doc_id = c.doc_id) UNION ALL SELECT namespace, doc_id, chunk_index, 'new ' || text FROM chunks WHERE doc_id % 30 = 0 AND chunk_index < 4"),
    "s06_delete_chunks": with_sql("chunks", "SELECT namespace, doc_id, chunk_index FROM chunks WHERE doc_id % 70 <> 0 AND namespace <> 'chat:5'"),
    "j05_fail_interrupted": with_sql("attachments kb_documents", "SELECT a.doc_id, CASE WHEN b.doc_id IS NOT NULL AND a.status NOT IN ('ready', 'error', 'injected_whole') THEN 'error' ELSE a.status END AS status, 'attachment' AS kind FROM attachments a LEFT JOIN (SELECT doc_id FROM kb_documents WHERE namespace <> 'global') b ON a.doc_id = b.doc_id UNION ALL SELECT doc_id, status, 'document' FROM kb_documents WHERE namespace = 'global'"),
    "j06_live_only": with_sql("chunks kb_documents", "SELECT doc_id, chunk_index FROM chunks WHERE doc_id IN (SELECT doc_id FROM kb_documents WHERE status = 'ready')"),
    "l05_cascade_delete": with_sql("chats messages attachments chunks", ", g AS (SELECT chat_id FROM chats WHERE chat_id % 5 = 0) SELECT 'messages' AS kind, count(*) AS n FROM messages WHERE chat_id NOT IN (FROM g) UNION ALL SELECT 'attachments', count(*) FROM attachments WHERE chat_id NOT IN (FROM g) UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE namespace NOT IN (SELECT 'chat:' || chat_id FROM g) AND namespace NOT IN (SELECT 'memory:' || chat_id FROM g)"),
    "w09_unique_names": with_sql("kb_documents", r""", f AS (SELECT doc_id, regexp_replace(filename, '\.[^.]+$', '') || CASE WHEN doc_id % 97 = 5 THEN ' (' || (doc_id % 4 + 2) || ')' ELSE '' END || regexp_extract(filename, '\.[^.]+$') AS filename FROM kb_documents),
      n AS (SELECT doc_id, filename, row_number() OVER (PARTITION BY filename ORDER BY doc_id) - 1 + CASE WHEN filename IN (SELECT filename FROM f WHERE doc_id % 40 = 0) THEN 1 ELSE 0 END AS m FROM f WHERE doc_id % 40 > 0),
      c AS (SELECT filename, unnest(range(2, max(m) + 8)) AS k FROM n GROUP BY filename),
      b AS (SELECT filename, k, regexp_replace(filename, '\.[^.]+$', '') || ' (' || k || ')' || regexp_extract(filename, '\.[^.]+$') AS made FROM c),
      o AS (SELECT filename, made, row_number() OVER (PARTITION BY filename ORDER BY k) AS m FROM b WHERE made NOT IN (SELECT filename FROM f))
      SELECT doc_id, n.filename, coalesce(made, n.filename) AS stored_name FROM n LEFT JOIN o ON o.filename = n.filename AND o.m = n.m"""),
    "w10_keep_one_active": "SELECT event_id, event_type = 'click' AND row_number() OVER (PARTITION BY user_id, event_type = 'click' ORDER BY ts, event_id) = 1 AS active FROM events",
    "l14_reset_interrupted": with_sql("books", "SELECT book_id, CASE WHEN status IN ('extracting', 'paginating') THEN 'imported' ELSE status END AS status FROM books"),
    "l16_upgrade_tables": with_sql("books", "SELECT book_id, filename, last_page, 'imported' AS status, CAST(NULL AS VARCHAR) AS error_message, 0 AS page_count, CAST(NULL AS VARCHAR) AS reading_language FROM books"),
    "r05_first_n_sorted": "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "j01_reading_history": with_sql("readings books", "SELECT reading_id, r.book_id, filename, least(r.last_page, greatest(page_count - 1, 0)) AS last_page, r.last_opened_at FROM readings r JOIN books b ON b.book_id = r.book_id"),
    "j09_save_positions": with_sql("readings books", "SELECT reading_id, CASE WHEN reading_id % 4 = 0 THEN CAST(least(reading_id % 90, greatest(coalesce(page_count, 0) - 1, 0)) AS INTEGER) ELSE r.last_page END AS last_page FROM readings r LEFT JOIN books b ON b.book_id = r.book_id"),
    "l05b_cascade_books_documents": with_sql("books readings book_pages kb_documents chunks", ", g AS (SELECT book_id FROM books WHERE status = 'ready'), e AS (SELECT doc_id FROM kb_documents WHERE status = 'error'), x AS (SELECT 'reading' AS kind, reading_id AS id FROM readings WHERE book_id NOT IN (FROM g) UNION ALL SELECT 'page', book_id FROM book_pages WHERE book_id NOT IN (FROM g) UNION ALL SELECT 'document', doc_id FROM kb_documents WHERE doc_id NOT IN (FROM e) UNION ALL SELECT 'chunk', vec_id FROM chunks WHERE doc_id NOT IN (FROM e)) SELECT kind, id, count(*) AS n FROM x GROUP BY ALL"),
    "l07b_set_reading_language": with_sql("books", "SELECT book_id, CASE WHEN status = 'ready' THEN reading_language WHEN book_id % 2 = 1 THEN 'de' END AS reading_language FROM books"),
    "a08b_remove_languages": with_sql("books book_pages", "SELECT b.book_id, any_value(CASE WHEN status <> 'ready' AND reading_language = 'es' THEN NULL ELSE reading_language END) AS reading_language, count(p.book_id) AS pages FROM books b LEFT JOIN book_pages p ON p.book_id = b.book_id AND NOT (b.status <> 'ready' AND p.language = 'es') GROUP BY 1"),
    "l07_clamp_after_repaginate": with_sql("readings books", "SELECT reading_id, CASE WHEN b.book_id IS NULL THEN r.last_page ELSE CAST(least(r.last_page, greatest(b.book_id % 12 - 1, 0)) AS INTEGER) END AS last_page FROM readings r LEFT JOIN (SELECT book_id FROM books WHERE book_id % 2 = 0) b ON b.book_id = r.book_id"),
    "l15_positions_to_readings": with_sql("books", "SELECT book_id AS reading_id, book_id, coalesce(last_page, 0) AS last_page, last_opened_at FROM books WHERE last_opened_at IS NOT NULL"),
    "a01_language_coverage": with_sql("books book_pages", "SELECT p.book_id, language, count(DISTINCT page) AS pages, language = coalesce(reading_language, 'original') AS is_reading FROM book_pages p JOIN books b ON b.book_id = p.book_id WHERE language <> 'images' GROUP BY 1, 2, 4"),
    "a02_next_missing_page": with_sql("books book_pages", ", w AS (SELECT book_id, unnest(['en', 'original']) AS language, page_count FROM books), e AS (SELECT book_id, language, unnest(range(1, page_count + 1)) AS page FROM w) SELECT w.book_id, w.language, CAST(m.p AS INTEGER) AS next_missing FROM w LEFT JOIN (SELECT book_id, language, min(page) AS p FROM e WHERE (book_id, language, page) NOT IN (SELECT (book_id, language, page) FROM book_pages) GROUP BY 1, 2) m ON m.book_id = w.book_id AND m.language = w.language"),
    "a08_removed_count": with_sql("books book_pages", ", w AS (SELECT book_id, unnest(['en', 'original']) AS language FROM books) SELECT w.book_id, w.language, count(p.book_id) AS removed FROM w LEFT JOIN book_pages p ON p.book_id = w.book_id AND p.language = w.language GROUP BY 1, 2"),
    "j07_page_with_fallback": with_sql("books book_pages", ", b AS (SELECT book_id, language, page, arg_min(format, f) AS format, arg_min(text, f) AS text FROM (SELECT *, CASE WHEN format = 'html' THEN 0 ELSE 1 END AS f FROM book_pages) GROUP BY 1, 2, 3), a AS (SELECT event_id AS request_id, user_id AS book_id, CASE WHEN event_id % 2 = 0 THEN 'en' ELSE 'es' END AS language, event_id % 41 + 1 AS page FROM events), j AS (SELECT a.request_id, CASE WHEN o.text IS NOT NULL THEN a.language WHEN f.text IS NOT NULL THEN 'original' END AS s, coalesce(o.format, f.format) AS fo, coalesce(o.text, f.text) AS te, CASE WHEN k.page_count IS NULL OR a.page > k.page_count THEN 'no_such_page' WHEN o.text IS NULL AND f.text IS NULL THEN 'page_missing' END AS error FROM a LEFT JOIN books k ON k.book_id = a.book_id LEFT JOIN b o ON o.book_id = a.book_id AND o.language = a.language AND o.page = a.page LEFT JOIN b f ON f.book_id = a.book_id AND f.language = 'original' AND f.page = a.page) SELECT request_id, CASE WHEN error IS NULL THEN s END AS served_language, CASE WHEN error IS NULL THEN fo END AS format, CASE WHEN error IS NULL THEN te END AS text, error FROM j"),
    "x02_mark_for_retranslation": with_sql("books book_pages", ", c AS (SELECT DISTINCT book_id, language, page * 7 % 43 AS i FROM book_pages), j AS (SELECT c.*, CASE WHEN language = 'original' THEN 'o' WHEN page_count IS NULL OR i >= page_count THEN 'n' END AS reason FROM c LEFT JOIN books b ON b.book_id = c.book_id) SELECT k.book_id, k.kept, r.refused FROM (SELECT book_id, count(*) AS kept FROM book_pages WHERE (book_id, language, page) NOT IN (SELECT (book_id, language, i + 1) FROM j WHERE reason IS NULL) GROUP BY 1) k LEFT JOIN (SELECT book_id, count(*) AS refused FROM j WHERE reason IS NOT NULL GROUP BY 1) r ON r.book_id = k.book_id"),
    "u03_missing_languages": with_sql("books book_pages", "SELECT book_id, unnest(['en', 'es', 'fr']) AS language FROM books EXCEPT SELECT book_id, language FROM book_pages"),
    "j12_manifest_spine": "SELECT l_orderkey AS book_id, l_linenumber AS pos, l_partkey AS idref, CASE WHEN l_partkey % 9 > 0 THEN 'c' || l_partkey END AS href, CASE WHEN l_partkey % 9 = 0 THEN 'unknown_idref' END AS error FROM lineitem",
    "p06_catalog_search": with_sql("voices", "SELECT voice FROM voices WHERE language = 'en' AND contains(lower(concat_ws(' ', display_name, language, language_name, quality)), 'high')"),
    "p07_distinct_languages": with_sql("voices", "SELECT language, arg_max(language_name, pos) AS language_name FROM voices GROUP BY 1"),
    "w11_quality_order": with_sql("voices", "SELECT voice, CASE quality WHEN 'kokoro' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS rank FROM voices"),
    "u02_catalog_union": with_sql("voices", "SELECT voice, quality, 'full' AS kind FROM voices WHERE pos % 2 = 0 UNION ALL SELECT voice, 'kokoro', 'full' FROM voices WHERE pos % 10 = 0 UNION ALL SELECT voice, quality, 'empty' FROM voices UNION ALL SELECT voice, 'kokoro', 'empty' FROM voices WHERE pos % 10 = 0"),
    "u04_drop_low_unless_only": with_sql("voices", "SELECT voice FROM voices WHERE quality <> 'low' OR language NOT IN (SELECT language FROM voices WHERE quality IN ('high', 'medium'))"),
    "j10_resolve_preferred": with_sql("books voices", r", l AS (SELECT DISTINCT language FROM (SELECT coalesce(reading_language, 'original') AS language FROM books UNION ALL SELECT language FROM voices UNION ALL SELECT split_part(voice, '-', 1) FROM voices)), a AS (SELECT language, lower(regexp_extract(CASE language WHEN 'original' THEN 'pt' ELSE language END, '^[^-_]*')) AS pre FROM l), p AS (SELECT split_part(voice, '-', 1) AS lang, max(voice) AS voice FROM voices WHERE pos % 97 = 1 GROUP BY 1), pp AS (SELECT lower(regexp_extract(lang, '^[^-_]*')) AS pre, arg_min(voice, lang) AS voice FROM p GROUP BY 1), h AS (SELECT voice, lower(regexp_extract(voice, '^[^-_]*')) AS pre FROM voices WHERE pos % 3 > 0), f AS (SELECT pre, min(voice) AS voice FROM h GROUP BY 1) SELECT a.language, coalesce(h.voice, f.voice) AS voice FROM a LEFT JOIN p ON p.lang = a.language LEFT JOIN pp ON pp.pre = a.pre LEFT JOIN f ON f.pre = a.pre LEFT JOIN h ON h.voice = coalesce(p.voice, pp.voice)"),
    "j11_match_limits": "SELECT model, arg_min(n_name, k) AS id, arg_min(n_regionkey * 1024, k) AS context FROM (SELECT m.model, n.n_name, n.n_regionkey, CASE WHEN n_name = model THEN 0 WHEN ends_with(n_name, model) THEN 100 ELSE 200 END + n.n_nationkey AS k FROM (SELECT DISTINCT CASE WHEN n_nationkey % 3 = 0 THEN n_name WHEN n_nationkey % 3 = 1 THEN substr(n_name, 3, 50) ELSE 'absent' END AS model FROM nation) m, nation n) GROUP BY 1",
    "t21_parse_manifest": with_sql("voices", "SELECT voice, display_name, language, language AS language_name, 'medium' AS quality, 'a/' || voice || '.onnx' AS model, 'a/' || voice || '.onnx.json' AS config, pos AS size_bytes FROM voices"),
}
