"""Queries of the text functions over whole driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorestack.functions import text as X
from lorestack.plans.standins import standin, with_sql
from lorestack.session import table

_WS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"


def t01_words(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.words(F.col("text"))).cast("long").alias("n_words"), F.get(X.words(F.col("text")), 0).alias("first_word"))


def t02_repair_hyphens(spark, d):
    broken = F.replace(F.col("text"), F.lit("er "), F.lit("er- "))
    return table(spark, d, "documents").select("doc_id", F.md5(X.repair_hyphens(broken)).alias("repaired_md5"), F.length(X.repair_hyphens(broken)).cast("long").alias("n"))


def t03_chunk_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(X.chunks(F.col("text"))).alias("chunk_index", "text")).select("doc_id", "chunk_index", F.md5("text").alias("chunk_md5"), F.length("text").cast("long").alias("n"))


def t04_paragraphs(spark, d):
    spaced = F.replace(F.col("text"), F.lit("\n"), F.lit(" \n\n "))
    return table(spark, d, "documents").select("doc_id", F.posexplode(X.paragraphs(spaced)).alias("pos", "paragraph")).select("doc_id", "pos", F.md5("paragraph").alias("paragraph_md5"))


def t05_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence")).select("doc_id", "pos", F.md5("sentence").alias("sentence_md5"))


def t13_image_markers(spark, d):
    doc = table(spark, d, "documents").withColumn("marker", X.image_marker(F.col("doc_id") % 20000, F.element_at(F.array(F.lit("png"), F.lit("jpeg")), (F.col("doc_id") % 2 + 1).cast("int"))))
    marked = F.concat(F.col("text"), F.lit(" "), F.col("marker"), F.lit("  tail"))
    return doc.select("doc_id", "marker", X.is_image_marker(F.concat(F.lit(" "), F.col("marker"))).alias("whole"), X.is_image_marker(marked).alias("inline"), X.without_image_markers(marked).alias("clean"))


def t16_truncate_utf8(spark, d):
    return table(spark, d, "documents").select("doc_id", X.truncate_utf8(F.col("text"), (F.col("doc_id") % 97 + 1).cast("int")).alias("cut"))


def t17_format_blocks(spark, d):
    m = standin(spark, d, "messages")
    block = X.source_block(F.concat(F.lit("m"), F.col("id").cast("string")), F.col("content"))
    both = X.joined_sections(block, F.when(F.col("role") == "user", F.lit("u")), F.lit(""), X.turn_text(F.col("role"), F.lit("r")))
    return m.select("id", F.md5(block).alias("block_md5"), F.md5(both).alias("joined_md5"))


def t18_namespace_of(spark, d):
    return standin(spark, d, "chats").select("chat_id", X.namespace_of(F.lit("global"), F.col("chat_id")).alias("g"), X.namespace_of(F.lit("chat"), F.col("chat_id")).alias("c"), X.namespace_of(F.lit("memory"), F.col("chat_id")).alias("m"))


def t19_token_budgets(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 > 0, (F.col("o_orderkey") % 9000).cast("int")).alias("ctx"))
    return o.select("o_orderkey", X.answer_budget(F.col("ctx")).cast("int").alias("answer"), X.prompt_budget(F.col("ctx")).cast("int").alias("prompt"))


def t20_ram_estimate(spark, d):
    kinds = F.array(*(F.lit(x) for x in ("Q4", "Q5", "Q8", "F16", "odd")))
    o = table(spark, d, "orders").select("o_orderkey", F.element_at(kinds, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("q"))
    need = X.ram_estimate(F.col("o_orderkey") * 1000, F.col("q"))
    return o.select("o_orderkey", need.alias("bytes"), X.fits_ram(need, (F.col("o_orderkey") % 3) * F.lit(20_000_000)).alias("fits"))


def t24_escape_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(X.escape_text(F.col("html"))).alias("escaped_md5"))


def p03_should_record_turn(spark, d):
    m = standin(spark, d, "messages")
    answer = F.when(F.col("id") % 5 == 0, F.lit(" \n ")).otherwise(F.col("content"))
    return m.select("id", X.should_record_turn(F.col("id") % 3 != 0, F.col("id") % 7 == 0, F.col("id") % 11 == 0, answer).alias("record"))


def p04_is_speakable(spark, d):
    bare = F.regexp_replace("text", r"[\p{L}\p{N}]", "")
    s = table(spark, d, "documents").select("doc_id", "text", F.element_at(F.array(bare, F.concat(bare, F.lit(" § 5")), F.lit(" [[image: 0001.png]]"), F.concat(F.lit("[[image: 0001.png]] "), bare), F.lit("")), (F.col("doc_id") % 5 + 1).cast("int")).alias("s"))
    return s.select("doc_id", X.is_speakable(F.col("text")).alias("speakable"), X.is_speakable(F.col("s")).alias("marks"))


def p05_route_attachments(spark, d):
    return standin(spark, d, "attachments").select("doc_id", X.attachment_route(F.col("extracted_text"), F.col("status") == "error").alias("route"))


def _asked(spark, d):
    """Every vector with one of the questions: that of its own fifty identifiers."""
    q = standin(spark, d, "questions").select("question_id", F.col("vector").alias("asked"))
    return table(spark, d, "embeddings").withColumn("question_id", F.col("vec_id") - F.col("vec_id") % 50).join(q, "question_id")


def r02_squared_l2(spark, d):
    return _asked(spark, d).select("vec_id", "question_id", F.round(X.squared_l2(F.col("embedding"), F.col("asked")), 6).alias("distance"))


def r01c_cosine(spark, d):
    return _asked(spark, d).select("vec_id", "question_id", F.round(X.cosine(F.col("embedding"), F.col("asked")), 6).alias("cosine"))


QUERIES = {f.__name__: f for f in (t01_words, t02_repair_hyphens, t03_chunk_text, t04_paragraphs, t05_sentences, t13_image_markers, t16_truncate_utf8, t17_format_blocks, t18_namespace_of, t19_token_budgets, t20_ram_estimate, t24_escape_text, p03_should_record_turn, p04_is_speakable, p05_route_attachments, r02_squared_l2, r01c_cosine)}

ORACLE_SQL = {
    "t01_words": f"SELECT doc_id, len(w) AS n_words, w[1] AS first_word FROM (SELECT doc_id, {_WS} AS w FROM documents)",
    "t02_repair_hyphens": r"SELECT doc_id, md5(r) AS repaired_md5, length(r) AS n FROM (SELECT doc_id, regexp_replace(replace(text, 'er ', 'er- '), '(\pL)-[ \n](\p{Ll})', '\1\2', 'g') AS r FROM documents)",
    "t03_chunk_text": f"""SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, md5(c) AS chunk_md5, length(c) AS n FROM (
        SELECT doc_id, i, array_to_string(w[1 + i * 336 : i * 336 + 384], ' ') AS c
        FROM (SELECT doc_id, w, unnest(range(0, 1 + greatest(0, CAST(ceil((len(w) - 384) / 336) AS BIGINT)))) AS i FROM (SELECT doc_id, {_WS} AS w FROM documents) WHERE len(w) > 0))""",
    "t04_paragraphs": r"""SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS pos, md5(unnest(p)) AS paragraph_md5 FROM (
        SELECT doc_id, list_filter(list_transform(string_split(replace(text, E'\n', E' \n\n '), E'\n\n'), lambda x: trim(x, E' \n\t')), lambda x: x <> '') AS p FROM documents)""",
    "t05_sentences": r"""SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS pos, md5(unnest(p)) AS sentence_md5 FROM (
        SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?…]["'')\]»”’]*)\s+([^.!?…\s])', '\1' || chr(1) || '\2', 'g'), '([.!?…]["'')\]»”’]*)\s+([^.!?…\s])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, E' \n\t')), lambda x: x <> '') AS p FROM documents)""",
    "t13_image_markers": r"""WITH m AS (SELECT doc_id, text, concat('[[image: ', CASE WHEN doc_id % 20000 > 9999 THEN CAST(doc_id % 20000 AS VARCHAR) ELSE lpad(CAST(doc_id % 20000 AS VARCHAR), 4, '0') END, '.', CASE WHEN doc_id % 2 = 0 THEN 'png' ELSE 'jpeg' END, ']]') AS marker FROM documents)
        SELECT doc_id, marker, true AS whole, false AS inline, trim(regexp_replace(concat(text, ' ', '  tail'), '\s+', ' ', 'g')) AS clean FROM m""",
    "t16_truncate_utf8": """SELECT doc_id, list_max(list_transform(range(0, 98), lambda i: CASE WHEN strlen(substr(text, 1, i)) <= doc_id % 97 + 1 THEN substr(text, 1, i) ELSE '' END)) AS cut FROM documents""",
    "t17_format_blocks": with_sql("messages", r"""SELECT id, md5(b) AS block_md5, md5(b || E'\n\n---\n\n' || CASE WHEN role = 'user' THEN 'u' || E'\n\n---\n\n' ELSE '' END || 'Usuário: ' || role || E'\nAssistente: r') AS joined_md5
        FROM (SELECT *, '[fonte: m' || id || E']\n' || content AS b FROM messages)"""),
    "t18_namespace_of": with_sql("chats", "SELECT chat_id, 'global' AS g, 'chat:' || chat_id AS c, 'memory:' || chat_id AS m FROM chats"),
    "t19_token_budgets": """SELECT o_orderkey, a AS answer, CAST(greatest((coalesce(ctx, 4096) - a) * 4, 0) AS INTEGER) AS prompt FROM (
        SELECT o_orderkey, ctx, CAST(CASE WHEN ctx IS NULL THEN 2048 ELSE least(2048, greatest(ctx // 2, 256)) END AS INTEGER) AS a
        FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 9000 END AS ctx FROM orders))""",
    "t20_ram_estimate": """SELECT o_orderkey, b AS bytes, (ram <= 0 OR b <= ram) AS fits FROM (SELECT o_orderkey, (o_orderkey % 3) * 20000000 AS ram,
        o_orderkey * 1000 * CASE o_orderkey % 5 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.625::DOUBLE WHEN 2 THEN 1.0::DOUBLE WHEN 3 THEN 2.0::DOUBLE END * 1.2::DOUBLE AS b FROM orders)""",
    "t24_escape_text": "SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped_md5 FROM pages",
    "p03_should_record_turn": with_sql("messages", "SELECT id, id % 3 <> 0 AND id % 7 <> 0 AND id % 11 <> 0 AND id % 5 <> 0 AND trim(coalesce(content, '')) <> '' AS record FROM messages"),
    "p04_is_speakable": r"SELECT doc_id, regexp_matches(text, '[\pL\pN]') AS speakable, CASE doc_id % 5 WHEN 1 THEN true WHEN 3 THEN regexp_matches(text, '[^\pL\pN\pZ\s]') ELSE false END AS marks FROM documents",
    "p05_route_attachments": with_sql("attachments", "SELECT doc_id, CASE WHEN status = 'error' OR extracted_text IS NULL THEN 'error' WHEN strlen(extracted_text) <= 8000 THEN 'injected_whole' ELSE 'index' END AS route FROM attachments"),
    "r02_squared_l2": "SELECT e.vec_id, q.vec_id AS question_id, round(list_sum(list_transform(list_zip(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS distance FROM embeddings e JOIN embeddings q ON q.vec_id = e.vec_id - e.vec_id % 50",
    "r01c_cosine": "SELECT e.vec_id, q.vec_id AS question_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS cosine FROM embeddings e JOIN embeddings q ON q.vec_id = e.vec_id - e.vec_id % 50",
}
