"""Knowledge-base tables derived from the driver's tables, as DataFrames and as the same SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorestack.session import table

#: SQL that both engines read alike; each entry is a view over the given tables.
SQL = {
    "messages": "SELECT conv_id AS chat_id, conv_id * 1000 + turn AS id, turn AS pos, role, text AS content FROM conversations",
    "chats": "SELECT DISTINCT conv_id AS chat_id, conv_id % 3 <> 0 AS use_global, conv_id % 4 <> 0 AS use_memory FROM conversations",
    "kb_documents": """SELECT doc_id, concat(source, '-', lang, CASE WHEN doc_id % 3 = 0 THEN '.PDF' WHEN doc_id % 3 = 1 THEN '.txt' ELSE '.png' END) AS filename,
        CASE WHEN doc_id % 4 = 0 THEN concat('chat:', CAST(doc_id % 50 AS VARCHAR(20))) ELSE 'global' END AS namespace,
        CASE doc_id % 7 WHEN 0 THEN 'queued' WHEN 1 THEN 'parsing' WHEN 2 THEN 'chunking' WHEN 3 THEN 'embedding' WHEN 4 THEN 'error' ELSE 'ready' END AS status,
        CAST(doc_id % 997 AS INTEGER) AS created_at, n_chars AS size_bytes, text, lang FROM documents""",
    "attachments": """SELECT doc_id, doc_id % 50 AS chat_id, concat('file-', CAST(doc_id AS VARCHAR(20)), '.md') AS filename,
        CASE doc_id % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'injected_whole' WHEN 2 THEN 'error' ELSE 'parsing' END AS status, text AS extracted_text FROM documents""",
    "chunks": """SELECT vec_id, CASE WHEN label < 4 THEN 'global' WHEN label < 7 THEN concat('chat:', CAST(label AS VARCHAR(20))) ELSE concat('memory:', CAST(label - 3 AS VARCHAR(20))) END AS namespace,
        CAST(vec_id - vec_id % 10 AS BIGINT) AS doc_id, CAST(vec_id % 10 AS INTEGER) AS chunk_index, concat('chunk ', CAST(vec_id AS VARCHAR(20))) AS text, embedding AS vector FROM embeddings""",
    "questions": "SELECT vec_id AS question_id, CAST(4 + vec_id % 150 / 50 AS INTEGER) AS chat_id, vec_id % 100 = 0 AS use_global, true AS use_memory, embedding AS vector FROM embeddings WHERE vec_id % 50 = 0",
    "books": """SELECT c_custkey AS book_id, concat('book-', CAST(c_custkey AS VARCHAR(20)), '.epub') AS filename, CAST(1 + c_custkey % 40 AS INTEGER) AS page_count,
        CASE WHEN c_custkey % 3 = 0 THEN 'en' WHEN c_custkey % 3 = 1 THEN 'es' END AS reading_language,
        CASE c_custkey % 4 WHEN 0 THEN 'extracting' WHEN 1 THEN 'paginating' WHEN 2 THEN 'imported' ELSE 'ready' END AS status,
        CASE WHEN c_custkey % 5 < 3 THEN CAST(c_custkey % 60 AS INTEGER) END AS last_page, CASE WHEN c_custkey % 5 < 4 THEN CAST(c_custkey % 1009 AS INTEGER) END AS last_opened_at FROM customer""",
    "readings": "SELECT event_id AS reading_id, user_id AS book_id, CAST(event_id % 50 AS INTEGER) AS last_page, CAST(event_id % 1013 AS INTEGER) AS last_opened_at FROM events",
    "book_pages": """SELECT o_custkey AS book_id, CASE o_orderkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'es' WHEN 2 THEN 'original' ELSE 'images' END AS language, CAST(1 + o_orderkey % 37 AS INTEGER) AS page,
        CASE WHEN o_orderkey % 2 = 0 THEN 'html' ELSE 'txt' END AS format, min(concat('page ', CAST(o_orderkey AS VARCHAR(20)))) AS text FROM orders GROUP BY 1, 2, 3, 4""",
    "voices": """SELECT p_partkey AS pos, concat(CASE p_partkey % 4 WHEN 0 THEN 'pt_BR' WHEN 1 THEN 'en_US' WHEN 2 THEN 'en_GB' ELSE 'fr_FR' END, '-', CAST(p_partkey AS VARCHAR(20)), '-x') AS voice, p_name AS display_name,
        CASE p_partkey % 4 WHEN 0 THEN 'pt' WHEN 1 THEN 'en' WHEN 2 THEN 'en' ELSE 'fr' END AS language, CASE p_partkey % 4 WHEN 0 THEN 'Portuguese' WHEN 1 THEN 'English' WHEN 2 THEN 'English (UK)' ELSE 'French' END AS language_name,
        CASE WHEN p_partkey % 4 = 3 THEN 'low' WHEN p_partkey % 3 = 0 THEN 'low' WHEN p_partkey % 3 = 1 THEN 'medium' ELSE 'high' END AS quality FROM part""",
}
_SOURCES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def standin(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table."""
    sql = SQL[name].replace("VARCHAR(20)", "STRING")
    given = {t: table(spark, sf_dir, t) for t in _SOURCES if f"FROM {t}" in sql}
    for t in given:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **given)


def with_sql(names: str, body: str) -> str:
    """The derived tables named as WITH clauses before ``body``, which is a SELECT or goes on with ", name AS (...) SELECT"."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n]})" for n in names.split()) + " " + body.strip()
