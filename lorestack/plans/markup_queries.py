"""Queries of markup and paging over whole driver tables, with SQL that walks the tokens one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorestack.functions import markup as M
from lorestack.operators import library as L
from lorestack.operators import structure as S
from lorestack.operators.paging import paged
from lorestack.session import table


def t06_paginate(spark, d):
    pages = paged(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.posexplode("pages").alias("page", "text"))
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.max(F.length("text")).cast("long").alias("longest"), F.sum(F.length("text")).alias("n_chars"))


def t07_strip_scripts(spark, d):
    clean = table(spark, d, "pages").select("page_id", M.strip_scripts(F.col("html")).alias("html"))
    return clean.select("page_id", F.md5("html").alias("clean_md5"), F.col("html").contains("<script").alias("has_script"), F.col("html").contains("<!--").alias("has_comment"))


def _blocks(spark, d):
    return S.blocks(table(spark, d, "pages").select("page_id", "html"), M.body_of(F.col("html")))


def t08_split_blocks(spark, d):
    return _blocks(spark, d).select("page_id", "block", F.md5("markup").alias("markup_md5"))


def t09_visible_text(spark, d):
    return S.visible_text(table(spark, d, "pages"), F.col("html")).select("page_id", F.md5("visible").alias("text_md5"))


def t10_decode_entities(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(M.decode_entities(F.concat(F.lit("&amp;lt; &#233; &copy; &hellip;"), "text"))).alias("decoded_md5"))


def t11_paginate_blocks(spark, d):
    return S.page_blocks(table(spark, d, "pages")).select("page_id", "part", "blocks", F.md5("text").alias("text_md5"))


def t12_xhtml_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(M.xhtml_to_text(F.col("html"))).alias("text_md5"))


def t15_body(spark, d):
    return table(spark, d, "pages").select("page_id", M.body_tag(F.col("html")).alias("tag"), F.length(M.body_of(F.col("html"))).alias("n"))


def t22_utterances(spark, d):
    return S.utterance_rows(table(spark, d, "pages")).select("page_id", "block", "sentence", "index", F.md5("text").alias("text_md5"))


def w08_utterance_spans(spark, d):
    return L.utterance_spans(S.utterance_rows(table(spark, d, "pages")), ["page_id", "block"]).select("page_id", "block", "sentence", "from", "to")


def j08_span_lookup(spark, d):
    spans = L.utterance_spans(S.utterance_rows(table(spark, d, "pages")), ["page_id", "block"])
    clicks = table(spark, d, "pages").select("page_id", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("i")).select((F.col("page_id") * 100 + F.col("i")).alias("click_id"), "page_id", F.col("i").alias("block"), ((F.col("i") * 37) % 200).alias("offset"))
    return L.span_lookup(clicks, spans)


def s07_write_pages(spark, d):
    pages = paged(table(spark, d, "documents").select(F.col("doc_id").alias("book_id"), F.lit("original").alias("language"), "text"))
    return L.number_pages(pages.drop("text"), ["book_id", "language"]).select("book_id", "language", "page", F.md5("text").alias("text_md5"))


def t14_hold_tags(spark, d):
    held = _blocks(spark, d).withColumn("held", S.held_tags(F.col("tokens"), F.col("ends")))
    return held.select("page_id", "block", F.size("held.tags").alias("tags"), F.md5("held.text").alias("text_md5"), F.md5(S.rebuilt(F.col("held"), F.col("held.text"))).alias("rebuilt_md5"))


def _sql(pattern: str) -> str:
    """A pattern as a literal of DuckDB."""
    return "'" + pattern.replace("'", "''") + "'"


_SPACES = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_BODY = "CASE WHEN regexp_matches(html, '(?is)<body[^>]*>') THEN regexp_extract(html, '(?is)<body[^>]*>(.*?)(?:</body>|\\z)', 1) ELSE html END"
_NAME = r"lower(regexp_extract({0}, '(?s)^<[/\s]*(?:[^ \t\n\r/>]*:)?([^ \t\n\r/>:]*)', 1))"
_ALONE = f"(t LIKE '%/>' OR {_NAME.format('t')} IN ({', '.join(map(repr, M.VOID))}) OR t LIKE '<!%' OR t LIKE '<?%' OR t NOT LIKE '%>')"
_TOKENS = f"w AS (SELECT page_id, regexp_extract_all(coalesce({{0}}, ''), {_sql(M.TOKEN)}) AS ts FROM pages), k AS (SELECT page_id, unnest(ts) AS t, unnest(range(0, len(ts))) AS i FROM w), n AS (SELECT page_id, i, t, t LIKE '<%' AND t NOT LIKE '<!--%' AS tag, {_NAME.format('t')} AS name, t LIKE '</%' AS shuts, {_ALONE} AS alone FROM k)"
#: One token after another: inside the element ``inside`` with ``deep`` open ones of its name, or outside (deep 0).
_WALK = """, s AS (SELECT page_id, -1 AS i, '' AS inside, 0 AS deep, 0 AS b, false AS begun FROM w UNION ALL
  SELECT n.page_id, n.i, CASE WHEN deep = 0 THEN name ELSE inside END,
    CASE WHEN deep = 0 THEN CASE WHEN {begins} AND NOT alone THEN 1 ELSE 0 END WHEN NOT tag OR name <> inside OR t LIKE '<!%' THEN deep WHEN shuts THEN deep - 1 WHEN t LIKE '%/>' THEN deep ELSE deep + 1 END,
    CASE WHEN deep = 0 THEN b + 1 ELSE b END, deep = 0 AND {begins}
  FROM s JOIN n ON n.page_id = s.page_id AND n.i = s.i + 1)"""


def _decoded(text: str) -> str:
    """Entities of a text decoded, in DuckDB."""
    number = lambda digits, base: f"TRY_CAST({base} || regexp_extract(e, {_sql(digits)}, 1) AS INTEGER)"
    decimal, hexadecimal = number("#([0-9]+)", "''"), number("[xX]([0-9a-fA-F]+)", "'0x'")
    named = " ".join(f"WHEN e = '&{name};' THEN {_sql(mark)}" for name, mark in M.ENTITIES.items())
    numbers = " ".join(f"WHEN regexp_matches(e, {_sql(pattern)}) AND {code} BETWEEN 1 AND 55295 THEN chr({code})" for pattern, code in (("^&#[0-9]{1,7};$", decimal), ("^&#[xX][0-9a-fA-F]{1,5};$", hexadecimal)))
    return f"coalesce(list_aggregate(list_transform(regexp_extract_all({text}, {_sql(M.ENTITY_TOKEN)}), lambda e: CASE {named} {numbers} ELSE e END), 'string_agg', ''), '')"


def _one_line(text: str) -> str:
    return f"trim(regexp_replace({text}, {_sql(_SPACES)}, ' ', 'g'))"


_DROPPED = M.DROPPED.format("|".join(M.REMOVED))
_PART = lambda p: f"regexp_replace(t, '(?s)^<|>$', '', 'g').regexp_extract({_sql(p)})"
_REST = r"regexp_replace(regexp_replace(t, '(?s)^<|>$', '', 'g'), '(?s)^[^ \t\n\r]*', '')"
_VALUE = rf"regexp_replace(regexp_extract(a, '(?s)=(.*)$', 1), {_sql(M.QUOTES)}, '', 'g')"
_RUNS = f"contains({_VALUE}, ':') AND (lower(regexp_replace(split_part({_VALUE}, ':', 1), '[^A-Za-z]', '', 'g')) IN ({', '.join(map(repr, M.SCHEMES))}) OR (lower(regexp_replace(split_part({_VALUE}, ':', 1), '[^A-Za-z]', '', 'g')) = 'data' AND regexp_matches(lower({_VALUE}), '^[^:]*:\\s*text/html')))"
_KEY = r"lower(regexp_extract(a, '^[^\s=/]+'))"
_KEPT = f"list_filter(regexp_extract_all({_REST}, {_sql(M.ATTRIBUTE)}), lambda a: NOT ({_KEY} LIKE 'on%' OR ({_KEY} IN ({', '.join(map(repr, M.ADDRESSES))}) AND {_RUNS})))"
_CLEAN = rf"CASE WHEN regexp_replace({_REST}, '\s', '', 'g') = '' OR t NOT LIKE '%>' THEN t ELSE '<' || {_PART('(?s)^[^ \t\n\r]*')} || coalesce(list_aggregate(list_transform({_KEPT}, lambda a: ' ' || a), 'string_agg', ''), '') || CASE WHEN regexp_matches(t, '/\s*>$') THEN '/' ELSE '' END || '>' END"

QUERIES = {n: globals()[n] for n in "t06_paginate t07_strip_scripts t08_split_blocks t09_visible_text t10_decode_entities t11_paginate_blocks t12_xhtml_to_text t14_hold_tags t15_body t22_utterances w08_utterance_spans j08_span_lookup s07_write_pages".split()}
ORACLE_SQL = {
    "t07_strip_scripts": f"WITH c AS (SELECT page_id, coalesce(list_aggregate(list_transform(regexp_extract_all(html, {_sql(M.SCRIPT_TOKEN)}), lambda t: CASE WHEN t NOT LIKE '<%' THEN t WHEN regexp_matches(t, {_sql(_DROPPED)}) AND (contains(t, '>') OR t LIKE '<!--%') THEN '' ELSE {_CLEAN} END), 'string_agg', ''), html) AS c FROM pages) SELECT page_id, md5(c) AS clean_md5, contains(c, '<script') AS has_script, contains(c, '<!--') AS has_comment FROM c",
    "t08_split_blocks": "WITH RECURSIVE " + _TOKENS.format(_BODY) + _WALK.format(begins="tag") + r", g AS (SELECT s.page_id, s.b, regexp_replace(string_agg(t, '' ORDER BY s.i), '^" + _SPACES + "|" + _SPACES + r"$', '', 'g') AS m FROM s JOIN n USING (page_id, i) GROUP BY ALL) SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY b) - 1 AS INTEGER) AS block, md5(m) AS markup_md5 FROM g WHERE m <> ''",
    "t09_visible_text": "WITH RECURSIVE " + _TOKENS.format("html") + _WALK.format(begins=f"tag AND name IN ({', '.join(map(repr, M.OPAQUE))})") + ", v AS (SELECT s.page_id, coalesce(string_agg(t, '' ORDER BY s.i) FILTER (t NOT LIKE '<%' AND deep = 0 AND NOT begun), '') AS m FROM s LEFT JOIN n USING (page_id, i) GROUP BY ALL) SELECT page_id, md5(" + _one_line(_decoded("m")) + ") AS text_md5 FROM v",
    "t10_decode_entities": "SELECT doc_id, md5(concat('&lt; é &copy; …', replace(replace(replace(replace(text, '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'))) AS decoded_md5 FROM documents",
    "t12_xhtml_to_text": f"WITH f AS (SELECT page_id, list_aggregate(list_transform(regexp_extract_all(html, {_sql(M.FLAT_TOKEN)}), lambda t: CASE WHEN t NOT LIKE '<%' THEN {_decoded('t')} WHEN t NOT LIKE '%>' OR regexp_matches(t, {_sql(M.DROPPED.format('head|style|script'))}) THEN '' WHEN {_NAME.format('t')} IN ({', '.join(map(repr, M.BREAKS))}) THEN chr(10) ELSE '' END), 'string_agg', '') AS m FROM pages) SELECT page_id, md5(coalesce(list_aggregate(list_filter(list_transform(regexp_split_to_array(coalesce(m, ''), '\\r?\\n'), lambda x: {_one_line('x')}), lambda x: x <> ''), 'string_agg', chr(10) || chr(10)), '')) AS text_md5 FROM f",
    "t15_body": "SELECT page_id, '<body' || " + " || ".join(f"""CASE WHEN regexp_matches(x, '(?s)\\s{a}\\s*=\\s*("[^"]*"|''[^'']*'')') THEN ' {a}="' || replace(replace(replace(replace({_decoded(f'''substr(regexp_extract(x, '(?s)\\s{a}\\s*=\\s*("[^"]*"|''[^'']*'')', 1), 2, length(regexp_extract(x, '(?s)\\s{a}\\s*=\\s*("[^"]*"|''[^'']*'')', 1)) - 2)''')}, '&', '&amp;'), '"', '&quot;'), '<', '&lt;'), '>', '&gt;') || '"' ELSE '' END""" for a in M.BODY_ATTRIBUTES) + " || '>' AS tag, CAST(length(y) AS INTEGER) AS n FROM (SELECT page_id, regexp_extract(html, '(?is)<body([^>]*)>', 1) AS x, " + _BODY + " AS y FROM pages)",
}
