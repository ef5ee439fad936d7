"""The functions as SQL: ``register(spark)`` makes them callable by name in the session's queries.

All are SQL functions of the session: Catalyst puts their bodies in place of the calls, and no plan has a Python node. What
needs the structure of markup is a table, not a function of one text: ``register_pages`` makes views of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorestack.functions import markup as M
from lorestack.functions.text import IMAGE_MARKER, SPACES
from lorestack.operators import structure


def _raw(text: str) -> str:
    """A literal without escapes; single quotes are put together from parts."""
    return f"r'{text}'" if "'" not in text else "concat(" + ", chr(39), ".join(f"r'{part}'" for part in text.split("'")) + ")"


_TRIM = r"r'(?U)^\s+|\s+$'"
_CUT = "decode(unhex('00EE8080'), 'UTF-8')"
_WORDS = f"filter(split(text, r'{SPACES}'), w -> w <> '')"
_WINDOW = "greatest(cast(max_tokens * 0.75D as int), 1)"
_STEP = f"({_WINDOW} - least(greatest(cast(overlap_tokens * 0.75D as int), 1), {_WINDOW} - 1))"
_NAMED = "map(" + ", ".join(f"'&{name};', {_raw(mark)}" for name, mark in M.ENTITIES.items()) + ")"
_CODE = "(CASE WHEN t RLIKE '^&#[xX]' THEN cast(conv(substring(t, 4, length(t) - 4), 16, 10) as bigint) ELSE cast(substring(t, 3, length(t) - 3) as bigint) END)"
_DROPPED = M.DROPPED.format("|".join(M.REMOVED))
_NAMES = ", ".join(f"'{n}'" for n in M.ADDRESSES)
_VALUE = f"regexp_replace(regexp_extract(a, r'(?s)=(.*)$', 1), {_raw(M.QUOTES)}, '')"
_SCHEME = f"lower(regexp_replace(substring_index({_VALUE}, ':', 1), '[^A-Za-z]', ''))"
_RUNS = f"(contains({_VALUE}, ':') AND ({_SCHEME} IN ({', '.join(repr(s) for s in M.SCHEMES)}) OR ({_SCHEME} = 'data' AND startswith(lower(regexp_replace({_VALUE}, r'(?s)^[^:]*:\\s*', '')), 'text/html'))))"
_BODY = "regexp_replace(t, '(?s)^<|>$', '')"
_KEY = r"lower(regexp_extract(a, r'^[^\s=/]+', 0))"
_KEPT = f"filter(regexp_extract_all(regexp_replace({_BODY}, r'(?s)^[^ \\t\\n\\r]*', ''), {_raw(M.ATTRIBUTE)}, 0), a -> NOT (startswith({_KEY}, 'on') OR ({_KEY} IN ({_NAMES}) AND {_RUNS})))"
_CLEAN = f"concat('<', regexp_extract({_BODY}, r'(?s)^[^ \\t\\n\\r]*', 0), array_join(transform({_KEPT}, a -> concat(' ', a)), ''), IF({_BODY} RLIKE r'/\\s*$', '/', ''), '>')"
_BARE = rf"regexp_replace({_BODY}, r'(?s)^[^ \t\n\r]*\s*', '') = ''"

_CHUNKS = f"get(transform(array(coalesce({_WORDS}, cast(array() as array<string>))), w -> IF(size(w) = 0, cast(array() as array<string>), transform(sequence(0, greatest(0, cast(ceil((size(w) - {_WINDOW}) / {_STEP}) as int))), i -> concat_ws(' ', slice(w, 1 + i * {_STEP}, {_WINDOW}))))), 0)"

#: Name and arguments, what it returns, and its body.
FUNCTIONS = [
    ("trim_spaces(text STRING)", "STRING", f"regexp_replace(text, {_TRIM}, '')"),
    ("split_sentences(text STRING)", "ARRAY<STRING>", f"filter(transform(split(regexp_replace(text, {_raw(M.SENTENCE_END)}, concat('$1', {_CUT})), {_CUT}), s -> regexp_replace(s, {_TRIM}, '')), s -> s <> '')"),
    ("split_paragraphs(text STRING)", "ARRAY<STRING>", rf"filter(transform(split(text, r'[ \t\r\f]*\n[ \t\r\f]*\n[ \t\r\n\f]*'), p -> regexp_replace(p, {_TRIM}, '')), p -> p <> '')"),
    ("chunks(text STRING, max_tokens INT DEFAULT 512, overlap_tokens INT DEFAULT 64)", "ARRAY<STRING>", _CHUNKS),
    ("truncate_utf8(text STRING, most INT)", "STRING", "CASE WHEN octet_length(text) <= most THEN text ELSE cast(get(filter(transform(array(0, 1, 2, 3), b -> substring(cast(text as binary), 1, greatest(most - b, 0))), c -> is_valid_utf8(cast(c as string))), 0) as string) END"),
    ("without_markers(text STRING)", "STRING", f"regexp_replace(regexp_replace(regexp_replace(text, r'{IMAGE_MARKER}', ''), r'{SPACES}', ' '), {_TRIM}, '')"),
    ("answer_budget(context INT)", "INT", "CASE WHEN context IS NULL THEN 2048 ELSE least(2048, greatest(cast(floor(context / 2) as int), 256)) END"),
    ("prompt_budget(context INT)", "INT", "greatest((coalesce(context, 4096) - CASE WHEN context IS NULL THEN 2048 ELSE least(2048, greatest(cast(floor(context / 2) as int), 256)) END) * 4, 0)"),
    (
        "decode_entities(text STRING)",
        "STRING",
        f"array_join(transform(regexp_extract_all(text, r'{M.ENTITY_TOKEN}', 0), t -> CASE WHEN startswith(t, '&#') AND endswith(t, ';') THEN coalesce(CASE WHEN {_CODE} <= 1114111 AND {_CODE} NOT BETWEEN 55296 AND 57343 THEN decode(unhex(lpad(hex({_CODE}), 8, '0')), 'UTF-32') END, t) WHEN startswith(t, '&') THEN coalesce(try_element_at({_NAMED}, t), t) ELSE t END), '')",
    ),
    (
        "strip_scripts(markup STRING)",
        "STRING",
        f"array_join(transform(regexp_extract_all(markup, r'{M.SCRIPT_TOKEN}', 0), t -> CASE WHEN NOT startswith(t, '<') THEN t WHEN t RLIKE r'{_DROPPED}' AND (contains(t, '>') OR startswith(t, '<!--')) THEN '' WHEN {_BARE} OR NOT endswith(t, '>') THEN t ELSE {_CLEAN} END), '')",
    ),
    ("chunk_text(text STRING, max_tokens INT DEFAULT 512, overlap_tokens INT DEFAULT 64)", "TABLE (chunk_index INT, text STRING)", f"SELECT posexplode({_CHUNKS}) AS (chunk_index, text)"),
]


def register(spark: SparkSession) -> None:
    """split_sentences, split_paragraphs, chunks, truncate_utf8, trim_spaces, without_markers, answer_budget, prompt_budget, decode_entities
    and strip_scripts as functions, chunk_text as a table function: a row for each overlapping chunk."""
    for name, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURNS {kind} RETURN {body}")


def register_pages(pages: DataFrame, page: str = "page_id", markup: str = "html", prefix: str = "page") -> None:
    """Views of a table of markup: ``<prefix>_blocks`` (block, markup, visible_text) and ``<prefix>_utterances``."""
    rows = structure.blocks(pages.select(page, markup), M.body_of(F.col(markup)))
    rows.select(page, "block", "markup", structure.visible(F.col("tokens"), F.col("ends")).alias("visible_text")).createOrReplaceTempView(f"{prefix}_blocks")
    structure.utterance_rows(pages, page, markup).createOrReplaceTempView(f"{prefix}_utterances")
