"""Translation of pages by a function from the caller: only what lacks, each distinct unit once."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorestack.functions import markup as M
from lorestack.functions import text as X
from lorestack.operators import structure
from lorestack.session import map_in_parts, materialise


def translate_pages(pages: DataFrame, wanted: DataFrame, translate: Callable[[list[str]], list[str]], source: str = "original") -> tuple[DataFrame, DataFrame]:
    """(translated pages, failed pages) for (book_id, language, page) in ``wanted`` without a row yet.

    Units are blocks with their inline tags held as markers. Of pages whose ``format`` is txt (a column that may be missing)
    they are paragraphs, joined by blank lines again, image markers copied. A page with a blank answer fails and is not
    written.
    """
    pending = wanted.join(pages.select("book_id", "language", "page"), ["book_id", "language", "page"], "left_anti")
    kind = F.col("format") if "format" in pages.columns else F.lit("html")
    original = pages.filter(F.col("language") == source).select("book_id", "page", "text", F.coalesce(kind, F.lit("html")).alias("format"))
    plain = F.transform(X.paragraphs(F.col("text")), lambda p: F.struct(F.when(X.is_image_marker(p), p).otherwise("").alias("open"), F.lit("").alias("close"), F.when(X.is_image_marker(p), "").otherwise(p).alias("text"), F.array().cast("array<array<string>>").alias("tags")))
    both = pending.join(original, ["book_id", "page"])
    body = M.body_tag(F.col("text")).alias("body")
    cut = structure.blocks(both.filter("format <> 'txt'").select("book_id", "language", "page", "format", "text", body), M.body_of(F.col("text")))
    kept = F.struct(F.col("markup").alias("open"), F.lit("").alias("close"), F.lit("").alias("text"), F.array().cast("array<array<string>>").alias("tags"))
    unit = F.when(structure.visible(F.col("tokens"), F.col("ends")) == "", kept).otherwise(structure.held_tags(F.col("tokens"), F.col("ends"))).alias("unit")
    html = materialise(cut.select("book_id", "language", "page", "format", "body", F.col("block").alias("pos"), unit))
    units = html.unionByName(both.filter("format = 'txt'").select("book_id", "language", "page", "format", F.lit("").alias("body"), F.posexplode(plain).alias("pos", "unit")))

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"language": batch["language"], "text": batch["text"], "translated": translate(list(batch["text"]))})

    distinct = units.filter("unit.text <> ''").select("language", F.col("unit.text").alias("text")).distinct()
    done = map_in_parts(distinct, run, "language string, text string, translated string", "text")

    same = F.when(F.col("unit.text") == "", F.col("unit.open")).when(X.trim_unicode("translated") != "", F.col("translated"))
    back = units.withColumn("text", F.col("unit.text")).join(done, ["language", "text"], "left").withColumn("out", F.when((F.col("format") == "txt") | (F.col("unit.text") == ""), same).when(X.trim_unicode("translated") != "", structure.rebuilt(F.col("unit"), F.col("translated"))))
    whole = back.groupBy("book_id", "language", "page", "format").agg(F.first("body").alias("body"), F.count(F.when(F.col("out").isNull(), 1)).alias("blank"), F.array_sort(F.collect_list(F.struct("pos", "out"))).alias("parts"))
    parts = F.transform("parts", lambda p: p["out"])
    text = F.when(F.col("format") == "txt", F.array_join(parts, "\n\n")).otherwise(F.concat("body", F.lit("\n"), F.array_join(parts, "\n\n"), F.lit("\n</body>")))
    return whole.filter("blank = 0").select("book_id", "language", "page", "format", text.alias("text")), whole.filter("blank > 0").select("book_id", "language", "page", F.lit("blank_answer").alias("error"))


def render_pages(pages: DataFrame, images: DataFrame, css: str = "") -> DataFrame:
    """(book_id, page, html): a whole document with its images inside as data addresses; a missing image keeps its name."""
    kinds = F.create_map(*(F.lit(x) for pair in {"png": "image/png", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml"}.items() for x in pair))
    named = pages.select("book_id", "page", "text", F.array_distinct(F.regexp_extract_all("text", F.lit(r'src="(\d{4,6}\.[a-z0-9]{1,5})"'), 1)).alias("names"))
    kind = F.coalesce(F.element_at(kinds, F.substring_index("name", ".", -1)), F.lit("image/jpeg"))
    data = images.select("book_id", "name", F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.regexp_replace(F.base64("content"), r"\s", "")).alias("address"))
    used = named.select("book_id", "page", F.explode("names").alias("name")).join(data, ["book_id", "name"]).groupBy("book_id", "page").agg(F.collect_list(F.struct("name", "address")).alias("found"))
    body = F.aggregate(F.coalesce("found", F.array().cast("array<struct<name:string,address:string>>")), F.col("text"), lambda t, x: F.replace(t, F.concat(F.lit('src="'), x["name"], F.lit('"')), F.concat(F.lit('src="'), x["address"], F.lit('"'))))
    return named.join(used, ["book_id", "page"], "left").select("book_id", "page", F.concat(F.lit(f"<!doctype html><html><head><style>{css}</style></head>"), body, F.lit("</html>")).alias("html"))
