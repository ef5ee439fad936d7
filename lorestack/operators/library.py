"""The e-book side: pages per language, reading positions, sentence spans and the voice catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorestack.functions.text import utf16_length

ORIGINAL = "original"
#: Order of voice qualities.
QUALITY_RANK = {"kokoro": 4, "high": 3, "medium": 2, "low": 1}


def clamp_page(page: Column, page_count: Column) -> Column:
    """A page position within a book, never below 0."""
    return F.least(page, F.greatest(page_count - 1, F.lit(0)))


def reading_history(readings: DataFrame, books: DataFrame) -> DataFrame:
    """Each reading with its book, the position clamped, the newest first."""
    joined = readings.join(books.select("book_id", "filename", "page_count"), "book_id")
    return joined.withColumn("last_page", clamp_page(F.col("last_page"), F.col("page_count"))).orderBy(F.col("last_opened_at").desc(), F.col("reading_id").desc())


def save_positions(readings: DataFrame, positions: DataFrame, books: DataFrame) -> DataFrame:
    """Readings with the new positions (reading_id, page), clamped to the book; others unchanged."""
    joined = readings.join(positions.select("reading_id", "page"), "reading_id", "left").join(books.select("book_id", "page_count"), "book_id", "left")
    new = clamp_page(F.col("page"), F.coalesce("page_count", F.lit(0)))
    return joined.withColumn("last_page", F.when(F.col("page").isNotNull(), new).otherwise(F.col("last_page"))).drop("page", "page_count")


def clamp_after_repaginate(readings: DataFrame, counts: DataFrame) -> DataFrame:
    """Readings of the books listed (book_id, page_count) moved inside the new page count."""
    joined = readings.join(counts.select("book_id", F.col("page_count").alias("_count")), "book_id", "left")
    return joined.withColumn("last_page", F.when(F.col("_count").isNull(), F.col("last_page")).otherwise(clamp_page(F.col("last_page"), F.col("_count")))).drop("_count")


def repaginate(books: DataFrame, readings: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Books and readings after the books listed (book_id, page_count) were cut into pages anew: the new page count stands on
    the book, its own position and those of its readings move inside it, and the book is ready. Of a book listed twice the
    larger count holds."""
    new = counts.filter("page_count is not null").groupBy("book_id").agg(F.max("page_count").alias("page_count"))
    joined = books.join(new.select("book_id", F.col("page_count").alias("_count")), "book_id", "left")
    told = F.col("_count").isNotNull()
    changed = {"page_count": F.when(told, F.col("_count")).otherwise(F.col("page_count"))}
    if "status" in books.columns:
        changed["status"] = F.when(told, "ready").otherwise(F.col("status"))
    if "last_page" in books.columns:
        changed["last_page"] = F.when(told, clamp_page(F.col("last_page"), F.col("_count"))).otherwise(F.col("last_page"))
    return joined.withColumns(changed).select(*books.columns), clamp_after_repaginate(readings, new)


def positions_to_readings(books: DataFrame) -> DataFrame:
    """One reading per opened book, its identifier the book's."""
    return books.filter("last_opened_at is not null").select(F.col("book_id").alias("reading_id"), "book_id", F.coalesce("last_page", F.lit(0)).alias("last_page"), "last_opened_at")


def number_pages(texts: DataFrame, key: list[str], pages: str = "pages") -> DataFrame:
    """Rows (key, page from 1, text) from arrays of pages, trailing white space trimmed."""
    each = texts.select(*key, F.posexplode(pages).alias("_at", "_text"))
    return each.select(*key, (F.col("_at") + 1).alias("page"), F.regexp_replace("_text", r"(?U)\s+$", "").alias("text"))


def language_coverage(pages: DataFrame, books: DataFrame, reserved: list[str] = ["images"]) -> DataFrame:
    """(book_id, language, pages, is_reading) of every language with pages; a null reading language is the original."""
    counted = pages.filter(~F.col("language").isin(*reserved)).groupBy("book_id", "language").agg(F.countDistinct("page").alias("pages"))
    reading = F.coalesce(F.col("reading_language"), F.lit(ORIGINAL))
    return counted.join(books.select("book_id", "reading_language"), "book_id").select("book_id", "language", "pages", (F.col("language") == reading).alias("is_reading"))


def next_missing_page(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """(book_id, language, next_missing): the lowest page of (book_id, language, page_count) without a row, null when complete."""
    every = wanted.filter("page_count > 0").select("book_id", "language", F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page"))
    lacking = every.join(pages.select("book_id", "language", "page"), ["book_id", "language", "page"], "left_anti").groupBy("book_id", "language").agg(F.min("page").alias("next_missing"))
    return wanted.select("book_id", "language").join(lacking, ["book_id", "language"], "left")


def removed_count(pages: DataFrame, removals: DataFrame) -> DataFrame:
    """(book_id, language, removed): the pages that removing a language would lose; 0 where there are none."""
    counted = pages.groupBy("book_id", "language").agg(F.count("*").alias("_n"))
    return removals.join(counted, ["book_id", "language"], "left").select("book_id", "language", F.coalesce("_n", F.lit(0)).cast("long").alias("removed"))


def set_reading_language(books: DataFrame, chosen: DataFrame) -> DataFrame:
    """Books with the reading language chosen (book_id, language); the original is no language of its own: null."""
    joined = books.join(chosen.select("book_id", F.col("language").alias("_chosen")), "book_id", "left")
    return joined.withColumn("reading_language", F.when(F.col("_chosen").isNull(), F.col("reading_language")).otherwise(F.nullif("_chosen", F.lit(ORIGINAL)))).drop("_chosen")


def remove_languages(pages: DataFrame, books: DataFrame, removals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages without the languages removed (book_id, language), and books whose reading language that was back at the original."""
    gone = removals.select("book_id", "language").distinct()
    left = pages.join(gone, ["book_id", "language"], "left_anti")
    marked = books.join(gone.select("book_id", F.col("language").alias("reading_language"), F.lit(True).alias("_gone")), ["book_id", "reading_language"], "left")
    reading = F.when(F.col("_gone").isNull(), F.col("reading_language"))
    return left, marked.withColumn("reading_language", reading).select(*books.columns)


def page_with_fallback(requests: DataFrame, pages: DataFrame, books: DataFrame) -> DataFrame:
    """(request_id, served_language, format, text, error) of requests (request_id, book_id, language, index from 0).

    The translated page if there is one, else the original; markup before text; beyond the last page an error.
    """
    best = pages.groupBy("book_id", "language", "page").agg(F.min_by(F.struct("format", "text"), F.when(F.col("format") == "html", 0).otherwise(1)).alias("best"))
    asked = requests.withColumn("page", F.col("index") + 1).join(books.select("book_id", "page_count"), "book_id", "left")
    own = best.select("book_id", "language", "page", F.col("best").alias("own"))
    original = best.filter(F.col("language") == ORIGINAL).select("book_id", "page", F.col("best").alias("fallback"))
    joined = asked.join(own, ["book_id", "language", "page"], "left").join(original, ["book_id", "page"], "left")
    beyond = F.coalesce(F.col("page") > F.col("page_count"), F.lit(True))
    served = F.when(F.col("own").isNotNull(), F.col("language")).when(F.col("fallback").isNotNull(), F.lit(ORIGINAL))
    error = F.when(beyond, "no_such_page").when(served.isNull(), "page_missing")
    got = F.coalesce("own", "fallback")
    return joined.select("request_id", F.when(error.isNull(), served).alias("served_language"), F.when(error.isNull(), got["format"]).alias("format"), F.when(error.isNull(), got["text"]).alias("text"), error.alias("error"))


def mark_for_retranslation(pages: DataFrame, chosen: DataFrame, books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages without those chosen (book_id, language, index from 0), and the choices refused with a reason."""
    judged = chosen.join(books.select("book_id", "page_count"), "book_id", "left")
    reason = F.when(F.col("language") == ORIGINAL, "original").when(F.coalesce(F.col("index") >= F.col("page_count"), F.lit(True)) | (F.col("index") < 0), "no_such_page")
    judged = judged.withColumn("reason", reason)
    gone = judged.filter("reason is null").select("book_id", "language", (F.col("index") + 1).alias("page"))
    return pages.join(gone, ["book_id", "language", "page"], "left_anti"), judged.filter("reason is not null").select("book_id", "language", "index", "reason")


def missing_languages(books: DataFrame, offered: list[str], present: DataFrame) -> DataFrame:
    """(book_id, language) of offered languages a book has no pages in."""
    wanted = books.select("book_id", F.explode(F.array(*(F.lit(x) for x in offered))).alias("language"))
    return wanted.join(present.select("book_id", "language").distinct(), ["book_id", "language"], "left_anti")


def utterance_spans(sentences: DataFrame, keys: list[str], order: str = "sentence", text: str = "text") -> DataFrame:
    """Adds from and to: where each sentence starts and ends in its block in UTF-16 units, one place apart from the next."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(utf16_length(F.col(text)) + 1).over(w), F.lit(0))
    return sentences.withColumn("from", start).withColumn("to", start + utf16_length(F.col(text)))


def span_lookup(clicks: DataFrame, spans: DataFrame, page: str = "page_id") -> DataFrame:
    """(click_id, index): the sentence of the clicked block that holds the offset, else the first of a later block.

    The spans' index grows along the page. An equality join on page and block first; what it misses is answered forward.
    """
    held = clicks.join(spans.select(page, "block", "index", "from", "to"), [page, "block"]).filter(F.col("offset").between(F.col("from"), F.col("to"))).groupBy("click_id").agg(F.min("index").alias("held"))
    firsts = spans.groupBy(page, "block").agg(F.min("index").alias("first"))
    points = firsts.select(page, "block", F.lit(1).alias("kind"), "first", F.lit(None).cast("long").alias("click_id")).unionByName(clicks.select(page, "block", F.lit(0).alias("kind"), F.lit(None).cast("int").alias("first"), F.col("click_id").cast("long")))
    ahead = Window.partitionBy(page).orderBy("block", "kind").rowsBetween(0, Window.unboundedFollowing)
    later = points.withColumn("ahead", F.first("first", ignorenulls=True).over(ahead)).filter("kind = 0").select("click_id", "ahead")
    return clicks.select("click_id").join(held, "click_id", "left").join(later, "click_id", "left").select("click_id", F.coalesce("held", "ahead").alias("index"))


def voice_language(voice: Column) -> Column:
    """The language code in a voice's identifier."""
    return F.substring_index(voice, "-", 1)


def language_prefix(language: Column) -> Column:
    """The language without its region, in lower case; the original counts as Portuguese."""
    return F.lower(F.regexp_extract(F.when(language == ORIGINAL, "pt").otherwise(language), "^([^-_]*)", 1))


def resolve_preferred(languages: DataFrame, pins: DataFrame, installed: DataFrame) -> DataFrame:
    """(language, voice): the pinned voice of the language or of its prefix, if installed; else the first installed of the prefix."""
    asked = languages.select("language").distinct().withColumn("prefix", language_prefix(F.col("language")))
    exact = pins.select(F.col("language").alias("_key"), F.col("voice").alias("_exact"))
    by_prefix = pins.groupBy(language_prefix(F.col("language")).alias("prefix")).agg(F.min_by("voice", "language").alias("_near"))
    there = installed.select("voice").distinct()
    first = there.groupBy(language_prefix(voice_language(F.col("voice"))).alias("prefix")).agg(F.min("voice").alias("_first"))
    joined = asked.join(exact, asked.language == exact._key, "left").join(by_prefix, "prefix", "left").join(first, "prefix", "left").withColumn("_pin", F.coalesce("_exact", "_near"))
    kept = joined.join(there.select(F.col("voice").alias("_have")), F.col("_pin") == F.col("_have"), "left")
    return kept.select("language", F.coalesce("_have", "_first").alias("voice"))


def match_limits(models: DataFrame, entries: DataFrame) -> DataFrame:
    """(model, id, context): the entry of that id, else one whose id ends with the name, else the first. ``entries``: (pos, id, context)."""
    first = lambda: F.min_by(F.struct("id", "context"), "pos")
    exact = entries.groupBy(F.col("id").alias("model")).agg(first().alias("exact"))
    ends = entries.select("pos", "id", "context", F.explode(F.transform(F.sequence(F.lit(1), F.length("id")), lambda i: F.expr("id").substr(i, F.length("id")))).alias("model"))
    ending = ends.groupBy("model").agg(first().alias("ending"))
    any_one = entries.agg(first().alias("any")).withColumn("_one", F.lit(1))  # one row
    found = models.select("model").distinct().join(exact, "model", "left").join(ending, "model", "left").withColumn("_one", F.lit(1)).join(any_one, "_one", "left")
    best = found.withColumn("best", F.coalesce("exact", "ending", "any")).filter("best is not null")
    return best.select("model", "best.id", "best.context")


def manifest_spine(spine: DataFrame, manifest: DataFrame) -> DataFrame:
    """Spine entries in reading order with the file they name; one without is an error."""
    joined = spine.join(manifest.select("book_id", "idref", "href"), ["book_id", "idref"], "left")
    return joined.select("book_id", "pos", "idref", "href", F.when(F.col("href").isNull(), "unknown_idref").alias("error"))


def catalog_search(voices: DataFrame, query: str | None = None, language: str | None = None) -> DataFrame:
    """Voices of a language whose listed words hold the text searched for."""
    found = voices if language is None else voices.filter(F.col("language") == language)
    listed = F.lower(F.concat_ws(" ", "display_name", "language", "language_name", "quality"))
    return found if not query else found.filter(listed.contains(query.lower()))


def distinct_languages(voices: DataFrame, pos: str = "pos") -> DataFrame:
    """(language, language_name) with the name seen last, by name."""
    return voices.groupBy("language").agg(F.max_by("language_name", pos).alias("language_name")).orderBy("language_name", "language")


def catalog_union(manifest: DataFrame, built_in: DataFrame, fixed: DataFrame) -> DataFrame:
    """The manifest, or the built-in list where that is empty, and the fixed voices."""
    none = manifest.agg(F.count("*").alias("_n")).filter("_n = 0").select(F.lit(1).alias("_one"))  # one row or none
    fallback = built_in.withColumn("_one", F.lit(1)).join(none, "_one", "left_semi").drop("_one")
    return manifest.unionByName(fallback).unionByName(fixed)


def quality_rank(quality: Column) -> Column:
    ranks = F.create_map(*(F.lit(x) for pair in QUALITY_RANK.items() for x in pair))
    return F.coalesce(F.element_at(ranks, quality), F.lit(0))


def quality_order(voices: DataFrame) -> DataFrame:
    """Voices by language name, best quality first, then name."""
    return voices.orderBy("language_name", quality_rank(F.col("quality")).desc(), "display_name", "voice")


def drop_low_unless_only(voices: DataFrame) -> DataFrame:
    """Rough voices only where their language has no natural one."""
    natural = F.max(F.col("quality").isin("high", "medium")).over(Window.partitionBy("language"))
    return voices.withColumn("_natural", natural).filter((F.col("quality") != "low") | ~F.col("_natural")).drop("_natural")


def parse_manifest(manifests: DataFrame, text: str = "json") -> DataFrame:
    """Voices of JSON manifests: rows with model and config path; a voice that lacks either is left out."""
    kind = "map<string,struct<name:string,language:struct<code:string,name_native:string,name_english:string>,quality:string,files:map<string,struct<size_bytes:long>>>>"
    each = manifests.select(F.explode(F.from_json(text, kind)).alias("voice", "v"))
    paths = F.map_keys("v.files")
    model, config = F.filter(paths, lambda p: p.endswith(".onnx")), F.filter(paths, lambda p: p.endswith(".onnx.json"))
    found = each.withColumn("model", F.get(F.array_sort(model), 0)).withColumn("config", F.get(F.array_sort(config), 0)).filter("model is not null and config is not null")
    size = F.element_at("v.files", F.col("model"))["size_bytes"]
    name = F.coalesce("v.language.name_native", "v.language.name_english", "v.language.code", voice_language(F.col("voice")))
    return found.select("voice", F.coalesce("v.name", "voice").alias("display_name"), F.coalesce("v.language.code", voice_language(F.col("voice"))).alias("language"), name.alias("language_name"), F.coalesce("v.quality", F.lit("medium")).alias("quality"), "model", "config", size.alias("size_bytes"))
