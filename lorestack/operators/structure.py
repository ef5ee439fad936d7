"""The structure of markup as tables: tags with their depth, elements by matching depths, blocks, and what reads them.

Tags are rows (page, place, kind, name). The depth of a name is a prefix sum over its tags on a page; an element ends at the
next end tag that brings the depth of its name below where it began, found by a running window. Walks that jump from
element to element follow the jumps by doubling: after k rounds the first 2^k stops are known.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorestack.functions import markup as M
from lorestack.functions import text as X
from lorestack.session import materialise

PAGE_CHARS = 2_500


def bound(value: Column, function: Callable[[Column], Column]) -> Column:
    """``function`` of a value that is computed once, however often the function names it."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def followed(jumps: Column) -> Column:
    """The places that are reached from place 0, in order; ``jumps`` has the next place of each. Places beyond the end stop."""
    jump = lambda s, x: F.when(x >= s["n"], s["n"]).otherwise(F.coalesce(F.get(s["j"], x), s["n"]))

    def double(s: Column, _: Column) -> Column:
        ahead = F.transform(s["r"], lambda x: jump(s, x))
        return F.struct(F.concat(s["r"], ahead).alias("r"), F.transform(s["j"], lambda x: jump(s, x)).alias("j"), s["n"].alias("n"))

    start = F.struct(F.array(F.lit(0)).alias("r"), jumps.alias("j"), F.size(jumps).alias("n"))
    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size(jumps) + 2)).cast("int") + 1)
    return F.aggregate(rounds, start, double, lambda s: F.filter(s["r"], lambda x: x < s["n"]))


def tag_table(parsed: DataFrame, key: str = "_row") -> DataFrame:
    """(key, at, kind, name) of every token: text, comment, declaration, alone (void or closed in itself), start, end."""
    body = lambda t: M.tag_body(t)

    def kind(t: Column) -> Column:
        alone = body(t).endswith("/") | M.tag_name(t).isin(*M.VOID)
        return F.when(~t.startswith("<"), "text").when(t.startswith("<!--"), "comment").when(t.rlike("^<[!?]"), "declaration").when(~t.endswith(">"), "open").when(t.startswith("</") & ~body(t).endswith("/"), "end").when(t.startswith("</"), "end_alone").when(alone, "alone").otherwise("start")

    tags = F.transform("tokens", lambda t: F.struct(kind(t).alias("kind"), M.tag_name(t).alias("name")))
    return parsed.select(key, F.posexplode(tags).alias("at", "tag")).select(key, "at", "tag.kind", "tag.name")


def element_ends(tags: DataFrame, key: str = "_row") -> DataFrame:
    """(key, ends): the last token of what begins at each token, itself where nothing does; unclosed elements run to the end.

    An end tag that begins nothing is taken for a start: it runs to the next end tag that closes it, or to the end.
    """
    last = tags.groupBy(key).agg(F.max("at").alias("_last"))
    change = F.when(F.col("kind").isin("end", "end_alone"), -1).when((F.col("kind") == "start") & ~F.col("name").isin(*M.VOID), 1)
    named = tags.withColumn("_change", change).filter("_change is not null")
    by_name = Window.partitionBy(key, "name").orderBy("at")
    deep = named.withColumn("_depth", F.sum("_change").over(by_name.rowsBetween(Window.unboundedPreceding, 0)))
    starts = deep.filter("kind <> 'end_alone' and not name in ({})".format(",".join(f"'{v}'" for v in M.VOID))).select(key, "name", "at", F.col("_depth").alias("_level"), F.lit(None).cast("int").alias("_end"))
    ends = deep.filter("_change < 0").select(key, "name", "at", (F.col("_depth") + 1).alias("_level"), F.col("at").alias("_end"))
    ahead = Window.partitionBy(key, "name", "_level").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    matched = starts.unionByName(ends).withColumn("_match", F.last("_end", ignorenulls=True).over(ahead)).filter("_end is null").select(key, "at", "_match")
    matched = matched.join(last, key).select(key, "at", F.coalesce("_match", "_last").alias("end"))
    whole = tags.select(key, "at").join(matched, [key, "at"], "left").withColumn("end", F.coalesce("end", "at"))
    return whole.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "end"))).alias("_both")).select(key, F.transform("_both", lambda x: x["end"]).alias("ends"))


def parsed(pages: DataFrame, markup: Column) -> DataFrame:
    """``pages`` with tokens and ends of a markup column, written to the shared folder; null or empty markup has none."""
    numbered = pages.withColumn("tokens", M.tokens(F.coalesce(markup, F.lit("")))).withColumn("_row", F.monotonically_increasing_id())
    known = materialise(numbered)
    none = F.array().cast("array<int>")
    return materialise(known.join(element_ends(tag_table(known)), "_row", "left").withColumn("ends", F.coalesce("ends", none)))


def _is_opaque(token: Column) -> Column:
    return M.is_tag(token) & M.tag_name(token).isin(*M.OPAQUE)


def visible(tokens: Column, ends: Column) -> Column:
    """What a reader sees, on one line: no tags, no content of opaque elements, entities decoded, white space collapsed."""

    def seen(b: Column) -> Column:
        both = F.arrays_zip(b["t"], b["e"])
        stops = followed(F.transform(both, lambda x, i: F.when(_is_opaque(x["t"]), x["e"] + 1).otherwise(i + 1)))
        return F.filter(F.transform(stops, lambda i: F.get(b["t"], i)), lambda t: ~t.startswith("<"))

    def text(b: Column) -> Column:  # only where there are opaque elements some text is passed over
        plain = F.filter(b["t"], lambda t: ~t.startswith("<"))
        return F.array_join(F.when(F.exists(b["t"], _is_opaque), seen(b)).otherwise(plain), "")

    return bound(bound(F.struct(tokens.alias("t"), ends.alias("e")), text), lambda t: X.trim_unicode(F.regexp_replace(M.decode_entities(t), X.SPACES, " ")))


def _cut(tokens: Column, ends: Column, first: Column, last: Column) -> tuple[Column, Column]:
    """Tokens first to last, and where their elements end among them."""
    n = F.greatest(last - first + 1, F.lit(0))
    return F.slice(tokens, first + 1, n), F.transform(F.slice(ends, first + 1, n), lambda e: F.least(e, last) - first)


def blocks(pages: DataFrame, markup: Column) -> DataFrame:
    """``pages`` by (block, markup, tokens, ends): top-level elements and loose text, in order; no element is cut."""
    known = parsed(pages, markup)
    blank = lambda t: ~t.startswith("<") & t.rlike(r"^[ \t\n\r\f]*$")
    jumps = known.withColumn("_jumps", F.transform("ends", lambda e, i: e + 1))
    starts = F.filter(followed(F.col("_jumps")), lambda i: ~blank(F.get(F.col("tokens"), i)))
    cut = lambda i: _cut(F.col("tokens"), F.col("ends"), i, F.get(F.col("ends"), i))
    each = F.transform(starts, lambda i: F.struct(cut(i)[0].alias("tokens"), cut(i)[1].alias("ends")))
    made = jumps.withColumn("_blocks", F.transform(each, lambda b: F.struct(X.trim_unicode(F.array_join(b["tokens"], "")).alias("markup"), b["tokens"].alias("tokens"), b["ends"].alias("ends"))))
    made = made.withColumn("_blocks", F.filter("_blocks", lambda b: b["markup"] != ""))
    own = [c for c in pages.columns]
    return made.select(*own, F.posexplode("_blocks").alias("block", "_b")).select(*own, "block", "_b.markup", "_b.tokens", "_b.ends")


def visible_text(pages: DataFrame, markup: Column, name: str = "visible") -> DataFrame:
    """``pages`` with the visible text of a markup column; null stays null."""
    known = parsed(pages.withColumn("_null", markup.isNull()), markup)
    return known.withColumn(name, F.when(~F.col("_null"), visible(F.col("tokens"), F.col("ends")))).drop("tokens", "ends", "_row", "_null")


def utterance_rows(pages: DataFrame, page: str = "page_id", markup: str = "html") -> DataFrame:
    """(page, block, sentence, index, text): speakable sentences of blocks, which keep their number; index counts along the
    page, sentence in the block."""
    parts = blocks(pages.select(page, markup), M.body_of(F.col(markup)))
    text = X.without_image_markers(visible(F.col("tokens"), F.col("ends")))
    said = parts.withColumn("_text", text).withColumn("_said", F.filter(X.sentences(F.col("_text")), X.is_speakable))
    order = Window.partitionBy(page).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = said.withColumn("_before", F.coalesce(F.sum(F.size("_said")).over(order), F.lit(0)))
    each = before.select(page, "block", "_before", F.posexplode("_said").alias("sentence", "text"))
    return each.select(page, "block", "sentence", (F.col("_before") + F.col("sentence")).cast("int").alias("index"), "text")


def packed(rows: DataFrame, key: list[str], order: str, cost: str, budget: int = PAGE_CHARS) -> DataFrame:
    """``rows`` with part: packed in order, a row that would take its part beyond the budget opens the next; one that is
    larger stands alone.

    The row that follows a part is found for every row that might begin one: in the order of running costs, as many rows end
    by then. The beginnings are followed by doubling.
    """
    known = materialise(rows)
    w = Window.partitionBy(*key).orderBy(order)
    run = known.select(*key, order, F.col(cost).alias("_c")).withColumn("_i", F.row_number().over(w) - 1).withColumn("_sum", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = run.select(*key, F.col("_sum").alias("_at"), F.lit(0).alias("_asks"), F.lit(None).cast("int").alias("_i"))
    asks = run.select(*key, (F.col("_sum") - F.col("_c") + budget).alias("_at"), F.lit(1).alias("_asks"), "_i")
    until = Window.partitionBy(*key).orderBy("_at", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    found = ends.unionByName(asks).withColumn("_n", F.sum(1 - F.col("_asks")).over(until)).filter("_asks = 1").select(*key, "_i", F.greatest(F.col("_n"), F.col("_i") + 1).cast("int").alias("_to"))
    jumps = materialise(found.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_i", "_to"))).alias("_j")).select(*key, F.transform("_j", lambda x: x["_to"]).alias("_j")))
    begun = jumps.select(*key, F.posexplode(followed(F.col("_j"))).alias("part", "_i"))
    at = run.select(*key, order, "_i").join(begun, [*key, "_i"], "left").withColumn("part", F.last("part", ignorenulls=True).over(Window.partitionBy(*key).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))).drop("_i")
    return known.join(at, [*key, order])


def page_blocks(pages: DataFrame, page: str = "page_id", markup: str = "html", budget: int = PAGE_CHARS) -> DataFrame:
    """(page, part, blocks, text): the blocks of a body packed to ``budget`` visible characters, a blank line between them,
    inside the body's own tag."""
    parts = blocks(pages.select(page, markup), M.body_of(F.col(markup)))
    costed = parts.select(page, "block", F.col("markup"), F.length(visible(F.col("tokens"), F.col("ends"))).cast("long").alias("_cost"))
    grouped = packed(costed, [page], "block", "_cost", budget).groupBy(page, "part").agg(F.count("*").cast("int").alias("blocks"), F.array_sort(F.collect_list(F.struct("block", "markup"))).alias("_m"))
    tagged = grouped.join(pages.select(page, M.body_tag(F.col(markup)).alias("_tag")), page)
    return tagged.select(page, "part", "blocks", F.concat("_tag", F.lit("\n"), F.array_join(F.transform("_m", lambda m: m["markup"]), "\n\n"), F.lit("\n</body>")).alias("text"))


def _peeled(tokens: Column) -> Column:
    """The place of an element's last end tag; null for text, void elements and what has no inside."""
    first = F.get(tokens, F.lit(0))
    close = F.array_max(F.transform(tokens, lambda t, i: F.when(t.startswith("</") & (i > 0), i)))
    return F.when(M.is_tag(first) & first.endswith(">") & ~M.tag_body(first).endswith("/") & ~M.tag_name(first).isin(*M.VOID), close)


def held_tags(tokens: Column, ends: Column) -> Column:
    """A block for translation: struct(open, close, text, tags). Its outer tags, its text with each element inside as a
    numbered pair of markers, and the tags that these stand for. Elements inside those are flattened."""

    def inner(b: Column, first: Column, last: Column) -> Column:
        cut, own = _cut(b["t"], b["e"], first, last)
        return F.struct(cut.alias("t"), own.alias("e"))

    def element(p: Column, shut: Column) -> Column:
        """An element inside: its tags and what is seen between them; one without an inside is a tag alone."""
        opened = F.when(shut.isNull(), F.array_join(p["t"], "")).otherwise(F.get(p["t"], F.lit(0)))
        closed = F.when(shut.isNull(), "").otherwise(F.array_join(F.slice(p["t"], shut + 1, F.size(p["t"]) - shut), ""))
        said = F.when(shut.isNull(), "").otherwise(visible(*_cut(p["t"], p["e"], F.lit(1), shut - 1)))
        return F.struct(F.lit(True).alias("tag"), said.alias("text"), opened.alias("open"), closed.alias("close"))

    def parts(b: Column) -> Column:
        loose = lambda i: F.struct(F.lit(False).alias("tag"), M.decode_entities(F.get(b["t"], i)).alias("text"), F.lit("").alias("open"), F.lit("").alias("close"))
        tag = lambda i: bound(inner(b, i, F.get(b["e"], i)), lambda p: bound(_peeled(p["t"]), lambda shut: element(p, shut)))
        return F.transform(followed(F.transform(b["e"], lambda e, i: e + 1)), lambda i: F.when(F.get(b["t"], i).startswith("<"), tag(i)).otherwise(loose(i)))

    def add(s: Column, p: Column) -> Column:
        n = (s["n"] + F.when(p["tag"], 1).otherwise(0)).cast("int")
        marked = F.concat(F.lit("⟦"), n.cast("string"), F.lit("⟧"), p["text"], F.lit("⟦/"), n.cast("string"), F.lit("⟧"))
        return F.struct(F.concat(s["text"], F.when(p["tag"], marked).otherwise(p["text"])).alias("text"), n.alias("n"))

    def whole(b: Column) -> Column:
        close = b["c"]
        rest = X.trim_unicode(F.array_join(F.slice(b["t"], close + 1, F.size(b["t"]) - close), ""))
        text = lambda ps: F.aggregate(ps, F.struct(F.lit("").alias("text"), F.lit(0).alias("n")), add, lambda s: X.trim_unicode(s["text"]))
        tags = lambda ps: F.transform(F.filter(ps, lambda p: p["tag"]), lambda p: F.array(p["open"], p["close"]))
        held = lambda ps: F.struct(F.get(b["t"], F.lit(0)).alias("open"), rest.alias("close"), text(ps).alias("text"), tags(ps).alias("tags"))
        bare = X.trim_unicode(F.regexp_replace(M.decode_entities(F.array_join(b["t"], "")), X.SPACES, " "))
        none = F.struct(F.lit("").alias("open"), F.lit("").alias("close"), bare.alias("text"), F.array().cast("array<array<string>>").alias("tags"))
        return F.when(close.isNull(), none).otherwise(bound(bound(inner(b, F.lit(1), close - 1), parts), held))

    return bound(F.struct(tokens.alias("t"), ends.alias("e"), _peeled(tokens).alias("c")), whole)


def rebuilt(held: Column, translated: Column) -> Column:
    """The translated block: tags back where every marker came back once and nests, else plain text in the outer tag."""
    return bound(F.struct(held.alias("held"), translated.alias("translated")), lambda b: _rebuilt(b["held"], b["translated"]))


def _rebuilt(held: Column, translated: Column) -> Column:
    parts = F.regexp_extract_all(translated, F.lit("(?s)⟦[^⟧]*⟧|[^⟦]+|⟦"), 0)
    number = lambda p: F.regexp_extract(p, r"^⟦/?(\d{1,9})⟧$", 1)
    count = F.size(held["tags"])

    def step(s: Column, p: Column) -> Column:
        n = F.when(number(p) != "", number(p).cast("int")).otherwise(0)
        closes, tag = p.startswith("⟦/"), F.get(held["tags"], n - 1)
        known = (n >= 1) & (n <= count)
        right = F.when(closes, F.coalesce(F.element_at(F.concat(F.array(F.lit(0)), s["stack"]), -1) == n, F.lit(False))).otherwise(~F.array_contains(s["seen"], n))
        mark = p.startswith("⟦")
        stack = F.when(~mark, s["stack"]).when(closes, F.slice(s["stack"], 1, F.greatest(F.size(s["stack"]) - 1, F.lit(0)))).otherwise(F.concat(s["stack"], F.array(n)))
        seen = F.when(mark & ~closes, F.concat(s["seen"], F.array(n))).otherwise(s["seen"])
        out = F.concat(s["out"], F.when(~mark, X.escape_text(p)).when(known, F.get(tag, F.when(closes, 1).otherwise(0))).otherwise(""))
        return F.struct((s["ok"] & (~mark | (known & right))).alias("ok"), stack.alias("stack"), seen.alias("seen"), out.alias("out"))

    none = F.array().cast("array<int>")
    start = F.struct(F.lit(True).alias("ok"), none.alias("stack"), none.alias("seen"), F.lit("").alias("out"))
    restored = F.aggregate(parts, start, step, lambda s: F.when(s["ok"] & (F.size(s["stack"]) == 0) & (F.size(s["seen"]) == count), s["out"]))
    plain = X.escape_text(F.regexp_replace(translated, "⟦[^⟧]*⟧|⟦", ""))
    return F.concat(held["open"], F.coalesce(restored, plain), held["close"])
