"""Pages of text: every place where a page might begin is a row, knows where the page from there on would end, and the
pages are what is reached from the first place by doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorestack.operators.structure import PAGE_CHARS, followed
from lorestack.session import materialise

IMAGE_CHARS = 700
MARKER_PREFIX = "[[image: "
_PARAGRAPH = r"(?s).*?(?:[ \t\r\f]*\n[ \t\r\f]*\n[ \t\r\n\f]*|\z)"
_SENTENCE = r"""(?sU).*?(?:[.!?…]["')\]»”’]*\s+(?=[^\s.!?…])|\z)"""
_MARKER = r"(?s).*?(?:\[\[image: |\z)"


def _starts(texts: DataFrame, pattern: str, kind: str) -> DataFrame:
    """(_row, pos, kind): where the pieces that a pattern ends begin, but for the first; of markers where they begin."""
    about = [F.length("_text").cast("long").alias("size"), F.endswith(F.col("_text"), F.lit(MARKER_PREFIX)).alias("whole")]
    cut = texts.select("_row", *about, F.posexplode(F.regexp_extract_all("_text", F.lit(pattern), 0)).alias("i", "piece"))
    pieces = cut.select("_row", "size", "whole", "i", F.length("piece").cast("long").alias("n"))
    ended = pieces.withColumn("pos", F.sum("n").over(Window.partitionBy("_row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    back = len(MARKER_PREFIX) if kind == "marker" else 0
    inside = ended.filter((F.col("pos") < F.col("size")) | (F.col("whole") & (F.lit(kind) == "marker")))
    return inside.filter("n > 0").select("_row", (F.col("pos") - back).alias("pos"), F.lit(kind).alias("kind"))


def _forced(start: Column, end: Column, markers: Column, budget: int, image: int) -> Column:
    """Where a stretch without any boundary is cut: as soon as characters and images reach the budget.

    From a place on, with j images before the cut it is the later of place + budget - j * image and the place after the
    j-th image; the least of these is right.
    """
    few = -(-budget // image) + 1

    def ahead(cur: Column) -> Column:
        near = F.slice(F.filter(markers, lambda m: m >= cur), 1, few)
        return F.array_min(F.concat(F.array(cur + budget), F.transform(near, lambda m, j: F.greatest(cur + budget - image * (j + 1), m + 1))))

    def step(s: Column, _: Column) -> Column:
        to = ahead(s["cur"])
        on = to < end
        return F.struct(F.when(on, to).otherwise(end).alias("cur"), F.when(on & (s["cur"] < end), F.concat(s["cuts"], F.array(to))).otherwise(s["cuts"]).alias("cuts"))

    most = F.ceil((end - start + image * F.size(markers)) / budget).cast("int") + 1
    looked = F.aggregate(F.sequence(F.lit(1), most), F.struct(start.alias("cur"), F.array().cast("array<bigint>").alias("cuts")), step, lambda s: s["cuts"])
    plain = F.when(end - start > budget, F.sequence(start + budget, end - 1, F.lit(budget).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(markers) == 0, plain).otherwise(looked)


def paged(texts: DataFrame, text: str = "text", budget: int = PAGE_CHARS, image: int = IMAGE_CHARS) -> DataFrame:
    """``texts`` with pages, an array: joined they give the text. A page ends at the last paragraph that begins within the
    budget of characters, else at the last sentence, else at the budget; an image marker counts ``image`` more. Null and
    blank texts have no pages."""
    known, value = materialise(texts.withColumn("_row", F.monotonically_increasing_id())), F.coalesce(F.col(text), F.lit(""))
    full = known.filter(value.rlike(r"(?U)\S")).select("_row", value.alias("_text"))
    first = full.select("_row", F.lit(0).cast("long").alias("pos"), F.lit("first").alias("kind"))
    last = full.select("_row", F.length("_text").cast("long").alias("pos"), F.lit("last").alias("kind"))
    events = first.unionByName(last)
    for pattern, kind in ((_PARAGRAPH, "paragraph"), (_SENTENCE, "sentence"), (_MARKER, "marker")):
        events = events.unionByName(_starts(full, pattern, kind))
    found = materialise(events.groupBy("_row", "pos").agg(*(F.bool_or(F.col("kind") == k).alias(k) for k in ("first", "last", "paragraph", "sentence", "marker"))))
    # Stretches between neighbouring boundaries that are over the budget have forced cuts.
    edges = found.filter("first or last or paragraph or sentence")
    reach = edges.select("_row", "pos", F.lead("pos").over(Window.partitionBy("_row").orderBy("pos")).alias("end")).filter("end is not null")
    images = found.filter("marker").select("_row", F.col("pos").alias("m"))
    inside = reach.select("_row", F.col("pos").alias("at"), F.lit(0).alias("o"), F.col("pos")).unionByName(images.select("_row", F.col("m").alias("at"), F.lit(1).alias("o"), F.lit(None).cast("long").alias("pos")))
    owner = inside.withColumn("pos", F.last("pos", ignorenulls=True).over(Window.partitionBy("_row").orderBy("at", "o").rowsBetween(Window.unboundedPreceding, 0))).filter("o = 1").groupBy("_row", "pos").agg(F.array_sort(F.collect_list("at")).alias("markers"))
    none = F.array().cast("array<bigint>")
    stretches = reach.join(owner, ["_row", "pos"], "left").withColumn("markers", F.coalesce("markers", none))
    cuts = stretches.filter(F.col("end") - F.col("pos") + image * F.size("markers") > budget).select("_row", F.explode(_forced(F.col("pos"), F.col("end"), F.col("markers"), budget, image)).alias("pos"))
    flags = ["first", "last", "paragraph", "sentence", "marker"]
    nodes = found.unionByName(cuts.select("_row", "pos", *(F.lit(False).alias(f) for f in flags))).groupBy("_row", "pos").agg(*(F.bool_or(f).alias(f) for f in flags))
    in_order = Window.partitionBy("_row").orderBy("pos")
    weighed = nodes.withColumn("w", F.col("pos") + image * F.coalesce(F.sum(F.col("marker").cast("long")).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = cuts.select("_row", "pos", F.lit(True).alias("cut"))
    stops = weighed.join(cut, ["_row", "pos"], "left").filter("first or last or paragraph or sentence or cut")
    numbered = materialise(stops.withColumn("i", (F.row_number().over(in_order) - 1).cast("int")).select("_row", "pos", "w", "i", "last", "paragraph", "sentence"))
    # Boundaries come before the questions at the same weight.
    has = numbered.filter("paragraph or sentence or last").select("_row", F.col("w").alias("at"), F.lit(0).alias("asks"), F.lit(None).cast("int").alias("i"), F.when(F.col("paragraph"), F.col("i")).alias("p"), F.when(F.col("sentence"), F.col("i")).alias("s"), F.when(F.col("last"), F.col("i")).alias("e"))
    asks = numbered.filter("not last").select("_row", (F.col("w") + budget).alias("at"), F.lit(1).alias("asks"), "i", *(F.lit(None).cast("int").alias(c) for c in "pse"))
    upto = Window.partitionBy("_row").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    told = has.unionByName(asks).select("_row", "asks", "i", *(F.last(c, ignorenulls=True).over(upto).alias(c) for c in "pse")).filter("asks = 1")
    later = lambda c: F.when(F.col(c) > F.col("i"), F.col(c))
    jumps = told.select("_row", "i", F.coalesce("e", later("p"), later("s"), F.col("i") + 1).alias("to"))
    ordered = jumps.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("i", "to"))).alias("j")).select("_row", F.transform("j", lambda x: x["to"]).alias("j"))
    reached = materialise(ordered).select("_row", F.explode(followed(F.col("j"))).alias("i"))
    begun = reached.join(numbered.select("_row", "i", "pos"), ["_row", "i"]).groupBy("_row").agg(F.array_sort(F.collect_list("pos")).alias("_starts"))
    size = F.length(value).cast("long")
    piece = lambda a, k: F.substring(value, (a + 1).cast("int"), (F.coalesce(F.get(F.col("_starts"), k + 1), size) - a).cast("int"))
    return known.join(begun, "_row", "left").withColumn("pages", F.coalesce(F.transform("_starts", piece), F.array().cast("array<string>"))).drop("_row", "_starts")
