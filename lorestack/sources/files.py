"""Files as rows: text extraction, e-book archives and their gate. Input is what ``binaryFile`` reads: path and content.

One bad file is an error row; the others go on. More formats come from the caller as ``extension -> bytes -> text``.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorestack.functions.text import repair_hyphens, window_words, words
from lorestack.session import map_in_parts, materialise

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_CONTAINER = "META-INF/container.xml"


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, content of the files below ``path``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def docx_text(content: bytes) -> str:
    """Text of paragraphs and table cells, a line each."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in root.iter(f"{_WORD}p"))


READERS: dict[str, Callable[[bytes], str]] = {"txt": lambda c: c.decode("utf-8"), "md": lambda c: c.decode("utf-8"), "docx": docx_text}


def extract_text(files: DataFrame, readers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(path, text, error): error is unsupported, unreadable or no_text; broken words are joined."""
    known = READERS | (readers or {})

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                kind = (re.search(r"\.([^./]+)$", path) or [None, ""])[1].lower()
                text, error = None, None
                if kind not in known:
                    error = "unsupported"
                else:
                    try:
                        text = known[kind](bytes(content))
                    except Exception:  # whatever a reader meets in a file is that file's error
                        error = "unreadable"
                    if error is None and not text.strip():
                        text, error = None, "no_text"
                rows.append((path, text, error))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return map_in_parts(files.select("path", "content"), run, "path string, text string, error string", "content").withColumn("text", repair_hyphens(F.col("text")))


#: Kinds of plain text, which need not be whole in one place to be read.
LINES = ("txt", "md")


def kind_of(path: Column) -> Column:
    """The extension of a path in lower case."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def line_chunks(spark: SparkSession, paths: list[str], max_tokens: int = 512, overlap_tokens: int = 64) -> tuple[DataFrame, DataFrame]:
    """Chunks (address, chunk_index, text) of text files, and (address, error) of each that has a line: what :func:`extract_text`
    and :func:`lorestack.functions.text.chunks` give, without a whole file in a task.

    Files are read in the splits that Spark makes of them. A split numbers the words of its lines; what earlier splits of a
    file have is a row for each split. A line gives each chunk that it reaches its words, and a chunk is put together from
    those: it has ``max_tokens`` however long its file is. A word that is broken by a hyphen at the end of a line is one word
    with the start of the next. A byte order mark is no part of the text. Longest of all that is held is a line.
    An address is what ``_metadata.file_path`` says, which is not spelt as the path is.
    """
    window, step = window_words(max_tokens, overlap_tokens)
    value, n = F.col("value"), F.col("n")
    quoted = [re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in paths]  # a path is no pattern
    read = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(quoted)
    lines = read.select(F.col("_metadata.file_path").alias("address"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")
    lines = materialise(
        lines.withColumns({
            "n": F.size(words(repair_hyphens(value))),
            "ends": value.rlike(r"\p{IsAlphabetic}-\z"),
            "starts": value.rlike(r"\A[\p{IsAlphabetic}&&\p{IsLowercase}]"),
            "bad": ~F.is_valid_utf8(value),
            "full": value.rlike(r"(?U)[^\s\x1c-\x1f]"),
        })
    )
    blocks = Window.partitionBy("address").orderBy("block")
    edges = lines.groupBy("address", "block").agg(F.max_by("ends", "row").alias("e"), F.min_by("starts", "row").alias("s"))
    edges = edges.select("address", "block", F.lag("e").over(blocks).alias("came"), F.lead("s").over(blocks).alias("goes"))
    inside = Window.partitionBy("address", "block").orderBy("row")
    glued = F.col("starts") & F.coalesce(F.lag("ends").over(inside), F.col("came"), F.lit(False))
    cut = F.col("ends") & F.coalesce(F.lead("starts").over(inside), F.col("goes"), F.lit(False))
    marked = lines.join(F.broadcast(edges), ["address", "block"]).withColumns({"glued": glued, "cut": cut})
    numbered = materialise(marked.withColumn("own", F.sum(n - F.col("glued").cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, 0))))
    totals = numbered.groupBy("address", "block").agg(F.sum(n - F.col("glued").cast("long")).alias("net"), F.bool_or("bad").alias("bad"), F.bool_or("full").alias("full"))
    totals = materialise(totals)
    files = totals.groupBy("address").agg(F.sum("net").alias("all"), F.when(F.bool_or("bad"), "unreadable").when(~F.bool_or("full"), "no_text").alias("error"))
    last = F.greatest(F.lit(0), F.ceil((F.col("all") - window) / step)).cast("long").alias("last")
    before = totals.select("address", "block", F.coalesce(F.sum("net").over(blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    before = before.join(files.filter("error is null").select("address", last), "address")

    text = repair_hyphens(F.when(F.col("cut"), F.expr("left(value, length(value) - 1)")).otherwise(value))
    begin = F.col("begin")
    fewest = F.when(begin < window, F.lit(0)).otherwise(F.floor((begin - window) / step) + 1).cast("long")
    most = F.least(F.floor((begin + n - 1) / step), F.col("last"))

    def part(w: Column, i: Column) -> Column:
        start, end = F.greatest(begin, i * step), F.least(begin + n, i * step + window)
        own = F.array_join(F.slice(w, (start - begin + 1).cast("int"), (end - start).cast("int")), " ")
        return F.struct(i.cast("int").alias("chunk_index"), ((start == begin) & F.col("glued")).alias("glued"), own.alias("part"))

    placed = numbered.filter("n > 0").join(F.broadcast(before), ["address", "block"]).withColumn("begin", F.col("before") + F.col("own") - n)
    each = F.get(F.transform(F.array(words(text)), lambda w: F.transform(F.sequence(fewest, most), lambda i: part(w, i))), 0)
    parts = placed.select("address", "block", "row", F.explode(each).alias("x")).select("address", "block", "row", "x.*")
    whole = parts.groupBy("address", "chunk_index").agg(F.array_sort(F.collect_list(F.struct("block", "row", "glued", "part"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p, j: F.concat(F.when((j == 0) | p["glued"], "").otherwise(" "), p["part"])), "")
    return whole.select("address", "chunk_index", joined.alias("text")), files.select("address", "error")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def spine_of(archive: zipfile.ZipFile) -> list[str]:
    """The archive's documents in reading order. Raises ValueError with the reason."""
    names = set(archive.namelist())
    if _CONTAINER not in names:
        raise ValueError("no_container")
    opf = next((e.get("full-path") for e in ElementTree.fromstring(archive.read(_CONTAINER)).iter() if _local(e.tag) == "rootfile"), None)
    if not opf or opf not in names:
        raise ValueError("no_package")
    package = ElementTree.fromstring(archive.read(opf))
    manifest = {e.get("id"): e.get("href", "") for e in package.iter() if _local(e.tag) == "item"}
    refs = [e.get("idref") for e in package.iter() if _local(e.tag) == "itemref"]
    if not refs:
        raise ValueError("no_spine")
    if missing := [r for r in refs if r not in manifest]:
        raise ValueError(f"unknown_idref {missing[0]}")
    return [posixpath.normpath(posixpath.join(posixpath.dirname(opf), unquote(manifest[r].partition("#")[0]))) for r in refs]


def epub_chapters(files: DataFrame) -> DataFrame:
    """(path, chapter_no, href, xhtml, css, error): the documents of each archive in spine order, or one error row.

    css holds the style sheets that a chapter links, each once in an archive, at the first chapter that names it.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as archive:
                        names, seen, own = set(archive.namelist()), set(), []
                        for n, href in enumerate(spine_of(archive), 1):
                            if href not in names:
                                raise ValueError("no_document")
                            xhtml, css = archive.read(href).decode("utf-8", "replace"), []
                            for link in re.findall(r"<link\b[^>]*href=[\"']([^\"']+\.css)[\"']", xhtml, re.I):
                                sheet = posixpath.normpath(posixpath.join(posixpath.dirname(href), unquote(link)))
                                if sheet in names and sheet not in seen:
                                    seen.add(sheet)
                                    css.append(archive.read(sheet).decode("utf-8", "replace"))
                            own.append((path, n, href, xhtml, "\n".join(css), None))
                        rows.extend(own)
                except (ValueError, ElementTree.ParseError) as e:
                    rows.append((path, None, None, None, None, str(e)[:80] if type(e) is ValueError else "bad_xml"))
                except (zipfile.BadZipFile, KeyError, RuntimeError):
                    rows.append((path, None, None, None, None, "unreadable"))
            yield pd.DataFrame(rows, columns=["path", "chapter_no", "href", "xhtml", "css", "error"]).astype({"chapter_no": "Int32"})

    return map_in_parts(files.select("path", "content"), run, "path string, chapter_no int, href string, xhtml string, css string, error string", "content")


def epub_images(files: DataFrame) -> DataFrame:
    """(path, n, name, extension, content): the images of each archive, numbered in reading order over the whole book."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows, seen = [], set()
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as archive:
                        names = set(archive.namelist())
                        for href in spine_of(archive):
                            for source in re.findall(r"<(?:img|image)\b[^>]*?(?:src|xlink:href)=[\"']([^\"']+)[\"']", archive.read(href).decode("utf-8", "replace"), re.I):
                                name = posixpath.normpath(posixpath.join(posixpath.dirname(href), unquote(source)))
                                if name in names and name not in seen:
                                    seen.add(name)
                                    rows.append((path, len(seen), name, name.rpartition(".")[2].lower(), archive.read(name)))
                except (ValueError, ElementTree.ParseError, zipfile.BadZipFile, KeyError, RuntimeError):
                    continue
                yield pd.DataFrame(rows, columns=["path", "n", "name", "extension", "content"])

    return map_in_parts(files.select("path", "content"), run, "path string, n int, name string, extension string, content binary", "content")


def book_gate(files: DataFrame) -> DataFrame:
    """(path, status, reason) of each book: only readable archives of the right kind without an encryption entry come in."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                reason = None
                if not path.lower().endswith(".epub"):
                    reason = "unsupported"
                else:
                    try:
                        with zipfile.ZipFile(io.BytesIO(bytes(content))) as archive:
                            reason = "protected" if "META-INF/encryption.xml" in archive.namelist() else None
                    except (zipfile.BadZipFile, RuntimeError):
                        reason = "unreadable"
                rows.append((path, "rejected" if reason else "imported", reason))
            yield pd.DataFrame(rows, columns=["path", "status", "reason"])

    return map_in_parts(files.select("path", "content"), run, "path string, status string, reason string", "content")
