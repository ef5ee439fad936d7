"""Queries that SQL can't express, over whole tables, against brute force: another parser, or plain Python over the rows."""

import hashlib
import os
import re
from html.parser import HTMLParser

import duckdb
import pytest
from pyspark.sql import functions as F

from lorestack.functions import markup as M
from lorestack.operators import structure as S
from lorestack.plans import registry
from lorestack.session import table
from tests import walker

DATA = os.environ.get("LORESTACK_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
md5 = lambda text: hashlib.md5(text.encode()).hexdigest()


class Reader(HTMLParser):
    """Visible text, and lines, by the standard library's parser."""

    def __init__(self, html, opaque):
        super().__init__(convert_charrefs=False)
        self.opaque, self.deep, self.out, self.tags = opaque, 0, [], []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attributes):
        self.tags.append((tag, dict(attributes)))
        self.deep += tag in self.opaque
        if tag in M.BREAKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.deep = max(0, self.deep - (tag in self.opaque))
        if tag in M.BREAKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.deep:
            self.out.append(data)

    def handle_entityref(self, name):
        self.handle_data(M.ENTITIES.get(name, f"&{name};"))

    def handle_charref(self, name):
        self.handle_data(chr(int(name[1:], 16) if name[0] in "xX" else int(name)))

    def text(self):
        return " ".join("".join(self.out).split())


def plain(html):
    """What is read, without white space: tags may or may not part words."""
    return "".join(Reader(html, M.OPAQUE).text().split())


@pytest.fixture(scope="module")
def rows():
    con = duckdb.connect()
    pages = dict(con.sql(f"SELECT page_id, html FROM '{DATA}/pages.parquet'").fetchall())
    docs = dict(con.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall())
    assert len(pages) >= 50 and len(docs) >= 200
    return pages, docs


def run(spark, name):
    return registry.QUERIES[name](spark, DATA)


def test_pages_of_text(spark, rows):
    docs = dict(rows[1])
    for r in run(spark, "t06_paginate").collect():
        text = docs.pop(r.doc_id)
        want = walker.pages(text)
        assert (r.n_chars, r.longest, r.pages) == (len(text), max(map(len, want)), len(want))
    assert not any(t.strip() for t in docs.values())
    _, docs = rows
    written = {}
    for r in run(spark, "s07_write_pages").collect():
        written.setdefault(r.book_id, {})[r.page] = r.text_md5
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in written.values())
    assert written == {i: {k: md5(p.rstrip()) for k, p in enumerate(walker.pages(t), 1)} for i, t in docs.items() if t.strip()}


def test_visible_text_by_another_parser(spark, rows):
    pages, _ = rows
    seen = {r.page_id: r.visible for r in S.visible_text(table(spark, DATA, "pages"), F.col("html")).collect()}
    assert {r.page_id: r.text_md5 for r in run(spark, "t09_visible_text").collect()} == {i: md5(t) for i, t in seen.items()}
    assert {i: "".join(t.split()) for i, t in seen.items()} == {i: plain(h) for i, h in pages.items()}
    lines = {r.page_id: r.text for r in table(spark, DATA, "pages").select("page_id", M.xhtml_to_text(F.col("html")).alias("text")).collect()}
    assert {r.page_id: r.text_md5 for r in run(spark, "t12_xhtml_to_text").collect()} == {i: md5(t) for i, t in lines.items()}
    for i, html in pages.items():
        read = Reader(html, ("head", "style", "script"))
        want = [" ".join(x.split()) for x in "".join(read.out).split("\n")]
        assert lines[i].split("\n\n") == [x for x in want if x]


def test_nothing_that_runs_is_left(spark, rows):
    pages, _ = rows
    clean = {r.page_id: r.html for r in table(spark, DATA, "pages").select("page_id", M.strip_scripts(F.col("html")).alias("html")).collect()}
    got = run(spark, "t07_strip_scripts").collect()
    assert {r.page_id: r.clean_md5 for r in got} == {i: md5(t) for i, t in clean.items()} and not any(r.has_script or r.has_comment for r in got)
    for i, html in clean.items():
        kept = Reader(html, ()).tags
        assert not any(t in M.REMOVED or any(a.startswith("on") for a in attributes) for t, attributes in kept)
        assert plain(html) == plain(pages[i])
        assert [t for t, _ in kept] == [t for t, _ in Reader(pages[i], ()).tags if t not in M.REMOVED]


def test_blocks_hold_the_body(spark, rows):
    pages, _ = rows
    body = {}
    for i, html in pages.items():
        inside = re.split(r"(?i)<body[^>]*>", html, maxsplit=1)[-1]
        body[i] = re.split(r"(?i)</body", inside)[0]
    held = {}
    for r in run(spark, "t08_split_blocks").collect():
        held.setdefault(r.page_id, {})[r.block] = r.markup_md5
    for i, blocks in held.items():
        found = walker.blocks(body[i])
        assert "".join("".join(found).split()) == "".join(body[i].split()) and [md5(b) for b in found] == [blocks[k] for k in sorted(blocks)]
    parts = {}
    for r in run(spark, "t11_paginate_blocks").collect():
        parts.setdefault(r.page_id, []).append((r.part, r.blocks))
    assert {i: sum(n for _, n in p) for i, p in parts.items()} == {i: len(b) for i, b in held.items()}
    assert {r.page_id: r.n for r in run(spark, "t15_body").collect()} == {i: len(b) for i, b in body.items()}
    for r in run(spark, "t14_hold_tags").collect():
        block = walker.blocks(body[r.page_id])[r.block]
        *_, text, tags = walker.held(block)
        assert (r.tags, r.text_md5, r.rebuilt_md5) == (len(tags), md5(text), md5(walker.rebuilt(block, text)))


def test_sentences_and_spans(spark, rows):
    pages, _ = rows
    found = {}
    for r in S.utterance_rows(spark.createDataFrame(list(pages.items()), "page_id long, html string")).collect():
        found.setdefault(r.page_id, []).append((r["index"], r.block, r.sentence, r.text))
    assert sum(map(len, found.values())) == run(spark, "t22_utterances").count()
    spans = {(r.page_id, r.block, r.sentence): (r["from"], r.to) for r in run(spark, "w08_utterance_spans").collect()}
    clicks = {r.click_id: r["index"] for r in run(spark, "j08_span_lookup").collect()}
    for page, items in found.items():
        said = re.sub(r"[\W_]", "", "".join(t for *_, t in sorted(items)))
        assert said == re.sub(r"[\W_]", "", plain(re.sub(r"(?is).*<body[^>]*>|</body.*", "", pages[page])))
        at = {}
        for index, block, sentence, text in sorted(items):
            begin = at.get(block, 0)
            assert spans[(page, block, sentence)] == (begin, begin + len(text.encode("utf-16-be")) // 2)
            at[block] = begin + len(text.encode("utf-16-be")) // 2 + 1
        for i in range(31):
            offset = (i * 37) % 200
            here = [n for n, b, s, _ in items if b == i and spans[(page, b, s)][0] <= offset <= spans[(page, b, s)][1]]
            ahead = [n for n, b, *_ in items if b >= i]
            assert clicks[page * 100 + i] == (min(here) if here else min(ahead, default=None)), (page, i)


def test_files_and_books(spark, rows):
    pages, docs = rows
    got = {r.path: (r.text_md5, r.error) for r in run(spark, "s02_extract_text").collect()}
    for i, text in docs.items():
        kind = ("txt", "docx", "MD", "docx", "png")[i % 5]
        error = {3: "unreadable", 4: "unsupported"}.get(i % 5) or ("no_text" if i % 15 == 2 or not text.strip() else None)
        assert got.pop(f"/in/{i}.{kind}") == ((None if error else md5(text)), error), i
    assert not got
    books = {}
    for i in sorted(pages):
        books.setdefault(i // 4, []).append(pages[i])
    chapters = {}
    for r in run(spark, "s03_epub_chapters").collect():
        chapters.setdefault(r.path, []).append((r.chapter_no, r.xhtml_md5, r.error))
    for b, texts in books.items():
        have = sorted(chapters[f"/books/{b}.{'epub' if b % 5 else 'mobi'}"], key=lambda x: x[0] or 0)
        assert [x[1] for x in have] == ([None] if b % 7 == 3 else [md5(t) for t in reversed(texts)]), b


def test_translated_and_rendered_pages(spark, rows):
    pages, _ = rows
    tags = {r.page_id: r.tag for r in run(spark, "t15_body").collect()}
    got = {r.page: r.text_md5 for r in run(spark, "x01_translate_pages").collect()}
    assert set(got) == {i for i in pages if i % 6}
    for i, text in got.items():
        inside = re.split(r"(?i)<body[^>]*>", pages[i], maxsplit=1)[-1]
        out = [walker.rebuilt(b, walker.held(b)[2].upper()) if walker.visible(walker.tokens(b)) else b for b in walker.blocks(re.split(r"(?i)</body", inside)[0])]
        assert text in (md5(tags[i] + "\n" + "\n\n".join(out) + "\n</body>"), "blank_answer")
    import base64

    for r in run(spark, "t23_render_page").collect():
        address = "data:image/png;base64," + base64.b64encode(pages[r.page].encode()).decode()
        html = f'<!doctype html><html><head><style>p{{margin:0}}</style></head>{tags[r.page]}<img src="{address}"/><img src="9999.jpg"/></body></html>'
        assert r.html_md5 == md5(html)
