"""Markup on cases of the rules: nesting, quoting, removal of what runs code, paging, sentences, held tags."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lorestack.functions import markup as M
from lorestack.operators import structure as S
from lorestack.operators.paging import IMAGE_CHARS, paged
from tests import walker


@pytest.fixture(scope="module")
def each(spark):
    """A column function on many values in one job."""

    def run(function, values):
        df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
        return [r.out for r in df.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]

    return run


@pytest.fixture(scope="module")
def blocks(spark):
    """The blocks of many texts: markup, visible text, held tags and the block rebuilt, by text."""

    def run(values, translated=lambda t: t):
        df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
        rows = S.blocks(df, F.col("v")).withColumn("seen", S.visible(F.col("tokens"), F.col("ends"))).withColumn("held", S.held_tags(F.col("tokens"), F.col("ends")))
        rows = rows.withColumn("back", S.rebuilt(F.col("held"), translated(F.col("held.text")))).orderBy("i", "block").collect()
        return [[(r.markup, r.seen, tuple(r.held), r.back) for r in rows if r.i == i] for i in range(len(values))]

    return run


def test_blocks_nest_by_name_and_loose_text_is_one(blocks):
    inner = "<section><section>deep</section>side</section>"
    html = f"<article id=k>{inner}</article>\n between \n<ul><li>one<li>two</ul><hr><h2>half"
    commented = "<div><!-- <div> -->a</div><p>b</p>"
    got = blocks([html, "", " \n ", None, commented, "<div>a<!-- </div> -->b</div>c", "<P>x</p><p/>y<q>z"])
    assert [[b[0] for b in t] for t in got] == [
        [f"<article id=k>{inner}</article>", "between", "<ul><li>one<li>two</ul>", "<hr>", "<h2>half"], [], [], [],
        ["<div><!-- <div> -->a</div>", "<p>b</p>"], ["<div>a<!-- </div> -->b</div>", "c"], ["<P>x</p>", "<p/>", "y", "<q>z"],
    ]


def soup(seed):
    rng = random.Random(seed)
    parts = ["<p>", "</p>", "<P a='b'>", "<div>", "</div>", "<b>", "</b>", "<br>", "<br/>", "<style>", "</style>", "<!-- <p> -->", "<svg:title>", "</title>", " ", "\n", "text", "&amp;lt;", "&#xe9;", "a.", "<", "<?x y?>", "<img src=x>", "</", "<i/>", "\xa0"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(40)))


def test_any_markup_as_by_a_walk_over_tokens(blocks):
    texts = [soup(i) for i in range(250)]
    for text, got in zip(texts, blocks(texts), strict=True):
        want = walker.blocks(text)
        assert [b[0] for b in got] == want, text
        for (markup, seen, held, back), block in zip(got, want, strict=True):
            assert seen == walker.visible(walker.tokens(block)), block
            assert (held[0], held[1], held[2], [list(t) for t in held[3]]) == walker.held(block), block
            assert back == walker.rebuilt(block, held[2]), block


def test_followed_jumps(spark):
    rng = random.Random(1)
    jumps = [[rng.randrange(i + 1, i + 6) for i in range(n)] for n in (0, 1, 2, 3, 50, 129)]
    df = spark.createDataFrame(list(enumerate(jumps)), "i int, j array<int>")
    for r in df.select("i", S.followed(F.col("j")).alias("r")).collect():
        at, want = 0, []
        while at < len(jumps[r.i]):
            want.append(at)
            at = jumps[r.i][at]
        assert r.r == want


def test_opaque_elements_are_not_seen(spark):
    cases = [x for tag in M.OPAQUE for x in ((f"north <{tag} k='1'>hidden &lt;</{tag}> south", "north south"), (f"north <{tag.upper()}>never closed", "north"), (f"n<x:{tag}>h</x:{tag}>s", "ns"))]
    cases += [("<td>7 &lt; 9</td>\n\n<td>&amp;gt;&#9731;&unknown;</td><!-- no -- > -->", "7 < 9 &gt;☃&unknown;"), ("<figure><img alt='text here'></figure>", ""), ("", ""), (None, None)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, v string")
    got = {r.i: r.visible for r in S.visible_text(df, F.col("v")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[1] for c in cases]


RUNS = ["javascript:go()", "JAVASCRIPT:go()", " javascript:go()", "vbscript:go()", "java\tscript:go()", "java&#09;script:go()", "data:text/html,go()", "data: text/html;base64,go()"]
KEEPS = ["mailto:a@b.example", "/local/javascript", "?q=vbscript:", "data:image/gif;base64,R0", "page.xhtml#n3", "ch:1/part:2.xhtml"]


def test_what_runs_goes(each):
    bad = [f'<form {a}="{v}" title="kept">w</form>' for v, a in itertools.product(RUNS, M.ADDRESSES)]
    for html, out in zip(bad, each(M.strip_scripts, bad), strict=True):
        assert "go()" not in out and 'title="kept"' in out and ">w</form>" in out, html
    kept = [f'<p><a href="{v}">w</a></p>' for v in KEEPS]
    assert each(M.strip_scripts, kept) == kept
    events = [f"<details {e}={q}run{q} open>w</details>" for e, q in itertools.product(["onfocus", "ONTOGGLE", "onAnimationEnd", "on"], ['"', "'", ""])]
    assert not any("run" in out for out in each(M.strip_scripts, events))


def test_removed_elements_go_with_what_they_hold(each):
    for tag in M.REMOVED:
        cases = [f"<h3>up</h3><{t} width=3>inside</{t}><h3>down</h3>" for t in (tag, tag.upper(), f"svg:{tag}", f"a:b:{tag}", f" {tag}", f"{tag}\n")]
        cases[5] = f"<h3>up</h3><{tag}\nwidth=3>inside</{tag} ><h3>down</h3>"
        # Where the end tag is written in another way than </name, nothing after it stays.
        assert each(M.strip_scripts, cases) == ["<h3>up</h3><h3>down</h3>"] * 2 + ["<h3>up</h3>"] * 3 + ["<h3>up</h3><h3>down</h3>"]
        assert not any(tag in x for x in each(M.strip_scripts, [f"w<{tag} a='>'>never closed", f"w<!-- <p>{tag}", f"w</{tag}>all that follows"]))
    hidden = ["<svg:script>alert(1)</svg:script>z", "<div><SCRIPT SRC=x></SCRIPT></div>", "<p>a<script/>b</p>", "<scr<script>ipt>alert(1)</script>x", '<script>if (a<b) x="</p>"</script>y']
    out = each(M.strip_scripts, hidden)
    assert "alert" not in out[0] and out[1:3] == ["<div></div>", "<p>ab</p>"] and out[4] == "y"
    texts = ["if a < b then c", "x > y & z", "", "5 << 2", "<scripted>w</scripted>", "<p  class=a>t</p>", "<br/>"]
    assert each(M.strip_scripts, texts) == ["if a < b then c", "x > y & z", "", "5 << 2", "<scripted>w</scripted>", "<p class=a>t</p>", "<br/>"]


def test_entities_and_bodies(each):
    texts = ["&amp;lt; &#233;&#xE9; &copy; &hellip;", "&#55296;&#1114112;&#xFFFFFFFFFF;", "a&b;&;&#;&", "&nbsp;x" * 3, None, ""]
    assert each(M.decode_entities, texts) == [None if t is None else walker.decode(t) for t in texts]
    pages = ['<html><BODY style="a" CLASS="x" onload="go()" class=\'q"&amp;\' lang = "de">x</body><p>y</p></body>', "no body", "<body>open", '<body id=k class="d"/>t</BODY>', "<body"]
    assert each(M.body_tag, pages) == ['<body class="q&quot;&amp;" lang="de" style="a">', "<body>", "<body>", '<body class="d">', "<body>"]
    assert each(M.body_of, pages) == ["x", "no body", "open", "t", "<body"]


def test_pages_join_to_the_text(spark):
    rng = random.Random(2)
    bits = ["a", "bé", " ", "  ", ". ", "! x", '." ', "\n\n", "\n", "[[image: 0001.png]]", "… ", "　"]
    texts = ["".join(rng.choice([*bits, "long" * rng.randrange(9)]) for _ in range(rng.randrange(70))) for _ in range(120)]
    texts += ["x" * 200, "[[image: " * 30, "q" * 50 + "[[image: ", "", " \n\t", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for budget, image in ((20, 7), (13, 40)):
        got = {r.i: r.pages for r in paged(df, budget=budget, image=image).collect()}
        assert got == {i: walker.pages(t or "", budget, image) for i, t in enumerate(texts)}
    whole = ["\n\n".join("Short line here. " * 30 for _ in range(15)), "q" * (2 * S.PAGE_CHARS + 1), "\n\n".join(f"[[image: {i:05d}.gif]]" for i in range(8))]
    got = {r.i: r.pages for r in paged(spark.createDataFrame(list(enumerate(whole)), "i int, text string")).collect()}
    assert all("".join(got[i]) == t and max(map(len, got[i])) <= S.PAGE_CHARS for i, t in enumerate(whole))
    assert len(got[0]) > 2 and len(got[1]) == 3 and len(got[2]) >= 8 * IMAGE_CHARS // S.PAGE_CHARS


def test_blocks_pack_and_stay_whole(spark):
    long = "<pre>" + "k" * (S.PAGE_CHARS + 9) + "</pre>"
    small = [f"<li>{i}</li>" for i in range(3)]
    pages = ["".join([*small, long, small[0]]), '<html><body id="k" onclick="go()"><h1>w</h1></body></html>', "", "<body> </body>"]
    got = {}
    for r in S.page_blocks(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")).orderBy("page_id", "part").collect():
        got.setdefault(r.page_id, []).append((r.part, r.blocks, r.text))
    page = lambda *blocks: "<body>\n" + "\n\n".join(blocks) + "\n</body>"
    assert got == {0: [(0, 3, page(*small)), (1, 1, page(long)), (2, 1, page(small[0]))], 1: [(0, 1, '<body id="k">\n<h1>w</h1>\n</body>')]}
    rng = random.Random(4)
    rows = [(k, i, rng.choice([0, 1, 3, 8, 30])) for k in range(20) for i in range(rng.randrange(1, 60))]
    parts = {(r.k, r.i): r.part for r in S.packed(spark.createDataFrame(rows, "k int, i int, c long"), ["k"], "i", "c", 10).collect()}
    last, spent, part = None, 0, 0
    for k, i, c in rows:
        if k != last:
            last, spent, part = k, 0, 0
        elif spent + c > 10:
            spent, part = 0, part + 1
        spent += c
        assert parts[k, i] == part


def test_utterances_keep_block_numbers(spark):
    html = "<h1>Ready? Set! Go.</h1><figure><img src=a></figure><p>- - -</p><p>Pay 2.50 soon...</p>"
    found = S.utterance_rows(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("index").collect()
    assert [(r.block, r.sentence, r["index"], r.text) for r in found] == [(0, 0, 0, "Ready?"), (0, 1, 1, "Set!"), (0, 2, 2, "Go."), (3, 0, 3, "Pay 2.50 soon...")]


def test_tags_are_held_and_put_back(blocks):
    block = '<li>red <i class="k">green <b>deep</b></i> blue<hr/>&lt;end</li>'
    ((_, _, held, back),) = blocks([block])[0:1][0]
    assert held[2] == "red ⟦1⟧green deep⟦/1⟧ blue⟦2⟧⟦/2⟧<end" and held[3] == [['<i class="k">', "</i>"], ["<hr/>", ""]]
    assert back == '<li>red <i class="k">green deep</i> blue<hr/>&lt;end</li>'
    answers = ["⟦2⟧⟦/2⟧ A & ⟦1⟧B⟦/1⟧", "⟦1⟧ lost and ⟦9⟧ unknown", "⟦1⟧a⟦2⟧b⟦/1⟧c⟦/2⟧", "⟦1⟧a⟦/1⟧⟦1⟧a⟦/1⟧⟦2⟧⟦/2⟧", "⟦1⟧⟦2⟧⟦/2⟧⟦/1⟧", "⟦1 ⟧x⟦", "", "⟦x⟧ y ⟦/1⟧"]
    for answer in answers:
        assert blocks([block], lambda t, a=answer: F.lit(a))[0][0][3] == walker.rebuilt(block, answer), answer


def test_paragraphs_of_markup(spark, each):
    html = "<head>no</head><blockquote>p  q</blockquote><li>r</li>s<img src='abc'>t<article>u</article><style>no</style>v<body>w"
    assert each(M.xhtml_to_text, [html]) == ["p q\n\nr\n\nst" + "uv\n\nw"]
    df = spark.createDataFrame([(html, {"abc": "[[image: 0003.gif]]"})], "v string, m map<string,string>")
    assert df.select(M.xhtml_to_text(F.col("v"), F.col("m"))).first()[0] == "p q\n\nr\n\ns\n\n[[image: 0003.gif]]\n\ntuv\n\nw"


def test_paging_writes_a_text_once(spark, monkeypatch):
    from lorestack.operators import paging

    seen = []
    real = paging.materialise
    monkeypatch.setattr(paging, "materialise", lambda df: seen.extend(f.name for f in df.schema if f.dataType.simpleString() == "string") or real(df))
    rows = [(1, "One. " * 900 + "[[image: 0001.png]]"), (2, None), (3, " \n"), (4, "x" * 5000)]
    got = paging.paged(spark.createDataFrame(rows, "id long, text string")).collect()
    assert seen == ["text"] and got[0].__fields__ == ["id", "text", "pages"]
    assert {r.id: "".join(r.pages) for r in got} == {i: (t or "") if i not in (2, 3) else "" for i, t in rows}
