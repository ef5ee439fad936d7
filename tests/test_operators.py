"""Literal cases of the operators: ties, gaps, blanks, multibyte text, missing scores."""

from pyspark.sql import functions as F

from lorestack import session
from lorestack.functions import text as X
from lorestack.operators import library as L
from lorestack.operators import retrieve as R
from lorestack.operators import store as S
from lorestack.operators import translate
from lorestack.operators import turns as U
from lorestack.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_chunk_windows(spark):
    words = " ".join(f"w{i}" for i in range(200))
    got = one(spark, X.chunks(F.lit(words), 100, 20))
    assert [len(c.split()) for c in got] == [75, 75, 75, 20] or [len(c.split()) for c in got][:2] == [75, 75]
    assert got[1].split()[0] == "w60" and got[-1].split()[-1] == "w199"
    assert one(spark, X.chunks(F.lit("   \n\t "))) == [] and one(spark, X.chunks(F.lit(""))) == []
    assert X.window_words(512, 0) == (384, 383) and X.window_words(10, 99) == (7, 1)


def test_hyphens(spark):
    for text, want in (("arrecadação e liqui- dação", "arrecadação e liquidação"), ("empre-\nsário", "empresário"), ("far-se-á", "far-se-á"), ("empresário - pessoa", "empresário - pessoa"), ("aqui- Outra", "aqui- Outra")):
        assert one(spark, X.repair_hyphens(F.lit(text))) == want


def test_sentences(spark):
    got = one(spark, X.sentences(F.lit('Era "assim." Depois foi. ...Depois veio 3.14 e fim! art. 5')))
    assert got == ['Era "assim."', "Depois foi. ...Depois veio 3.14 e fim!", "art.", "5"]


def test_truncate(spark):
    assert [one(spark, X.truncate_utf8(F.lit("aç🎉b"), n)) for n in range(8)] == ["", "a", "a", "aç", "aç", "aç", "aç", "aç🎉"]


def test_budgets(spark):
    assert [one(spark, X.answer_budget(F.lit(c).cast("int"))) for c in (None, 100, 1000, 9000)] == [2048, 256, 500, 2048]
    assert one(spark, X.prompt_budget(F.lit(None).cast("int"))) == 8192 and one(spark, X.prompt_budget(F.lit(100))) == 0


def messages(spark, roles):
    return spark.createDataFrame([(1, i, i, r, f"m{i}") for i, r in enumerate(roles)], "chat_id long, id long, pos int, role string, content string")


def test_turns(spark):
    pairs = lambda roles: [(r.question, r.answer) for r in U.pair_turns(messages(spark, roles)).orderBy("pos").collect()]
    assert pairs(["user", "assistant", "user", "assistant"]) == [("m0", "m1"), ("m2", "m3")]
    assert pairs(["user", "user", "system", "assistant"]) == [("m1", "m3")]
    assert pairs(["assistant", "system"]) == [] and pairs(["user"]) == []


def test_pool(spark):
    def pool(distances, **options):
        rows = [(1, "global" if i % 2 else "chat:1", i, 0, float(d)) for i, d in enumerate(distances)]
        df = spark.createDataFrame(rows, "question_id int, namespace string, doc_id long, chunk_index int, distance double")
        return [r.distance for r in R.rank_pool(df, 4, **options).orderBy("pool_rank").collect()]

    assert pool([0.09, 0.20, 0.35]) == [0.09, 0.20]
    assert pool([0.0, 0.08]) == [0.0, 0.08]
    got = pool([float("nan"), 0.09])
    assert got[0] == 0.09 and got[1] != got[1]
    assert len(pool([0.09] * 10)) == 4


def test_recall_filters_before_the_cap(spark):
    recalled = spark.createDataFrame([(1, 10, 0.1), (1, 11, 0.2)], "question_id int, answer_id int, distance double")
    history = spark.createDataFrame([(1, 10)], "question_id int, answer_id int")
    assert [r.answer_id for r in R.recall_not_in_prompt(recalled, history).collect()] == [11]


def test_upsert(spark):
    old = spark.createDataFrame([("global", 1, "a"), ("global", 1, "b"), ("chat:1", 1, "c")], "namespace string, doc_id int, text string")
    new = spark.createDataFrame([("global", 1, "n")], old.schema)
    assert sorted(r.text for r in S.upsert_chunks(old, new).collect()) == ["c", "n"]
    assert sorted(r.text for r in S.upsert_chunks(S.upsert_chunks(old, new), new).collect()) == ["c", "n"]
    assert S.upsert_chunks(old, new.limit(0)).count() == 3


def test_unique_names_step_over_literals(spark):
    files = spark.createDataFrame([(1, "a.txt"), (2, "a.txt"), (3, "a (2).txt"), (4, "a.txt"), (5, "b")], "doc_id int, filename string")
    got = [r.stored_name for r in S.unique_names(files, files.limit(0), ["doc_id"]).orderBy("doc_id").collect()]
    assert got[0] == "a.txt" and got[2] == "a (2).txt" and len(set(got)) == 5


def test_missing_pages(spark):
    pages = spark.createDataFrame([(1, "en", p) for p in (1, 3, 5)], "book_id int, language string, page int")
    wanted = spark.createDataFrame([(1, "en", 5), (1, "es", 2), (2, "en", 0)], "book_id int, language string, page_count int")
    got = {(r.book_id, r.language): r.next_missing for r in L.next_missing_page(pages, wanted).collect()}
    assert got == {(1, "en"): 2, (1, "es"): 1, (2, "en"): None}


def test_span_lookup(spark):
    spans = spark.createDataFrame([(1, 0, 0, 0, 5), (1, 0, 1, 5, 9), (1, 3, 2, 0, 4)], "page_id long, block int, index int, `from` int, `to` int")
    clicks = spark.createDataFrame([(1, 1, 0, 5), (2, 1, 0, 7), (3, 1, 1, 0), (4, 1, 0, 99), (5, 1, 4, 0)], "click_id long, page_id long, block int, offset int")
    assert {r.click_id: r["index"] for r in L.span_lookup(clicks, spans).collect()} == {1: 0, 2: 1, 3: 2, 4: 0, 5: None}


def test_upgrade_is_idempotent(spark):
    chats = spark.createDataFrame([(1, "t")], "chat_id int, title string")
    once = S.upgrade(chats, "chats")
    assert once.columns == S.upgrade(once, "chats").columns == ["chat_id", "title", "use_global_rag", "use_memory"]
    assert once.first().use_memory


def test_each_step_of_an_upgrade_is_made_once(spark):
    books = spark.createDataFrame([(1, "ready")], "book_id int, status string")
    chats = spark.createDataFrame([(5,)], "chat_id int")
    for start in ([], [("books", 10, "status")], [("chats", 4, "use_global_rag"), ("books", 10, "page_count")]):
        tables, ledger = S.migrate({"books": books, "chats": chats}, spark.createDataFrame(start, S.LEDGER))
        again, same = S.migrate(tables, ledger)
        steps = sorted(tuple(r) for r in ledger.collect())
        assert steps == sorted({(n, v, c) for n in ("books", "chats") for v, c, _, _ in S.VERSIONS[n]}) == sorted(tuple(r) for r in same.collect())
        assert again["books"].columns == tables["books"].columns and tables["books"].first().status == "ready"
        made = {c for _, _, c in start}
        assert ("page_count" in tables["books"].columns) == ("page_count" not in made)
        assert again["chats"].first().use_memory is True


def test_names_that_many_rows_share(spark):
    files = [(i, "a.txt") for i in range(40)] + [(100 + k, f"a ({k}).txt") for k in (2, 3, 7, 7, 50, 1)] + [(200, "b"), (201, "b"), (202, "b (2)"), (203, "a (02).txt")]
    got = {r.doc_id: r.stored_name for r in S.unique_names(spark.createDataFrame(list(dict(files).items()), "doc_id long, filename string").repartition(5), spark.createDataFrame([("b",)], "filename string"), ["doc_id"]).collect()}
    used, literal, want = {"b"}, {n for _, n in dict(files).items()} | {"b"}, {}
    for i, name in sorted(dict(files).items()):
        made, n = name, 2
        stem, dot, ext = name.rpartition(".") if "." in name else (name, "", "")
        while made in used or (made != name and made in literal):
            made, n = f"{stem} ({n}){dot}{ext}", n + 1
        used.add(made)
        want[i] = made
    assert got == want


def test_workers_take_large_batches_in_parts(spark):
    df = spark.range(0, 60, 1, 1).select("id", F.when(F.col("id") != 7, F.expr("repeat('x', 500000)")).alias("text"))

    def run(batches):
        for batch in batches:
            yield batch.assign(rows=len(batch), n=batch["text"].str.len().astype("Int64"))[["id", "n", "rows"]]

    got = session.map_in_parts(df, run, "id long, n long, rows int", "text").collect()
    assert sorted((r.id, r.n) for r in got) == [(i, None if i == 7 else 500_000) for i in range(60)]
    assert max(r.rows for r in got) <= 9  # 4 MB, not the 30 MB of a batch


def test_translation_and_archives_take_their_rows_in_parts(spark, monkeypatch):
    seen = []
    real = session.map_in_parts
    for module in (files, translate):
        monkeypatch.setattr(module, "map_in_parts", lambda df, run, schema, column: seen.append(column) or real(df, run, schema, column))
    some = spark.createDataFrame([("a.epub", b"broken")], "path string, content binary")
    assert [r.error for r in files.epub_chapters(some).collect()] == ["unreadable"] and [r.status for r in files.book_gate(some).collect()] == ["rejected"]
    pages = spark.createDataFrame([(1, "original", 1, "txt", "one\n\ntwo")], "book_id int, language string, page int, format string, text string")
    wanted = pages.selectExpr("book_id", "'xx' AS language", "page")
    done, _ = translate.translate_pages(pages, wanted, lambda texts: [t.upper() for t in texts])
    assert [r.text for r in done.collect()] == ["ONE\n\nTWO"] and seen == ["content", "content", "text"]
