"""The flagship over whole tables against brute force: documents of every language and all attachments are cited."""

from functools import reduce
from operator import add

from lorestack.operators.embed import hashing_model
from lorestack.operators.prompt import prompt_messages
from lorestack.plans import registry

LANGS = ("en", "fr", "de", "es")
RULE = "\n\n---\n\n"


def test_assembled_prompts(spark, tmp_path):
    docs = [(i, f"{'alpha beta gamma delta epsilon zeta eta theta'.split()[i % 8]} common {'word%d ' % (i % 5)}{'x' * (i % 7 + 1)} end", LANGS[i % 4], "src", 0) for i in range(60)]
    talk = [(c, t, "user" if t == 0 else "assistant", f"{docs[c * 3][1]} asked in {c}" if t == 0 else f"answer {c}") for c in range(9) for t in range(2)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.question_id: r for r in registry.QUERIES["r14_assemble_prompts"](spark, str(tmp_path)).collect()}

    model = hashing_model()
    vector = lambda kind, text: model([f"{kind}: {text}"])[0]
    stored = [("global", i, text, vector("passage", text)) for i, text, *_ in docs]
    said = {(c, t): text for c, t, _, text in talk}
    for c in range(9):
        if c % 4:
            text = f"Usuário: {said[c, 0]}\nAssistente: {said[c, 1]}"
            stored.append((f"memory:{c}", c * 1000 + 1, text, vector("passage", text)))
    names = {i: f"src-{lang}{('.PDF', '.txt', '.png')[i % 3]}" for i, _, lang, *_ in docs}
    cited = set()
    for c in range(9):
        asked = vector("query", said[c, 0])
        pool = []
        for space, k, on in (("global", 4, c % 3), (f"memory:{c}", 8, c % 4)):
            near = sorted((reduce(add, [x * x for x in (v - asked).tolist()]), i, text) for s, i, text, v in stored if s == space)
            pool += [(d, space, i, text) for d, i, text in near[:k]] if on else []
        pool.sort(key=lambda x: x[:3])
        kept = [h for h in pool if h[0] <= max(pool[0][0] * 3, 0.1)]
        files = [h for h in kept if h[1] == "global"][: 3 if any(h[1] != "global" for h in kept) else 4]
        blocks = [f"[fonte: file-{i}.md]\n{text}" for i, text, *_ in docs if i % 50 == c and i % 5 != 2]
        blocks += [f"[fonte: {names[i]}]\n{text}" for _, _, i, text in files]
        cited |= {LANGS[i % 4] for _, _, i, _ in files}
        r = got.pop(c)
        assert (r.source_bytes or 0, r.n_history, r.memory_bytes, r.answer_tokens) == (len(RULE.join(blocks).encode()), 2, None, 1024), c
    assert not got and len(cited) == 4


def test_messages_of_prompts(spark):
    kind = "question_id long, sources string, history array<struct<role:string,content:string>>, memory string, memory_nearer boolean, question string"
    rows = [
        (1, "S", [("user", "a"), ("user", "b"), ("assistant", "c")], "M", False, "q"),
        (2, "S", [("user", "open")], "M", True, "q"),
        (3, None, None, None, False, "q"),
        (4, "", [("assistant", "x")], "M", False, "q"),
    ]
    got = {}
    for r in prompt_messages(spark.createDataFrame(rows, kind), "sys", "from:", "past:").orderBy("question_id", "position").collect():
        got.setdefault(r.question_id, []).append((r.position, r.role, r.content))
    assert got == {
        1: [(1, "system", "sys"), (2, "user", "a\n\nb"), (3, "assistant", "c"), (4, "user", f"past:\n\nM{RULE}from:\n\nS{RULE}q")],
        2: [(1, "system", "sys"), (2, "user", f"open\n\nfrom:\n\nS{RULE}past:\n\nM{RULE}q")],
        3: [(1, "system", "sys"), (2, "user", "q")],
        4: [(1, "system", "sys"), (2, "assistant", "x"), (3, "user", f"past:\n\nM{RULE}q")],
    }


def test_questions_that_fill_their_budget_stay(spark, tmp_path):
    docs = [(i, f"word{i} common end", "en", "src", 0) for i in range(4)]
    talk = [(1, 0, "user", "long " * 4000), (1, 1, "assistant", "answer"), (2, 0, "user", "short word1"), (2, 1, "assistant", "answer")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.question_id: r for r in registry.QUERIES["r14_assemble_prompts"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2} and not got[1].source_bytes and not got[1].memory_bytes and got[2].source_bytes


def test_a_question_that_cannot_be_searched_keeps_the_rest(spark):
    from lorestack.operators.prompt import assemble_prompts

    questions = spark.createDataFrame([(1, 1, "what?", [1.0, 0.0], True, False, 2048), (2, 2, "what?", None, True, False, 2048), (3, 3, "what?", [1.0], True, False, 2048)], "question_id long, chat_id long, question string, vector array<float>, use_global boolean, use_memory boolean, context int")
    chunks = spark.createDataFrame([("global", 7, 0, "a found text", [1.0, 0.1])], "namespace string, doc_id long, chunk_index int, text string, vector array<float>")
    messages = spark.createDataFrame([(c, c * 10, 0, "user", "said before") for c in (1, 2, 3)], "chat_id long, id long, pos long, role string, content string")
    documents = spark.createDataFrame([(7, "book.txt")], "doc_id long, filename string")
    attachments = spark.createDataFrame([(c, c + 50, "note.md", "injected_whole", "a note") for c in (1, 2, 3)], "chat_id long, doc_id long, filename string, status string, extracted_text string")
    turns = spark.createDataFrame([], "answer_id long, question string, answer string")
    got = {r.question_id: r for r in assemble_prompts(questions, chunks, messages, documents, attachments, turns).collect()}
    assert [got[i].retrieval_error for i in (1, 2, 3)] == [None, "no_vector", "no_score"]
    assert "a found text" in got[1].sources and all("a note" in got[i].sources and len(got[i].history) == 1 for i in got)
    assert not any("a found text" in got[i].sources for i in (2, 3))
