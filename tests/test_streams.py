"""Streams end in Parquet, one folder per batch; nothing of them is held on the driver."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from lorestack.functions.text import repair_hyphens
from lorestack.operators import tables as B
from lorestack.plans import job_queries as Q
from lorestack.streaming import jobs as J
from lorestack.streaming import stateful as T


def test_results_are_parquet_by_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(40).select("id", (F.col("id") % 4).alias("key")).repartition(4).write.parquet(source)
    stream = lambda: spark.readStream.schema("id long, key long").option("maxFilesPerTrigger", 1).parquet(source)
    tables = {t.name for t in spark.catalog.listTables()}
    out, at = str(tmp_path / "rows"), str(tmp_path / "rows_checkpoint")
    for _ in range(2):  # the second run finds nothing new and gives the same
        assert sorted(r.id for r in J.run_available(stream(), out, "append", at).collect()) == list(range(40))
    assert len([x for x in os.listdir(out) if x.startswith("batch=")]) == 4
    got = J.run_available(J.stream_status(stream().withColumn("value", F.col("id")), "key", ["id"], ["value"]), str(tmp_path / "last"), "complete", str(tmp_path / "last_checkpoint"))
    assert sorted((r.key, r.value) for r in got.collect()) == [(k, 36 + k) for k in range(4)]
    assert {t.name for t in spark.catalog.listTables()} == tables


def _batches(spark, path, batches, schema):
    """A stream of which each list of rows is a batch of its own, in that order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        for f in os.listdir(path):
            if f.endswith(".parquet") and not f.startswith("b"):
                os.rename(f"{path}/{f}", f"{path}/b{k:03d}-{f}")
                os.utime(f"{path}/b{k:03d}-{f}", (1_700_000_000 + k * 60,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


MESSAGES = "chat_id long, id long, pos long, role string, content string"


def test_turns_of_messages_out_of_order(spark, tmp_path):
    rng = random.Random(4)
    rows = [(c, c * 100 + p, p, rng.choice(["user", "assistant", "system"]), f"t{c}.{p}") for c in range(6) for p in range(12)]
    want = set()
    for c in range(6):
        held = None
        for _, i, _, role, text in (r for r in rows if r[0] == c):
            if role == "user":
                held = text
            elif role == "assistant":
                want |= {(c, i, held, text)} if held is not None else set()
                held = None
    rng.shuffle(rows)
    stream = _batches(spark, str(tmp_path / "in"), [rows[:20], rows[15:50], rows[50:]], MESSAGES)  # five come twice
    got = J.run_available(T.stream_turns(stream), str(tmp_path / "out"), "update", str(tmp_path / "c"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def _until(condition, seconds=60):
    end = time.time() + seconds
    while not condition() and time.time() < end:
        time.sleep(0.5)
    assert condition()


def test_questions_expire_and_gaps_are_passed(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    add = lambda *rows: spark.createDataFrame(list(rows), MESSAGES).coalesce(1).write.mode("append").parquet(source)
    add((1, 10, 0, "user", "old"), (2, 20, 0, "user", "q"), (2, 22, 2, "assistant", "a"))
    stream = spark.readStream.schema(MESSAGES).parquet(source)

    def write(batch, number):
        batch.write.mode("append").parquet(out)

    query = T.stream_turns(stream, gap_ms=1_000, ttl_ms=20_000).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        rows = lambda: sorted(map(tuple, spark.read.parquet(out).collect())) if os.path.exists(f"{out}/_SUCCESS") else []
        _until(lambda: rows() == [(2, 22, "q", "a")])  # position 1 never comes
        time.sleep(21)
        add((1, 11, 1, "assistant", "late"), (3, 30, 0, "user", "new"), (3, 31, 1, "assistant", "soon"))
        _until(lambda: (3, 31, "new", "soon") in rows())
        assert not [r for r in rows() if r[0] == 1]
    finally:
        query.stop()


def test_texts_as_their_lines_come(spark, tmp_path):
    line = lambda text: 'data: {"choices":[{"delta":{"content":"%s"}}]}' % text
    first = [(1, 0, line("a")), (1, 2, line("c")), (2, 0, line("x")), (3, 1, "data: [DONE]")]
    second = [(1, 1, line("b")), (1, 2, line("c")), (2, 1, "event: cancel"), (2, 2, line("never")), (3, 0, "data: {broken")]
    third = [(1, 3, ": ping"), (1, 4, "data: [DONE]"), (1, 5, line("after")), (2, 3, line("never"))]
    stream = _batches(spark, str(tmp_path / "in"), [first, second, third], "message_id long, seq long, line string")
    J.run_available(T.stream_texts(J.parse_tokens(stream, every=True)), str(tmp_path / "out"), "update", str(tmp_path / "c"))
    got = sorted((r.batch, r.message_id, r.text, r.done, r.cancelled, r.errors) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, 1, "a", False, False, 0), (0, 2, "x", False, False, 0), (1, 1, "abc", False, False, 0), (1, 2, "x", True, True, 0), (1, 3, "", True, False, 1), (2, 1, "abc", True, False, 0)]


def test_a_batch_writes_the_keys_it_changed(spark, tmp_path):
    events = [[(k, 1, f"a{k}") for k in range(40)], [(3, 2, "b"), (7, 0, "older")], [(3, 2, "b")]]
    stream = _batches(spark, str(tmp_path / "in"), events, "key long, at long, value string")
    seen, path = [], str(tmp_path / "t")
    status = J.stream_status(stream, "key", ["at"], ["value"], ordered=True)

    def count(batch, number):
        seen.append(batch.count())

    status.writeStream.outputMode("update").foreachBatch(count).option("checkpointLocation", str(tmp_path / "c0")).trigger(availableNow=True).start().awaitTermination()
    assert seen[0] == 40 and seen[1] <= 2
    J.merge_latest(status, path, str(tmp_path / "c1"), "key", ["at"]).awaitTermination()
    before = B.manifest(spark, path)
    assert len({f.split("/")[0] for f in before["parts"].values()}) > 1  # the second batch left most buckets alone
    J.merge_latest(status, path, str(tmp_path / "c2"), "key", ["at"]).awaitTermination()  # all batches again
    rows = {r.key: (r["at"], r.value) for r in B.read_table(spark, path).collect()}
    assert rows == {k: (1, f"a{k}") for k in range(40)} | {3: (2, "b")}


def test_old_spans_leave_the_state(spark, tmp_path):
    events = [[(1, 0, "a")], [(2, 400, "b")], [(3, 800, "c")], [(1, 1, "too late")]]
    stream = _batches(spark, str(tmp_path / "in"), events, "key long, s long, value string").withColumn("ts", F.timestamp_seconds("s"))
    path = str(tmp_path / "t")
    query = J.merge_latest(J.stream_status(stream, "key", ["ts"], ["value"], time="ts", delay="60 seconds"), path, str(tmp_path / "c"), "key", ["ts"])
    query.awaitTermination()
    assert min(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress[2:]) == 1
    assert {r.key: r.value for r in B.read_table(spark, path).collect()} == {1: "a", 2: "b", 3: "c"}


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "chunks")
    made = lambda docs, text, n=3: spark.createDataFrame([("global", d, i, f"{text}{d}.{i}") for d in docs for i in range(n)], "namespace string, doc_id long, chunk_index int, text string")
    rows = lambda: {(r.doc_id, r.chunk_index): r.text for r in B.read_table(spark, path).collect()}
    assert B.delete_from_table(spark, made([1], ""), path) == 0
    assert B.upsert_table(spark, made(range(50), "a"), path) == 16
    before = B.manifest(spark, path)["parts"]
    assert B.upsert_table(spark, made([7], "b", 1), path) == 1 and B.upsert_table(spark, made([], "b"), path) == 0
    after = B.manifest(spark, path)["parts"]
    assert sum(before[p] != after[p] for p in before) == 1
    want = {(d, i): f"a{d}.{i}" for d in range(50) for i in range(3) if d != 7} | {(7, 0): "b7.0"}
    assert rows() == want
    assert B.upsert_table(spark, made([7], "b", 1), path) == 1 and rows() == want  # again
    old = B.read_table(spark, path)
    assert B.delete_from_table(spark, made([9, 9, 99], ""), path) in (1, 2)
    assert rows() == {k: v for k, v in want.items() if k[0] != 9} and old.count() == len(want)  # a reader keeps its version
    state = B.manifest(spark, path)
    B._commit(spark, path, {**state, "version": state["version"] + 1})
    with pytest.raises(RuntimeError):
        B._commit(spark, path, {**state, "version": state["version"] + 1})
    assert B.vacuum(spark, path) > 0 and rows() == {k: v for k, v in want.items() if k[0] != 9}


def test_a_key_reads_and_writes_its_state_once_a_batch():
    class Value:
        held, calls = None, 0

        def get(self):
            self.calls += 1
            return self.held

        def update(self, value):
            self.calls += 1
            self.held = value

    class Handle:  # has no other kind of state
        def getValueState(self, name, schema):
            return Value()

    texts = T.Texts(None)
    texts.init(Handle())
    run = lambda rows: [tuple(r) for r in texts._run((1,), rows, False, 0)]
    late = [(i, f"{i} ", 0) for i in range(1, 100)]
    assert run([*reversed(late), (100, None, 1), (101, "never", 0)]) == [] and texts.state.calls == 2
    assert "never" not in texts.state.held[1]  # what comes after the end mark isn't kept
    assert run([(0, "0 ", 0), (0, "again", 0)]) == [(1, "".join(f"{i} " for i in range(100)), True, False, 0, 101)]
    assert texts.state.calls == 4 and texts.state.held == (101, None, "", 0, 101, True, False)


def test_streams_of_larger_tables_have_more_files_and_no_more_batches(spark, tmp_path, monkeypatch):
    rows, path = spark.range(0, 1200, 1, 6).withColumn("half", F.col("id") % 2), str(tmp_path / "in")
    monkeypatch.setattr(Q, "_folder", lambda spark: path)
    stream = Q._stream(spark, rows)
    assert len(spark.read.parquet(path).inputFiles()) == 24  # four for each part of the table
    out = str(tmp_path / "out")
    got = J.run_available(stream, out, "append", str(tmp_path / "c"))
    assert sorted(r.id for r in got.collect()) == list(range(1200))
    assert len([x for x in os.listdir(out) if x.startswith("batch=")]) == 2


def test_text_files_are_read_in_parts(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    word = lambda: rng.choice(["a", "Bee", "see-", "d\u00e9", "-", "e-", "x- y", "\u2003"])
    folder = tmp_path / "in" / "some [1] {a,b}* %20"
    folder.mkdir(parents=True)
    texts = {1: "".join(word() + rng.choice(" \n \n\n\t") for _ in range(6000)), 2: "one-\ntwo-\nthree", 3: " ".join(["w"] * 384), 4: "\n".join(["w"] * 385), 5: "up-\nDown-", 6: " \n\u2003\n"}
    for k, text in texts.items():
        (folder / f"{k}.{'txt' if k % 2 else 'MD'}").write_bytes(text.encode())
    (folder / "8.txt").write_bytes(b"fine\nbad \xff\nfine")
    (folder / "9.pdf").write_bytes(b"?")
    real = J.extract_text
    monkeypatch.setattr(J, "extract_text", lambda files, readers=None: real(files.filter(~F.col("path").rlike("(?i)[.](txt|md)$")), readers))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")  # many splits of one file
    try:
        J.start_file_ingest(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "s"), str(tmp_path / "c"), key=F.regexp_extract("path", r"(\d+)\.\w+$", 1)).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = sorted((r.doc_id, r.chunk_index, r.text) for r in J.read_chunks(spark, str(tmp_path / "t")).collect())
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("text", repair_hyphens(F.col("text")))
    assert got == sorted((r.doc_id, r.chunk_index, r.text) for r in J.ingest(rows).collect()) and len([g for g in got if g[0] == 1]) > 9
    said = {r.doc_id: r.error_message for r in spark.read.parquet(str(tmp_path / "s")).collect()}
    assert said == {1: None, 2: None, 3: None, 4: None, 5: None, 6: "no_text", 8: "unreadable", 9: "unsupported"}


def test_a_large_partition_is_written_by_several_tasks(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = spark.range(0, 20_000, 1, 8).select(F.lit("global").alias("namespace"), F.lit(7).cast("long").alias("doc_id"), F.col("id").cast("int").alias("chunk_index"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        assert B.upsert_table(spark, rows, path) == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    got = B.read_table(spark, path)
    assert len(got.inputFiles()) > 3 and got.drop("bucket").exceptAll(rows).isEmpty() and got.count() == 20_000
