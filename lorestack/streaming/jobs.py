"""Streams: arriving files into chunks, messages into turns, token lines into texts, events into the latest status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from lorestack.functions.text import chunks
from lorestack.operators.embed import embed, hashing_model
from lorestack.operators.store import read_or_empty
from lorestack.operators.tables import merge_partitions, read_table, upsert_table
from lorestack.session import materialise
from lorestack.sources.files import LINES, extract_text, kind_of, line_chunks


def ingest(files: DataFrame, factory: Callable = hashing_model, namespace: str = "global") -> DataFrame:
    """Chunk rows with vectors of (doc_id, text) rows; works on a stream and on a table."""
    each = files.filter("text is not null").select(F.lit(namespace).alias("namespace"), "doc_id", F.posexplode(chunks(F.col("text"))).alias("chunk_index", "text"))
    return _embedded(each, factory)


def _embedded(each: DataFrame, factory: Callable) -> DataFrame:
    return each.select("namespace", "doc_id", "chunk_index", "text", embed(F.col("text"), factory).alias("vector"))


def start_ingest(files: DataFrame, path: str, checkpoint: str, factory: Callable = hashing_model, live: DataFrame | None = None, buckets: int = 16) -> StreamingQuery:
    """Upsert each batch's chunks into the chunk table at ``path``: later batches win.

    The table is parted by buckets of the document. A batch rewrites the buckets of its own documents and no others, so the
    table is compact after every batch and reading it groups nothing; a batch that is run again finds its own rows and puts
    them in their own place. Documents that are gone are dropped right before the write.
    """

    def write(batch: DataFrame, number: int) -> None:
        made = ingest(batch, factory)
        if live is not None:
            made = made.join(live.select("doc_id").distinct(), "doc_id", "left_semi")
        upsert_table(batch.sparkSession, made, path, buckets)

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_file_ingest(spark: SparkSession, folder: str, path: str, status_path: str, checkpoint: str, key: Column | None = None, readers: dict[str, Callable[[bytes], str]] | None = None, factory: Callable = hashing_model) -> StreamingQuery:
    """Files that arrive under ``folder`` into the chunk table at ``path``, and a status row for each at ``status_path``.

    A file that can't be read, or holds no text, is an ``error`` row with its reason; the others go on. ``key`` gives a
    file's doc_id from its path (else a hash of it). Batches may be run again: each overwrites its own folders. Text files
    without a reader of the caller's are read in parts, so no task holds a whole one; files of other kinds are read whole.
    """
    kind = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(kind).option("recursiveFileLookup", "true").load(folder).select("*", F.col("_metadata.file_path").alias("address"))
    ident = (F.xxhash64("path") if key is None else key).cast("long").alias("doc_id")

    by_line = kind_of(F.col("path")).isin([k for k in LINES if k not in (readers or {})])

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        parsed = materialise(extract_text(batch.filter(~by_line), readers).select(ident, "path", "text", "error"))  # read and parsed once
        made, parsed = ingest(parsed, factory), parsed.select("doc_id", "path", "error")
        if paths := [r.path for r in batch.filter(by_line).select("path").collect()]:  # names alone
            chunked, known = line_chunks(spark, paths)
            files = materialise(batch.filter(by_line).select("path", "address"))
            chunked = chunked.join(F.broadcast(files), "address").select(F.lit("global").alias("namespace"), ident, "chunk_index", "text")
            made = made.unionByName(_embedded(chunked, factory))
            files = files.join(known.withColumn("_read", F.lit(True)), "address", "left")  # an empty file has no line
            parsed = parsed.unionByName(files.select(ident, "path", F.when(F.col("_read").isNull(), "no_text").otherwise(F.col("error")).alias("error")))
        upsert_table(spark, made, path)
        status = parsed.select("doc_id", "path", F.when(F.col("error").isNull(), "ready").otherwise("error").alias("status"), F.col("error").alias("error_message"))
        status.write.mode("overwrite").parquet(f"{status_path}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table as its last manifest has it."""
    return read_table(spark, path).drop("bucket")


def parse_tokens(lines: DataFrame, every: bool = False) -> DataFrame:
    """(message_id, seq, delta, done, cancelled, error) of server-sent lines; ``event: cancel`` ends a message early. Blank
    and other lines are left out, or kept without a delta with ``every``."""
    data = F.trim(F.regexp_extract("line", r"^data:\s*(.*)$", 1))
    line = F.col("line")
    cancelled = F.coalesce(line.rlike(r"^event:\s*cancel\s*$"), F.lit(False))
    rows = (lines if every else lines.filter(line.startswith("data:") | cancelled)).withColumn("data", F.when(line.startswith("data:"), data))
    done = F.coalesce(F.col("data") == "[DONE]", F.lit(False))
    bad = ~done & F.col("data").isNotNull() & F.isnull(F.try_parse_json("data"))
    delta = F.get_json_object("data", "$.choices[0].delta.content")
    return rows.select("message_id", F.col("seq").cast("long").alias("seq"), F.when(~done & ~bad, delta).alias("delta"), done.alias("done"), cancelled.alias("cancelled"), F.when(bad, "malformed").alias("error"))


def collect_tokens(tokens: DataFrame) -> DataFrame:
    """(message_id, text, done, errors): the deltas before the end mark, in order."""
    ended = F.min(F.when(F.col("done"), F.col("seq")))
    parts = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("delta", F.lit("")).alias("delta"))))
    each = tokens.groupBy("message_id").agg(parts.alias("parts"), ended.alias("ended"), F.count("error").alias("errors"))
    kept = F.filter("parts", lambda p: F.col("ended").isNull() | (p["seq"] < F.col("ended")))
    return each.select("message_id", F.array_join(F.transform(kept, lambda p: p["delta"]), "").alias("text"), F.col("ended").isNotNull().alias("done"), "errors")


def stream_status(events: DataFrame, key: str, order: list[str], values: list[str], time: str | None = None, delay: str = "7 days", ordered: bool = False) -> DataFrame:
    """The latest values of each key, with the columns of the order if ``ordered``. In update output a batch gives the keys
    that it changed. With ``time``, a column of event time, what a key has in a span of ``delay`` leaves the state when the
    span is over; the last values stay where :func:`merge_latest` wrote them."""
    columns = [key, *dict.fromkeys([*(order if ordered or time else []), *values])]
    if time is None:
        return _latest(events, [key], order, values).select(*columns)
    spans = events.withWatermark(time, delay).withColumn("_span", F.window(time, delay))
    return _latest(spans, [key, "_span"], order, values).select(*columns)


def _latest(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    last = rows.groupBy(*keys).agg(F.max(F.struct(*dict.fromkeys([*order, *values]))).alias("_last"))
    return last.select(*keys, *(F.col(f"_last.{c}").alias(c) for c in dict.fromkeys([*order, *values])))


def merge_latest(updates: DataFrame, path: str, checkpoint: str, key: str, order: list[str], buckets: int = 16) -> StreamingQuery:
    """Merge update output into a table of the latest row of each key, and run until what is there is in.

    The table is parted by buckets of the key; a batch reads and rewrites the buckets that its keys fall into and no others.
    A batch that is run again meets its own rows and changes nothing, since the later row of a key wins.
    """
    spark = updates.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        new = materialise(batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
        merge_partitions(spark, new, path, ["bucket"], lambda old, new: _latest(old.unionByName(new), [key, "bucket"], order, [c for c in new.columns if c not in (key, "bucket")]).select(*new.columns))

    return updates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_available(stream: DataFrame, path: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there into Parquet at ``path`` and give its result as a table.

    One folder per batch, so that a batch that is run again overwrites its own. Of complete output the last batch is the
    result, of append output all are. Nothing is gathered on the driver.
    """
    spark, schema = stream.sparkSession, stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = read_or_empty(spark, path, StructType([*schema.fields, StructField("batch", LongType())]))
    if mode == "complete":
        rows = rows.filter(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    return rows.select(*schema.names)
