"""Chunk, page and relational tables as transformations: upserts, deletes, cascades, upgrades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorestack.operators.running import running_sums

RUNNING = ["queued", "parsing", "chunking", "embedding"]


def upsert_chunks(existing: DataFrame, incoming: DataFrame, keys: list[str] = ["namespace", "doc_id"]) -> DataFrame:
    """Replace by document: what ``incoming`` has of a key takes the place of all that ``existing`` has. No rows, no change."""
    return existing.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def delete_rows(existing: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` without the keys listed."""
    return existing.join(gone.select(*keys).distinct(), keys, "left_anti")


def live_only(results: DataFrame, live: DataFrame, keys: list[str] = ["doc_id"]) -> DataFrame:
    """Results of documents that still exist."""
    return results.join(live.select(*keys).distinct(), keys, "left_semi")


def fail_interrupted(attachments: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attachments whose borrowed document never finished become errors; the borrowed documents go."""
    borrowed = documents.filter(F.col("namespace") != "global")
    flagged = attachments.join(borrowed.select("doc_id").distinct().withColumn("_borrowed", F.lit(True)), "doc_id", "left")
    ended = F.col("status").isin("ready", "error", "injected_whole")
    fixed = flagged.withColumn("status", F.when(F.col("_borrowed") & ~ended, "error").otherwise(F.col("status"))).drop("_borrowed")
    return fixed, documents.filter(F.col("namespace") == "global")


def cascade_delete_chats(gone: DataFrame, messages: DataFrame, attachments: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages, attachments and chunks without those of the chats listed (chat_id), both of a chat's namespaces included."""
    chat = F.col("chat_id").cast("string")
    spaces = gone.select(F.explode(F.array(F.concat(F.lit("chat:"), chat), F.concat(F.lit("memory:"), chat))).alias("namespace"))
    return delete_rows(messages, gone, ["chat_id"]), delete_rows(attachments, gone, ["chat_id"]), delete_rows(chunks, spaces, ["namespace"])


def cascade_delete_books(gone: DataFrame, readings: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readings and pages without those of the books listed (book_id)."""
    return delete_rows(readings, gone, ["book_id"]), delete_rows(pages, gone, ["book_id"])


def cascade_delete_documents(gone: DataFrame, documents: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents without those listed (doc_id), and chunks without theirs, in whichever namespace."""
    return delete_rows(documents, gone, ["doc_id"]), delete_rows(chunks, gone, ["doc_id"])


def latest_status(events: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The last event of each key, by one pre-aggregated maximum."""
    last = events.groupBy(key).agg(F.max(F.struct(*order, *values)).alias("_last"))
    return last.select(key, *(F.col(f"_last.{v}").alias(v) for v in values))


def unique_names(files: DataFrame, taken: DataFrame, order: list[str], name: str = "filename") -> DataFrame:
    """Adds stored_name: the name itself for the first, ``stem (n)ext`` from 2 for later ones, never a name in use.

    Names that are taken come first, and those that stand in the list literally stay free for their own rows: a number whose
    name is in use is passed over. Later rows are numbered m = 1, 2, ...; the m-th free number is m + 1 and one more for
    each number in use that has fewer than m free ones before it, which is a running count. No name is one task, however
    many rows have it.
    """
    pattern = r"(?s)^(.*) \((\d{1,9})\)(\.[^./]+)?$"
    stem, ext = F.regexp_replace(F.col(name), r"(\.[^./]+)$", ""), F.regexp_extract(F.col(name), r"(\.[^./]+)$", 1)
    used = taken.select(name).distinct()
    literal = files.select(name).unionByName(used).distinct()
    parted = literal.filter(F.col(name).rlike(pattern)).select(F.concat(F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 3)).alias("_of"), F.regexp_extract(name, pattern, 2).alias("_d"))
    written = parted.filter((F.col("_d").cast("long").cast("string") == F.col("_d")) & (F.col("_d").cast("long") >= 2)).select(F.col("_of").alias(name), F.col("_d").cast("long").alias("_busy"))
    numbered = running_sums(files, [name], [F.col(c) for c in order], {"_n": F.lit(1)})
    known = numbered.join(used.withColumn("_used", F.lit(1)), name, "left").withColumn("_m", F.col("_n") - 1 + F.coalesce("_used", F.lit(0)))
    # A busy number stands where its count of free numbers before it is passed.
    busy = running_sums(written, [name], [F.col("_busy")], {"_i": F.lit(1)}).select(name, (F.col("_busy") - F.col("_i") - 1).alias("_at"), F.lit(1).alias("_skip"))
    rows = known.withColumn("_at", F.col("_m")).withColumn("_skip", F.lit(0))
    placed = running_sums(rows.unionByName(busy, allowMissingColumns=True).withColumn("_row", F.lit(1) - F.col("_skip")), [name], [F.col("_at"), F.col("_skip")], {"_passed": "_skip"}).filter("_row = 1")
    number = (F.col("_m") + 1 + F.col("_passed")).cast("string")
    stored = F.when(F.col("_m") == 0, F.col(name)).otherwise(F.concat(stem, F.lit(" ("), number, F.lit(")"), ext))
    return placed.select(*files.columns, stored.alias("stored_name"))


def keep_one_active(rows: DataFrame, group: list[str], order: list[str], flag: str = "active") -> DataFrame:
    """Of several active rows of a group the oldest stays active."""
    first = F.row_number().over(Window.partitionBy(*group, F.col(flag)).orderBy(*order)) == 1
    return rows.withColumn(flag, F.col(flag) & first)


def reset_interrupted(books: DataFrame) -> DataFrame:
    """Books caught in the middle of a step are imported again."""
    return books.withColumn("status", F.when(F.col("status").isin("extracting", "paginating"), "imported").otherwise(F.col("status")))


#: Columns that later versions added, with their defaults: table -> [(version, column, type, default)].
VERSIONS = {
    "chats": [(4, "use_global_rag", "boolean", True), (8, "use_memory", "boolean", True)],
    "documents": [(7, "namespace", "string", "global")],
    "books": [(10, "status", "string", "imported"), (10, "error_message", "string", None), (10, "page_count", "int", 0), (10, "reading_language", "string", None)],
}


def upgrade(df: DataFrame, name: str) -> DataFrame:
    """Add the columns that the table lacks, with their defaults; run again, it changes nothing."""
    for _, column, kind, default in sorted(VERSIONS.get(name, []), key=lambda v: v[0]):
        if column not in df.columns:
            df = df.withColumn(column, F.lit(default).cast(kind))
    return df


#: The ledger of versions: a row for each step that a table has been through.
LEDGER = "table_name string, version int, column_name string"


def migrate(tables: dict[str, DataFrame], ledger: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables brought to the last version, and the ledger with a row for each step that was made.

    Steps go in the order of versions, each of them adds a column with its default and is made once: what the ledger has is
    passed over, even if the column was dropped since. A column that is there before its step stays as it is.
    """
    made = {(r.table_name, r.version, r.column_name) for r in ledger.filter(F.col("table_name").isin(*VERSIONS)).collect()}  # a row for each step at most
    out, rows = dict(tables), []
    steps = [(version, name, column, kind, default) for name, of in VERSIONS.items() for version, column, kind, default in of]
    for version, name, column, kind, default in sorted(steps, key=lambda s: s[:3]):
        if name not in tables or (name, version, column) in made:
            continue
        if column not in out[name].columns:
            out[name] = out[name].withColumn(column, F.lit(default).cast(kind))
        rows.append((name, version, column))
    return out, ledger.unionByName(ledger.sparkSession.createDataFrame(rows, LEDGER))


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table, or no rows where nothing was written yet."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def write_replacing(df: DataFrame, path: str, keys: list[str]) -> None:
    """Write partitions by ``keys``, replacing those that ``df`` holds and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def resumable(documents: DataFrame) -> DataFrame:
    """Documents of the knowledge base whose work was cut short."""
    return documents.filter(F.col("status").isin(*RUNNING) & (F.col("namespace") == "global"))


def import_gate(files: DataFrame, kinds: list[str] = ["pdf", "docx", "txt", "md"], most_bytes: int = 100 * 1024 * 1024) -> DataFrame:
    """Adds status (queued or rejected) and reason of every file: unsupported, unreadable, too_large. Format is judged first."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    reason = F.when(~kind.isin(*kinds), "unsupported").when(F.col("length").isNull(), "unreadable").when(F.col("length") > most_bytes, "too_large")
    return files.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "queued").otherwise("rejected"))


def newest_first(df: DataFrame, time: str, key: str, columns: list[str], ascending: bool = False) -> DataFrame:
    """A listing ordered by time, ties by identifier."""
    t, k = F.col(time), F.col(key)
    return df.orderBy(t.asc() if ascending else t.desc(), k.asc() if ascending else k.desc()).select(*columns)


def first_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of an order."""
    return df.orderBy(*order).limit(n)
