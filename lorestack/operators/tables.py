"""Tables in folders of Parquet that are changed partition by partition.

A table is a folder with data files and manifests. A manifest lists, for each partition, the folder that holds its rows; the
manifest with the largest number is the table. A change writes new folders for the partitions that it touches, and then one
new manifest, by a rename: readers see the table before or after, and what failed leaves files that no manifest lists.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorestack.session import materialise


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm.org.apache.hadoop.fs
    return jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), jvm.Path


def manifest(spark: SparkSession, path: str) -> dict:
    """{"version", "parts": {partition: folder}, "schema"} of the table at ``path``; version 0 where there is none."""
    fs, at = _fs(spark, path)
    folder = at(f"{path}/_manifests")
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    found = max((n for n in names if n.endswith(".json")), default=None)
    if found is None:
        return {"version": 0, "parts": {}, "schema": None}
    return json.loads(spark.read.text(f"{path}/_manifests/{found}", wholetext=True).first()[0])


def _commit(spark: SparkSession, path: str, state: dict) -> None:
    """Put a manifest in its place by a rename; of two writers one fails."""
    fs, at = _fs(spark, path)
    name = f"{path}/_manifests/{state['version']:012d}.json"
    draft = at(f"{path}/_manifests/.{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    if fs.exists(at(name)) or not fs.rename(draft, at(name)):
        raise RuntimeError(f"another writer has committed version {state['version']} of {path}")


def read_table(spark: SparkSession, path: str, parts: list[str] | None = None) -> DataFrame:
    """The rows of a table, or of some of its partitions."""
    state = manifest(spark, path)
    if state["schema"] is None:
        raise FileNotFoundError(f"no table at {path}")
    folders = sorted({f for p, f in state["parts"].items() if parts is None or p in parts})
    from pyspark.sql.types import StructType

    schema = StructType.fromJson(state["schema"])
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders]) if folders else spark.createDataFrame([], schema)


def merge_partitions(spark: SparkSession, new: DataFrame, path: str, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
    """Rewrite the partitions that ``new`` touches as ``merge(old rows, new rows)`` and commit; how many were rewritten.

    ``keys`` are columns of ``new`` with few values each, which name the partition; they are listed on the driver. A large
    partition is written by several tasks, so what a task reads doesn't grow with the table.
    """
    state = manifest(spark, path)
    name = F.concat_ws("/", *(F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in keys))
    touched = [r[0] for r in new.select(name.alias("p")).distinct().collect()]
    if not touched:
        return 0
    there = [p for p in touched if p in state["parts"]]
    old = read_table(spark, path, there) if there else new.limit(0)
    write = f"data-{state['version'] + 1:012d}-{uuid.uuid4().hex[:8]}"
    rows = merge(old.select(*new.columns), new).select(*new.columns)
    copies = [F.col(k).alias(f"_{k}") for k in keys]
    rows.select("*", *copies).hint("rebalance", *(F.col(f"_{k}") for k in keys)).write.partitionBy(*(f"_{k}" for k in keys)).parquet(f"{path}/{write}")
    fs, at = _fs(spark, path)
    parts = dict(state["parts"])
    for p in touched:
        folder = f"{write}/" + "/".join(f"_{x}" for x in p.split("/"))
        if fs.exists(at(f"{path}/{folder}")):
            parts[p] = folder
        else:  # no row is left
            parts.pop(p, None)
    _commit(spark, path, {"version": state["version"] + 1, "parts": parts, "schema": json.loads(new.schema.json())})
    return len(touched)


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("namespace", "doc_id"), F.lit(buckets)).cast("int"))


def upsert_table(spark: SparkSession, incoming: DataFrame, path: str, buckets: int = 16) -> int:
    """Replace by document in the chunk table at ``path``: all rows of a (namespace, doc_id) that comes give way to those that
    come. Buckets of other documents stay as they are. How many were rewritten."""
    new = materialise(_bucketed(incoming, buckets))
    return merge_partitions(spark, new, path, ["bucket"], lambda old, new: old.join(new.select("namespace", "doc_id").distinct(), ["namespace", "doc_id"], "left_anti").select(*new.columns).unionByName(new))


def delete_from_table(spark: SparkSession, gone: DataFrame, path: str, buckets: int = 16) -> int:
    """The chunk table at ``path`` without the documents listed (namespace, doc_id); how many buckets were rewritten."""
    state = manifest(spark, path)
    if state["schema"] is None:
        return 0
    keys = materialise(_bucketed(gone.select("namespace", "doc_id").distinct(), buckets))
    names = {r[0] for r in keys.select(F.concat(F.lit("bucket="), F.col("bucket").cast("string"))).distinct().collect()}
    there = sorted(names & set(state["parts"]))
    if not there:
        return 0
    kept = materialise(read_table(spark, path, there).join(keys, ["namespace", "doc_id", "bucket"], "left_anti").select(*read_table(spark, path, there).columns))
    return _replace(spark, kept, path, state, there)


def _replace(spark: SparkSession, rows: DataFrame, path: str, state: dict, names: list[str]) -> int:
    write = f"data-{state['version'] + 1:012d}-{uuid.uuid4().hex[:8]}"
    rows.withColumn("_bucket", F.col("bucket")).hint("rebalance", F.col("_bucket")).write.partitionBy("_bucket").parquet(f"{path}/{write}")
    fs, at = _fs(spark, path)
    parts = dict(state["parts"])
    for p in names:
        parts.pop(p)
        if fs.exists(at(f"{path}/{write}/_{p}")):
            parts[p] = f"{write}/_{p}"
    _commit(spark, path, {**state, "version": state["version"] + 1, "parts": parts})
    return len(names)


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the folders and manifests that the last manifest doesn't need; no reader of earlier ones may be at work."""
    fs, at = _fs(spark, path)
    state = manifest(spark, path)
    used, gone = {f.split("/")[0] for f in state["parts"].values()}, 0
    for f in fs.listStatus(at(path)):
        if f.getPath().getName().startswith("data-") and f.getPath().getName() not in used:
            gone += fs.delete(f.getPath(), True)
    for f in fs.listStatus(at(f"{path}/_manifests")):
        if f.getPath().getName() != f"{state['version']:012d}.json":
            fs.delete(f.getPath(), False)
    return gone
