"""Session helpers shared by tests, bench and entry points."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def local_session(cpus: int = 8, partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lorestack")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share: ``spark.checkpoint.dir``, or the session's own checkpoint
    folder; on one machine (a local master) else a new temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lorestack-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: later steps neither recompute ``df`` nor depend on an executor."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder, by any path Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch cut into parts of about ``most_bytes`` of one column, a row each at least."""
    start = size = 0
    for i, value in enumerate(batch.column(column)):
        n = value.as_buffer().size if value.is_valid else 0
        if i > start and size + n > most_bytes:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)


def map_in_parts(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, column: str) -> DataFrame:
    """``mapInPandas`` with frames of about 4 MB of ``column``: a worker turns no whole batch into Python objects, and hands on
    what it made of a part before it goes on to the next."""
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in run(part.to_pandas() for batch in batches for part in slices(batch, column)):
            yield pa.RecordBatch.from_pandas(frame, schema=kind, preserve_index=False)

    return df.mapInArrow(over, schema)
