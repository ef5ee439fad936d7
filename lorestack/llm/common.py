"""What the operators of this subpackage share: reading tables and cutting lineage in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: WeakKeyDictionary = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Where the setting is absent the session's own checkpoint
    folder is used, or, on one machine only (a local master), a new temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        base = context.getCheckpointDir()
        if not base:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="lorestack-")
            context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: later steps neither recompute ``df`` nor depend on an executor."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[back] = path
    return back


def discard(*written: DataFrame) -> None:
    """Delete what :func:`materialise` wrote for these frames; nothing that is still to run may depend on them."""
    for df in written:
        path = _WRITTEN.pop(df, None)
        if path:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def unused(taken: Iterable[str], *wanted: str) -> list[str]:
    """The names wanted, with underscores before those that are taken; case doesn't tell names apart."""
    busy, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in busy:
            name = f"_{name}"
        busy.add(name.lower())
        out.append(name)
    return out
