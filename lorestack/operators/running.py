"""Running counts and sums of a key's rows that don't need the key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorestack.session import materialise


def running_sums(df: DataFrame, key: list[str], order: list[Column], sums: dict[str, str | Column]) -> DataFrame:
    """``df`` with a running sum over each key's rows in an order, the row's own value included, for each of ``sums``.

    Rows are dealt to ranges of (key, order), so one key on all rows is as many tasks as its rows ask for. A range sums its
    own; what earlier ranges of a key have is a row for each (key, range), and only keys that lie in several ranges have any.
    """
    values = {name: f"_v{i}" for i, name in enumerate(sums)}
    rows = df.withColumns({values[n]: F.col(v) if isinstance(v, str) else v for n, v in sums.items()}).withColumn("_tie", F.monotonically_increasing_id())
    ranged = materialise(rows.repartitionByRange(*key, *order, "_tie").withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy(*key, "_part").orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, 0)
    totals = ranged.groupBy(*key, "_part").agg(*(F.sum(v).alias(f"_all{v}") for v in values.values()))
    wide = totals.join(totals.groupBy(*key).count().filter("count > 1").drop("count"), key, "left_semi")
    earlier = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = wide.select(*key, "_part", *(F.sum(f"_all{v}").over(earlier).alias(f"_had{v}") for v in values.values()))
    own = ranged.withColumns({f"_own{v}": F.sum(v).over(inside) for v in values.values()}).join(before, [*key, "_part"], "left")
    return own.select(*df.columns, *((F.col(f"_own{v}") + F.coalesce(F.col(f"_had{v}"), F.lit(0))).alias(n) for n, v in values.items()))
