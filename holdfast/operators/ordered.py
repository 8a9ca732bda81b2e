"""Running sums and ranks over a whole table without one task that holds it.

The table is dealt by ranges of the order and written to the shared folder with the number
of its range; sums of the ranges, a row for each, give every range its start, and inside a
range a window does the rest. Rows equal in the order are always in one range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.sources import shared


def in_ranges(df: DataFrame, order: str, sums: list[str]) -> DataFrame:
    """df with _range, and for each column of sums _before_<column>: its sum over the earlier ranges."""
    path = shared.scratch(df.sparkSession, "ranges")
    df.repartitionByRange(F.col(order).asc_nulls_first()).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_range").agg(*[F.sum(c).alias(c) for c in sums])  # a row for each range
    starts = totals.select("_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{c}") for c in sums])
    return rows.join(F.broadcast(starts), "_range")


def running_sums(df: DataFrame, order: str, sums: list[str], inclusive: bool = True) -> DataFrame:
    """df with sum_<column> for each column of sums, over all rows up to this one's order, or before it."""
    rows = in_ranges(df, order, sums)
    frame = Window.partitionBy("_range").orderBy(F.col(order).asc_nulls_first())
    inside = frame.rangeBetween(Window.unboundedPreceding, 0)
    out = {}
    for c in sums:
        own = F.sum(c).over(inside)
        if not inclusive:
            own = own - F.sum(c).over(Window.partitionBy("_range", order))
        out[f"sum_{c}"] = F.col(f"_before_{c}") + own
    return rows.withColumns(out).drop("_range", *[f"_before_{c}" for c in sums])


def average_rank(df: DataFrame, x: str, into: str) -> DataFrame:
    """Ranks from 1, ties sharing their mean rank."""
    rows = in_ranges(df.withColumn("_one", F.lit(1).cast("long")), x, ["_one"])
    first = F.rank().over(Window.partitionBy("_range").orderBy(F.col(x).asc_nulls_first()))
    ties = F.count("*").over(Window.partitionBy("_range", x))
    return rows.withColumn(into, F.col("_before__one") + first + (ties - 1) / 2).drop("_range", "_one", "_before__one")
