"""What the operators of this subpackage share: tables, the shared folder, deterministic keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.operators.frames import joinable
from holdfast.sources.shared import scratch, written

__all__ = ["lower_ascii", "scratch", "sorted_joinable", "sorted_side", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sorted_side(df: DataFrame) -> DataFrame:
    """A side of a join that is done by shuffles and sorting at any size. A side under the broadcast threshold is else gathered and built on the driver, where each takes several times that threshold, in every join of a loop."""
    return df.hint("merge")


def sorted_joinable(df: DataFrame) -> DataFrame:
    """`joinable`, and never built on the driver."""
    return sorted_side(joinable(df))
