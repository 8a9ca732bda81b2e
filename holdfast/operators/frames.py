"""Small frame operators that others build on."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def joinable(df: DataFrame) -> DataFrame:
    """An aggregate that is to be joined back to its rows. AQE splits a hot key of a join only where both sides come straight from a shuffle for the join, so the aggregate gets a shuffle of its own; it has a row for each key and is the small side."""
    return df.hint("rebalance")


def map_distinct(df: DataFrame, column: str, into: str, fn: Callable[[Column], Column]) -> DataFrame:
    """fn over the distinct values of a column, joined back: for functions that cost more than a shuffle of the keys. Nulls map to null."""
    found = df.select(column).filter(F.col(column).isNotNull()).distinct().withColumn(into, fn(F.col(column)))
    return df.join(found, column, "left")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in an order that must be total. Spark limits the groups before the shuffle, so a hot key costs a row for each task."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key; at most n of a key leave a task."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)
