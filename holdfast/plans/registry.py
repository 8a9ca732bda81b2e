"""The reference queries: each has a name, a function of the tables, and DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """t.part, t.orders and so on, read lazily; t.spark and t.sf_dir."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return f

    return add


def over(table: str, *exprs: str):
    """A projection that reads alike in Spark and DuckDB: a function of the tables, and the head of a SQL text that names it i."""
    return (lambda t: getattr(t, table).selectExpr(*exprs)), f"WITH i AS (SELECT {', '.join(exprs)} FROM {table}) "
