"""Sources and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.sources import shared

HITS = "query int, target int, score double"


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """fn over Arrow batches of rows, in the tasks that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield fn(batch)

    return df.mapInArrow(run, schema)


def read_many(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """The given columns of several tables, one below the other."""
    return reduce(DataFrame.unionByName, [read_columns(spark, p, columns) for p in paths])


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated edges with fixed types."""
    return spark.read.csv(path, sep="\t", schema=HITS)


def read_hits_coerced(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated edges of names: blanks at the ends go, a score that is no number is null."""
    raw = spark.read.csv(path, sep="\t", schema="query string, target string, score string")
    return raw.select(F.trim("query").alias("query"), F.trim("target").alias("target"), F.trim("score").try_cast("double").alias("score"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a line that does not parse, such as a truncated last one, is left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def scan_wanted(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """id, value of a (gzip) tab-separated file whose ids are wanted. keys: id."""
    return spark.read.csv(path, sep="\t", schema="id string, value string").join(keys.select("id").distinct(), "id", "left_semi")


def parse_lines(lines: DataFrame) -> DataFrame:
    """name, size, reason from a column of 'name size' lines: reason is null for a line to keep, else why it is not."""
    parts = F.split(F.trim("value"), r"\s+")
    size = F.get(parts, F.lit(1)).try_cast("int")
    reason = (
        F.when(F.trim("value") == "", "empty").when(F.trim("value").startswith("#"), "comment").when(F.size(parts) != 2, "fields").when(size.isNull(), "not a number").when(size < 1, "too small")
    )
    return lines.select("*", F.get(parts, F.lit(0)).alias("name"), size.alias("size"), reason.alias("reason"))


def find_splits(spark: SparkSession, root: str) -> list[str]:
    """Folders under root, threshold_* ones too, that hold all of train, val and test."""
    found = []
    for name in shared.children(spark, root):
        for at in [f"{root}/{name}", *[f"{root}/{name}/{x}" for x in shared.children(spark, f"{root}/{name}") if x.startswith("threshold_")]]:
            if {"train.parquet", "val.parquet", "test.parquet"} <= set(shared.children(spark, at)):
                found.append(at[len(root) + 1 :])
    return sorted(found)


def resolve_split(spark: SparkSession, root: str, threshold: str | None = None) -> str:
    """The folder itself if it holds the splits, else that of the threshold, else the only one; more than one is an error."""
    if {"train.parquet", "val.parquet", "test.parquet"} <= set(shared.children(spark, root)):
        return root
    under = [x for x in shared.children(spark, root) if x.startswith("threshold_")]
    wanted = [x for x in under if threshold is None or x == f"threshold_{threshold}"]
    if len(wanted) != 1:
        raise ValueError(f"{len(wanted)} of {len(under)} thresholds fit")
    return f"{root}/{wanted[0]}"


def vector_source(df: DataFrame, key: str, column: str | None = None, store: DataFrame | None = None) -> DataFrame:
    """(key, v) from a column if there is one (the first row of a key, by its text), else from a store."""
    if column and column in df.columns:
        return df.filter(F.col(column).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(F.col(column)).alias("v"))
    if store is None:
        raise ValueError("neither a vector column nor a store")
    return df.select(F.col(key).alias("key")).distinct().join(store, "key")


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*(partition_by or [])).parquet(path)


def write_named_splits(df: DataFrame, path: str, stats: dict | None = None) -> None:
    """One folder for each split, and the stats beside them."""
    for s in ("train", "val", "test"):
        write_parquet(df.filter(F.col("split") == s).drop("split"), f"{path}/{s}.parquet")
    shared.write_json(df.sparkSession, f"{path}/stats.json", stats or {})


def write_threshold_splits(df: DataFrame, path: str) -> None:
    write_parquet(df, path, ["threshold", "split"])


def unify_nulls(frames: list[DataFrame]) -> list[DataFrame]:
    """Columns without a type in one frame take that of the first sibling that has one."""
    kinds: dict[str, T.DataType] = {}
    for df in frames:
        for f in df.schema:
            if not isinstance(f.dataType, T.NullType):
                kinds.setdefault(f.name, f.dataType)
    return [df.select(*[F.col(f"`{f.name}`").cast(kinds[f.name]).alias(f.name) if isinstance(f.dataType, T.NullType) and f.name in kinds else F.col(f"`{f.name}`") for f in df.schema]) for df in frames]


def fasta(key: Column, sequence: Column) -> Column:
    return F.concat(F.lit(">"), key, F.lit("\n"), sequence)


def append_rows(df: DataFrame, rows: DataFrame) -> DataFrame:
    """A log with more rows, columns of either side that the other lacks being null."""
    return df.unionByName(rows, allowMissingColumns=True)
