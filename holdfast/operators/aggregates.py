"""Aggregates: edge maxima, lists, log means, split statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.operators.ordered import running_sums

QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def symmetric_max(edges: DataFrame, score: str = "score") -> DataFrame:
    """key, score: the largest score of the edges (query, target) that a key is an end of. Self edges don't count."""
    ends = edges.filter("query <> target").select(F.explode(F.array("query", "target")).alias("key"), score)
    return ends.groupBy("key").agg(F.max(score).alias(score))


def clashes(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with more than one distinct value."""
    return df.groupBy(*keys).agg(F.count_distinct(value).alias("n_values")).filter("n_values > 1")


def log_mean(x: Column) -> Column:
    """Geometric mean."""
    return F.pow(F.lit(10.0), F.avg(F.log10(x)))


def sorted_sources(x: Column, sign: str = "|") -> Column:
    return F.array_join(F.array_sort(F.collect_set(x)), sign)


def mean_pool(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Element-wise mean of the vectors of a key, as array<double>: aggregated by (key, position) before the shuffle."""
    elements = df.select(key, F.posexplode(vector).alias("_at", "_x")).groupBy(key, "_at").agg(F.avg(F.col("_x").cast("double")).alias("_x"))
    return elements.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_x"))), lambda s: s["_x"]).alias(vector))


def quantiles(x: Column, at: tuple[float, ...] = QUANTILES) -> Column:
    """Exact, with linear interpolation."""
    return F.percentile(x, list(at))


def split_shift(df: DataFrame, split: str, x: str) -> DataFrame:
    """Per split, against the rows of split `train`: counts, moments, mean and median shift, shares outside the range and the 1 to 99 % range of train, KS, and RMSE, MAE and R2 of the train mean."""
    train = df.filter(F.col(split) == "train").agg(F.avg(x).alias("_m"), F.median(x).alias("_md"), F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.percentile(x, [0.01, 0.99]).alias("_q"))
    rows = df.crossJoin(F.broadcast(train))  # one row
    v = F.col(x)
    found = rows.groupBy(split).agg(
        F.count("*").alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        (F.avg(v) - F.first("_m")).alias("mean_shift"),
        (F.median(v) - F.first("_md")).alias("median_shift"),
        F.avg(((v < F.col("_lo")) | (v > F.col("_hi"))).cast("double")).alias("outside_range"),
        F.avg(((v < F.col("_q")[0]) | (v > F.col("_q")[1])).cast("double")).alias("outside_q01_q99"),
        F.sqrt(F.avg(F.pow(v - F.col("_m"), 2))).alias("rmse"),
        F.avg(F.abs(v - F.col("_m"))).alias("mae"),
        F.when(F.var_pop(v) > 0, 1 - F.avg(F.pow(v - F.col("_m"), 2)) / F.var_pop(v)).otherwise(0.0).alias("r2"),
    )
    return found.join(ks(df, split, x), split)


def ks(df: DataFrame, split: str, x: str, reference: str = "train") -> DataFrame:
    """Per split, the largest gap between its distribution function and that of the reference split. Values are counted first, so the running sums run over distinct values."""
    splits = [r[0] for r in df.select(split).distinct().orderBy(split).collect()]
    wide = df.filter(F.col(x).isNotNull()).groupBy(x).pivot(split, splits).count().na.fill(0)
    running = running_sums(wide, x, splits)
    total = wide.agg(*[F.sum(f"`{s}`").alias(s) for s in splits]).first()
    share = lambda s: F.col(f"`sum_{s}`") / total[s]
    gaps = running.select(*[F.abs(share(s) - share(reference)).alias(s) for s in splits])
    return gaps.agg(*[F.max(F.col(f"`{s}`")).alias(s) for s in splits]).unpivot([], splits, split, "ks")


def histogram(x: Column, low: float, high: float, bins: int) -> Column:
    """Bin number from 0, the last bin closed on its right; null outside."""
    width = (high - low) / bins
    return F.when(x.between(low, high), F.least(F.floor((x - low) / width), F.lit(bins - 1)))


def block_scaling(df: DataFrame, vector: str) -> DataFrame:
    """One mean and deviation over all elements of the vectors that are not all zero; a deviation of 0 becomes 1."""
    live = df.filter(F.exists(vector, lambda v: v != 0))
    rows = live.select(F.size(vector).alias("n"), F.aggregate(vector, F.lit(0.0), lambda s, v: s + v).alias("s"), F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v).alias("q"))
    total = rows.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    std = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    return total.select(mean.alias("mean"), F.when(std > 0, std).otherwise(1.0).alias("std"))
