"""Leakage-controlled splits: by group, by similarity threshold, by edges and by time.

A similarity split is: one number for each key (its largest similarity to another key),
test keys below the threshold in order of (similarity, row count, key) until the budget,
validation keys from what is left in the same order, and train for all else, keys of
unknown similarity included.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.operators.frames import require_columns
from holdfast.operators.selection import balanced_assign, greedy_fill, group_min, running_before

SPLITS = ("train", "val", "test")


@dataclass(frozen=True)
class Fractions:
    """Shares of rows; truncated to whole rows as floor(share * rows) in double."""

    train: float = 0.9
    val: float = 0.05
    test: float = 0.05

    def rows(self, n: int) -> tuple[int, int]:
        return math.floor(self.val * n), math.floor(self.test * n)


def similarity_split(keys: DataFrame, n_rows: int, threshold: float, fractions: Fractions = Fractions(), eligible: Column | None = None, val_any: bool = False, match_val_to_test: bool = False) -> DataFrame:
    """key, split. keys: key, sim (null or NaN if unknown), n (rows of the key), one row each.

    eligible: what may be tested at all, by default a known similarity. val_any: every key
    that is not test may be validated, unknown ones too, in the same order with unknown
    last. match_val_to_test: validation gets as many rows as test got.
    """
    require_columns(keys, ["key", "sim", "n"])
    val_rows, test_rows = fractions.rows(n_rows)
    known = F.coalesce(~F.isnan("sim"), F.lit(False)) & F.col("sim").isNotNull()
    may = known if eligible is None else known & eligible
    order = [F.col("sim").asc_nulls_last(), F.col("n"), F.col("key")]
    marked = keys.withColumn("_may", may)
    candidates = marked.filter(F.col("_may") & (F.col("sim") < threshold))
    test = greedy_fill(candidates, order, "n", F.lit(test_rows)).filter("taken").select("key", "n")
    if match_val_to_test:
        val_rows = test.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rest = marked.join(test.select("key"), "key", "left_anti")
    val = greedy_fill(rest if val_any else rest.filter("_may"), order, "n", F.lit(val_rows)).filter("taken").select("key")
    marks = test.select("key", F.lit("test").alias("split")).unionByName(val.withColumn("split", F.lit("val")))
    return keys.select("key").join(marks, "key", "left").withColumn("split", F.coalesce("split", F.lit("train")))


def multi_threshold(keys: DataFrame, n_rows: int, thresholds: list[float], **options) -> DataFrame:
    """threshold, key, split: the similarities are computed once, the assignment once for each threshold."""
    parts = [similarity_split(keys, n_rows, t, **options).withColumn("threshold", F.lit(t)) for t in thresholds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def apply_split(df: DataFrame, assignment: DataFrame, key: str, null_split: str = "train") -> DataFrame:
    """Rows with the split of their key; null keys go to null_split."""
    own = assignment.select(F.col("key").alias("_k"), "split")
    return df.join(own, df[key] == F.col("_k"), "left").drop("_k").withColumn("split", F.when(F.col(key).isNull(), null_split).otherwise(F.col("split")))


def companion_split(df: DataFrame, assignment: DataFrame, key: str) -> DataFrame:
    """apply_split to another table of the same keys; a key without an assignment is an error."""
    loose = df.filter(F.col(key).isNotNull()).join(assignment.select(F.col("key").alias(key)), key, "left_anti")
    if found := loose.select(key).limit(3).collect():
        raise ValueError(f"keys without a split: {', '.join(str(r[0]) for r in found)}")
    return apply_split(df, assignment, key)


def day_of(df: DataFrame, date: str) -> Column:
    """The day of a date, a time or a text; null where a text is not a time."""
    own = F.col(date)
    return F.to_date(F.try_to_timestamp(own) if df.schema[date].dataType.simpleString() == "string" else own)


def time_split(df: DataFrame, date: str, fractions: Fractions = Fractions(), groups: list[str] | None = None, missing: str = "train") -> DataFrame:
    """df with split: whole days in order, each to train while train has fewer rows than its share, then to val, then to test.

    Rows without a date, and with a text that is not one, go to `missing` (train, val, test, drop or error), where they count
    towards its share. With groups, every row of a group then moves to the group's earliest split;
    null is a group of its own. The running sums are over days, which are few.
    """
    day = day_of(df, date)
    n, undated = df.agg(F.count("*"), F.count_if(day.isNull())).first()
    if undated and missing == "error":
        raise ValueError(f"{undated} rows have no date")
    if missing == "drop":
        df, n = df.filter(day.isNotNull()), n - undated
    preload = {s: undated if missing == s else 0 for s in SPLITS}
    train_rows, val_rows = math.floor(fractions.train * n), math.floor(fractions.val * n)
    days = df.filter(day.isNotNull()).groupBy(day.alias("_day")).agg(F.count("*").alias("_n"))
    days = running_before(days, "_day", "_n", "_before").withColumn("_train", F.col("_before") + preload["train"] < train_rows)
    later = F.coalesce(F.sum(F.when(~F.col("_train"), F.col("_n"))).over(Window.partitionBy(F.lit(0)).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.when(F.col("_train"), 0).when(later + preload["val"] < val_rows, 1).otherwise(2)
    ranked = days.select("_day", rank.alias("_rank"))
    own = df.withColumn("_day", day).join(ranked, "_day", "left").withColumn("_rank", F.coalesce("_rank", F.lit(SPLITS.index(missing) if missing in SPLITS else 0))).drop("_day")
    if groups:
        require_columns(df, groups)
        own = group_min(own.withColumnRenamed("_rank", "_own"), groups, "_own", "_rank").drop("_own")
    return own.withColumn("split", F.element_at(F.array(*map(F.lit, SPLITS)), F.col("_rank") + 1)).drop("_rank")


def random_grouped_split(df: DataFrame, key: str, fractions: Fractions = Fractions(), seed: int = 42) -> DataFrame:
    """df with split: whole groups, drawn by hash, balanced by rows. Null and blank keys are one group."""
    group = F.when(F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))) == "", "__MISSING__").otherwise(F.col(key).cast("string"))
    own = df.withColumn("_g", group)
    sizes = own.groupBy("_g").agg(F.count("*").alias("_n"))
    marks = balanced_assign(sizes, "_g", "_n", {"train": fractions.train, "val": fractions.val, "test": fractions.test}, seed)
    return own.join(marks.select("_g", "split"), "_g").drop("_g")


def edge_maxima(structures: DataFrame, edges: DataFrame) -> DataFrame:
    """id, sim: the largest score of a structure to one of another sequence, 0.0 without an edge. structures: id, sequence (null matches none); edges: query, target, score."""
    a, b = structures.select(F.col("id").alias("query"), F.col("sequence").alias("_a")), structures.select(F.col("id").alias("target"), F.col("sequence").alias("_b"))
    own = edges.filter("query <> target").join(a, "query").join(b, "target").filter(~F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)))
    ends = own.select(F.explode(F.array("query", "target")).alias("id"), "score").groupBy("id").agg(F.max("score").alias("sim"))
    return structures.select("id").distinct().join(ends, "id", "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))


def leaks(df: DataFrame, key: str) -> DataFrame:
    """Keys in more than one split: empty if nothing leaks."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct("split").alias("n_splits")).filter("n_splits > 1")


FAMILIES = {"random_grouped": random_grouped_split, "time": time_split, "similarity": similarity_split, "multi_threshold": multi_threshold, "companion": companion_split}


def dispatch(config: dict[str, dict], families: list[str] | None = None) -> list[tuple[str, str]]:
    """(dataset, family) of every dataset whose config names the family; datasets that end in _unified are left out."""
    return [(d, f) for d, own in sorted(config.items()) if not d.endswith("_unified") for f in (families or FAMILIES) if f in own]
