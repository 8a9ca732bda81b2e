"""Evaluation metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.keys import padded_levels
from holdfast.operators.frames import top_per_key
from holdfast.operators.ordered import average_rank


def regression(pred: Column, target: Column) -> list[Column]:
    mse = F.avg(F.pow(pred - target, 2))
    return [mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(pred - target)).alias("mae"), F.when(F.var_pop(target) > 0, 1 - mse / F.var_pop(target)).otherwise(0.0).alias("r2")]


def pearson(a: Column, b: Column) -> Column:
    """0 for fewer than two rows, no variance, or a value that is not finite."""
    r = F.when((F.count(a) >= 2) & (F.var_pop(a) > 0) & (F.var_pop(b) > 0), F.corr(a, b))
    return F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    ranked = average_rank(average_rank(df, a, "_ra"), b, "_rb")
    return ranked.agg(pearson(F.col("_ra"), F.col("_rb")).alias("scc"))


def classification(df: DataFrame, pred: str, target: str, classes: int) -> DataFrame:
    """accuracy, balanced_accuracy, macro_f1, weighted_f1 from counts by (target, pred). Rows whose target is null or outside 0..classes-1 are left out, predictions outside count for no class; all 0 where no row is left."""
    inside = lambda x: F.col(x).between(0, classes - 1)
    pairs = df.filter(inside(target)).groupBy(target, pred).count()
    by_target = pairs.groupBy(F.col(target).alias("class")).agg(F.sum("count").alias("support"), F.sum(F.when(F.col(target) == F.col(pred), F.col("count")).otherwise(0)).alias("hit"))
    by_pred = pairs.filter(inside(pred)).groupBy(F.col(pred).alias("class")).agg(F.sum("count").alias("called"))
    rows = by_target.join(by_pred, "class", "full_outer").na.fill(0)
    rows = rows.withColumn("f1", 2 * F.col("hit") / (F.col("support") + F.col("called")))
    total = F.sum("support")
    zero = lambda v: F.coalesce(v, F.lit(0.0))
    return rows.agg(
        zero(F.sum("hit") / F.nullif(total, F.lit(0))).alias("accuracy"),
        zero(F.avg(F.when(F.col("support") > 0, F.col("hit") / F.col("support")))).alias("balanced_accuracy"),
        zero(F.avg("f1")).alias("macro_f1"),
        zero(F.sum(F.col("f1") * F.col("support")) / F.nullif(total, F.lit(0))).alias("weighted_f1"),
    )


def top_k(labels: Column, scores: Column, k: int) -> Column:
    """The labels of the k highest scores, ties in the order given."""
    zipped = F.transform(F.arrays_zip(labels.alias("l"), scores.alias("s")), lambda z, i: F.struct((-z["s"]).alias("s"), i.alias("i"), z["l"].alias("l")))
    return F.transform(F.slice(F.array_sort(zipped), 1, k), lambda z: z["l"])


def prefix_equal(a: Column, b: Column, levels: int) -> Column:
    return F.slice(padded_levels(a), 1, levels) == F.slice(padded_levels(b), 1, levels)


def matched_levels(true: Column, pred: Column) -> Column:
    """Length of the common prefix; 0 for a prediction that does not have four levels."""
    t, p = padded_levels(true), F.split(pred, r"\.")
    same = [F.get(t, F.lit(i)) == F.get(p, F.lit(i)) for i in range(4)]
    out = F.lit(0)
    for n in range(1, 5):
        all_ = same[0]
        for s in same[1:n]:
            all_ = all_ & s
        out = F.when(all_, n).otherwise(out)
    return F.when(F.size(p) == 4, out).otherwise(0)


def merge_queries(predictions: DataFrame, depth: int = 50) -> DataFrame:
    """Rows (query, label, score) of a query merged: each label keeps its best score, the best `depth` stay, ties by label. Empty labels go."""
    best = predictions.filter("label is not null and label <> ''").groupBy("query", "label").agg(F.max("score").alias("score"))
    return top_per_key(best, ["query"], [F.desc("score"), F.col("label")], depth)


def level_accuracy(truth: DataFrame, ranked: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10, 20, 30, 40, 50)) -> DataFrame:
    """k, level, accuracy: for each true label the best match among the top k, the share of a query's labels that reach the level, averaged over queries, in %. truth: query, label; ranked: query, label, rank."""
    t = truth.select("query", F.col("label").alias("true")).distinct()
    pairs = t.join(ranked.select("query", "label", "rank"), "query", "left")
    steps = pairs.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    best = steps.groupBy("k", "query", "true").agg(F.max(F.when(F.col("rank") <= F.col("k"), matched_levels(F.col("true"), F.col("label"))).otherwise(0)).alias("m"))
    wide = best.withColumn("level", F.explode(F.array(*[F.lit(i) for i in range(1, 5)])))
    by_query = wide.groupBy("k", "level", "query").agg(F.avg((F.col("m") >= F.col("level")).cast("double")).alias("share"))
    return by_query.groupBy("k", "level").agg((100 * F.avg("share")).alias("accuracy"))
