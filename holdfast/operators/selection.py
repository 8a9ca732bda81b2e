"""Ordering, greedy selection and assignment.

greedy_fill and balanced_assign decide each key by what was taken before, so they run over
one ordered list. What they run over is a table of keys with row counts, not the rows;
greedy_fill streams that table, sorted, through one task that holds a running total.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.operators.frames import joinable, top_per_key
from holdfast.operators.ordered import running_sums
from holdfast.sources.shared import written


def group_min(df: DataFrame, keys: list[str], x: str, into: str) -> DataFrame:
    """The least x of the row's group; nulls are one group. Aggregated and joined back, so a hot group is combined before the shuffle."""
    least = df.groupBy(*keys).agg(F.min(x).alias(into)).withColumnsRenamed({k: "_" + k for k in keys})
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col("_" + k))
        same = one if same is None else same & one
    return df.join(joinable(least), same).drop(*["_" + k for k in keys])


def running_before(df: DataFrame, order: str, x: str, into: str) -> DataFrame:
    """Sum of x over the rows before, for a table with one row for each value of a bounded domain such as dates."""
    return df.withColumn(into, F.coalesce(F.sum(x).over(Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def pick_by_rules(df: DataFrame, keys: list[str], value: str, rules: list[Column]) -> DataFrame:
    """Per group, the value of the row that the first rule leaves alone; where no rule leaves one, the least value."""
    picks = [F.when(F.count_if(r) == 1, F.min(F.when(r, F.col(value)))) for r in rules]
    return df.groupBy(*keys).agg(F.coalesce(*picks, F.min(value)).alias("picked"))


def greedy_fill(df: DataFrame, order: list[Column], n: str, budget: Column, by: str | None = None) -> DataFrame:
    """df with taken: in order, a key is taken if the rows taken so far and its own stay within the budget, else it is skipped and the walk goes on.

    order must be total. budget may differ by group `by` but is one number in a group. A
    null n counts as 0. One group is one walk by its nature; it streams in sorted order
    through a task of its own and is not gathered.
    """
    fields = df.withColumn("_budget", budget.cast("long")).withColumn("taken", F.lit(False))
    group = by or "_one"
    own = fields if by else fields.withColumn("_one", F.lit(0))
    spread = own.repartition(F.col(group)).sortWithinPartitions(F.col(group), *order)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = object(), 0
        for batch in batches:
            flags = []
            for g, size, most in zip(batch.column(group).to_pylist(), batch.column(n).to_pylist(), batch.column("_budget").to_pylist(), strict=True):
                if g != now:
                    now, total = g, 0
                fits = total + (size or 0) <= most
                total += (size or 0) if fits else 0
                flags.append(fits)
            yield batch.set_column(batch.schema.get_field_index("taken"), "taken", pa.array(flags, pa.bool_()))

    return spread.mapInArrow(walk, spread.schema).drop("_budget", "_one")


def greedy_fill_folded(df: DataFrame, key: str, order: list[str], n: str, budget: int) -> DataFrame:
    """The same walk as one ordered fold in Catalyst, for up to some ten thousand keys: kept as a cross-check. Returns the keys taken."""
    rows = df.agg(F.array_sort(F.collect_list(F.struct(*order, F.col(key).alias("_key"), F.coalesce(n, F.lit(0)).cast("long").alias("_n")))).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast(f"array<{df.schema[key].dataType.simpleString()}>").alias("keys"))
    step = lambda acc, r: F.when(acc["total"] + r["_n"] <= budget, F.struct((acc["total"] + r["_n"]).alias("total"), F.array_append(acc["keys"], r["_key"]).alias("keys"))).otherwise(acc)
    return rows.select(F.explode(F.aggregate("rows", start, step)["keys"]).alias(key))


def balanced_assign(groups: DataFrame, key: str, n: str, fractions: dict[str, float], seed: int = 42) -> DataFrame:
    """Each group, in an order drawn by hash of seed and key, to the split that it brings nearest its target, in squared distance; a split still empty comes first once only as many groups are left as there are empty splits. Nulls and blanks are one group, __MISSING__.

    groups: one row for each key with its row count. It streams through one task, which holds a total for each split.
    """
    names = list(fractions)
    g = groups.withColumn(key, F.when(F.trim(F.coalesce(key, F.lit(""))) == "", "__MISSING__").otherwise(F.col(key))).groupBy(key).agg(F.sum(n).alias(n))
    total, count = g.agg(F.sum(n), F.count("*")).first()
    if (count or 0) < len(names):
        raise ValueError("fewer groups than splits")
    target = [fractions[s] * total for s in names]
    ordered = g.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}|"), key), 256)).repartition(1).sortWithinPartitions("_h")

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filled, left = [0] * len(names), count
        for frame in frames:
            out = []
            for size in frame[n].tolist():
                empty = [s for s in range(len(names)) if not filled[s]]
                choice = empty if len(empty) >= left else range(len(names))
                gaps = {s: ((filled[s] + size) - target[s], filled[s] - target[s]) for s in choice}
                best = min(choice, key=lambda s: (gaps[s][0] * gaps[s][0] - gaps[s][1] * gaps[s][1], s))
                filled[best] += size
                left -= 1
                out.append(names[best])
            yield pd.DataFrame({key: frame[key], n: frame[n], "split": out})

    return ordered.mapInPandas(walk, f"{key} string, {n} long, split string")


def lightest_bin(lengths: DataFrame, bins: int) -> DataFrame:
    """Longest first to the bin with the least cost (the first of equals), a length costing its square: (length, bin, n) from a histogram (length, n).

    The histogram comes to the driver: a row for each length, so no more than the longest
    text has characters. Texts of one length are placed together: they take the lowest of
    the steps cost, cost + square, ... of all bins, so a level is found below which all
    steps are taken. A length of 0 costs nothing, so the lightest bin takes all of them.
    """
    costs, placed = [0] * bins, []
    for length, n in sorted(((r["length"] or 0, r["n"]) for r in lengths.collect()), reverse=True):
        step = length * length
        if step == 0:
            placed.append((length, min(range(bins), key=lambda b: (costs[b], b)), n))
            continue
        taken = lambda level: [max(0, (level - x) // step + 1) for x in costs]  # noqa: E731,B023
        low, high = min(costs) - 1, max(costs) + step * n
        while high - low > 1:
            middle = (low + high) // 2
            if sum(taken(middle)) <= n:
                low = middle
            else:
                high = middle
        own = taken(low)
        for b in sorted(range(bins), key=lambda b: (costs[b] + own[b] * step, b))[: n - sum(own)]:
            own[b] += 1
        for b, k in enumerate(own):
            costs[b] += k * step
            if k:
                placed.append((length, b, k))
    return lengths.sparkSession.createDataFrame(placed, "length int, bin int, n long")


@dataclass(frozen=True)
class Fill:
    """How the texts of one length go into buckets: `room` into bucket `first`, then `most` into each of the next."""

    length: int
    first: int
    room: int
    most: int


def bucket_plan(lengths: list[tuple[int, int]], budget: int, most_texts: int, extra: int) -> list[Fill]:
    """Fills for a histogram (length, n): by rising length, a bucket is closed when the next text would bring its number of texts, or that number times the text's padded length, over the limits; a text that is over the budget alone has a bucket of its own."""
    out, bucket, held = [], 0, 0
    for length, n in sorted(lengths):
        most = max(1, min(most_texts, budget // (length + extra)))
        if held and held >= most:
            bucket, held = bucket + 1, 0
        room = most - held
        out.append(Fill(length, bucket, room, most))
        if n <= room:
            held += n
        else:
            full = -(-(n - room) // most)
            bucket, held = bucket + full, n - room - (full - 1) * most
    return out


def length_buckets(df: DataFrame, key: str, n: str, budget: int, most_texts: int = 1 << 30, extra: int = 2) -> DataFrame:
    """key, bucket: batches of texts of like length, by length and then key, so that texts times padded length (`extra` more than the longest) keep within `budget`, and texts within `most_texts`. A null length is 0.

    The walk is over the histogram of lengths, which comes to the driver (a row for each
    length). Ranks inside a length are dealt over ranges, so a frequent length is no task's alone.
    """
    own = df.select(key, F.coalesce(n, F.lit(0)).cast("int").alias("_n")).withColumn("_at", F.struct("_n", key)).withColumn("_one", F.lit(1).cast("long"))
    sizes = own.groupBy("_n").agg(F.count("*").alias("c"))
    counts = [(r["_n"], r["c"]) for r in sizes.collect()]
    plan = bucket_plan(counts, budget, most_texts, extra)
    before, at = {}, 0
    for length, c in sorted(counts):
        before[length], at = at, at + c
    table = df.sparkSession.createDataFrame([(f.length, before[f.length], f.first, f.room, f.most) for f in plan], "_n int, _before long, _first long, _room long, _most long")
    rank = F.col("sum__one") - 1 - F.col("_before")
    place = F.when(rank < F.col("_room"), F.col("_first")).otherwise(F.col("_first") + 1 + F.floor((rank - F.col("_room")) / F.col("_most")))
    return running_sums(own, "_at", ["_one"]).join(joinable(table), "_n").select(key, place.alias("bucket"))


def rank_labels(hits: DataFrame, frequency: DataFrame, depth: int = 20) -> DataFrame:
    """Labels of each query by best hit, then training frequency, then label. hits: query, label, score."""
    best = hits.groupBy("query", "label").agg(F.max("score").alias("score")).join(frequency, "label")
    return top_per_key(best, ["query"], [F.desc("score"), F.desc("frequency"), F.col("label")], depth)


def candidate_pool(pairs: DataFrame, lower: float, upper: float, step: float, n: int) -> DataFrame:
    """The pairs (k, cand, sim) in each k's pool: sim from `lower` to `upper`; where those are fewer than n, `lower` goes down by `step` until they are enough, and at 0 all up to `upper` are in."""
    last = math.ceil(round(lower / step, 9))
    level = F.when(F.col("sim") >= lower, 0).otherwise(F.least(F.lit(last), F.ceil(F.round((F.lit(lower) - F.col("sim")) / step, 9)).cast("int")))
    levels = pairs.filter(F.col("sim") <= upper).withColumn("_level", level)
    counts = levels.groupBy("k", "_level").agg(F.count("*").alias("_c"))  # as many rows of a k as levels
    upto = F.sum("_c").over(Window.partitionBy("k").orderBy("_level").rowsBetween(Window.unboundedPreceding, 0))
    reach = counts.withColumn("_upto", upto).groupBy("k").agg(F.coalesce(F.min(F.when(F.col("_upto") >= n, F.col("_level"))), F.max("_level")).alias("_reach"))
    return levels.join(joinable(reach), "k").filter(F.col("_level") <= F.col("_reach")).drop("_level", "_reach")


def negatives(positives: DataFrame, pairs: DataFrame, lower: float, upper: float, step: float, n: int, seed: int = 42) -> DataFrame:
    """Up to n negatives (k, cand) for each positive row, from its pool, a candidate being taken n times the number of its own positive rows at most.

    positives: k (unique), cand (its positive); pairs: k, cand, sim of the candidates that
    are not positive for k. In place of random draws, pairs have one order, by hash of
    seed, k and cand, and a pair is taken unless its k or its candidate is full by
    then. That walk is done in rounds without one task that holds all: every k offers its
    first n pairs that were not refused, every candidate keeps its first ones up to its
    limit and refuses the rest, until no pair is refused.
    """
    limits = positives.groupBy("cand").agg((F.count("*") * n).alias("_limit"))
    drawn = F.md5(F.concat_ws(":", F.lit(seed), "k", "cand"))
    pool = written(candidate_pool(pairs, lower, upper, step, n).join(joinable(limits), "cand").select("k", "cand", "_limit", drawn.alias("_drawn")), "pool")
    while True:
        offered = top_per_key(pool, ["k"], [F.col("_drawn"), F.col("cand")], n)
        ranked = offered.withColumn("_place", F.row_number().over(Window.partitionBy("cand").orderBy("_drawn", "k")))
        refused = written(ranked.filter(F.col("_place") > F.col("_limit")).select("k", "cand"), "refused")
        if refused.isEmpty():
            return offered.select("k", "cand")
        pool = written(pool.join(refused, ["k", "cand"], "left_anti"), "pool")
