"""Run control and lookups: upserts, latest states, budgets, aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.operators.frames import first_per_key, joinable
from holdfast.operators.ordered import running_sums


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, the new one of a key winning, in order of the keys."""
    rest = old.join(new.select(*keys), keys, "left_anti")
    return rest.unionByName(new, allowMissingColumns=True).orderBy(*keys)


def lookup_required(table: DataFrame, keys: DataFrame, key: str, value: str) -> DataFrame:
    """key, value of the wanted keys; empty values count as missing, and a missing key is an error."""
    own = table.filter(F.col(value).isNotNull() & (F.col(value).cast("string") != ""))
    gone = keys.select(key).distinct().join(own.select(key), key, "left_anti")
    if names := [str(r[0]) for r in gone.orderBy(key).limit(20).collect()]:
        raise KeyError(f"missing: {', '.join(names)}")
    return keys.select(key).distinct().join(own.select(key, value), key)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the greatest order, which must be total."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_r"))
    return best.select("_r.*")


def evict_oldest(entries: DataFrame, budget: int, protected: Column) -> DataFrame:
    """Entries (id, size, mtime) to remove, oldest first, until the total is within the budget; protected ones stay but count. The running sum is dealt over ranges of (mtime, id)."""
    total = entries.agg(F.sum("size").alias("_total"))
    marked = entries.withColumns({"_protected": protected, "_at": F.struct("mtime", "id")})
    gone = running_sums(marked.withColumn("_size", F.when(F.col("_protected"), 0).otherwise(F.col("size"))), "_at", ["_size"], inclusive=False)
    return gone.crossJoin(F.broadcast(total)).filter(~F.col("_protected") & (F.col("sum__size") < F.col("_total") - budget)).select(*entries.columns)  # one row


def follow_alias(entries: DataFrame) -> DataFrame:
    """id, target of entries (id, active, merge_to): itself if active, else the entry that it was merged into if that one is active; others go."""
    active = entries.filter("active").select(F.col("id").alias("_t"))
    own = entries.withColumn("target", F.when(F.col("active"), F.col("id")).otherwise(F.col("merge_to")))
    return own.join(active, own["target"] == active["_t"]).select("id", "target")


def preferred_or_fallback(hits: DataFrame, key: str, preferred: str) -> DataFrame:
    """Preferred hits of a key if it has any, else all of its hits."""
    any_ = hits.groupBy(key).agg(F.bool_or(preferred).alias("_any"))
    return hits.join(joinable(any_), key).filter(~F.col("_any") | F.col(preferred)).drop("_any")


def tokens_text(x: Column) -> Column:
    """Lower-cased runs of letters and digits, each between single spaces."""
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(x), F.lit(r"([a-z0-9]+)"), F.lit(1)), " "), F.lit(" "))


def phrase_matches(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name) of the names that occur in a text as whole words. Names meet a text by their first word, so texts are not held against all names. texts: id, text; names: name."""
    own = names.select("name").distinct().withColumn("_p", tokens_text(F.col("name"))).withColumn("_w", F.split_part(F.trim("_p"), F.lit(" "), F.lit(1)))
    words = texts.select("id", tokens_text(F.col("text")).alias("_t")).withColumn("_w", F.explode(F.array_distinct(F.split(F.trim("_t"), " "))))
    return words.join(own, "_w").filter(F.contains("_t", F.col("_p"))).select("id", "name").distinct()


def first_location(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Per wanted key its (shard, row), as a scan of the shards in order finds it: the scan ends with the first shard after which all keys are known, and a later occurrence before that replaces an earlier one. rows: key, shard, row."""
    wanted = keys.select("key").filter("key is not null").distinct()
    hits = rows.join(wanted, "key", "left_semi")
    firsts = hits.groupBy("key").agg(F.min("shard").alias("_first"))
    end = firsts.agg(F.count("*").alias("_found"), F.max("_first").alias("_end")).crossJoin(wanted.agg(F.count("*").alias("_wanted")))  # one row
    seen = hits.crossJoin(F.broadcast(end)).filter((F.col("_found") < F.col("_wanted")) | (F.col("shard") <= F.col("_end")))
    return seen.groupBy("key").agg(F.max(F.struct("shard", "row")).alias("_l")).select("key", "_l.*")


def classify_work(records: DataFrame, existing: DataFrame, skipped: DataFrame, longest: int) -> DataFrame:
    """records (id, sequence) with status: exists, skipped, too long or to do, the first that holds."""
    e, s = existing.select("id", F.lit(True).alias("_e")).distinct(), skipped.select("id", F.lit(True).alias("_s")).distinct()
    status = F.when(F.col("_e"), "exists").when(F.col("_s"), "skipped").when(F.length("sequence") > longest, "too long").otherwise("to do")
    return records.join(e, "id", "left").join(s, "id", "left").withColumn("status", status).drop("_e", "_s")


def reusable(sources: list[tuple[DataFrame, int]], key: str, ok: Column) -> DataFrame:
    """Rows that may be used again, of each key that of the highest priority."""
    rows = None
    for df, priority in sources:
        own = df.filter(ok).withColumn("_p", F.lit(priority))
        rows = own if rows is None else rows.unionByName(own)
    return first_per_key(rows, [key], [F.desc("_p"), *[F.col(c) for c in rows.columns if c not in (key, "_p")]]).drop("_p")


def fanout(rows: DataFrame, results: DataFrame, key: str, status: str) -> DataFrame:
    """rows with the result of their key; results must be unique by key, rows without one are `missing`, rows with a null key `not_applicable`."""
    if results.groupBy(key).count().filter("count > 1").limit(1).count():
        raise ValueError("results are not unique")
    return rows.join(results, key, "left").withColumn(status, F.when(F.col(key).isNull(), "not_applicable").otherwise(F.coalesce(status, F.lit("missing"))))


def name_clashes(df: DataFrame, raw: str) -> DataFrame:
    """Clean names that more than one raw id gives."""
    clean = F.regexp_replace(raw, r"[^A-Za-z0-9_.-]+", "_")
    return df.groupBy(clean.alias("name")).agg(F.count_distinct(raw).alias("n")).filter("n > 1")


def complete_grid(df: DataFrame, categories: list[str], methods: list[str]) -> DataFrame:
    """A row for each category and method, in that order; combinations that are not there have nulls, a null std is 0."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(i, c, m) for i, c in enumerate(categories) for m in methods], "at int, category string, method string")
    return grid.join(df, ["category", "method"], "left").withColumn("std", F.coalesce("std", F.lit(0.0)))
