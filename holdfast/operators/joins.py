"""Joins of the data model: maps, similarity tables, edges and candidate keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inner_map(df: DataFrame, unique: DataFrame, on: str) -> DataFrame:
    """df with the columns of a table that has one row for each key; rows without one go. Catalyst broadcasts the map where it is small."""
    return df.join(unique, on, "inner")


def left_similarity(df: DataFrame, similarity: DataFrame, on: str, value: str, flag: str) -> DataFrame:
    """Left join of a value: null and NaN become 0, flag says whether a row was there."""
    found = df.join(similarity, on, "left")
    return found.withColumns({flag: F.col(value).isNotNull(), value: F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))})


def left_lists(df: DataFrame, values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df with the sorted distinct values of its keys, an empty list where there are none; null keys are equal to each other."""
    lists = values.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias(value)).select(*[F.col(k).alias("_" + k) for k in keys], value)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col("_" + k)) for k in keys])
    found = df.join(lists, same, "left").drop(*["_" + k for k in keys])
    return found.withColumn(value, F.coalesce(value, F.array().cast("array<string>")))


def map_ends(edges: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """edges (query, target) with query_name and target_name from two tables (id, name); edges with an unknown end go."""
    q = queries.select(F.col("id").alias("query"), F.col("name").alias("query_name"))
    t = targets.select(F.col("id").alias("target"), F.col("name").alias("target_name"))
    return edges.join(q, "query").join(t, "target")


def same_group_pairs(members: DataFrame) -> DataFrame:
    """Pairs (q, t) of members (id, g) of one group, self pairs too. Quadratic in a group by its nature: use without_same_group to drop such edges."""
    return members.select(F.col("id").alias("q"), "g").join(members.select(F.col("id").alias("t"), "g"), "g").select("q", "t").distinct()


def without_same_group(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges (q, t) whose ends don't share a group; each end has one group at most, so groups are compared and no pair is built."""
    q, t = members.select(F.col("id").alias("q"), F.col("g").alias("_gq")), members.select(F.col("id").alias("t"), F.col("g").alias("_gt"))
    found = edges.join(q, "q", "left").join(t, "t", "left")
    return found.filter(F.col("_gq").isNull() | F.col("_gt").isNull() | (F.col("_gq") != F.col("_gt"))).select("q", "t", *[c for c in edges.columns if c not in ("q", "t")])


def missing_keys(keys: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Keys whose SHA-256 is not in the index (key_hash)."""
    return keys.withColumn("key_hash", F.sha2(key, 256)).join(index, "key_hash", "left_anti").drop("key_hash")


def by_candidates(df: DataFrame, store: DataFrame, candidates: str, key: str) -> DataFrame:
    """For each row the first of its candidate keys, in their order, that the store has; rows without one go. store has one row for each key."""
    others = [c for c in df.columns if c != candidates]
    found = df.select(*others, F.posexplode(candidates).alias("_at", key)).join(store, key)
    return found.groupBy(*others).agg(F.min_by(F.struct(*store.columns), "_at").alias("_s")).select(*others, "_s.*")


def add_new(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of a enriched with b's columns, then the rows of b whose key a lacks, with the source of each."""
    own = a.join(b, key, "left").withColumn("source", F.lit("a"))
    return own.unionByName(b.join(a.select(key), key, "left_anti").withColumn("source", F.lit("b")), allowMissingColumns=True)


def by_name(df: DataFrame, names: DataFrame) -> DataFrame:
    """Least id of the trimmed name, cases alike. names: id, name."""
    unique = names.groupBy(F.lower(F.trim("name")).alias("_name")).agg(F.min("id").alias("id"))
    return df.withColumn("_name", F.lower(F.trim("name"))).join(unique, "_name").drop("_name")


def superset_keys(sources: list[tuple[DataFrame, str]]) -> DataFrame:
    """Distinct non-empty strings v of scalar and list columns, sorted."""
    one = [df.select((F.explode(c) if df.schema[c].dataType.typeName() == "array" else F.col(c)).alias("v")) for df, c in sources]
    return reduce(DataFrame.unionByName, one).filter("v is not null and v <> ''").distinct().orderBy("v")


def replace_in_lists(df: DataFrame, mapping: DataFrame, key: str, ids: str) -> DataFrame:
    """ids with each entry replaced by `new` where the mapping (old, new) has it. key must be unique."""
    rows = df.select(key, F.posexplode(ids).alias("_at", "old")).join(mapping, "old", "left")
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("new", "old").alias("v")))).alias("_l"))
    return lists.select(key, F.transform("_l", lambda x: x["v"]).alias(ids))
