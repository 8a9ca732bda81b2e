"""Choosing, assigning and merging structure candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.operators.frames import first_per_key, joinable

#: Sources in order of preference, and the coverage and identity that a match needs.
SOURCES = ("alphafold", "esmfold2", "esm3")
FULL_COVERAGE, LEAST_IDENTITY, LEAST_COVERAGE = 0.8, 0.9, 0.3


def mean_confidence(atoms: DataFrame, key: str, b: str) -> DataFrame:
    """key, v: mean of b; null where all are equal; a mean of 1 or less is a share and becomes a percentage."""
    m = F.avg(b)
    return atoms.groupBy(key).agg(F.when(F.min(b) < F.max(b), F.when(m <= 1, m * 100).otherwise(m)).alias("v"))


def locate(catalog: DataFrame) -> DataFrame:
    """Per id the file of the preferred source, of its highest version. catalog: id, source, version, path."""
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    return first_per_key(catalog.filter(F.col("source").isin(*SOURCES)), ["id"], [rank, F.col("version").desc(), F.col("path")])


def choose(candidates: DataFrame) -> DataFrame:
    """One candidate for each row key: experimental before predicted, then coverage, then id. candidates: row_key, pdb, kind, coverage."""
    return first_per_key(candidates, ["row_key"], [F.when(F.col("kind") == "experimental", 0).otherwise(1), F.col("coverage").desc_nulls_last(), F.col("pdb")])


def select_chain(chains: DataFrame) -> DataFrame:
    """Per pdb the chain that matches best, among those of the accession if it has any. chains: pdb, chain, of_accession, identity, coverage."""
    any_ = chains.groupBy("pdb").agg(F.bool_or("of_accession").alias("_any"))
    own = chains.join(joinable(any_), "pdb").filter(~F.col("_any") | F.col("of_accession")).drop("_any")
    own = own.filter((F.col("identity") >= LEAST_IDENTITY) & (F.col("coverage") >= LEAST_COVERAGE))
    return first_per_key(own, ["pdb"], [F.col("coverage").desc(), F.col("identity").desc(), F.col("chain")])


def assign(rows: DataFrame, coverage: DataFrame) -> DataFrame:
    """Per row id every pdb with full coverage, else its best partial one, else a row of kind predicted with no pdb. rows: id; coverage: id, pdb, coverage."""
    full = coverage.filter(F.col("coverage") >= FULL_COVERAGE).select("id", "pdb", F.lit("full").alias("kind"))
    rest = coverage.join(full.select("id").distinct(), "id", "left_anti")
    part = first_per_key(rest, ["id"], [F.col("coverage").desc(), F.col("pdb")]).select("id", "pdb", F.lit("partial").alias("kind"))
    found = full.unionByName(part)
    none = rows.select("id").distinct().join(found.select("id").distinct(), "id", "left_anti")
    return found.unionByName(none.select("id", F.lit(None).cast("string").alias("pdb"), F.lit("predicted").alias("kind")))


def merge_by_sequence(records: DataFrame) -> DataFrame:
    """sequence, ids (sorted), kind (that of the least id). records: id, sequence, kind."""
    return records.groupBy("sequence").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.min_by("kind", "id").alias("kind"))


def fallback_inputs(records: DataFrame, failed: DataFrame, folded: DataFrame) -> DataFrame:
    """Records whose hash failed and none of whose ids is folded. records: hash, ids; failed: hash; folded: id."""
    own = records.join(failed.select("hash").distinct(), "hash", "left_semi")
    done = own.select("hash", F.explode("ids").alias("id")).join(folded.select("id").distinct(), "id", "left_semi").select("hash").distinct()
    return own.join(done, "hash", "left_anti")
