"""From raw documents to packed training sequences: quality, lines, near copies, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs; all but the last keep the columns of
documents. Rows with null texts fail the quality rules; other nulls, and extra columns
of whatever name, pass through. Rows equal in doc_id and text are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from holdfast.llm.common import table, written
from holdfast.llm.decontaminate import drop_contaminated
from holdfast.llm.line_dedup import cut_repeated_lines
from holdfast.llm.near_copies import keep_one_of_each
from holdfast.llm.packing import pack
from holdfast.llm.quality import fit, keep_good
from holdfast.llm.tokens import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned rules, or the base limits, reject go."""
    return keep_good(docs, fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of windows of three lines are cut out; documents that lose all their lines go."""
    return cut_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is cut into pieces and packed into sequences of 4096 tokens."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

ORACLE_SQL = None  # learned rules, fingerprints and tokens have no SQL; tests/llm/test_pipeline.py holds run() against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, name)
    return docs
