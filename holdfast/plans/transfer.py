"""Nearest-neighbour label transfer over vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions.vectors import PRODUCTS, block_rows, in_blocks, matrix_of, unit_rows
from holdfast.sources.shared import written


def best_hits(queries: DataFrame, train: DataFrame, block: int | None = None) -> DataFrame:
    """query, label, score: the best cosine of each query to each label of train. Both have id, label, v.

    All queries against all training rows, in blocks of training rows that are broadcast
    one after the other: a task multiplies its queries with the block where they lie and
    gives a row for each query and label of the block, never one for each pair; vectors
    are not shuffled. block: rows of a block, by default what fits a bound in bytes.
    """
    rows = written(train.select("id", "label", F.col("v").cast("array<double>").alias("v")), "train")
    asked = written(queries.select(F.col("id").cast("long").alias("query"), F.col("v").cast("array<double>").alias("v")), "queries")
    parts = []
    for table in in_blocks(rows, "id", block or block_rows(rows, "v")):
        if not len(table):
            continue
        table = table.sort_by("label")
        labels, first = np.unique(np.array(table.column("label").to_pylist(), object), return_index=True)
        shared = rows.sparkSession.sparkContext.broadcast((labels, first, unit_rows(matrix_of(table.column("v")))))

        def multiply(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            labels, first, y = shared.value
            for batch in batches:
                x, ids = unit_rows(matrix_of(batch.column("v"))), batch.column("query").to_numpy()
                step = max(1, PRODUCTS // len(y))
                for lo in range(0, len(x), step):
                    best = np.maximum.reduceat(x[lo : lo + step] @ y.T, first, axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[lo : lo + step], len(labels))), pa.array(np.tile(labels, len(best)), pa.string()), pa.array(best.ravel())], names=["query", "label", "score"])

        parts.append(asked.mapInArrow(multiply, "query long, label string, score double"))
    if not parts:
        return rows.sparkSession.createDataFrame([], "query long, label string, score double")
    return reduce(DataFrame.unionByName, parts).groupBy("query", "label").agg(F.max("score").alias("score"))


def wide_ranks(ranked: DataFrame, depth: int) -> DataFrame:
    """query and columns c0, c1, ...: the label of each rank, null where there is none."""
    lists = ranked.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "label"))).alias("_l"))
    return lists.select("query", *[F.get("_l", F.lit(i))["label"].alias(f"c{i}") for i in range(depth)])


