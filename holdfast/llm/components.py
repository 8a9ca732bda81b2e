"""Connected components of an edge table: in one task up to a fixed number of edges, else by alternating large and small stars, a logarithmic number of rounds, each written to the shared folder.

A round is some 16 Spark stages, and the driver's memory grows with each, whatever its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import sorted_joinable, sorted_side, written

ONE_TASK = 2_000_000  # edges that one task joins, some 32 MB of them


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges, and of each the least node reachable: roots with a lesser neighbour hook to the least of them, until no edge has two roots."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent, a, b = np.arange(len(nodes)), at[: len(u)], at[len(u) :]
    while len(a):
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        a, b = parent[a], parent[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[parent]


def joined_in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [[b.column(c).to_numpy() for c in ("u", "v")] for b in batches if b.num_rows]:
            nodes, roots = least_reachable(*(np.concatenate(x) for x in zip(*held, strict=True)))
            for lo in range(0, len(nodes), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)]) for x in (nodes, roots)], names=["node", "root"])

    return edges.coalesce(1).mapInArrow(run, "node long, root long")


def tangled(edges: DataFrame) -> bool:
    """Whether some node has two roots, or is a root and has one: edges u, v are not yet stars."""
    many = edges.groupBy("u").count().filter("count > 1").select("u")
    chained = edges.select("v").distinct().join(sorted_side(edges.select(F.col("u").alias("v")).distinct()), "v", "left_semi").select(F.col("v").alias("u"))
    return not many.unionByName(chained).isEmpty()


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """edges: u, v (long, not null; loops and repeats do no harm). Returns node, root for every node of an edge between two nodes: root is the least node reachable. An empty table gives no rows.

    Distinct edges are counted, and up to `one_task` of them are joined by one task, whose
    rows so do not follow the input. Beyond that come rounds:

    Minima are aggregated before the shuffle, and the joins that bring them back have a
    row for each node on one side, so AQE can split the hub of a large component. No join
    is a broadcast: the driver holds no rows in any round. It is done when the edges are
    stars, which is read from the edges themselves.
    """
    now = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if now.count() <= one_task:
        return written(joined_in_one_task(now), "components")
    while tangled(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(sorted_joinable(least), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(sorted_joinable(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = written(small, "edges")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
