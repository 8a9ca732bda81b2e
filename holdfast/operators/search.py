"""Sequence search: k-mer seeds, then global alignment, as an edge table."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions.align import identity_and_coverage
from holdfast.functions.vectors import BLOCK_BYTES, in_blocks
from holdfast.sources.shared import written

HITS = "query string, target string, identity double, coverage double"


def kmers(text: str, k: int) -> set[str]:
    """Distinct stretches of k letters; the text itself where it is shorter, none of an empty one."""
    return {text[i : i + k] for i in range(max(1, len(text) - k + 1))} if text else set()


def sequence_hits(queries: DataFrame, targets: DataFrame, k: int = 5, least_shared: int = 2, min_identity: float = 0.0, min_coverage: float = 0.0, block: int | None = None) -> DataFrame:
    """query, target, identity, coverage of the pairs that share `least_shared` distinct k-mers and align well enough. queries, targets: id, sequence.

    All queries against all targets, in blocks of targets that are broadcast one after the
    other with an index of their k-mers: a task counts the shared k-mers of its queries,
    aligns the pairs that reach the number and gives only the hits, so neither k-mers nor
    pairs are shuffled, and a lost task repeats its own queries alone. The rows are the
    same for any block (targets of one, by default some BLOCK_BYTES of k-mers). Null and
    empty sequences have no hits; repeated rows each count.
    """
    own = written(targets.select(F.col("id").cast("string").alias("id"), "sequence").filter("sequence <> ''"), "targets")
    asked = written(queries.select(F.col("id").cast("string").alias("id"), "sequence").filter("sequence <> ''"), "queries")
    rows, letters = own.agg(F.count("*"), F.sum(F.char_length("sequence"))).first()
    parts = []
    for table in in_blocks(own, "id", block or max(1, BLOCK_BYTES // 64 * rows // max(1, letters or 1))):
        ids, sequences = table.column("id").to_pylist(), table.column("sequence").to_pylist()
        if not ids:
            continue
        index: dict[str, list[int]] = {}
        for i, s in enumerate(sequences):
            for x in kmers(s, k):
                index.setdefault(x, []).append(i)
        shared = own.sparkSession.sparkContext.broadcast((ids, sequences, {x: np.array(at, np.int32) for x, at in index.items()}))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, sequences, index = shared.value
            for batch in batches:
                found = []
                for query, text in zip(batch.column("id").to_pylist(), batch.column("sequence").to_pylist(), strict=True):
                    at = [index[x] for x in kmers(text, k) if x in index]
                    for i in np.flatnonzero(np.bincount(np.concatenate(at), minlength=len(ids)) >= least_shared) if at else ():
                        identity, coverage = identity_and_coverage(text, sequences[i])
                        if identity >= min_identity and coverage >= min_coverage:
                            found.append((query, ids[i], identity, coverage))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], t) for c, t in enumerate((pa.string(), pa.string(), pa.float64(), pa.float64()))], names=["query", "target", "identity", "coverage"])

        parts.append(asked.mapInArrow(search, HITS))
    return reduce(DataFrame.unionByName, parts) if parts else own.sparkSession.createDataFrame([], HITS)
