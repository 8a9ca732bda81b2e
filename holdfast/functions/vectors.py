"""Vectors as arrays: Column expressions, and the blocked product for all-pairs maxima."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.sources.shared import written


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column, least: float = 1e-10) -> Column:
    """A norm below `least` counts as 1."""
    norm = lambda v: F.sqrt(dot(v, v))
    safe = lambda v: F.when(norm(v) < least, 1.0).otherwise(norm(v))
    return dot(a, b) / (safe(a) * safe(b))


def tanimoto_bits(a: Column, b: Column) -> Column:
    """Over 0/1 vectors, values above 0 counting as 1; 0 where no bit is set."""
    one = lambda v: F.aggregate(v, F.lit(0), lambda s, x: s + F.when(x > 0, 1).otherwise(0))
    both = F.aggregate(F.zip_with(a, b, lambda x, y: F.when((x > 0) & (y > 0), 1).otherwise(0)), F.lit(0), lambda s, v: s + v)
    union = one(a) + one(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def tanimoto_sets(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, both / union).otherwise(0.0)


def shingles(x: Column, n: int) -> Column:
    """Distinct character n-grams; the text itself where it is shorter."""
    return F.array_distinct(F.when(F.char_length(x) < n, F.array(x)).otherwise(F.transform(F.sequence(F.lit(1), F.char_length(x) - n + 1), lambda i: F.substr(x, i, F.lit(n)))))


def character_pairs(x: Column, reach: int) -> Column:
    """Distinct (character, distance, character) triples of all pairs up to `reach` apart, the lesser character first: what atom pairs are for a molecule, for a text."""
    one = lambda d: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(x) - d, F.lit(1))), lambda i: F.when(i + d <= F.char_length(x), F.concat(F.least(F.substr(x, i, F.lit(1)), F.substr(x, i + d, F.lit(1))), F.lit(str(d)), F.greatest(F.substr(x, i, F.lit(1)), F.substr(x, i + d, F.lit(1))))))
    return F.array_distinct(F.array_compact(F.flatten(F.array(*[one(d) for d in range(1, reach + 1)]))))


def neighbourhoods(x: Column, radius: int) -> Column:
    """Distinct hashes of the stretch around each character, for every radius from 0 on: what circular fingerprints are for a molecule, for a text."""
    one = lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(x), F.lit(1))), lambda i: F.xxhash64(F.lit(r), F.substr(x, F.greatest(i - r, F.lit(1)), F.least(i, F.lit(r + 1)) + r)))
    return F.when(F.char_length(x) > 0, F.array_distinct(F.flatten(F.array(*[one(r) for r in range(radius + 1)])))).otherwise(F.array().cast("array<bigint>"))


def set_difference_both(a: Column, b: Column) -> Column:
    """What only one side of a reaction has: the stand-in for a differential reaction fingerprint."""
    return F.concat(F.array_except(a, b), F.array_except(b, a))


def json_vector(x: Column) -> Column:
    return F.from_json(x, "array<double>")


def valid(v: Column) -> Column:
    return F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def nan_to_zero(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0).cast("double")).otherwise(x))


def concat_blocks(blocks: list[tuple[Column, int]]) -> Column:
    """Fixed-width blocks one after the other, zeros for a missing one."""
    return F.concat(*[F.coalesce(v, F.array_repeat(F.lit(0.0), d)) for v, d in blocks])


def standardise(v: Column, mean: Column | float, std: Column | float) -> Column:
    """(v - mean) / std; an all-zero block stays as it is."""
    return F.when(valid(v), F.transform(v, lambda x: (x - mean) / std)).otherwise(v)


BLOCK_BYTES = 64 << 20
PRODUCTS = 1 << 22  # of a multiplication at a time in a task


def in_blocks(rows: DataFrame, key: str, size: int) -> Iterator[pa.Table]:
    """A written table in blocks of some `size` rows, dealt by hash of the key, one at a time on the driver; a block is what is broadcast against all rows."""
    blocks = max(1, -(-rows.count() // size))
    for b in range(blocks):
        yield rows.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).toArrow()


def matrix_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit_rows(x: np.ndarray, least: float = 1e-10) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm < least, 1.0, norm)


def block_rows(rows: DataFrame, vector: str) -> int:
    """Rows whose vectors fit BLOCK_BYTES."""
    first = rows.select(F.size(vector).alias("n")).first()
    return max(1, BLOCK_BYTES // (8 * max(1, first["n"] if first else 1)))


def best_of(parts: list[DataFrame], key: str) -> DataFrame:
    """key, sim: the largest sim of each key over the blocks; 0.0 where there was nothing to compare with."""
    whole = reduce(DataFrame.unionByName, parts)
    return whole.groupBy(key).agg(F.max("sim").alias("sim")).withColumn("sim", F.when(F.col("sim") == float("-inf"), 0.0).otherwise(F.col("sim")))


def max_similarity(vectors: DataFrame, key: str, vector: str, kind: str = "cosine", block: int | None = None) -> DataFrame:
    """key, sim: the largest similarity of each valid vector to another one; 0.0 where it is the only one.

    All rows against all rows, in blocks of bounded size that are broadcast one after the
    other: a task multiplies its rows with the block where they lie, so vectors are never
    shuffled, and gives a number for each row and block, never a pair. Keys must be
    unique; rows without a valid vector are left out. kind: cosine or tanimoto. block:
    rows of a block, by default what fits BLOCK_BYTES.
    """
    own = written(vectors.filter(valid(F.col(vector))).select(key, F.col(vector).cast("array<double>").alias("_v")), "vectors")
    kind_of = own.schema[key].dataType.simpleString()
    prepared = unit_rows if kind == "cosine" else lambda x: (x > 0).astype(np.float64)
    parts = []
    for table in in_blocks(own, key, block or block_rows(own, "_v")):
        shared = own.sparkSession.sparkContext.broadcast((table.column(key).to_pylist(), prepared(matrix_of(table.column("_v")))))

        def multiply(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            keys, y = shared.value
            at, sizes = {k: i for i, k in enumerate(keys)}, y.sum(axis=1)
            for batch in batches:
                x, best = prepared(matrix_of(batch.column("_v"))), []
                step = max(1, PRODUCTS // max(1, len(keys)))
                for lo in range(0, len(x) if keys else 0, step):
                    sims = x[lo : lo + step] @ y.T
                    if kind == "tanimoto":
                        union = x[lo : lo + step].sum(axis=1)[:, None] + sizes[None, :] - sims
                        sims = np.divide(sims, union, out=np.zeros_like(sims), where=union > 0)
                    for i, k in enumerate(batch.column(key)[lo : lo + step].to_pylist()):
                        if k in at:
                            sims[i, at[k]] = -np.inf
                    best.append(sims.max(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(np.concatenate(best) if best else np.full(len(x), -np.inf))], names=[key, "sim"])

        parts.append(own.mapInArrow(multiply, f"{key} {kind_of}, sim double"))
    return best_of(parts, key)


def max_set_similarity(sets: DataFrame, key: str, column: str, block: int | None = None) -> DataFrame:
    """key, sim: the largest Tanimoto similarity of each set (an array<bigint> without repeats) to another one; 0.0 where it is the only one, or empty.

    As max_similarity, with an inverted index of each block in place of the product, so an
    element that very many sets have costs a number for each row and set of a block, and no
    pair is shuffled. block: sets of a block, by default of some BLOCK_BYTES together.
    """
    own = written(sets.select(key, F.col(column).alias("_s")), "sets")
    kind_of = own.schema[key].dataType.simpleString()
    rows, elements = own.agg(F.count("*"), F.sum(F.size("_s"))).first()
    parts = []
    for table in in_blocks(own, key, block or max(1, BLOCK_BYTES // 16 * rows // max(1, elements or 1))):
        column_ = table.column("_s").combine_chunks()
        terms, lengths = column_.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(column_.offsets.to_numpy()) if len(column_) else np.zeros(0, np.int64)
        order = np.argsort(terms, kind="stable")
        shared = own.sparkSession.sparkContext.broadcast((table.column(key).to_pylist(), lengths, terms[order], np.repeat(np.arange(len(lengths)), lengths)[order]))

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            keys, sizes, terms, holders = shared.value
            at = {k: i for i, k in enumerate(keys)}
            for batch in batches:
                best, mine = [], batch.column("_s")
                for i, k in enumerate(batch.column(key).to_pylist()):
                    x = mine[i].values.to_numpy(zero_copy_only=False)
                    lo, n = np.searchsorted(terms, x, "left"), 0
                    n = np.searchsorted(terms, x, "right") - lo
                    places = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                    both = np.bincount(holders[places], minlength=len(keys))
                    sims = np.divide(both, sizes + len(x) - both, out=np.zeros(len(keys)), where=(sizes + len(x)) > 0)
                    if k in at:
                        sims[at[k]] = -np.inf
                    best.append(sims.max(initial=-np.inf))
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(best, pa.float64())], names=[key, "sim"])

        parts.append(own.mapInArrow(count, f"{key} {kind_of}, sim double"))
    return best_of(parts, key)
