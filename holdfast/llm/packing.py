"""Best-fit packing by large-item matching, on the histogram of lengths.

Lengths lie between 1 and the capacity, so their histogram is bounded whatever the
corpus. Pieces above a third of the capacity are matched greedily, the longest with the
longest that still fits beside it, two in a sequence at most; shorter ones go, longest
first, into the smallest gap that takes them. All pieces of one length are placed as
runs of ranks, so the plan is small, and every task looks up the place of its own pieces.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdfast.llm.common import table, written
from holdfast.llm.tokens import encoder, tokenizer_path

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
MOST_GROUPS = 400_000
PIECE_COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32")
PACKED_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long"


@dataclass(frozen=True)
class Run:
    """Ranks lo..hi-1 of a length: per of them in a sequence, from sequence first and offset on."""

    lo: int
    hi: int
    first: int
    per: int
    offset: int


def plan(histogram: dict[int, int], capacity: int) -> tuple[dict[int, list[Run]], int]:
    """Runs for each length, and the number of sequences."""
    left, runs = dict(histogram), {x: [] for x in histogram}
    sequences = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> intervals of sequences
    order: list[int] = []

    def opened(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, n))

    def place(length: int, n: int, first: int, per: int, offset: int) -> None:
        lo = histogram[length] - left[length]
        runs[length].append(Run(lo, lo + n, first, per, offset))
        left[length] -= n

    large = sorted(x for x in histogram if 3 * x > capacity)
    while large:
        x = large[-1]
        i = bisect_left(large, capacity - x + 1) - 1
        if i < 0:  # nothing fits beside it
            n = left[x]
            place(x, n, sequences, 1, 0)
            opened(capacity - x, sequences, n)
        elif (y := large[i]) != x:
            n = min(left[x], left[y])
            place(x, n, sequences, 1, 0)
            place(y, n, sequences, 1, x)
            opened(capacity - x - y, sequences, n)
        elif left[x] > 1:
            n = left[x] // 2
            place(x, 2 * n, sequences, 2, 0)
            opened(capacity - 2 * x, sequences, n)
        else:
            i = bisect_left(large, x) - 1
            n = 1
            place(x, 1, sequences, 1, 0)
            if i >= 0:
                place(large[i], 1, sequences, 1, x)
                opened(capacity - x - large[i], sequences, 1)
            else:
                opened(capacity - x, sequences, 1)
        sequences += n
        large = [v for v in large if left[v]]

    for x in sorted((v for v in histogram if 3 * v <= capacity), reverse=True):
        while left[x]:
            k = bisect_left(order, x)
            if k == len(order):
                per = capacity // x
                full, rest = divmod(left[x], per)
                if full:
                    place(x, full * per, sequences, per, 0)
                    opened(capacity - per * x, sequences, full)
                if rest:
                    place(x, rest, sequences + full, rest, 0)
                    opened(capacity - rest * x, sequences + full, 1)
                sequences += full + (rest > 0)
                break
            gap = order[k]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[k]
            used = min(n, left[x])
            place(x, used, first, 1, capacity - gap)
            opened(gap - x, first, used)
            opened(gap, first + used, n - used)
    return runs, sequences


def pieces(documents: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Documents as ids with end_id behind, cut where longer than the capacity."""
    end, step = struct.pack("<I", end_id), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = own.encode(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECE_SCHEMA)


def pack(documents: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, group: int = 512) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    documents: doc_id, text; other columns are not looked at. A null text counts as empty
    and gives the end id alone; a null doc_id is kept; repeated rows are packed each.
    An empty table gives no rows. Pieces of one length are ranked in groups of some `group`
    rows, as many as its count asks for, so a frequent length is dealt over tasks; where
    that would be more than MOST_GROUPS in all, groups are larger, so that the driver gets
    no more counts than that and one for each length (capacity at most).
    """
    found = written(pieces(documents, tokenizer, capacity, end_id), "pieces")
    lengths = found.groupBy("length").count().collect()
    group = max(group, sum(r["count"] for r in lengths) // MOST_GROUPS)
    lengths = [(r["length"], -(-r["count"] // group)) for r in lengths]
    salts = F.broadcast(documents.sparkSession.createDataFrame(sorted(lengths), "length long, _salts long"))  # capacity rows at most
    found = found.join(salts, "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_salts")).cast("int")).select(*PIECE_COLUMNS, "salt")
    counts = found.groupBy("length", "salt").count().collect()
    base, histogram = {}, {}
    for r in sorted(counts):
        base[r["length"], r["salt"]] = histogram.get(r["length"], 0)
        histogram[r["length"]] = histogram.get(r["length"], 0) + r["count"]
    runs, _ = plan(histogram, capacity)
    by_length = {x: tuple(np.array([getattr(r, k) for r in own], np.int64) for k in ("lo", "first", "per", "offset")) for x, own in runs.items()}
    shared = documents.sparkSession.sparkContext.broadcast((base, by_length))

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, by_length = shared.value
        for frame in frames:
            rank = frame["rank"].to_numpy() - 1 + np.fromiter((base[k] for k in zip(frame["length"], frame["salt"], strict=True)), np.int64, len(frame))
            sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            for x, rows in frame.groupby("length").indices.items():
                lo, first, per, at = by_length[x]
                k = np.searchsorted(lo, rank[rows], "right") - 1
                i = rank[rows] - lo[k]
                sequence[rows] = first[k] + i // per[k]
                offset[rows] = at[k] + i % per[k] * x
            yield frame.drop(columns=["salt", "rank"]).assign(sequence_id=sequence, offset=offset)

    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return found.withColumn("rank", F.row_number().over(order)).mapInPandas(assign, PACKED_SCHEMA)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
