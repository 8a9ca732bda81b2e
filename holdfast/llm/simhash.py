"""SimHash near-dedup by a byte-position inverted index with count filtering.

A fingerprint has eight bytes. Two that differ in at most `bits` bits agree at 8 - bits
of the eight byte positions at least: the guaranteed tally of shared positional bytes.
The index has a posting list for each set of one positional byte less (of three, for four
bits) out of a family that meets every set of positions the tally may consist of, so any
pair that reaches the tally stands in a common list, under 20 postings a fingerprint
instead of the 70 of all choices. For each pair met in a list all its shared positional
bytes are tallied, pairs under the guaranteed tally go, and the rest are verified by
their differing bits: no link is lost. Equal fingerprints are one entry, and of the links
in a list only a spanning forest leaves the task, so copies are never expanded into
pairs. Lists are counted first, and one that is too long for a task is dealt into blocks,
each pair of blocks being a list of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.common import sorted_joinable, sorted_side, table, written
from holdfast.llm.components import components

UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
TO_LOWER = bytes.maketrans(UPPER, LOWER)
BYTES = 8
LIST_CAP = 1 << 14  # entries of a block of a long list
BROADCAST_ROWS = 1_000_000


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit, highest first."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(len(hashes), -1), axis=1)
    total = np.zeros(64, np.int64)
    for lo in range(0, len(bits), 255):
        total += np.add.reduce(bits[lo : lo + 255], axis=0, dtype=np.uint8)
    return total


def fingerprint(text: str | None, shingle: int, seed: int = 42, block: int = 1 << 15) -> int:
    """Bit by bit, whether more than half of the hashes of the word shingles have it; zero without words. Long texts are tallied in blocks."""
    words = (text or "").encode("utf-8").translate(TO_LOWER).split()
    if not words:
        return 0
    whole, size = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    lasts = ends[min(shingle, len(words)) - 1 :]
    tally = np.zeros(64, np.int64)
    for lo in range(0, n, block):
        hi = min(n, lo + block)
        tally += bit_sums(np.array([size(whole[a:b], seed) for a, b in zip(begins[lo:hi].tolist(), lasts[lo:hi].tolist(), strict=True)], np.uint64))
    return int(np.packbits(2 * tally > n).view(">u8")[0])


def fingerprints(documents: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """Per row: doc_id, print (a signed long). A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "print"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, print long")


def posted(share: int, positions: int = BYTES) -> list[tuple[int, ...]]:
    """Sets of share - 1 positions (one at least) such that every set of `share` positions holds one of them.

    Triples for four positions: three groups of positions in a circle, and the triples
    inside a group or with two in one and one in the next (20 of 56, the fewest known);
    other sizes are chosen greedily.
    """
    width = max(1, share - 1)
    choices = list(combinations(range(positions), width))
    if width == 3:
        inside = lambda c: [sum(p % 3 == g for p in c) for g in range(3)]
        return [c for c in choices if max(n := inside(c)) == 3 or any(n[g] == 2 and n[(g + 1) % 3] == 1 for g in range(3))]
    left, out = set(combinations(range(positions), share)), []
    while left:
        best = max(choices, key=lambda c: (sum(set(c) <= set(x) for x in left), c))
        left = {x for x in left if not set(best) <= set(x)}
        out.append(best)
    return sorted(out)


def tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many positional bytes fingerprints share."""
    x = np.atleast_1d(a ^ b)
    return (x.view(np.uint8).reshape(*x.shape, BYTES) == 0).sum(axis=-1)


def alike(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs are links: first by the guaranteed tally of shared positional bytes, then by their differing bits."""
    near = tally(a, b) >= BYTES - bits
    near[near] = np.bitwise_count((np.atleast_1d(a ^ b))[near]) <= bits
    return near


def forest(entries: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the links among fingerprints: what is reached leaves the rest, so a dense group is walked in few steps."""
    rest = entries
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = alike(rest, x, bits)
            if near.any():
                found, rest = rest[near], rest[~near]
                yield np.broadcast_to(x, found.shape), found
                queue.extend(found)


def links_in_lists(batches: Iterator[tuple[np.ndarray, np.ndarray]], bits: int, small: int = 8) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """From (keys, fingerprints), in their order so that retries give the same, edges that join all fingerprints of a key which are linked: all pairs of lists up to `small`, forests of longer ones. Lists may run over batches; of a list, only the fingerprints are held."""
    held: list[np.ndarray] = []
    held_key = None

    def closed() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if 1 < (n := sum(map(len, held))) <= small:
            own = np.concatenate(held)
            i, j = np.triu_indices(n, 1)
            near = alike(own[i], own[j], bits)
            yield own[i[near]], own[j[near]]
        elif n > small:
            yield from forest(np.concatenate(held), bits)

    for keys, prints in batches:
        if not len(keys):
            continue
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
        if keys[0] != held_key:
            yield from closed()
            held = []
        held_key = keys[0]
        held.append(prints[: ends[0]])
        if len(begins) == 1:
            continue
        yield from closed()
        held, held_key = [prints[begins[-1] :]], keys[-1]
        inner = slice(1, len(begins) - 1)
        sizes, begins, ends = (ends - begins)[inner], begins[inner], ends[inner]
        short, lengths = begins[(sizes > 1) & (sizes <= small)], sizes[(sizes > 1) & (sizes <= small)]
        for i in range(small - 1):
            for j in range(i + 1, small):
                at = short[lengths > j]
                if len(at):
                    a, b = prints[at + i], prints[at + j]
                    near = alike(a, b, bits)
                    if near.any():
                        yield a[near], b[near]
        for k in np.flatnonzero(sizes > small):
            yield from forest(prints[begins[k] : ends[k]], bits)
    yield from closed()


def split_lists(filed: DataFrame, cap: int, n: int, bins: int = 1 << 16, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """filed (key, print) with other keys, so that every list has some 2 * cap rows at most: a longer one is dealt into blocks by hash, and its rows go to the list of each pair of blocks that theirs is in. Any two rows of a list still meet.

    Rows are counted in bins of keys, n rows over so many bins that few of them share one;
    a bin below the cap has no long list. The counts are combined before the shuffle. The
    keys of a bin above it are all dealt into blocks, which costs only copies. Such bins
    are fewer than n / cap; they are counted, and broadcast up to `broadcast_rows`, else
    joined by a shuffle.
    """
    bins = max(bins, n // 1024)
    bin_ = F.pmod(F.col("key"), F.lit(bins))
    long = written(filed.groupBy(bin_.alias("_bin")).count().filter(F.col("count") > cap).select("_bin", F.ceil(F.col("count") / cap).cast("int").alias("_blocks")), "long-lists")
    if not (found := long.count()):
        return filed.select("key", "print")
    brought = F.broadcast(long) if found <= broadcast_rows else sorted_joinable(long)
    own = F.pmod(F.xxhash64(F.lit("block"), "print"), F.col("_blocks")).cast("int")
    dealt = filed.withColumn("_bin", bin_).join(brought, "_bin", "left").withColumn("_own", own)
    dealt = dealt.withColumn("_other", F.explode(F.when(F.col("_blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_blocks") - 1))))
    key = F.when(F.col("_blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other")))
    return dealt.select(key.alias("key"), "print")


def links(prints: DataFrame, bits: int = 4, cap: int = LIST_CAP) -> DataFrame:
    """Edges u, v among distinct fingerprints (print): enough to join all that are linked by chains of at most `bits` differing bits."""
    keys = []
    for k, kept in enumerate(posted(BYTES - bits)):
        mask = sum(0xFF << (8 * p) for p in kept)
        keys.append(F.xxhash64(F.lit(k), F.col("print").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))))
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = prints.repartition(tasks)  # fingerprints are small, but each becomes a row for every posting: AQE would put them into few tasks
    filed = split_lists(spread.select(F.explode(F.array(*keys)).alias("key"), "print"), cap, prints.count() * len(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = ((b.column("key").to_numpy(), b.column("print").to_numpy().view(np.uint64)) for b in batches)
        for u, v in links_in_lists(arrays, bits):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (u, v)], names=["u", "v"])

    found = filed.repartition("key").sortWithinPartitions("key", "print").mapInArrow(run, "u long, v long")
    return found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def near_dedup(documents: DataFrame, shingle: int = 4, bits: int = 4, seed: int = 42) -> DataFrame:
    """Per row: doc_id, fingerprint (a signed long), component_id.

    documents: doc_id, text; other columns are not looked at. Texts without words, null
    ones too, have the fingerprint zero and are linked like any other. A null doc_id is
    kept, but is no component's id unless all ids of the component are null. Repeated
    rows each give a row. An empty table gives no rows. bits: 7 at most, so that a shared
    positional byte is guaranteed.
    """
    if not 0 <= bits < BYTES:
        raise ValueError("bits must lie between 0 and 7")
    prints = written(fingerprints(documents, shingle, seed), "prints")
    distinct = written(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct-prints")
    roots = components(links(distinct.select("print"), bits)).withColumnRenamed("node", "print")
    known = written(distinct.join(sorted_side(roots), "print", "left").withColumn("root", F.coalesce("root", "print")), "roots")
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = known.join(sorted_joinable(least), "root").select("print", "component_id")
    return prints.join(sorted_side(groups), "print").select("doc_id", F.col("print").alias("fingerprint"), "component_id")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
