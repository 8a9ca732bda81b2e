"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask laid over consecutive tokens: positions with 1 are hashed together,
positions with 0 are ignored, so a substitution under a 0 does not disturb it. Every
position of every document gives one hash for each mask; those that a benchmark item
also gives are hits. Around a hit, document and item are laid side by side without gaps,
and the document is contaminated if some window of the item agrees in enough tokens. The
masks are such that every window that passes is hit (checked by trying all patterns of
substitutions in the tests). Items of a few tokens have one seed, the whole item, and
must be found word for word. Seeds of a benchmark of bounded size are broadcast, so that
documents are not shuffled by seed; those of a larger one are joined by a shuffle of
hashes alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.common import table, written
from holdfast.llm.quality import fresh
from holdfast.operators.frames import joinable

#: Found by trying all masks of weight 6 and span 11 at most: every choice of 4 substitutions among 20 tokens leaves a hit.
MASKS = ("1111011", "1110111", "1110100011")
#: For items shorter than the window, of weight 5: with these, every choice of a fifth of the tokens leaves a hit at every length from SHORTEST on.
SHORT_MASKS = ("1001111", "111101")
WINDOW = 20
SHARE = 0.8
SHORTEST = 10  # items of fewer tokens must be found whole and without a substitution
MOST_SEEDS = 1_000_000  # that are broadcast
AT_ONCE = 4096  # positions of a document that are laid out at a time, so that memory does not grow with its length


def tokens_of(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits; none for a null."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds_at_positions(df: DataFrame, h: str, masks: dict[str, Column | None]) -> DataFrame:
    """df with a row for each position of array h and mask that fits there: p from 0, seed. masks: with the rows that they are laid on, None for all."""
    span = max(map(len, masks))
    blocks = df.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.size(h) - 1, F.lit(0)), F.lit(AT_ONCE))).alias("from"))
    ahead = [F.slice(F.col(h), F.col("from") + k + 1, F.lit(AT_ONCE)).alias(f"t{k}") for k in range(span)]
    rows = blocks.select("*", F.posexplode(F.arrays_zip(*ahead)).alias("in_block", "z")).withColumn("p", F.col("from") + F.col("in_block")).drop("from", "in_block")
    at = lambda k: F.col("z")[f"t{k}"]
    fits = lambda m, own: at(len(m) - 1).isNotNull() if own is None else at(len(m) - 1).isNotNull() & own
    seeds = [F.when(fits(m, own), F.xxhash64(F.lit(m), *[at(k) for k, c in enumerate(m) if c == "1"])) for m, own in masks.items()]
    return rows.withColumn("seed", F.explode(F.array(*seeds))).drop("z").filter("seed is not null")


def need(size: Column, window: int, share: float) -> Column:
    """Tokens of an item's best window that must agree."""
    return F.when(size < SHORTEST, size).otherwise(F.ceil(F.lit(share) * F.least(F.lit(window), size) - F.lit(1e-9)).cast("int"))


def overlaps(documents: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, share: float = SHARE, most_seeds: int = MOST_SEEDS) -> DataFrame:
    """Per contaminated document and item: doc_id, text_hash, item_id, best (tokens that agree in the best window), matched (tokens that agree on that alignment).

    documents: doc_id, text; benchmark: item_id, text; other columns are not looked at.
    Texts are compared as hashes of lower-cased runs of letters and digits. An item
    shorter than the window is one window; one under SHORTEST tokens must be there whole,
    even a single word, so a benchmark should not hold items that mean nothing. Null and
    empty texts have no tokens and overlap with nothing; a null doc_id or item_id is kept
    as it is; rows that are equal in doc_id and text count once. Either table may be
    empty, and then there are no rows.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), tokens_of(F.col("text")).alias("h"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens_of(F.col("text")).alias("item")).filter(F.size("item") > 0).distinct()
    items = written(items.withColumn("item_key", F.xxhash64("item_id", "item")), "items")
    size = F.size("item")
    known = items.agg(F.sum(size).alias("tokens"), F.collect_set(F.when(size < SHORTEST, size)).alias("short")).first()  # nine lengths at most
    laid: dict[str, Column | None] = {m: size >= SHORTEST for m in masks} | {m: size.between(SHORTEST, window - 1) for m in SHORT_MASKS} | {"1" * n: size == n for n in sorted(known["short"])}
    few = (known["tokens"] or 0) * (len(masks) + len(SHORT_MASKS)) <= most_seeds

    seeds = seeds_at_positions(items, "item", laid).select("seed", "item_key", size.alias("n"), F.col("p").alias("q")).distinct()
    begin = (F.col("p") - F.col("q")).alias("begin")
    part = F.slice("h", F.greatest(F.col("begin"), F.lit(0)) + 1, F.col("n") + F.least(F.col("begin"), F.lit(0)))
    positions = seeds_at_positions(docs, "h", dict.fromkeys(laid))
    if few:
        hits = positions.join(F.broadcast(seeds), "seed").select("doc_id", "text_hash", "h", "item_key", "n", begin)
        aligned = hits.select("doc_id", "text_hash", "item_key", "n", "begin", part.alias("part")).distinct().join(F.broadcast(items), "item_key")  # fewer rows than the seeds
    else:
        hits = positions.select("doc_id", "text_hash", "p", "seed").join(joinable(seeds), "seed").select("doc_id", "text_hash", "item_key", "n", begin).distinct()
        same_doc = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_hash") == F.col("_text_hash"))
        own = hits.withColumnsRenamed({"doc_id": "_doc_id", "text_hash": "_text_hash"}).join(docs.dropDuplicates(["doc_id", "text_hash"]), same_doc)
        aligned = own.select("doc_id", "text_hash", "item_key", "n", "begin", part.alias("part")).join(joinable(items), "item_key")

    item = F.slice("item", F.greatest(-F.col("begin"), F.lit(0)) + 1, F.size("item"))
    same = F.transform(F.arrays_zip(item.alias("a"), F.col("part").alias("b")), lambda z: F.coalesce(z["a"] == z["b"], F.lit(False)).cast("int"))
    pairs = aligned.withColumn("same", F.array_compact(same)).withColumn("width", F.least(F.lit(window), F.size("item")))
    ends = F.sequence(F.lit(1), F.greatest(F.size("same") - F.col("width") + 1, F.lit(1)))
    best = F.array_max(F.transform(ends, lambda i: F.aggregate(F.slice("same", i, F.col("width")), F.lit(0), lambda s, x: s + x)))
    found = pairs.select("doc_id", "text_hash", "item_id", best.alias("best"), F.aggregate("same", F.lit(0), lambda s, x: s + x).alias("matched"), need(size, window, share).alias("least"))
    found = found.filter("best >= least").drop("least")
    return found.groupBy("doc_id", "text_hash", "item_id").agg(F.max("best").alias("best"), F.max_by("matched", F.struct("best", "matched")).alias("matched"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents without a benchmark item, with their columns as they were.

    A null text holds no item and stays; null ids are told apart by their texts; rows
    equal in doc_id and text stay or go together. With an empty benchmark all rows stay;
    an empty table of documents stays empty.
    """
    name = fresh(documents, "_text_hash")
    bad = overlaps(documents, benchmark).select(F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash")).distinct()
    own = documents.withColumn(name, F.xxhash64("text"))
    return own.join(bad, (own[name] == bad["_bad_hash"]) & own["doc_id"].cast("long").eqNullSafe(bad["_bad_id"]), "left_anti").drop(name)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")
