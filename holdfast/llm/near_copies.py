"""Near copies by the Jaccard similarity of word shingles: the pipeline's stage of SimHash near-dedup, made exact.

First comes the method of `simhash`: each text's fingerprint, here of its distinct
shingles, goes through the byte-position index, pairs are tallied and held against the
bits, and what is linked so is verified by whole sets. No number of fingerprint bits or
bytes guarantees a Jaccard similarity, so the pairs that this leaves come from an inverted
index over the shingles themselves, filtered by counting too: two texts of the similarity
share a guaranteed number of shingles among the first of their order (prefix filter), and
those that reach it are grouped by their rarest shingles and verified by whole sets. Copies are never expanded
into pairs: equal sets of shingles are one node, and links leave a task as a spanning
forest. All joins here are by shuffles and sorting, so that none is built on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm import simhash
from holdfast.llm.common import sorted_joinable, sorted_side, written
from holdfast.llm.components import components
from holdfast.llm.quality import fresh
from holdfast.llm.simhash import TO_LOWER

SHINGLE = 5
SIMILARITY = 0.8
BITS = 4  # that the fingerprints of a link may differ in
LIST_CAP = 256  # texts of a list, and of a block of a longer one
WHOLE_GROUP = 8192  # texts up to which a group is compared as one; a larger one is, shingle by shingle


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Distinct hashes of the word shingles, in order; of the whole where there are fewer words, none without words."""
    words = (text or "").encode("utf-8").translate(TO_LOWER).split()
    own = {xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle])) for i in range(max(1, len(words) - shingle + 1))} if words else set()
    return np.sort(np.fromiter(own, np.uint64, len(own)).view(np.int64))


def fingerprint(grams: np.ndarray) -> int:
    """As `simhash.fingerprint`, over distinct shingles, so that its bits follow the similarity; zero without words."""
    return int(np.packbits(2 * simhash.bit_sums(grams.view(np.uint64)) > len(grams)).view(">u8")[0]) if len(grams) else 0


def overlap(n: int, similarity: float) -> int:
    """How many of its n shingles a text shares, at least, with any other of the similarity."""
    return max(1, math.ceil(similarity * n - 1e-9))


def spare(n: int) -> int:
    return max(1, n // 5)


def head(n: int, similarity: float) -> int:
    """In any one order of all shingles, two texts of the similarity share `spare` of the shorter's n among their first so many, as each has no more than n - overlap that the other lacks."""
    return min(n, n - overlap(n, similarity) + spare(n))


def shingle_sets(documents: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Per row: doc_id, text_hash, node (a hash of the set of shingles), print (its fingerprint, a signed long), need (how many of its head another text must share) and head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [shingle_hashes(t.as_py(), shingle) for t in batch.column("text")]
            nodes = np.array([xxhash.xxh64_intdigest(g.tobytes()) for g in grams], np.uint64).view(np.int64)
            prints = np.array([fingerprint(g) for g in grams], np.uint64).view(np.int64)
            needs = [spare(overlap(len(g), similarity)) for g in grams]
            heads = pa.array([g[: head(len(g), similarity)] for g in grams], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(nodes), pa.array(prints), pa.array(needs, pa.int64()), heads], names=["doc_id", "text_hash", "node", "print", "need", "head"])

    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return own.mapInArrow(run, "doc_id long, text_hash long, node long, print long, need long, head array<long>")


def grams_of(places: DataFrame, documents: DataFrame, shingle: int) -> DataFrame:
    """node, grams of the documents that stand for the nodes. places: node, first (n, doc_id, text_hash)."""
    wanted = places.select("node", F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"))
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    texts = own.join(sorted_side(wanted), (own["text_hash"] == wanted["_hash"]) & own["doc_id"].eqNullSafe(wanted["_id"])).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [shingle_hashes(t.as_py(), shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(grams, pa.list_(pa.int64()))], names=["node", "grams"])

    return texts.mapInArrow(run, "node long, grams array<long>").dropDuplicates(["node"])


def rarest(grams: DataFrame, similarity: float) -> DataFrame:
    """node, h: of each text's n shingles the n - overlap + 1 with the fewest texts, of those that another text has too. Any two texts of the similarity share one."""
    n = F.size("grams")
    rows = grams.select("node", n.alias("n"), F.explode("grams").alias("h"))
    counts = written(rows.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1"), "gram-counts")
    common = rows.join(sorted_joinable(counts), "h")
    kept = F.col("n") - F.greatest(F.lit(1), F.ceil(F.lit(similarity) * F.col("n") - F.lit(1e-9))) + 1
    alone = F.col("n") - F.size("of")  # those of no other text are the rarest
    filed = common.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("of"))
    return filed.select("node", F.explode(F.slice("of", F.lit(1), F.greatest(F.lit(0), kept - alone).cast("int"))).alias("x")).select("node", F.col("x.h").alias("h"))


def grouped(filed: DataFrame) -> DataFrame:
    """node, root: components of the texts that share one of the filed shingles, as all pairs of the similarity do. Those that share none are left out."""
    least = filed.groupBy("h").agg(F.min("node").alias("v"))
    return components(filed.join(sorted_joinable(least), "h").select(F.col("node").alias("u"), "v"))


def alike(sides: np.ndarray, grams: list[np.ndarray], similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of all pairs that have the similarity, on two sides if there are two. Every such pair is looked at unless its texts are joined already; shared shingles are counted over posting lists, which lose what is reached."""
    n, sizes = len(grams), np.array([len(g) for g in grams])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.unique(np.concatenate(grams), return_inverse=True)[1]
    by_id = np.argsort(ids, kind="stable")
    terms, holders = ids[by_id], np.repeat(np.arange(n), sizes)[by_id]
    rest, left, whole = np.ones(n, bool), n, (sides == sides[0]).all()
    begins = np.searchsorted(terms, np.arange(len(ids) + 1))
    for first in range(n):
        if not rest[first]:
            continue
        rest[first] = False
        queue = [first]
        while queue and rest.any():
            x = queue.pop()
            if 2 * rest.sum() < left:
                left = rest.sum()
                terms, holders = terms[rest[holders]], holders[rest[holders]]
                begins = np.searchsorted(terms, np.arange(len(ids) + 1))
            own = ids[bounds[x] : bounds[x + 1]]
            lengths = begins[own + 1] - begins[own]
            at = np.repeat(begins[own] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            shared = np.bincount(holders[at], minlength=n)
            near = rest & (shared >= similarity * (sizes + sizes[x] - shared))
            if not whole:
                near &= sides != sides[x]
            found = np.flatnonzero(near)
            if len(found):
                rest[found] = False
                yield np.full(len(found), x), found
                queue.extend(found.tolist())


def links_in_lists(lists: DataFrame, similarity: float) -> DataFrame:
    """Edges u, v that join all nodes of a list which have the similarity by chains. lists: key, own (the side; nodes of one side are compared only if there is no other), node, grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(rows: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                nodes = np.array([r[1] for r in rows], np.int64)
                for u, v in alike(np.array([r[0] for r in rows]), [r[2] for r in rows], similarity):
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[u]), pa.array(nodes[v])], names=["u", "v"])

        held: list[tuple[int, int, np.ndarray]] = []
        held_key = None
        for batch in batches:
            column = batch.column("grams")
            values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
            for k, (key, own, node_) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("key", "own", "node")], strict=True)):
                if key != held_key:
                    yield from closed(held)
                    held, held_key = [], key
                held.append((own, node_, values[offsets[k] : offsets[k + 1]]))
        yield from closed(held)

    return lists.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "u long, v long")


def verified_pairs(pairs: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """The pairs u, v that have the similarity."""
    side = lambda at: sorted_joinable(grams.select(F.col("node").alias(at), F.col("grams").alias(f"_{at}")))
    both = F.size(F.array_intersect("_u", "_v"))
    return pairs.filter("u <> v").distinct().join(side("u"), "u").join(side("v"), "v").filter(both >= F.lit(similarity) * (F.size("_u") + F.size("_v") - both)).select("u", "v")


def print_links(nodes: DataFrame, grams: DataFrame, similarity: float, bits: int = BITS) -> DataFrame:
    """Edges u, v that have the similarity, by the byte-position index of the fingerprints. nodes: node, print.

    Nodes of one fingerprint are held against the least of them, and those least against
    each other where the index links their fingerprints. Nodes without grams have no pair
    of the similarity. Which pairs a star or the bits leave out is for the shingles to find.
    """
    least = written(nodes.groupBy("print").agg(F.min("node").alias("least")), "prints")
    same = nodes.join(sorted_joinable(least), "print").select(F.col("node").alias("u"), F.col("least").alias("v"))
    side = lambda at: sorted_joinable(least.select(F.col("print").alias(at), F.col("least").alias(f"_{at}")))
    across = simhash.links(least.select("print"), bits).join(side("u"), "u").join(side("v"), "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
    return verified_pairs(same.unionByName(across), grams, similarity)


def dealt_lists(rows: DataFrame, cap: int) -> DataFrame:
    """key, own, node: lists of some 2 * cap rows at most in which any two nodes of one h meet that are of different components. rows: h, node, comp (once for each h and node).

    The largest component of an h is one side. Only pairs with a node outside of it are
    looked for: the others are dealt into blocks of cap rows, and meet each other and the
    blocks of the large side. Where there are few others, as in a group of copies of one
    text, every row is in few lists. An h of one component has none. A side of fewer than
    64 * cap rows has smaller blocks, so that it too is dealt over many tasks.
    """
    counts = rows.groupBy("h", "comp").agg(F.count("*").alias("c"))
    sizes = counts.groupBy("h").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("s"), (F.sum("c") - F.max("c")).alias("r")).filter("r > 0")
    many = lambda n: F.ceil(F.col(n) / F.least(F.lit(cap), F.greatest(F.lit(min(cap, 64)), F.ceil(F.col(n) / 64)))).cast("int")
    blocks = sizes.select("h", "main", many("s").alias("a"), many("r").alias("b"))
    own = rows.join(sorted_joinable(blocks), "h").withColumn("large", F.col("comp") == F.col("main"))
    place = F.pmod(F.xxhash64(F.lit("block"), "node"), F.when(F.col("large"), F.col("a")).otherwise(F.col("b"))).cast("int")
    own = own.withColumn("place", place)
    meets = F.when(F.col("large"), F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda j: F.struct(F.lit(0).alias("kind"), F.col("place").alias("x"), j.alias("y")))).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("a") - 1), lambda i: F.struct(F.lit(0).alias("kind"), i.alias("x"), F.col("place").alias("y"))),
            F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda j: F.struct(F.lit(1).alias("kind"), F.least(j, F.col("place")).alias("x"), F.greatest(j, F.col("place")).alias("y"))),
        )
    )
    out = own.withColumn("at", F.explode(meets))
    side = F.when(F.col("at.kind") == 0, F.when(F.col("large"), 0).otherwise(1)).otherwise(F.col("place"))
    return out.select(F.xxhash64("h", "at.kind", "at.x", "at.y").alias("key"), side.cast("int").alias("own"), "node")


def large_links(filed: DataFrame, groups: DataFrame, grams: DataFrame, similarity: float, cap: int, whole: int, links: DataFrame | None = None) -> DataFrame:
    """Edges as `verified_links`, of groups that are too large for one list; what `links` joins already is not compared in lists.

    First every node is held against its group's root, and those that this does not join
    against the least node of each of their shingles; both are a number of pairs that is
    linear in the rows. Then what is not yet joined is compared: within groups of up to
    `whole` nodes, and shingle by shingle in larger ones, whose nodes may have little to
    do with each other.
    """
    first = written(verified_pairs(groups.select(F.col("node").alias("u"), F.col("root").alias("v")), grams, similarity), "root-links")
    joined = groups.join(sorted_joinable(first.select(F.col("u").alias("node"), F.lit(True).alias("joined"))), "node", "left").withColumn("joined", F.coalesce("joined", F.col("node") == F.col("root")))
    own = written(filed.join(sorted_joinable(joined), "node"), "large-filed")
    pivots = own.groupBy("h").agg(F.min("node").alias("v"))
    second = verified_pairs(own.filter("not joined").join(sorted_joinable(pivots), "h").select(F.col("node").alias("u"), "v"), grams, similarity)
    known = written(first.unionByName(second), "star-links")
    roots = components(known if links is None else known.unionByName(links))
    sizes = groups.groupBy("root").agg(F.count("*").alias("size"))
    sized = written(groups.join(sorted_joinable(sizes), "root"), "large-sizes")
    as_one = sized.filter(F.col("size") <= whole).select(F.xxhash64(F.lit("group"), "root").alias("h"), "node")
    by_shingle = own.select("h", "node").join(sorted_joinable(sized.filter(F.col("size") > whole).select("node")), "node").select("h", "node")
    comp = as_one.unionByName(by_shingle).join(sorted_joinable(roots.withColumnRenamed("root", "comp")), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    lists = dealt_lists(written(comp, "large-lists"), cap)
    return known.unionByName(links_in_lists(lists.join(sorted_joinable(grams), "node").select("key", "own", "node", "grams"), similarity))


def verified_links(filed: DataFrame, groups: DataFrame, grams: DataFrame, similarity: float, cap: int = LIST_CAP, whole: int = WHOLE_GROUP, links: DataFrame | None = None) -> DataFrame:
    """Edges u, v that join all nodes of a group which have the similarity by chains; every edge is verified by whole sets. A group of up to `cap` nodes is one list. links: edges that are verified already, and returned too."""
    sizes = written(groups.groupBy("root").agg(F.count("*").alias("size")).filter("size > 1"), "group-sizes")
    sized = groups.join(sorted_joinable(sizes), "root")
    small = sized.filter(F.col("size") <= cap).select(F.xxhash64("root").alias("key"), F.lit(0).alias("own"), "node")
    found = links_in_lists(grams.join(sorted_side(small), "node").select("key", "own", "node", "grams"), similarity)
    large = written(sized.filter(F.col("size") > cap).select("node", "root"), "large-groups")
    found = found if links is None else found.unionByName(links)
    return found if large.isEmpty() else found.unionByName(large_links(filed, large, grams, similarity, cap, whole, links))


def keep_one_of_each(documents: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The document with the least doc_id (null last) of each component, with its columns as they were. Rows equal in doc_id and text are one document, and stay or go together.

    Links are all pairs whose sets of shingles have the Jaccard similarity; texts without
    words are alike; a null text has none. An empty table stays empty. The texts that may
    have a partner at all are found by the heads of their shingles in order of hash.
    Links come first from the fingerprints of all texts by their byte-position index,
    verified by whole sets; then the texts are grouped by their rarest shingles, and
    compared by whole sets within the groups, so that no pair is left out.
    """
    hashed = fresh(documents, "_text_hash")
    sets = written(shingle_sets(documents, shingle, similarity), "sets")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")
    places = written(sets.groupBy("node", "print", "need").agg(F.min(order).alias("first"), F.count("*").alias("copies")), "places")

    rows = sets.select("node", F.explode("head").alias("h"))
    shared = written(rows.groupBy("h").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("h"), "shared")
    found = rows.join(sorted_joinable(shared), "h").groupBy("node").agg(F.count("*").alias("found"))
    paired = places.join(sorted_side(found), "node").filter(F.col("found") >= F.col("need") * F.col("copies")).select("node", "first")

    grams = written(grams_of(paired, documents, shingle), "grams")
    filed = written(rarest(grams, similarity), "filed")
    groups = written(grouped(filed), "groups")
    linked = written(print_links(places.select("node", "print"), grams, similarity), "print-links")
    roots = components(verified_links(filed, groups, grams, similarity, links=linked))

    final = places.join(sorted_side(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = final.groupBy("root").agg(F.min("first").alias("first"))
    first = first.select(F.col("first.doc_id").alias("_first_id"), F.col("first.text_hash").alias("_first_hash"))
    own = documents.withColumn(hashed, F.xxhash64("text"))
    return own.join(sorted_side(first), (own[hashed] == first["_first_hash"]) & own["doc_id"].cast("long").eqNullSafe(first["_first_id"]), "left_semi").drop(hashed)
