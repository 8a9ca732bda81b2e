"""Line dedup, SimHash, decontamination and the pipeline against plain Python."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from holdfast.llm import components, decontaminate, line_dedup, near_copies, simhash
from holdfast.llm.common import written

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


# Line dedup

def cut(docs):
    """(doc_id, text) rows with distinct ids -> (n_lines, n_removed, text) by the definition."""
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    lines = {d: (t.split("\n") if t is not None else []) for d, t in order}
    first, cover = {}, {d: set() for d, _ in order}
    for d, _ in order:
        own = [i for i, x in enumerate(lines[d]) if re.search(r"[^\x20\x09-\x0D]", x)]
        for at in zip(own, own[1:], own[2:], strict=False):
            key = tuple(lines[d][i] for i in at)
            if key in first:
                cover[d] |= set(at)
            else:
                first[key] = (d, at)
    return {d: (len(lines[d]), len(cover[d]), None if t is None else "\n".join(x for i, x in enumerate(lines[d]) if i not in cover[d])) for d, t in order}


def test_line_dedup(spark):
    rng = random.Random(4)
    pool = [prose(rng, 4) for _ in range(6)] + ["", "  "]
    docs = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 12)))) for i in range(60)] + [(100, None), (101, ""), (102, "\n\n"), (103, "a\nb"), (None, "\n".join(pool)), (104, "\n".join(["x"] * 3000))]
    df = spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, n_lines int").repartition(5)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup_lines(df).collect()}
    assert got == cut(docs)
    kept = line_dedup.cut_repeated_lines(df.withColumnRenamed("n_lines", "_cut"))
    assert kept.columns == ["doc_id", "text", "_cut"]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_equal_rows_are_one_document(spark):
    df = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc\nd")], "doc_id long, text string")
    assert Counter((r.doc_id, r.text) for r in line_dedup.dedup_lines(df).collect()) == {(1, "a\nb\nc"): 2, (2, "d"): 1}


# SimHash

def bits_of(text, shingle):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    own = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in own]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    rng = random.Random(5)
    for text in [None, "", " \n", "One", "one two three", "É É É É É", "a b c d", prose(rng, 700), "x" * 9000, "\x1f a\x0bb"]:
        for shingle in (4, 5):
            assert simhash.fingerprint(text, shingle) == bits_of(text, shingle)
            assert simhash.fingerprint(text, shingle, block=100) == bits_of(text, shingle)


def test_postings_meet_every_tally():
    """Any set of positions that two linked fingerprints may share holds a posted set, so they meet in a list; by trying all."""
    for bits in range(8):
        posted = simhash.posted(8 - bits)
        assert all(any(set(p) <= set(x) for p in posted) for x in itertools.combinations(range(8), 8 - bits)), bits
    assert len(simhash.posted(4)) == 20 and {len(p) for p in simhash.posted(4)} == {3}


def test_the_tally_comes_before_the_bits():
    a = np.array([0, 0, 0, 0], np.uint64)
    b = np.array([0x0101010100000000, 0x0101010101000000, 0xFF, 0x0F00000000000000], np.uint64)
    assert simhash.tally(a, b).tolist() == [4, 3, 7, 7]
    assert simhash.alike(a, b, 4).tolist() == [True, False, False, True]
    rng = random.Random(3)
    for _ in range(2000):  # no pair within the bits is under the tally
        x, y = rng.getrandbits(64), 0
        for i in rng.sample(range(64), rng.randint(0, 4)):
            y ^= 1 << i
        assert simhash.alike(np.array([x], np.uint64), np.array([x ^ y], np.uint64), 4).all()


def groups_of(values, near):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(values)), 2):
        if near(values[i], values[j]):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("seed,cap,bits", [(0, 1 << 16, 4), (1, 4, 4), (2, 2, 4), (3, 64, 6), (4, 64, 2)])
def test_links_lose_nothing(spark, seed, cap, bits):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(12)]
    values = [0]
    for c in centres:
        for _ in range(20):
            v = c
            for b in rng.sample(range(64), rng.randint(0, 6)):
                v ^= 1 << b
            values.append(v)
    values = sorted(set(values))
    want = groups_of(values, lambda a, b: (a ^ b).bit_count() <= bits)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(s,) for s in signed], "print long").repartition(3)
    roots = {r.node: r.root for r in components.components(simhash.links(df, bits, cap)).collect()}
    roots = {s: roots.get(s, s) for s in signed}
    got: dict = {}
    for s, w in zip(signed, want, strict=True):
        got.setdefault(roots[s], set()).add(w)
    assert all(len(x) == 1 for x in got.values()) and len(got) == len(set(want))


def test_long_lists_are_split(spark):
    df = spark.createDataFrame([(1, i) for i in range(1000)] + [(2, 5)], "key long, print long")
    for broadcast_rows in (10, 0):
        got = [r["count"] for r in simhash.split_lists(df, 100, 1001, broadcast_rows=broadcast_rows).groupBy("key").count().collect()]
        assert max(got) < 300 and len(got) == 1 + 55 and sum(got) == 1 + 1000 * 10


def test_lists_over_batches():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 30, 500))
    prints = rng.integers(0, 64, 500).astype(np.uint64)

    def joined(size):
        batches = [(keys[i : i + size], prints[i : i + size]) for i in range(0, 500, size)]
        return [(int(a), int(b)) for u, v in simhash.links_in_lists(iter(batches), 1) for a, b in zip(u, v, strict=True)]

    whole = joined(500)
    labels = lambda edges: groups_of(range(64), lambda a, b: (a, b) in edges or (b, a) in edges)
    for size in (1, 7, 64):
        assert labels(set(joined(size))) == labels(set(whole))


def test_near_dedup(spark):
    rng = random.Random(6)
    base = [prose(rng, 200) for _ in range(15)]
    docs = []
    for t in base:
        for _ in range(4):
            words = t.split()
            for i in rng.sample(range(len(words)), rng.choice([0, 0, 1, 2])):
                words[i] = rng.choice(WORDS)
            docs.append(" ".join(words))
    rows = [(i, t) for i, t in enumerate(docs)] + [(900, None), (901, ""), (None, docs[0]), (902, docs[0]), (902, docs[0])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, print string").repartition(4)
    prints = [bits_of(t, 4) for _, t in rows]
    want = groups_of(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {g: min((rows[i][0] for i in range(len(rows)) if want[i] == g and rows[i][0] is not None), default=None) for g in set(want)}
    got = Counter((r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in simhash.near_dedup(df).collect())
    assert got == Counter((i, p, least[g]) for (i, _), p, g in zip(rows, prints, want, strict=True))
    assert simhash.near_dedup(df.limit(0)).count() == 0


def fresh_words(rng, n):
    return [f"w{rng.getrandbits(40)}" for _ in range(n)]


def grams_of(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def changed(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = fresh_words(rng, 1)[0]
    return words


def kept_of(spark, texts):
    """Which of the texts stay, and which should by plain Jaccard over all pairs."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id for r in near_copies.keep_one_of_each(df).collect()}, set(groups_of([grams_of(t.split()) for t in texts], lambda a, b: len(a & b) >= 0.8 * len(a | b)))


def test_near_copies_within_a_large_loose_group(spark):
    rng = random.Random(10)
    base = fresh_words(rng, 400)
    texts = [" ".join(base)]
    for _ in range(30):
        own = changed(rng, base, 26)
        texts += [" ".join(own), " ".join(changed(rng, own, 6))]
    got, want = kept_of(spark, texts)
    assert got == want and 20 <= len(want) <= 40


@pytest.mark.parametrize("templates", [1, 4])
def test_blocks_of_a_group_lose_no_link(spark, templates):
    rng = random.Random(14)
    bases = [fresh_words(rng, 200) for _ in range(templates)]
    for other in bases[1:]:
        other[:60] = bases[0][:60]  # a passage that joins the templates to one group
    texts = [changed(rng, bases[k % templates], rng.randint(2, 8 if templates == 1 else 5)) for k in range(60)]
    grams = [np.unique(np.array([xxhash.xxh64_intdigest(" ".join(w[i : i + 5])) for i in range(196)], np.uint64).view(np.int64)) for w in texts]
    alike = lambda i, j: len(np.intersect1d(grams[i], grams[j])) >= 0.8 * len(np.union1d(grams[i], grams[j]))
    want = groups_of(range(60), alike)
    df = spark.createDataFrame([(i, g.tolist()) for i, g in enumerate(grams)], "node long, grams array<long>")
    filed = near_copies.rarest(df, 0.8).cache()
    groups = near_copies.grouped(filed)
    for cap, whole in ((1024, 1024), (7, 1024), (7, 7), (1, 1)):
        edges = {(r.u, r.v) for r in near_copies.verified_links(filed, groups, df, 0.8, cap, whole).collect()}
        assert all(alike(u, v) for u, v in edges)
        assert groups_of(range(60), lambda a, b: (a, b) in edges or (b, a) in edges) == want and 1 < len(set(want)) < 60


def test_lists_hold_few_rows_and_all_pairs(spark):
    rng = random.Random(16)
    rows = [(1, n, 0) for n in range(50)] + [(1, n, n) for n in range(50, 60)] + [(2, n, 7) for n in range(30)] + [(3, n, n // 9) for n in range(40)]
    rng.shuffle(rows)
    got: dict = {}
    for r in near_copies.dealt_lists(spark.createDataFrame(rows, "h int, node long, comp long"), 8).collect():
        got.setdefault(r.key, []).append((r.own, r.node))
    met = {frozenset((a, b)) for own in got.values() for (x, a), (y, b) in itertools.combinations(own, 2) if x != y or len({z for z, _ in own}) == 1}
    for h in (1, 3):
        own = [(n, c) for k, n, c in rows if k == h]
        assert all(frozenset((a, b)) in met for (a, x), (b, y) in itertools.combinations(own, 2) if x != y)
    assert max(map(len, got.values())) <= 40 and sum(map(len, got.values())) < 6 * len(rows)


def test_recall_by_band_of_similarity(spark):
    rng = random.Random(11)
    texts, bands = [], {}
    while len(texts) < 600:
        words = fresh_words(rng, rng.randint(120, 400))
        other = changed(rng, words, rng.randint(1, len(words) // 35))
        a, b = grams_of(words), grams_of(other)
        if (j := len(a & b) / len(a | b)) >= 0.8:
            bands.setdefault(int(50 * j + 1e-9) / 50, []).append(len(texts) + 1)
            texts += [" ".join(words), " ".join(other)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in near_copies.keep_one_of_each(df).collect()}
    found = {b: 1 - len(got & set(ids)) / len(ids) for b, ids in sorted(bands.items())}
    assert found == dict.fromkeys(found, 1.0) and len(bands[0.8]) >= 20 and got == set(range(0, 600, 2))


def test_a_repeated_phrase_makes_no_near_copies(spark):
    rng = random.Random(12)
    texts = []
    for phrase, times in ((3, 40), (5, 30), (3, 80)):
        own = fresh_words(rng, phrase) * times
        texts += [" ".join(fresh_words(rng, 150) + own + fresh_words(rng, 150)) for _ in range(5)]
    got, want = kept_of(spark, texts)
    assert got == want == set(range(15))


def test_copies_that_differ_in_how_often_a_phrase_comes(spark):
    rng = random.Random(13)
    texts = []
    for phrase, times in ((5, 30), (8, 20), (20, 8)):
        before, own, after = fresh_words(rng, 150), fresh_words(rng, phrase), fresh_words(rng, 150)
        texts += [" ".join(before + own * n + after) for n in (1, times)]
    got, want = kept_of(spark, texts)
    assert got == want == {0, 2, 4}


def test_near_copies_go_through_the_byte_position_index(spark, monkeypatch):
    rng = random.Random(17)
    base = [fresh_words(rng, 300) for _ in range(10)]
    texts = [" ".join(w) for own in base for w in (own, changed(rng, own, 1))]
    asked, got = [], []
    links, print_links = simhash.links, near_copies.print_links
    monkeypatch.setattr(near_copies.simhash, "links", lambda prints, *a, **b: asked.append(prints.count()) or links(prints, *a, **b))
    monkeypatch.setattr(near_copies, "print_links", lambda *a, **b: got.append(print_links(*a, **b)) or got[-1])
    assert kept_of(spark, texts) == (set(range(0, 20, 2)),) * 2
    prints = [near_copies.fingerprint(near_copies.shingle_hashes(t, 5)) for t in texts]
    close = sum((prints[i] ^ prints[i + 1]).bit_count() <= 4 for i in range(0, 20, 2))
    assert asked == [len(set(prints))] and got[0].count() == close > 3


def test_links_of_the_index_are_verified(spark):
    nodes = spark.createDataFrame([(1, 5), (2, 5), (3, 4), (4, 5), (9, 5), (5, ~5)], "node long, print long")
    grams = spark.createDataFrame([(1, list(range(10))), (2, list(range(20, 30))), (3, list(range(1, 10))), (4, list(range(10, 19))), (5, list(range(10)))], "node long, grams array<long>")
    assert {frozenset(r) for r in near_copies.print_links(nodes, grams, 0.8).collect()} == {frozenset((1, 3))}
    assert near_copies.fingerprint(np.array([], np.int64)) == 0 and near_copies.fingerprint(np.array([-2, 6, 3], np.int64)) == 6 | 2


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1002), (1000, 1002), (5, 5)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000, 1002: 1000}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_of_few_edges_take_one_task(spark, monkeypatch):
    rng = random.Random(19)
    own = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1200)] + [(2000, 2000 - i) for i in range(1, 50)] + [(-(1 << 63), (1 << 63) - 1)]
    rng.shuffle(own)
    least = {n: n for e in own for n in e if e[0] != e[1]}
    while any(least[u] != least[v] for u, v in own if u != v):
        for u, v in own:
            if u != v:
                least[u] = least[v] = min(least[u], least[v])
    names = []
    monkeypatch.setattr(components, "written", lambda df, name: names.append(name) or written(df, name))
    df = spark.createDataFrame(own, "u long, v long").repartition(5)
    for edges, want in ((df, least), (df.limit(0), {})):
        names.clear()
        assert sorted(map(tuple, components.components(edges).collect())) == sorted(want.items()) and names == ["edges", "components"]
    assert sorted(map(tuple, components.components(df, one_task=0).collect())) == sorted(least.items()) and len(names) > 4


def test_near_copies_build_no_side_of_a_join_on_the_driver(spark, monkeypatch):
    """Under Spark's default threshold, under which all these tables are."""
    rng = random.Random(20)
    bases = [fresh_words(rng, 200) for _ in range(6)]
    texts = [" ".join(changed(rng, own, 8)) for own in bases for _ in range(12)] + [" ".join(own) for own in bases]
    plans = []

    def watched(df, name):
        df.collect()
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return written(df, name)

    for module in (components, near_copies, simhash):
        monkeypatch.setattr(module, "written", watched)
    monkeypatch.setattr(near_copies.verified_links, "__defaults__", (4, 8, None))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    components.components(spark.createDataFrame([(i, i + 1) for i in range(20)], "u long, v long"), one_task=0)
    watched(near_copies.keep_one_of_each(df), "kept")
    assert {"large-lists", "star-links", "kept"} <= {name for name, _ in plans} and [name for name, plan in plans if "Broadcast" in plan] == []


# Decontamination

def test_masks_hit_every_window_that_passes():
    def hit(n, gone):
        masks = decontaminate.MASKS + (decontaminate.SHORT_MASKS if n < decontaminate.WINDOW else ())
        return any(all(not (c == "1" and s + i in gone) for i, c in enumerate(m)) for m in masks for s in range(n - len(m) + 1))

    for n in range(decontaminate.SHORTEST, decontaminate.WINDOW + 1):
        most = n - int(np.ceil(decontaminate.SHARE * n - 1e-9))
        assert all(hit(n, set(gone)) for gone in itertools.combinations(range(n), most)), n


def tokens(text):
    return [w for w in re.split(r"[^\w]|_", (text or "").lower()) if w]


def best_overlaps(docs, items):
    out = {}
    for d, text in docs:
        a = tokens(text)
        for i, it in items:
            b = tokens(it)
            width = min(20, len(b))
            if not b:
                continue
            least = len(b) if len(b) < 10 else np.ceil(0.8 * width - 1e-9)
            for shift in range(-len(b) + 1, len(a)):
                lo, hi = max(0, -shift), min(len(b), len(a) - shift)
                same = [a[shift + j] == b[j] for j in range(lo, hi)]
                if len(same) >= width:
                    m = max(sum(same[s : s + width]) for s in range(len(same) - width + 1))
                    if m >= least:
                        out[d, i] = max(out.get((d, i), 0), m)
    return out


@pytest.mark.parametrize("most_seeds", [1_000_000, 60])
def test_overlaps(spark, most_seeds):
    rng = random.Random(8)
    items = [(i, prose(rng, n)) for i, n in enumerate([45, 30, 20, 14, 10, 9, 4, 0])] + [(50, None), (51, "zyzzyva")]
    docs = []
    for k in range(40):
        words = prose(rng, rng.randint(0, 60)).split()
        if k % 2:
            own = items[k // 2 % 7][1].split()
            own = own[rng.randint(0, len(own) // 3) :]
            for i in rng.sample(range(len(own)), rng.randint(0, max(1, len(own) // 6))):
                own[i] = "zz"
            at = rng.randint(0, len(words))
            words[at:at] = own
        docs.append((k, ", ".join(words).upper() if k % 3 else " ".join(words)))
    docs += [(100, None), (101, ""), (102, items[0][1]), (103, "a b"), (104, "the Zyzzyva, " + items[6][1]), (104, "the Zyzzyva, " + items[6][1])]
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, h string")
    got = {(r.doc_id, r.item_id): r.best for r in decontaminate.overlaps(df, bench, most_seeds=most_seeds).collect()}
    want = best_overlaps(docs, items)
    assert got == want and len(want) > 10 and {(104, 6), (104, 51)} <= set(want)
    kept = {r.doc_id for r in decontaminate.drop_contaminated(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.overlaps(df, bench.limit(0)).count() == 0 and decontaminate.overlaps(df.limit(0), bench).count() == 0


def test_null_ids_are_told_apart_by_text(spark):
    item = prose(random.Random(9), 40)
    df = spark.createDataFrame([(None, "x " + item, 1), (None, "clean", 2), (3, item, 3), (3, "clean", 4)], "doc_id long, text string, _text_hash int")
    bench = spark.createDataFrame([(None, item)], "item_id long, text string")
    assert {r._text_hash for r in decontaminate.drop_contaminated(df, bench).collect()} == {2, 4}
