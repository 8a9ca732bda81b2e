"""Operators against their definitions in plain Python, over random cases."""

import datetime
import hashlib
import math
import random
import statistics
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.functions import align, keys, records, vectors
from holdfast.operators import aggregates, clean, metrics, runs, search, selection, store, structures
from holdfast.plans import splits, transfer
from holdfast.sources import io, shared

c = F.col


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# Selection and assignment

def walk(sizes, budget):
    """Places of the sizes that a greedy walk takes; None counts as 0."""
    out, total = [], 0
    for i, n in enumerate(sizes):
        if total + (n or 0) <= budget:
            total += n or 0
            out.append(i)
    return out


def test_greedy_fill(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.choice([None, 0, 1, 2, 5, 9, 30])) for g in range(12) for i in range(rng.choice([0, 1, 2, 15]))]
    budgets = {g: rng.choice([0, 1, 13, 40, 10**6]) for g in range(12)}
    df = frame(spark, [(g, i, n, budgets[g]) for g, i, n in rows], "g int, i int, n long, b long").repartition(5)
    got = {(r.g, r.i) for r in selection.greedy_fill(df, [c("i")], "n", c("b"), by="g").filter("taken").collect()}
    assert got == {(g, i) for g in range(12) for i in walk([n for h, _, n in rows if h == g], budgets[g])}
    one = [n for _, _, n in rows]
    df = frame(spark, list(enumerate(one)), "i int, n long")
    for budget in (0, 7, 50):
        want = set(walk(one, budget))
        assert {r.i for r in selection.greedy_fill(df, [c("i")], "n", F.lit(budget)).filter("taken").collect()} == want
        assert {r.i for r in selection.greedy_fill_folded(df, "i", ["i"], "n", budget).collect()} == want
    assert selection.greedy_fill(df.limit(0), [c("i")], "n", F.lit(5)).count() == 0


def test_lightest_bin(spark):
    rng = random.Random(2)
    for bins in (1, 3, 8):
        lengths = [rng.choice([0, 0, 1, 1, 2, 3, 7, 50, 400]) for _ in range(rng.choice([5, 300]))]
        costs, want = [0] * bins, Counter()
        for x in sorted(lengths, reverse=True):
            b = costs.index(min(costs))
            costs[b] += x * x
            want[x, b] += 1
        got = selection.lightest_bin(frame(spark, list(Counter(lengths).items()), "length int, n long"), bins)
        assert Counter({(r.length, r.bin): r.n for r in got.collect()}) == want


@pytest.mark.parametrize("budget,most", [(100, 1 << 30), (1, 5), (60, 3), (10**6, 7)])
def test_length_buckets(spark, budget, most):
    rng = random.Random(budget)
    lengths = [rng.choice([None, 0, 4, 4, 4, 10, 10, 33, 90, 500]) for _ in range(200)]
    order, want, bucket, held = sorted(range(200), key=lambda i: (lengths[i] or 0, i)), {}, 0, 0
    for i in order:
        if held and (held >= most or (held + 1) * ((lengths[i] or 0) + 2) > budget):
            bucket, held = bucket + 1, 0
        want[i], held = bucket, held + 1
    df = frame(spark, list(enumerate(lengths)), "id int, n int").repartition(4)
    assert {r.id: r.bucket for r in selection.length_buckets(df, "id", "n", budget, most).collect()} == want


@pytest.mark.parametrize("seed", range(3))
def test_negatives(spark, seed):
    rng = random.Random(seed)
    lower, upper, step, n = 0.6, 0.9, 0.2, 3
    positives = [(k, rng.randrange(6)) for k in range(40)]
    pairs = [(k, cand, rng.choice([0.0, 0.1, 0.3, 0.45, 0.6, 0.75, 0.9, 0.95])) for k, own in positives for cand in range(6) if cand != own]
    most = {cand: n * k for cand, k in Counter(cand for _, cand in positives).items()}
    pool = {}
    for k, _ in positives:
        own, low = [(cand, s) for j, cand, s in pairs if j == k and s <= upper], lower
        while low > 0 and sum(s >= low - 1e-9 for _, s in own) < n:
            low = max(0.0, low - step)
        pool[k] = [cand for cand, s in own if low <= 1e-9 or s >= low - 1e-9]
    order = sorted(((hashlib.md5(f"42:{k}:{cand}".encode()).hexdigest(), k, cand) for k in pool for cand in pool[k] if cand in most))
    per_k, per_cand, want = Counter(), Counter(), set()
    for _, k, cand in order:
        if per_k[k] < n and per_cand[cand] < most[cand]:
            per_k[k] += 1
            per_cand[cand] += 1
            want.add((k, cand))
    got = selection.negatives(frame(spark, positives, "k int, cand int"), frame(spark, pairs, "k int, cand int, sim double"), lower, upper, step, n)
    assert {(r.k, r.cand) for r in got.collect()} == want and max(per_cand[x] / most[x] for x in per_cand) == 1


def test_label_ranks(spark):
    rng = random.Random(3)
    hits = [(f"q{rng.randrange(5)}", rng.choice("abcdef"), rng.choice([0.2, 0.5, 0.8])) for _ in range(80)]
    often = dict(zip("abcdef", (3, 1, 3, 2, 1, 9), strict=True))
    got = selection.rank_labels(frame(spark, hits, "query string, label string, score double"), frame(spark, list(often.items()), "label string, frequency long"), 4)
    for q in {h[0] for h in hits}:
        best = {x: max(s for k, y, s in hits if (k, y) == (q, x)) for _, x, _ in [h for h in hits if h[0] == q]}
        assert [r.label for r in got.filter(c("query") == q).orderBy("rank").collect()] == sorted(best, key=lambda x: (-best[x], -often[x], x))[:4]


# Splits

def similarity(keys_, total, threshold, fractions, may, val_any=False, match=False):
    """key -> split by the definition. keys_: key -> (sim, n)."""
    order = sorted(keys_, key=lambda k: (keys_[k][0] is None, keys_[k][0] or 0, keys_[k][1], k))
    first = [k for k in order if may(k) and keys_[k][0] < threshold]
    test = {first[i] for i in walk([keys_[k][1] for k in first], math.floor(fractions.test * total))}
    budget = sum(keys_[k][1] for k in test) if match else math.floor(fractions.val * total)
    second = [k for k in order if k not in test and (val_any or may(k))]
    val = {second[i] for i in walk([keys_[k][1] for k in second], budget)}
    return {k: "test" if k in test else "val" if k in val else "train" for k in keys_}


@pytest.mark.parametrize("seed", range(4))
def test_similarity_split(spark, seed):
    rng = random.Random(seed)
    own = {f"k{i:02d}": (rng.choice([None, 0.0, 0.1, 0.1, 0.3, 0.6, 0.9]), rng.choice([1, 1, 2, 6])) for i in range(60)}
    fractions, total = splits.Fractions(0.6, 0.15, 0.25), sum(n for _, n in own.values())
    df = frame(spark, [(k, s, n, int(k[1:]) % 3 > 0) for k, (s, n) in own.items()], "key string, sim double, n long, has boolean")
    known = lambda k: own[k][0] is not None
    has = lambda k: known(k) and int(k[1:]) % 3 > 0 and own[k][0] > 0
    for options, may, extra in (({}, known, {}), ({"match_val_to_test": True}, known, {"match": True}), ({"val_any": True}, known, {"val_any": True}), ({"eligible": c("has") & (c("sim") > 0)}, has, {})):
        got = splits.similarity_split(df, total, 0.35, fractions, **options)
        assert {r.key: r.split for r in got.collect()} == similarity(own, total, 0.35, fractions, may, **extra)


def test_edges(spark):
    rng = random.Random(5)
    members = [(f"s{i}", rng.choice(["A", "B", "C", None])) for i in range(12)]
    edges = [(f"s{rng.randrange(14)}", f"s{rng.randrange(14)}", rng.randrange(100) / 100) for _ in range(40)]
    named, best, both = dict(members), {k: 0.0 for k, _ in members}, {}
    for a, b, s in edges:
        if a != b:
            both[a], both[b] = max(both.get(a, 0), s), max(both.get(b, 0), s)
        if a != b and a in named and b in named and not (named[a] is not None and named[a] == named[b]):
            best[a], best[b] = max(best[a], s), max(best[b], s)
    edge_rows = frame(spark, edges, "query string, target string, score double")
    assert {r.id: r.sim for r in splits.edge_maxima(frame(spark, members, "id string, sequence string"), edge_rows).collect()} == best
    assert {r.key: r.score for r in aggregates.symmetric_max(edge_rows).collect()} == both


def test_companion(spark):
    marks = frame(spark, [("p", "val"), ("q", "train"), ("r", "test")], "key string, split string")
    df = frame(spark, [(i, k) for i, k in enumerate(["q", None, "r", "p", "q", "q"])], "i int, key string")
    assert [r.split for r in splits.companion_split(df, marks, "key").orderBy("i").collect()] == ["train", "train", "test", "val", "train", "train"]
    with pytest.raises(ValueError, match="r"):
        splits.companion_split(df, marks.filter("key <> 'r'"), "key")


def by_time(days, fractions, preload):
    """day -> split: whole days in order, into the first split that is not yet full and not before the last one used. days: day -> rows."""
    total, filled, at, out = sum(days.values()) + sum(preload.values()), dict(preload), 0, {}
    most = {"train": math.floor(fractions.train * total), "val": math.floor(fractions.val * total)}
    for day in sorted(days):
        while at < 2 and filled.get(splits.SPLITS[at], 0) >= most[splits.SPLITS[at]]:
            at += 1
        out[day] = splits.SPLITS[at]
        filled[out[day]] = filled.get(out[day], 0) + days[day]
    return out


@pytest.mark.parametrize("missing", ["train", "val", "test", "drop", "error"])
def test_time_split(spark, missing):
    rng = random.Random(6)
    days = {datetime.date(2021, 5, 1) + datetime.timedelta(d): rng.randint(1, 7) for d in rng.sample(range(400), 30)}
    rows = [(str(d),) for d, n in days.items() for _ in range(n)] + [("never",), (None,), ("2021-02-31",), ("",)]
    df, fractions = frame(spark, rows, "date string").repartition(3), splits.Fractions(0.7, 0.1, 0.2)
    if missing == "error":
        with pytest.raises(ValueError, match="4 rows"):
            splits.time_split(df, "date", missing=missing)
        return
    got = {(r.date, r.split) for r in splits.time_split(df, "date", fractions, missing=missing).collect()}
    want = by_time(days, fractions, {missing: 4} if missing != "drop" else {})
    assert {x for x in got if x[0] in map(str, days)} == {(str(d), s) for d, s in want.items()}
    assert {s for d, s in got if d not in map(str, days)} == (set() if missing == "drop" else {missing})
    dated = frame(spark, [(d,) for d, n in days.items() for _ in range(n)], "date date")
    assert {(r.date, r.split) for r in splits.time_split(dated, "date", fractions).collect()} == set(by_time(days, fractions, {}).items())


def test_groups_take_their_least(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["p", "q", None]), rng.choice(["x", "y", "", None]), rng.randrange(9)) for i in range(60)]
    df = frame(spark, rows, "i int, a string, b string, x int").repartition(3)
    for group, of in ((["a"], lambda r: r[1]), (["a", "b"], lambda r: r[1:3])):
        want = {r[0]: min(o[3] for o in rows if of(o) == of(r)) for r in rows}
        assert {r.i: r.m for r in selection.group_min(df, group, "x", "m").collect()} == want


def test_undirected_keys(spark):
    texts = ["m.n>>o", "o>>m.n", "o>>o", "no arrow", ">>", "b>>a>>c", None]
    got = [r[0] for r in frame(spark, [(t,) for t in texts], "x string").select(keys.undirected_key(c("x"))).collect()]
    assert got == [t if t is None or ">>" not in t else ">>".join(sorted(t.split(">>", 1))) for t in texts]


def test_random_grouped(spark):
    rng = random.Random(8)
    sizes = [rng.randint(100, 250) for _ in range(5)] + [rng.randint(1, 12) for _ in range(900)]
    df = frame(spark, [(f"g{i}",) for i, n in enumerate(sizes) for _ in range(n)], "g string")
    got = splits.random_grouped_split(df, "g")
    share = {r.split: r["count"] / sum(sizes) for r in got.groupBy("split").count().collect()}
    assert splits.leaks(got, "g").count() == 0 and all(abs(share[s] - x) < 0.02 for s, x in (("train", 0.9), ("val", 0.05), ("test", 0.05)))
    assert got.distinct().exceptAll(splits.random_grouped_split(df.orderBy(F.rand(3)), "g").distinct()).count() == 0
    with pytest.raises(ValueError, match="fewer"):
        splits.random_grouped_split(df.limit(1), "g")
    blank = splits.random_grouped_split(frame(spark, [(x,) for x in (None, "\t", " ", "", "u", "v")], "g string").withColumn("m", F.trim(F.regexp_replace(F.coalesce("g", F.lit("")), "\t", " ")) == ""), "g")
    assert blank.filter("g is null or trim(g) = ''").select("split").distinct().count() == 1 and blank.count() == 6


# Metrics

def test_split_shift(spark):
    rng = random.Random(9)
    values = {s: [round(rng.gauss(m, d), 2) for _ in range(n)] for s, m, d, n in (("train", 0, 1, 50), ("val", 0.5, 2, 21), ("test", 4, 0, 8))}
    got = {r["split"]: r for r in aggregates.split_shift(frame(spark, [(s, x) for s, own in values.items() for x in own], "split string, x double"), "split", "x").collect()}
    base = values["train"]
    mean, low, high = statistics.fmean(base), min(base), max(base)
    share = lambda own, x: sum(v <= x for v in own) / len(own)
    for s, own in values.items():
        r, every = got[s], base + own
        assert (r.n, r.outside_range) == (len(own), sum(not low <= v <= high for v in own) / len(own))
        assert r.mean_shift == pytest.approx(statistics.fmean(own) - mean) and r.median_shift == pytest.approx(statistics.median(own) - statistics.median(base))
        assert r.ks == pytest.approx(max(abs(share(own, x) - share(base, x)) for x in every))
        mse, var = statistics.fmean((v - mean) ** 2 for v in own), statistics.pvariance(own)
        assert r.rmse == pytest.approx(mse**0.5) and r.mae == pytest.approx(statistics.fmean(abs(v - mean) for v in own))
        assert r.r2 == pytest.approx(1 - mse / var if var else 0, abs=1e-9)


def shared_levels(true, pred):
    t, p = ([*true.split("."), "-", "-", "-"])[:4], (pred or "").split(".")
    return 0 if len(p) != 4 else next((i for i in range(4) if t[i] != p[i]), 4)


def test_level_accuracy(spark):
    rng = random.Random(10)
    label = lambda: ".".join(str(rng.randint(1, 2)) for _ in range(rng.choice([4, 4, 4, 3])))
    truth = [(f"q{rng.randrange(15)}", label()) for _ in range(30)]
    ranked = [(f"q{q}", label(), k) for q in range(12) for k in range(1, 6)]
    got = {(r.k, r.level): r.accuracy for r in metrics.level_accuracy(frame(spark, truth, "query string, label string"), frame(spark, ranked, "query string, label string, rank int"), (1, 2, 5)).collect()}
    for k in (1, 2, 5):
        for level in range(1, 5):
            by_query = []
            for q in {q for q, _ in truth}:
                own = [max((shared_levels(t, p) for o, p, r in ranked if o == q and r <= k), default=0) >= level for t in {t for o, t in truth if o == q}]
                by_query.append(sum(own) / len(own))
            assert got[k, level] == pytest.approx(100 * statistics.fmean(by_query))


def test_matched_levels(spark):
    rng = random.Random(11)
    pairs = [(".".join(rng.choices("12-", k=4)), rng.choice([None, "", ".".join(rng.choices("12-", k=rng.choice([3, 4, 4, 5])))])) for _ in range(200)]
    got = frame(spark, pairs, "t string, p string").select(F.coalesce(metrics.matched_levels(c("t"), c("p")), F.lit(0)).alias("m")).collect()
    assert [r.m for r in got] == [shared_levels(t, p) for t, p in pairs]


@pytest.mark.parametrize("seed", range(3))
def test_classification(spark, seed):
    rng = random.Random(seed)
    classes = 5
    pairs = [(rng.randint(-1, 6), rng.choice([-2, 0, 1, 1, 3, 4, 8, None])) for _ in range(60)]
    live = [(p, t) for p, t in pairs if t is not None and 0 <= t < classes]
    support, called, hit = Counter(t for _, t in live), Counter(p for p, _ in live if 0 <= p < classes), Counter(t for p, t in live if p == t)
    f1 = {k: 2 * hit[k] / (support[k] + called[k]) for k in {*support, *called}}
    want = (sum(hit.values()) / len(live), statistics.fmean(hit[k] / support[k] for k in support), statistics.fmean(f1.values()), sum(f1[k] * support[k] for k in f1) / len(live))
    df = frame(spark, pairs, "p int, t int")
    assert tuple(metrics.classification(df, "p", "t", classes).first()) == pytest.approx(want)
    assert tuple(metrics.classification(df.filter("t < 0"), "p", "t", classes).first()) == (0, 0, 0, 0)


# Vectors

@pytest.mark.parametrize("block", [None, 4, 1])
def test_max_similarity(spark, block):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(14, 3))
    x[5] = 0
    bits = (rng.random((14, 6)) < 0.3).astype(int)
    for values, kind, sim in ((x, "cosine", lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))), (bits, "tanimoto", lambda a, b: (a & b).sum() / (a | b).sum())):
        live = [i for i in range(14) if values[i].any()]
        df = frame(spark, [(i, v.astype(float).tolist()) for i, v in enumerate(values)] + [(99, None)], "key long, v array<double>").repartition(3)
        got = {r.key: r.sim for r in vectors.max_similarity(df, "key", "v", kind, block).collect()}
        assert got == pytest.approx({i: max(sim(values[i], values[j]) for j in live if j != i) for i in live})
    alone = frame(spark, [("a", [1.0]), ("b", [0.0])], "key string, v array<double>")
    assert [tuple(r) for r in vectors.max_similarity(alone, "key", "v", block=block).collect()] == [("a", 0.0)]
    assert vectors.max_similarity(alone.limit(0), "key", "v", block=block).count() == 0


@pytest.mark.parametrize("block", [None, 5, 1])
def test_max_set_similarity(spark, block):
    rng = random.Random(12)
    sets = [sorted(rng.sample(range(-3, 12), rng.randint(0, 8))) for _ in range(16)]
    df = frame(spark, [(f"k{i}", s) for i, s in enumerate(sets)], "key string, s array<long>").repartition(3)
    sim = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 0.0
    got = {r.key: r.sim for r in vectors.max_set_similarity(df, "key", "s", block).collect()}
    assert got == pytest.approx({f"k{i}": max(sim(s, t) for j, t in enumerate(sets) if j != i) for i, s in enumerate(sets)})
    assert vectors.max_set_similarity(df.limit(0), "key", "s", block).count() == 0


@pytest.mark.parametrize("block", [None, 7])
def test_best_hits(spark, block):
    rng = np.random.default_rng(2)
    x, labels = rng.normal(size=(30, 4)), [f"l{i % 3}" for i in range(30)]
    own = frame(spark, [(i, labels[i], x[i].tolist()) for i in range(30)], "id long, label string, v array<double>").repartition(3)
    got = {(r.query, r.label): r.score for r in transfer.best_hits(own.filter("id < 8"), own.filter("id >= 8"), block).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == pytest.approx({(q, y): max(unit[q] @ unit[t] for t in range(8, 30) if labels[t] == y) for q in range(8) for y in set(labels)})
    assert transfer.best_hits(own, own.limit(0), block).count() == 0


# Keys, records, alignment

def levels_of(x):
    own = ["".join(ch for ch in p if ch.isascii() and (ch.isalnum() or ch == "-")) or "-" for p in [p.strip() for p in (x or "").split(".")] if p][:4]
    if not own:
        return None
    if len(own) == 4 and not own[3].isdigit():
        own[3] = "-"
    return ".".join([*own, "-", "-", "-"][:4])


def test_label_tokens(spark):
    rng = random.Random(13)
    texts = [None, "", " . ", "."] + ["".join(rng.choices("123.. -nB*\t", k=rng.randint(1, 14))) for _ in range(400)]
    got = frame(spark, [(t,) for t in texts], "x string").select(keys.label_token(c("x"))).collect()
    assert [r[0] for r in got] == [levels_of(t) for t in texts]


def test_equations(spark):
    rows = [
        ("2 K1 + Na+ => (n+1) K22 + Na+", ([("2", "K1"), ("1", "Na+")], [("(n+1)", "K22"), ("1", "Na+")], "=>")), ("K5 <=> K6", ([("1", "K5")], [("1", "K6")], "<=>")), ("K5 = K6", ([("1", "K5")], [("1", "K6")], "=>")),
        ("K5 + water = K6", None), ("K5", None), ("K1 = K2 = K3", None), (None, None), ("", None),
    ]
    got = frame(spark, [(x,) for x, _ in rows], "x string").select(keys.parse_equation(c("x"), r"K\d+|Na\+").alias("e")).collect()
    said = [e.e and ([tuple(p) for p in e.e.left], [tuple(p) for p in e.e.right], e.e.direction) for e in got]
    assert said == [want for _, want in rows]


def test_hash_seeds(spark):
    got = frame(spark, [(f"s{i}",) for i in range(40)], "x string").select(keys.hash_seed(c("x"))).collect()
    assert [int(r[0]) for r in got] == [struct.unpack(">Q", hashlib.sha256(f"s{i}".encode()).digest()[:8])[0] for i in range(40)]


def test_first_locations(spark):
    rng = random.Random(14)
    rows = [(f"k{rng.randrange(9)}", rng.randrange(6), i) for i in range(60)]
    df = frame(spark, rows, "key string, shard int, row int").repartition(3)
    for wanted in (["k1", "k2"], ["k0", "k3", "k3"], ["k1", "none"], []):
        at: dict = {}
        for shard in range(6):
            if not set(wanted) - set(at):
                break
            at |= {k: (s, r) for k, s, r in rows if s == shard and k in wanted}
        got = runs.first_location(df, frame(spark, [(k,) for k in wanted], "key string"))
        assert {r.key: (r["shard"], r["row"]) for r in got.collect()} == at


def aligned(a, b):
    """The best alignment by trying all paths, remembered: (score doubled, equal letters, -pairs); gaps at the ends are free."""
    from functools import cache

    @cache
    def best(i, j, gap):
        """From prefixes i, j to the end, after a gap letter in `gap`, or none."""
        if i == len(a) and j == len(b):
            return (0, 0, 0)
        out = []
        if i < len(a) and j < len(b):
            s = best(i + 1, j + 1, None)
            out.append((s[0] + (2 if a[i] == b[j] else -2), s[1] + (a[i] == b[j]), s[2] - 1))
        if i < len(a):  # b has a gap
            s = best(i + 1, j, "b")
            out.append(((0 if j in (0, len(b)) else -1 if gap == "b" else -4) + s[0], s[1], s[2]))
        if j < len(b):
            s = best(i, j + 1, "a")
            out.append(((0 if i in (0, len(a)) else -1 if gap == "a" else -4) + s[0], s[1], s[2]))
        return max(out)

    return best(0, 0, None)


def test_alignment():
    rng = random.Random(15)
    for _ in range(300):
        a, b = ("".join(rng.choices("ABC", k=rng.randint(1, 9))) for _ in range(2))
        score, equal, pairs = aligned(a, b)
        assert align.best_pairs(a, b) == (equal, -pairs), (a, b, score)
        assert align.identity_and_coverage(a, b) == (equal / -pairs if pairs else 0.0, -pairs / len(a))
    long = "".join(rng.choices("ACGT", k=9000))
    assert align.identity_and_coverage(long, long[100:8800]) == (1.0, 8700 / 9000)
    assert align.identity_and_coverage("", "A") == align.identity_and_coverage("A", "") == (0.0, 0.0)


@pytest.mark.parametrize("block", [None, 7, 1])
def test_sequence_hits(spark, block):
    rng = random.Random(20)
    base = ["".join(rng.choices("ACDE", k=rng.randint(1, 25))) for _ in range(6)]
    cut = lambda s: s[rng.randint(0, len(s) // 3) :] + "".join(rng.choices("ACDE", k=rng.randint(0, 4)))
    targets = [(f"t{i}", cut(rng.choice(base))) for i in range(20)] + [("none", None), ("blank", "")]
    queries = [(f"q{i}", cut(rng.choice(base))) for i in range(12)] + [("q0", "ACDEACDE"), ("none", None)]
    grams = lambda s: {s[i : i + 4] for i in range(len(s) - 3)} or {s}
    want = Counter()
    for q, a in queries:
        for t, b in targets:
            if a and b and len(grams(a) & grams(b)) >= 2:
                _, equal, pairs = aligned(a, b)
                if pairs and equal / -pairs >= 0.6 and -pairs / len(a) >= 0.5:
                    want[q, t, round(equal / -pairs, 9), round(-pairs / len(a), 9)] += 1
    df = lambda rows: frame(spark, rows, "id string, sequence string").repartition(3)
    got = search.sequence_hits(df(queries), df(targets), 4, 2, 0.6, 0.5, block)
    assert Counter((r.query, r.target, round(r.identity, 9), round(r.coverage, 9)) for r in got.collect()) == want and len(want) > 10
    assert search.sequence_hits(df(queries), df(targets).limit(0), block=block).count() == 0


def test_article_records(spark):
    one = '<S><PubmedArticle><MedlineCitation><Article><ArticleTitle>On &lt;x&gt;</ArticleTitle><Abstract><AbstractText Label="A">first</AbstractText></Abstract></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="pii">z</ArticleId><ArticleId IdType="doi">10/1</ArticleId></ArticleIdList></PubmedData></PubmedArticle></S>'
    rows = [one.replace(' Label="A"', ""), "<S></S>", "<S><PubmedArticle></S>", "", None, "<S><PubmedArticle/></S>"]
    got = [[tuple(x) for x in r[0]] for r in frame(spark, [(x,) for x in rows], "x string").select(records.article_records(c("x"))).collect()]
    assert got[0] == [(None, "On <x>", "first", "10/1")] and got[1:5] == [[], [], [], []] and got[5] in ([], [(None, None, None, None)])


def test_qualified_values(spark):
    rows = [("~3", None), ("> 2.5", None), ("= 12,000.5", 12000.5), ("\t0.25 ", 0.25), ("n/a", None), (None, None)]
    got = frame(spark, [(x,) for x, _ in rows], "x string").select(clean.qualified_value(c("x")).alias("v")).collect()
    assert [r.v for r in got] == [v for _, v in rows]


def test_mutations(spark):
    rng = random.Random(16)
    rows = []
    for _ in range(150):
        s = "".join(rng.choices("ACDE", k=6))
        edits = [rng.choice([f"{rng.choice('ACDE')}{rng.randint(0, 7)}{rng.choice('ACDE')}", "bad", f"{s[2]}3W"]) for _ in range(rng.randint(0, 2))]
        out = s
        for e in edits:
            at = int(e[1:-1]) - 1 if e[1:-1].isdigit() else -1
            out = out[:at] + e[-1] + out[at + 1 :] if out is not None and 0 <= at < 6 and out[at] == e[0] else None
        rows.append((s, edits, out))
    got = frame(spark, rows, "s string, e array<string>, want string").select(keys.mutate(c("s"), c("e")).alias("v")).collect()
    assert [r.v for r in got] == [w for _, _, w in rows] and sum(w is not None for _, _, w in rows) > 20


# Structures, stores, run control

def test_choose_structures(spark):
    rng = random.Random(17)
    rows = [(f"r{rng.randrange(6)}", f"P{rng.randrange(50)}", rng.choice(["experimental", "predicted"]), rng.choice([None, 0.2, 0.7])) for _ in range(40)]
    got = {r.row_key: r.pdb for r in structures.choose(frame(spark, rows, "row_key string, pdb string, kind string, coverage double")).collect()}
    assert got == {k: min((r[2] != "experimental", -(r[3] if r[3] is not None else -1), r[1]) for r in rows if r[0] == k)[2] for k in {r[0] for r in rows}}


def test_collapse_to_lists(spark):
    from holdfast.operators.joins import left_lists

    rng = random.Random(18)
    rows = [(rng.choice(["m", "n", None]), rng.choice(["5E", "4D", "6F"])) for _ in range(12)]
    names = frame(spark, [("m",), ("n",), ("o",), (None,)], "k string")
    got = {r.k: r.pdb for r in left_lists(names, frame(spark, rows, "k string, pdb string"), ["k"], "pdb").collect()}
    assert got == {k: sorted({p for x, p in rows if x == k}) for k in ("m", "n", "o", None)}


LENGTHS = lambda ks: ([None if k == "none" else [float(len(k)), 0.5] for k in ks], ["has none" if k == "none" else None for k in ks])


def test_store(spark):
    s = store.VectorStore(spark, shared.scratch(spark, "store"), 2)
    asked = frame(spark, [("uno",), ("none",), (None,), ("dieci",), ("uno",)], "key string")
    s.embed(asked, LENGTHS, 4)
    s.embed(asked, LENGTHS, 6)
    assert sorted((r.key, r.vec[0], r.seq) for r in s.vectors().collect()) == [("dieci", 5.0, 4), ("uno", 3.0, 4)]
    assert [(r.key, r.error, r.seq) for r in s.failures().collect()] == [("none", "has none", 6)]
    assert [r.key for r in s.missing(asked).collect()] == ["none"]
    assert {r.key_hash for r in s.index().collect()} == {r.key_hash for r in s.vectors().collect()}
    s.put(frame(spark, [("uno", [7.0, 7.0])], "key string, vec array<double>"), 8)
    assert s.rows().count() == 3 and s.reclaim() == 1 and s.rows().count() == s.vectors().count() == 2
    assert {r.key: r.vec[0] for r in store.VectorStore(spark, s.path, 2).vectors().collect()} == {"uno": 3.0, "dieci": 5.0}
    assert [r.key for r in store.drop_keys(s.vectors(), frame(spark, [("uno",)], "key string")).collect()] == ["dieci"]
    with pytest.raises(ValueError, match="made with"):
        store.VectorStore(spark, s.path, 3)


def test_a_flush_that_was_cut_off(spark):
    """A whole checkpoint is flushed when the store is opened again, a partial one is dropped; nothing is lost or double."""
    s = store.VectorStore(spark, shared.scratch(spark, "store"), 2)
    asked = frame(spark, [("a",), ("bb",), ("none",)], "key string")
    s.stage(asked, LENGTHS, 1)
    assert s.vectors().count() == 0
    again = store.VectorStore(spark, s.path, 2)
    assert again.vectors().count() == 2 and again.failures().count() == 1 and not [x for x in shared.children(spark, s.path) if x.startswith("staged")]
    again.stage(frame(spark, [("ccc",)], "key string"), LENGTHS, 2)
    shared.delete(spark, f"{s.path}/staged-2/_SUCCESS")
    last = store.VectorStore(spark, s.path, 2)
    assert last.vectors().count() == 2 and [r.key for r in last.missing(frame(spark, [("ccc",), ("a",)], "key string")).collect()] == ["ccc"]


def test_published_tables(spark):
    path, ks, calls = shared.scratch(spark, "cache"), frame(spark, [("m",), ("n",), ("o",)], "key string"), []

    def compute(rows=ks):
        calls.append(1)
        return rows.withColumn("v", F.lit(len(calls)))

    assert [store.cached(ks, "key", path, compute, t=1).first().v for _ in range(2)] == [1, 1]
    assert store.cached(ks, "key", path, compute, t=2).first().v == 2
    assert len([x for x in shared.children(spark, path) if x.startswith("table-")]) == 1
    partial = shared.scratch(spark, "cache")
    store.cached(ks, "key", partial, lambda: ks.limit(1))
    with pytest.raises(ValueError, match="lacks keys"):
        store.cached(ks, "key", partial, lambda: ks)
    with pytest.raises(ValueError, match="no policy"):
        store.materialized(ks, "key", partial, lambda: ks, "maybe")
    marks = [store.fingerprint(x, "key").first()[0] for x in (ks, ks.orderBy(F.desc("key")), ks.union(ks), ks.limit(2))]
    assert marks[0] == marks[1] == marks[2] != marks[3]


def test_files_are_replaced_whole(spark):
    path = shared.scratch(spark, "file") + "/x.json"
    for k in range(3):
        shared.write_json(spark, path, {"k": k})
        assert shared.read_json(spark, path) == {"k": k}
    assert shared.children(spark, path.rsplit("/", 1)[0]) == ["x.json"]


def test_scratch_is_cleared(spark):
    path = shared.scratch(spark, "gone")
    spark.range(3).write.parquet(path)
    assert shared.exists(spark, path)
    shared.clear(spark)
    assert not shared.exists(spark, path)


def test_no_machine_local_folder_on_a_cluster(spark):
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session)


def test_mixed_batches(spark):
    df = frame(spark, [(i, i % 7) for i in range(1003)], "i long, x int").repartition(6)
    got = store.mixed_batches(df, ["i"], 10, 5, 4).collect()
    assert all(r.chunk == r.i // 10 for r in got) and {r.batch for r in got} == set(range(26))
    chunks = sorted({r.chunk for r in got}, key=lambda k: hashlib.sha256(f"5:{k}".encode()).hexdigest())
    assert {(r.chunk, r.batch) for r in got} == {(k, i // 4) for i, k in enumerate(chunks)}


def test_split_folders(spark):
    root = shared.scratch(spark, "root")
    df = frame(spark, [(1, "train"), (2, "val"), (3, "test")], "x int, split string")
    for name in ("plain", "many/threshold_0.2", "many/threshold_0.9", "single/threshold_1"):
        io.write_named_splits(df, f"{root}/{name}")
    assert io.find_splits(spark, root) == ["many/threshold_0.2", "many/threshold_0.9", "plain", "single/threshold_1"]
    assert io.resolve_split(spark, f"{root}/plain") == f"{root}/plain" and io.resolve_split(spark, f"{root}/single") == f"{root}/single/threshold_1"
    assert io.resolve_split(spark, f"{root}/many", "0.9") == f"{root}/many/threshold_0.9"
    for threshold in (None, "0.5"):
        with pytest.raises(ValueError, match="of 2"):
            io.resolve_split(spark, f"{root}/many", threshold)


@pytest.mark.parametrize("budget", [0, 35, 90, 10**6])
def test_evict_oldest(spark, budget):
    rng = random.Random(19)
    rows = [(i, rng.randint(1, 9), rng.randrange(6)) for i in range(25)]
    keep, total, want = {r[0] for r in rows if r[0] % 6 == 0}, sum(r[1] for r in rows), set()
    for i, size, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if i not in keep and total > budget:
            want.add(i)
            total -= size
    got = runs.evict_oldest(frame(spark, rows, "id int, size int, mtime int").repartition(3), budget, c("id") % 6 == 0)
    assert {r.id for r in got.collect()} == want and got.columns == ["id", "size", "mtime"]


def test_required_lookup(spark):
    have = frame(spark, [("x", "9"), ("y", None), ("z", "")], "k string, v string")
    assert [tuple(r) for r in runs.lookup_required(have, have.filter("k = 'x'").select("k"), "k", "v").collect()] == [("x", "9")]
    with pytest.raises(KeyError, match="y, z"):
        runs.lookup_required(have, have.select("k"), "k", "v")
