"""Quality rules: an ordered list of threshold conjunctions, learned by sequential covering and run as one CASE expression.

The statistics of a text are built-in expressions over the row itself, so judging moves
no rows. The list is learned on the driver from the statistics of a bounded sample of
labelled documents: two thirds grow conjunctions of thresholds, one third prunes them,
and a rule stays only if it is precise on the third that did not grow it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.common import table

WORD_GAP = r"[\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("n_words", "mean_word", "symbol_rate", "mark_rate", "upper_rate", "digit_rate", "dup_line_rate", "repeat_rate", "distinct_rate")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def repeated_words(trigrams: Column) -> Column:
    """Words in windows found twice or more: the windows are sorted with their places, those with an equal neighbour kept, and their spans of three merged."""
    placed = F.sort_array(F.transform(trigrams, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def twice(s: Column) -> Column:
        same = lambda e, at: F.coalesce(F.get(s, at)["x"] == e["x"], F.lit(False))
        return F.array_compact(F.transform(s, lambda e, i: F.when(same(e, i - 1) | same(e, i + 1), e["i"])))

    places = F.sort_array(F.element_at(F.transform(F.array(placed), twice), 1))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    merge = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last"))
    return F.when(F.size(F.array_distinct(trigrams)) == F.size(trigrams), 0).otherwise(F.aggregate(places, start, merge, lambda acc: acc["n"]))


def with_statistics(df: DataFrame, text: str, into: str) -> DataFrame:
    """df with a struct column of the base statistics and the features. Null and empty texts have no words and zeros throughout."""
    words, lines, trigrams = fresh(df, "_words"), fresh(df, "_lines"), fresh(df, "_trigrams")
    whole = F.coalesce(F.col(text), F.lit(""))
    found = df.withColumns(
        {
            words: F.array_remove(F.split(whole, WORD_GAP), ""),
            lines: F.filter(F.split(whole, "\n"), lambda x: x.rlike(HAS_WORD)),
        }
    )
    windows = lambda ws: F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))
    found = found.withColumn(trigrams, F.element_at(F.transform(F.array(F.col(words)), windows), 1))
    count = lambda pattern: F.regexp_count(whole, F.lit(pattern)).cast("long")
    base = F.struct(
        F.size(words).cast("long").alias("n_words"),
        (F.char_length(whole) - count(r"[\x20\x09-\x0D]")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col(trigrams)).cast("long").alias("n_repeat_words"),
        count(r"[!?|]").alias("n_marks"),
        count(r"[A-Z]").alias("n_upper"),
        count(r"[0-9]").alias("n_digits"),
        F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
        F.size(lines).cast("long").alias("n_lines"),
    )
    return found.withColumn(into, base).drop(words, lines, trigrams)


def features(s: Column) -> dict[str, Column]:
    rate = lambda a, b: F.coalesce(s[a] / F.nullif(s[b], F.lit(0)), F.lit(0.0))
    return {
        "n_words": s["n_words"].cast("double"),
        "mean_word": rate("word_chars", "n_words"),
        "symbol_rate": rate("n_symbols", "n_words"),
        "mark_rate": rate("n_marks", "n_words"),
        "upper_rate": rate("n_upper", "word_chars"),
        "digit_rate": rate("n_digits", "word_chars"),
        "dup_line_rate": rate("n_dup_lines", "n_lines"),
        "repeat_rate": rate("n_repeat_words", "n_words"),
        "distinct_rate": rate("n_distinct", "n_words"),
    }


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x > self.threshold if self.above else x <= self.threshold

    def column(self, f: dict[str, Column]) -> Column:
        return f[self.feature] > self.threshold if self.above else f[self.feature] <= self.threshold


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x[c.feature])
    return out


def grow(x: dict[str, np.ndarray], bad: np.ndarray, thresholds: dict[str, np.ndarray], most: int) -> Rule:
    """Add the condition of the largest FOIL gain until no good document is covered or nothing gains."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < most:
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p or not n:
            break
        before, best = math.log2(p / (p + n)), (1e-9, None)
        for name, cuts in thresholds.items():
            for cut in cuts:
                for above in (True, False):
                    c = Condition(name, above, float(cut))
                    held = inside & c.holds(x[name])
                    q = int((held & bad).sum())
                    if q and (gain := q * (math.log2(q / int(held.sum())) - before)) > best[0]:
                        best = (gain, c)
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(x[best[1].feature])
    return tuple(rule)


def widen(rule: Rule, x: dict[str, np.ndarray]) -> Rule:
    """Each threshold moved to the middle of the empty space between the values on its two sides."""
    out = []
    for c in rule:
        v = x[c.feature]
        low, high = v[v <= c.threshold], v[v > c.threshold]
        out.append(Condition(c.feature, c.above, float((low.max() + high.min()) / 2)) if len(low) and len(high) else c)
    return tuple(out)


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, int, int]:
    """The shortest head of the rule with the best (p - n) / (p + n) on rows that did not grow it, and its p and n."""
    best, best_value, counts = rule, -2.0, (0, 0)
    for k in range(1, len(rule) + 1):
        held = covers(rule[:k], x, len(bad))
        p, n = int((held & bad).sum()), int((held & ~bad).sum())
        value = (p - n) / (p + n) if p + n else -1.0
        if value > best_value:
            best, best_value, counts = rule[:k], value, (p, n)
    return best, *counts


def learn(rows: list[tuple], max_rules: int = 12, max_conditions: int = 4, cuts: int = 48, precision: float = 0.97, support: int = 3) -> list[Rule]:
    """Sequential covering. rows: (fold 0..2, bad, features...); fold 2 prunes. Stops at the first rule that does not keep the precision on the pruning rows."""
    if not rows:
        return []
    data = np.array(rows, float)
    fold, bad = data[:, 0].astype(int), data[:, 1] > 0
    x = {name: data[:, 2 + k] for k, name in enumerate(FEATURES)}
    left, rules = np.ones(len(data), bool), []
    while len(rules) < max_rules:
        g, h = left & (fold < 2), left & (fold == 2)
        if not (g & bad).any() or not (g & ~bad).any():
            break
        own = {k: v[g] for k, v in x.items()}
        thresholds = {k: np.unique(np.quantile(v, np.linspace(0, 1, cuts), method="lower")) for k, v in own.items()}
        rule = grow(own, bad[g], thresholds, max_conditions)
        if not rule:
            break
        rule, p, n = prune(rule, {k: v[h] for k, v in x.items()}, bad[h])
        held = covers(rule, x, len(data)) & left
        p, n = p + int((held & g & bad).sum()), n + int((held & g & ~bad).sum())
        if p < support or p / (p + n) < precision:
            break
        rules.append(widen(rule, {k: v[left] for k, v in x.items()}))
        left &= ~held
    return rules


def verdict(rules: list[Rule], s: Column) -> Column:
    """The ordered list as one expression: the first rule that holds rejects, else the document stays."""
    if not rules:
        return F.lit(True)
    f, out = features(s), None
    for rule in rules:
        held = rule[0].column(f)
        for c in rule[1:]:
            held &= c.column(f)
        out = F.when(held, False) if out is None else out.when(held, False)
    return out.otherwise(True)


def fit(documents: DataFrame, labels: DataFrame, sample: int = 6000) -> list[Rule]:
    """Learn from at most `sample` labelled documents, those whose ids hash lowest, so that every size of corpus gives a uniform sample.

    labels: doc_id, quality (0 bad, 1 good); rows with a null in either are left out, a
    document with both labels counts once for each. Rows of documents with equal doc_id
    count as one, the least. No labels, or one class alone: no rules.
    """
    chosen = labels.filter("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 0).alias("bad")).distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "bad").limit(sample)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows are broadcast
    found = with_statistics(texts, "text", "s")  # no filter on statistics here: it would be pushed below the join and run over all texts
    f = features(F.col("s"))
    rows = found.groupBy("doc_id", "bad").agg(F.min(F.struct(*[f[k].alias(k) for k in FEATURES])).alias("x"))
    rows = rows.select(F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)).alias("fold"), F.col("bad").cast("int").alias("bad"), "x.*")
    words, repeats = 2 + FEATURES.index("n_words"), 2 + FEATURES.index("repeat_rate")
    return learn(sorted(tuple(r) for r in rows.collect() if r[words] >= 50 and r[repeats] <= 0.5))


def judge(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """Per row: doc_id, the base statistics, base_failed, kept. No shuffle.

    documents: doc_id, text; other columns, of whatever name, are not looked at. A null or
    empty text has no words and fails; a null doc_id stays null; repeated rows each give a
    row; texts are read whole; an empty table gives no rows. Without rules only the base
    decides.
    """
    found = with_statistics(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", "s")
    failed = base_failed(F.col("s"))
    return found.select("doc_id", *[F.col("s")[k].alias(k) for k in BASE], failed.alias("base_failed"), (~failed & verdict(rules, F.col("s"))).alias("kept"))


def keep_good(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows that are kept, with their columns as they were, whatever these are called. Nulls, repeats and empty tables as in `judge`."""
    s = fresh(documents, "_statistics")
    found = with_statistics(documents, "text", s)
    return found.filter(~base_failed(F.col(s)) & verdict(rules, F.col(s))).drop(s)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return judge(documents, fit(documents, table(spark, sf_dir, "labels")))
