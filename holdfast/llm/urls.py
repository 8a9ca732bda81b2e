"""URL filters: domain and path rules first, then the log-likelihood ratio of two character language models.

Both models are variable-order Markov models over all characters: a character's
probability after up to CONTEXT characters is interpolated with that after one less
(Witten-Bell weights), down to the uniform one, and where a context was never seen the
next shorter one speaks. Seen strings are closed under dropping characters from the
front, so a URL's log-likelihood is a sum of one number for each string of up to
CONTEXT + 1 characters in it that the model has seen: what the string's last character
gains over the shorter context, less the escape of its own context that this undoes, plus
the escape from it as a context. Scoring is so a join of strings with a table of numbers
and a sum; the table is broadcast up to a checked size, beyond it joined by a shuffle. A
URL's score is the mean log ratio over its characters; the bar that it must reach is set
on labelled URLs that were kept from the counts. All of it is built-in expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdfast.llm.common import lower_ascii, table, written
from holdfast.operators.frames import joinable

CONTEXT = 4
BROADCAST_ROWS = 1_000_000
UNIFORM = 1 / 0x110000  # of a character that was never seen; the same for both models
START, END = "\x02", "\x03"


@dataclass(frozen=True)
class Rule:
    """Holds for the host and its subdomains where the path starts with the rule's."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values of the production query.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and where there is no ://."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, nulls if none does."""
    name = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, r.name) if name is None else name.when(fits, r.name)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    return (name, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def chars_of(url: Column) -> Column:
    """The start, the lower-cased characters after ://, and the end; empty where nothing follows a ://."""
    rest = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1))
    chars = F.concat(F.array(F.lit(START)), F.array_remove(F.split(rest, ""), ""), F.array(F.lit(END)))
    return F.when(F.length(rest) > 0, chars).otherwise(F.array().cast("array<string>"))


def strings_of(chars: Column) -> Column:
    """For each character but the start, the strings of one up to CONTEXT + 1 characters that end with it (none reaches over the start); and the start alone."""
    back = lambda i, k: F.concat(*[F.get(chars, i - j) for j in range(k, -1, -1)])
    ending = lambda c, i: F.when(i == 0, F.array(c)).otherwise(F.array_compact(F.array(*[F.when(i >= k, back(i, k)) for k in range(CONTEXT + 1)])))
    return F.flatten(F.transform(chars, ending))


def fit_ratio(labelled: DataFrame) -> DataFrame:
    """Per string: s, and its part v of a log ratio; the row of the empty string counts for every character. labelled: url, accepted."""
    sides = ("a", "r")
    grams = labelled.select("accepted", chars_of(F.col("url")).alias("chars")).select("accepted", F.explode(strings_of(F.col("chars"))).alias("s"))
    counts = grams.groupBy("s").agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r"))
    counts = written(counts, "url-strings")
    foretold = counts.filter(F.col("s") != START)
    before = F.substring("s", F.lit(1), F.length("s") - 1).alias("s")
    contexts = foretold.select(before, *sides).groupBy("s").agg(*[f(k).alias(n + k) for k in sides for n, f in (("n", F.sum), ("t", lambda k: F.count_if(F.col(k) > 0)))])
    escape = lambda k: F.when(F.col("n" + k) > 0, F.col("t" + k) / (F.col("n" + k) + F.col("t" + k)))
    contexts = written(contexts.select("s", *[c for k in sides for c in ((F.col("n" + k) + F.col("t" + k)).alias("m" + k), escape(k).alias("e" + k))]), "url-contexts")

    own = contexts.withColumnsRenamed({"s": "of"} | {c + k: "o" + c + k for c in "me" for k in sides})
    shares = foretold.withColumn("of", F.substring("s", F.lit(1), F.length("s") - 1)).join(own, "of")
    shares = shares.select("s", *[c for k in sides for c in (F.when(F.col(k) > 0, F.col(k) / F.col("om" + k)).alias("f" + k), F.col("oe" + k).alias("b" + k))])

    tails = F.transform(F.sequence(F.lit(1), F.length("s")), lambda n: F.struct(n.alias("n"), F.substring("whole", F.length("whole") - n + 1, n).alias("s")))
    parts = foretold.select(F.col("s").alias("whole"), "s").select("whole", F.explode(tails).alias("x")).select("whole", "x.n", "x.s").join(shares, "s")
    folded = parts.groupBy("whole").agg(F.sort_array(F.collect_list(F.struct("n", *[c + k for k in sides for c in "fb"]))).alias("xs"))  # CONTEXT + 1 at most

    def gain(k: str) -> Column:
        """Log of the last character's probability against that after one character less, and the escape of the string's own context undone; null if not seen."""
        step = lambda p, x: F.when(x["f" + k].isNull(), p).otherwise(x["f" + k] + x["b" + k] * p)
        low = F.aggregate(F.slice("xs", F.lit(1), F.size("xs") - 1), F.lit(UNIFORM), step)
        last = F.element_at("xs", -1)
        return F.log(last["f" + k] + last["b" + k] * low) - F.log(low) - F.log(last["b" + k])

    gains = folded.select(F.col("whole").alias("s"), *[gain(k).alias("g" + k) for k in sides])
    both = gains.join(contexts.select("s", "ea", "er"), "s", "full")
    value = lambda k: F.coalesce(F.col("g" + k), F.lit(0.0)) + F.coalesce(F.log("e" + k), F.lit(0.0))
    return both.select("s", (value("a") - value("r")).alias("v"))


def scores(urls: DataFrame, ratio: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per distinct url: url, and the mean log ratio over its characters as score; those without characters are left out."""
    brought = F.broadcast(ratio) if ratio.count() <= broadcast_rows else joinable(ratio)
    tasks = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = urls.select("url").distinct().repartition(tasks)  # URLs are small, but each becomes hundreds of strings: AQE would put them into few tasks
    chars = spread.withColumn("chars", chars_of(F.col("url")))
    strings = chars.select("url", (F.size("chars") - 1).alias("n"), F.explode(strings_of(F.col("chars"))).alias("s"))
    sums = strings.join(brought, "s", "left").groupBy("url").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"), F.max("n").alias("n"))
    each = ratio.filter("s = ''").agg(F.coalesce(F.max("v"), F.lit(0.0)).alias("v"))
    return sums.select("url", (F.col("v") / F.col("n") + each.scalar()).alias("score"))


def fit_bar(held: DataFrame, step: float = 0.005, reach: int = 4000) -> DataFrame:
    """One row with the score that parts held-out accepted from rejected URLs best (true positives less false ones). held: score, accepted. Scores are counted in 2 * reach + 1 bins at most."""
    bins = held.filter("score is not null").select("accepted", F.greatest(F.lit(-reach), F.least(F.lit(reach), F.floor(F.col("score") / step))).alias("bin"))
    bins = bins.groupBy("bin").agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r"))
    every, before = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    share = lambda k: F.coalesce(F.sum(k).over(before), F.lit(0)) / F.greatest(F.sum(k).over(every), F.lit(1))
    gains = bins.select("bin", (share("r") - share("a")).alias("gain"))
    return gains.agg((F.coalesce(F.max_by("bin", F.struct("gain", -F.abs("bin"), -F.col("bin"))), F.lit(0)) * step).alias("bar"))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...], labelled: DataFrame | None = None) -> DataFrame:
    """Per row: page_id, url, host, path, rule, score, verdict.

    pages: page_id, url; other columns are not looked at. labelled: url, accepted; by
    default the URLs on which the rules decide, so that the models carry the rules' taste
    to hosts that no rule names. A fifth of them, by hash, sets the bar and is not
    counted. A URL that is null, or has no ://, has an empty host and path and no score,
    and is allowed; so is all that no rule fits where no labelled URL is given. Repeated
    rows each give a row. An empty table gives no rows.
    """
    judged = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    name, decided = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": name, "decided": decided})
    if labelled is None:
        labelled = judged.filter("decided is not null").select("url", (F.col("decided") == "allow").alias("accepted"))
    labelled = labelled.select("url", "accepted").filter("url is not null and accepted is not null")
    held = F.crc32("url") % 5 == 0
    ratio = written(fit_ratio(labelled.filter(~held)), "url-ratio")
    scored = written(scores(judged.select("url").unionByName(labelled.filter(held).select("url")), ratio), "url-scores")
    bar = written(fit_bar(labelled.filter(held).join(joinable(scored), "url").select("score", "accepted")), "url-bar")
    own = F.when(F.col("score") < bar.scalar(), "block").otherwise("allow")
    return judged.join(joinable(scored), "url", "left").select("page_id", "url", "host", "path", "rule", "score", F.coalesce("decided", own).alias("verdict"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES)
