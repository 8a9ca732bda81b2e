"""Line dedup: windows of three consecutive lines are hashed, repeated windows found over the whole corpus, and later ones cut.

Lines without a word do not count: windows are over the others, in their order. Of equal
windows the first, by doc_id (null last) and then by line, stays; the lines of every
later one are covered, covered lines are merged over overlapping windows, and what is
covered goes. Window keys are two independent 64-bit hashes; texts are not shuffled by
window, only (key, document, lines). The number of occurrences and the first one are
aggregated before the shuffle, so a window that a third of all documents share costs a
row for each task; the join that finds its later occurrences can be split by AQE, as
one of its sides has a row for each window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.common import table
from holdfast.llm.quality import HAS_WORD, fresh
from holdfast.operators.frames import joinable


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def windows(documents: DataFrame) -> DataFrame:
    """A row for each window: doc_id, text_hash, its three line numbers p0 p1 p2, and its key k1 k2."""
    numbered = F.transform(lines_of(F.col("text")), lambda x, i: F.when(x.rlike(HAS_WORD), F.struct(i.alias("p"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))))
    lines = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.array_compact(numbered).alias("x"))
    rest = lambda k: F.slice("x", k, F.greatest(F.size("x") - 2, F.lit(0)))
    rows = lines.select("doc_id", "text_hash", F.inline(F.arrays_zip(rest(1).alias("x"), rest(2).alias("y"), rest(3).alias("z"))))
    key = lambda h: F.xxhash64(*[F.col(c)[h] for c in "xyz"])
    return rows.select("doc_id", "text_hash", F.col("x.p").alias("p0"), F.col("y.p").alias("p1"), F.col("z.p").alias("p2"), key("a").alias("k1"), key("b").alias("k2"))


def covered(documents: DataFrame) -> DataFrame:
    """Per document with later windows: doc_id, text_hash, cover (its covered line numbers)."""
    found = windows(documents.filter("text is not null"))
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("p0").alias("p"))
    repeated = found.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1").drop("n")
    later = found.join(joinable(repeated), ["k1", "k2"]).filter(place > F.col("first"))
    return later.groupBy("doc_id", "text_hash").agg(F.array_distinct(F.flatten(F.collect_set(F.array("p0", "p1", "p2")))).alias("cover"))


def with_cut_text(documents: DataFrame, text: str, n_lines: str, n_removed: str, n_left: str) -> DataFrame:
    """documents with new columns: the text without its covered lines, the numbers of lines, of lines removed, and of lines with a word that are left."""
    hashed, c_id, c_hash, c_lines, left_lines = (fresh(documents, c) for c in ("_text_hash", "_cover_id", "_cover_hash", "_cover", "_left"))
    cover = covered(documents.select("doc_id", "text")).select(F.col("doc_id").alias(c_id), F.col("text_hash").alias(c_hash), F.col("cover").alias(c_lines))
    own = documents.withColumn(hashed, F.xxhash64("text"))
    joined = own.join(cover, (own[hashed] == cover[c_hash]) & own["doc_id"].cast("long").eqNullSafe(cover[c_id]), "left")
    lines = lines_of(F.col("text"))
    kept = lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(c_lines)), lambda i: F.get(ls, i))
    joined = joined.withColumn(left_lines, F.when(F.col(c_lines).isNull(), lines).otherwise(F.element_at(F.transform(F.array(lines), kept), 1)))
    return joined.withColumns(
        {
            text: F.array_join(left_lines, "\n"),
            n_lines: F.coalesce(F.when(F.col("text").isNotNull(), F.size(lines)), F.lit(0)).cast("long"),
            n_removed: F.coalesce(F.when(F.col(c_lines).isNotNull(), F.size(c_lines)), F.lit(0)).cast("long"),
            n_left: F.coalesce(F.when(F.col(left_lines).isNotNull(), F.size(F.filter(left_lines, lambda x: x.rlike(HAS_WORD)))), F.lit(0)).cast("long"),
        }
    ).drop(left_lines, c_lines, c_id, c_hash, hashed)


def dedup_lines(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n_lines, n_removed, text (without the lines removed).

    documents: doc_id, text; other columns are not looked at. A null text stays null and
    has no lines; texts under three lines with a word have no window and stay as they
    are. Rows with equal doc_id and text are one document; where rows of one doc_id tie
    for the first occurrence, each keeps it. A null doc_id stands after all others. An
    empty table gives no rows.
    """
    found = with_cut_text(documents.select("doc_id", "text"), "_cut", "n_lines", "n_removed", "_n_left")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_removed", F.col("_cut").alias("text"))


def cut_repeated_lines(documents: DataFrame) -> DataFrame:
    """The documents with their texts cut, n_chars counted anew where it is a column, and without those that lost every line with a word. Other columns stay as they are, whatever they are called; nulls, ties and empty tables as in `dedup_lines`."""
    cut, total, removed, left = (fresh(documents, c) for c in ("_cut", "_n_lines", "_n_removed", "_n_left"))
    found = with_cut_text(documents, cut, total, removed, left)
    found = found.filter((F.col(removed) == 0) | (F.col(left) > 0))
    own = {"text": F.col(cut), "n_chars": F.when(F.col(removed) > 0, F.char_length(cut).cast("long")).otherwise(F.col("n_chars")) if "n_chars" in documents.columns else None}
    return found.select(*[own[c].alias(c) if c in own else F.col(f"`{c}`") for c in documents.columns])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL
), worded AS (
  SELECT doc_id, pos AS p0, line AS a,
    lead(pos, 1) OVER w AS p1, lead(line, 1) OVER w AS b, lead(pos, 2) OVER w AS p2, lead(line, 2) OVER w AS c
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), windows AS (SELECT * FROM worded WHERE p2 IS NOT NULL), numbered AS (
  SELECT doc_id, p0, p1, p2, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p0) AS k FROM windows
), cover AS (
  SELECT doc_id, p0 AS pos FROM numbered WHERE k > 1 UNION
  SELECT doc_id, p1 FROM numbered WHERE k > 1 UNION
  SELECT doc_id, p2 FROM numbered WHERE k > 1
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed, string_agg(line, chr(10) ORDER BY l.pos) FILTER (c.pos IS NULL) AS text
  FROM lines l LEFT JOIN cover c ON l.doc_id = c.doc_id AND l.pos = c.pos GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
