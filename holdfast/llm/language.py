"""Language ID: multinomial naive Bayes over hashed character bigrams and trigrams, scored in sparse batches.

Texts are taken in batches: their characters stand in one array, the n-grams of all of
them are hashed together, and an n-gram touches only its own bucket, so nothing as wide
as the buckets is made for a document. Learning counts every training document; tasks sum
their counts by language and bucket, so what is shuffled follows the number of tasks, and
what reaches the driver is languages x buckets numbers, for a bounded number of
languages. The matrix of log probabilities is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.common import table, written

BUCKETS = 1 << 14
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
MOST_LANGUAGES = 500  # 66 MB of log probabilities
AT_ONCE = 1 << 18  # characters of a batch; a longer text is a batch of its own
BLOCK = 1 << 16  # n-grams hashed at a time
HELD_LANGUAGES = 64  # whose counts a task holds before it passes them on


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def batched(texts: Iterator[str | None]) -> Iterator[list[str]]:
    """Lists of texts, nulls as empty, of AT_ONCE characters or one text."""
    own: list[str] = []
    size = 0
    for text in texts:
        text = text or ""
        if own and size + len(text) > AT_ONCE:
            yield own
            own, size = [], 0
        own.append(text)
        size += len(text)
    if own:
        yield own


class Batch:
    """The lower-cased letters of texts, all else being a space, with a space before and behind each text."""

    def __init__(self, texts: list[str]):
        raw = [f" {t.lower()} ".encode("utf-32-le", "surrogatepass") for t in texts]
        self.starts = np.concatenate([[0], np.cumsum([len(b) // 4 for b in raw])])
        points = np.frombuffer(b"".join(raw), "<u4")
        is_letter = letters()[points]
        self.points = np.where(is_letter, points, 32).astype(np.uint32)
        self.lettered = np.add.reduceat(is_letter, self.starts[:-1], dtype=np.int64) > 0 if texts else np.zeros(0, bool)

    def grams(self, block: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Texts (by number) and buckets of all bigrams and trigrams inside the texts, block by block."""
        block, n = block or BLOCK, len(self.points)
        for lo in range(0, n, block):
            x = self.points[lo : lo + block + 2]
            own = np.searchsorted(self.starts, np.arange(lo, lo + len(x)), "right") - 1
            two = x[:-1] * np.uint32(0x9E3779B1) ^ x[1:] * np.uint32(0x85EBCA77)
            three = (x[:-2] * np.uint32(0xC2B2AE3D) ^ x[1:-1] * np.uint32(0x27D4EB2F) ^ x[2:] * np.uint32(0x165667B1)) + np.uint32(0x9E3779B9)
            for h, width in ((two, 2), (three, 3)):
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x2C1B3C6D)
                inside = own[: len(h)] == own[width - 1 :]
                inside[block:] = False
                yield own[: len(h)][inside], (h >> np.uint32(18))[inside].astype(np.int64)


@dataclass
class Model:
    """log_p: languages x buckets. languages in order."""

    languages: list[str]
    prior: np.ndarray
    log_p: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its posterior; und and 0 without letters or without a learned language."""
        if not self.languages or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        batch = Batch(texts)
        value = np.tile(self.prior, (len(texts), 1))
        for own, buckets in batch.grams():
            if len(own):
                first, n = own[0], own[-1] - own[0] + 1
                for k, row in enumerate(self.log_p):
                    value[first : first + n, k] += np.bincount(own - first, row[buckets], n)
        best = value.argmax(axis=1)
        score = 1 / np.exp(value - value.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.languages[k] if ok else UNKNOWN for k, ok in zip(best, batch.lettered, strict=True)], np.where(batch.lettered, score, 0.0)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, bucket, n of the rows (text, lang); the number of documents of a language under bucket -1."""
    sums: dict[str, np.ndarray] = {}

    def passed_on() -> Iterator[pa.RecordBatch]:
        for lang, x in sums.items():
            own = np.flatnonzero(x)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(own), "bucket": own - 1, "n": x[own]})
        sums.clear()

    for rows in batches:
        at, langs = 0, rows.column("lang").to_pylist()
        for texts in batched(t.as_py() for t in rows.column("text")):
            names, of = np.unique(np.array(langs[at : at + len(texts)], object), return_inverse=True)
            at += len(texts)
            batch = Batch(texts)
            docs = np.flatnonzero(batch.lettered)
            for own, buckets in chain([(docs, np.full(len(docs), -1))], batch.grams()):
                live = batch.lettered[own]
                codes, n = np.unique(of[own[live]] * (BUCKETS + 1) + buckets[live] + 1, return_counts=True)
                cuts = np.searchsorted(codes, np.arange(len(names) + 1) * (BUCKETS + 1))
                for k in np.flatnonzero(np.diff(cuts)):
                    lo, hi = cuts[k], cuts[k + 1]
                    sums.setdefault(names[k], np.zeros(BUCKETS + 1, np.int64))[codes[lo:hi] - k * (BUCKETS + 1)] += n[lo:hi]
                    if len(sums) > HELD_LANGUAGES:
                        yield from passed_on()
    yield from passed_on()


def learn(documents: DataFrame, smoothing: float = 0.5, most_languages: int = MOST_LANGUAGES) -> Model:
    """From doc text and lang; rows with a null or no letter in the text, or a null lang, are left out. More than `most_languages` names of languages are an error, as the matrix would not be small."""
    found = documents.filter("text is not null and lang is not null").select("text", "lang").mapInArrow(counted, "lang string, bucket long, n long")
    found = written(found.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "gram-counts")
    if (n := found.filter("bucket = -1").count()) > most_languages:
        raise ValueError(f"{n} languages; at most {most_languages} can be learned")
    rows = found.toPandas()
    languages = sorted(rows["lang"].unique())
    counts = np.zeros((len(languages), BUCKETS + 1))
    counts[np.searchsorted(languages, rows["lang"]) if languages else [], rows["bucket"].to_numpy(int) + 1] = rows["n"]
    docs, grams = counts[:, 0], counts[:, 1:] + smoothing
    return Model(languages, np.log(docs / docs.sum()) if languages else docs, np.log(grams / grams.sum(axis=1, keepdims=True)))


def identify(documents: DataFrame, folds: int = 5) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score.

    documents: doc_id, text, lang; other columns are not looked at. Rows whose crc32 of
    doc_id, as text, divides by `folds` are held out of the learning, and so are rows
    with a null doc_id, which count as not held out. A null text, or one without letters,
    is `und` with score 0; so is every row where no language was learned. Of equally
    likely languages the first by name wins. Repeated rows each count and each give a
    row. Texts are read whole. An empty table gives no rows.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))
    model = learn(documents.filter(F.crc32(F.col("doc_id").cast("string")) % folds != 0))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            names, scores = [], []
            for texts in batched(t.as_py() for t in batch.column("text")):
                got, score = own.predict(texts)
                names += got
                scores.append(score)
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(run, SCHEMA)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
