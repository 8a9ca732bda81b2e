"""Token counts by a sentencepiece model: pre-tokens that are one token are counted from a table, the rest are merged by the library.

A pre-token is a run of spaces with the characters after it. Where no vocabulary string
has a space after another character (checked when the table is built), no merge crosses
the border of two pre-tokens, so a text's tokens are those of its pre-tokens. The table
holds every vocabulary string that the library, asked for it alone, gives as one token.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.common import table
from holdfast.llm.tokens import tokenizer_path

SPACE = "▁"
COUNT_SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class PieceCounter:
    """memo: pre-tokens outside the table whose counts are kept, twice that for a moment."""

    LONGEST = 64

    def __init__(self, path: str, memo: int = 300_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.separable = not any(SPACE in p.lstrip(SPACE) for p in pieces) and self.model.encode(f"a{SPACE}b") == self.model.encode("a b")
        self.whole = self.proven(pieces) if self.separable else {}
        self.memo = memo
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def proven(self, pieces: list[str]) -> dict[str, int]:
        """Words that alone are one token, by asking the library for each vocabulary string."""
        words = [p[1:] for p in pieces if p.startswith(SPACE) and len(p) > 1 and SPACE not in p[1:]]
        found = {w: 1 for w, ids in zip(words, self.model.encode(words, num_threads=1), strict=True) if len(ids) == 1}
        return found | {"": len(self.model.encode("a ")) - len(self.model.encode("a"))}  # a space at the end, which can't be asked for alone

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.separable:
            return len(self.model.encode(text, num_threads=1))
        words = text.replace(SPACE, " ").split(" ")
        if "" in words:  # runs of spaces, and spaces at an end: the first pre-token's leading space is the one that the model itself puts in front
            words = [w[1:] for w in re.findall(" +[^ ]*", " " + text.replace(SPACE, " "))]
        young, whole, total = self.young, self.whole, 0
        rest = []
        for w in words:
            if (n := whole.get(w)) is None:
                rest.append(w)
            else:
                total += n
        missing, brief = [], []
        for w in set(rest).difference(young):
            if (known := self.old.get(w)) is not None:
                young[w] = known
            else:
                missing.append(w)
            if len(w) > self.LONGEST:
                brief.append(w)
        if missing:
            for w, ids in zip(missing, self.model.encode(missing, num_threads=1), strict=True):
                young[w] = len(ids)
        total += sum([young[w] for w in rest])
        for w in brief:
            del young[w]
        if len(young) > self.memo:
            self.young, self.old = {}, young
        return total


_COUNTERS: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def token_counts(documents: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit. No shuffle.

    A null text counts as empty (0 bytes, 0 tokens); a null doc_id stays null; repeated
    rows each give a row; other columns are not looked at; texts are read whole; an empty
    table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model)
        for batch in batches:
            n = [own.count(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")).mapInArrow(run, COUNT_SCHEMA)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
