"""Global alignment of two sequences: identity and coverage."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values, doubled so that scores are whole numbers: match, mismatch, first and further letters of a gap. Gaps at the ends are free.
MATCH, MISMATCH, OPEN, EXTEND = 2, -2, -4, -1
UNIT = 1 << 24  # letters of a sequence at most; scores, identities and pairs are held in one number


def identity_and_coverage(a: str, b: str) -> tuple[float, float]:
    """Share of equal letters among the aligned pairs of the best alignment, and pairs over the length of a; 0 and 0 where a letter is missing on either side.

    Of alignments with the best score, the one with the most equal letters counts, and of
    those the one with the fewest pairs. A row of the table is filled at once: gaps along
    it come from a running maximum.
    """
    if not a or not b:
        return 0.0, 0.0
    if len(a) < len(b):
        identical, pairs = best_pairs(b, a)
    else:
        identical, pairs = best_pairs(a, b)
    return (identical / pairs if pairs else 0.0), pairs / len(a)


def best_pairs(a: str, b: str) -> tuple[int, int]:
    """Equal letters and pairs of the best alignment. Values are score * UNIT^2 + identical * UNIT - pairs, as whole numbers of Python where they need it."""
    kind = np.int64 if 2 * len(b) < 1 << 14 else object
    square = UNIT * UNIT
    x, y = np.array([ord(c) for c in a]), np.array([ord(c) for c in b])
    m = len(y)
    step = np.arange(m + 1).astype(kind)
    least = np.array(-(1 << 61) if kind is np.int64 else -(1 << 90), kind)
    above, gap_down = np.zeros(m + 1, kind), np.full(m + 1, least, kind)
    equal, other = MATCH * square + UNIT - 1, MISMATCH * square - 1
    best = np.zeros(1, kind)[0]
    for i in range(len(x)):
        gap_down = np.maximum(gap_down + EXTEND * square, above + OPEN * square)
        row = np.zeros(m + 1, kind)
        row[1:] = np.maximum(above[:-1] + np.where(y == x[i], equal, other).astype(kind), gap_down[1:])
        if m > 1:
            shifted = np.maximum.accumulate(row[:-1] - EXTEND * square * step[:-1]) + (OPEN - EXTEND) * square + EXTEND * square * step[1:]
            row[1:] = np.maximum(row[1:], shifted)
        best = max(best, row[-1])
        above = row
    best = int(max(best, above.max()))
    score = (best + square // 2) // square
    rest = best - score * square
    identical = -(-rest // UNIT)
    return identical, identical * UNIT - rest


@F.pandas_udf(T.StructType([T.StructField("identity", T.DoubleType()), T.StructField("coverage", T.DoubleType())]))
def identity_coverage(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """identity and coverage of pairs of texts; nulls count as empty."""
    found = [identity_and_coverage(x or "", y or "") for x, y in zip(a, b, strict=True)]
    return pd.DataFrame(found, columns=["identity", "coverage"])
