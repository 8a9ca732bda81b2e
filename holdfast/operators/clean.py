"""Filters and projections that clean measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Plausible temperatures in kelvin and pH values, inclusive.
TEMPERATURE, PH = (273.15, 373.15), (0.0, 14.0)


def is_in(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is among keys; null keys match nothing."""
    return df.join(keys.select(on).distinct(), on, "left_semi")


def is_not_in(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on).distinct(), on, "left_anti")


def plausible(x: Column, low: float, high: float) -> Column:
    """The number, or null where it does not parse or lies outside."""
    v = x.try_cast("double")
    return F.when(v.between(low, high), v)


def qualified_value(x: Column) -> Column:
    """'>5' and '<5' are null; commas, blanks and a leading = go; what then does not parse is null."""
    bare = F.regexp_replace(F.regexp_replace(x, r"[,\s]", ""), "^=", "")
    return F.when(~F.trim(x).rlike("^[<>]"), bare.try_cast("double"))


def placeholder(x: Column, base: float = 5.5) -> Column:
    """Whether x is base times a power of ten."""
    return F.coalesce((x > 0) & (F.abs(F.log10(x / base) - F.round(F.log10(x / base))) < 1e-9), F.lit(False))


def full_label(x: Column) -> Column:
    return ~F.contains(x, F.lit("-")) & (F.size(F.split(x, r"\.")) == 4)


def numeric_label(x: Column) -> Column:
    return x.rlike(r"^\d+\.\d+\.\d+\.\d+$")


#: Fixed values of the SMILES notation: an atom in brackets or of the organic subset, and all that a line may hold.
ATOM = r"\[[0-9]*(?:[A-Z][a-z]?|[a-z]{1,2}|\*)[^\]\[]*\]|Br|Cl|[BCNOPSFI]|[bcnops]|\*"
LINE = rf"^(?:{ATOM}|[-=#$:/\\().~]|%[0-9][0-9]|[0-9])+$"


def tiny(x: Column, most: int = 3) -> Column:
    """A molecule in SMILES notation with at most `most` heavy atoms, or without carbon. Atoms are read from the notation; null, and a text that is not in it, is not tiny."""
    atoms = F.regexp_extract_all(x, F.lit(f"({ATOM})"), F.lit(1))
    symbols = F.transform(atoms, lambda a: F.regexp_extract(a, r"^\[?[0-9]*([A-Z][a-z]?|[a-z]{1,2}|\*)", 1))
    opened, closed = F.regexp_count(x, F.lit(r"\(")), F.regexp_count(x, F.lit(r"\)"))
    heavy = F.filter(symbols, lambda s: s != "H")
    carbon = F.exists(symbols, lambda s: s.isin("C", "c"))
    return F.coalesce(x.rlike(LINE) & (opened == closed) & ((F.size(heavy) <= most) | ~carbon), F.lit(False))


def low_confidence(x: Column, least: float) -> Column:
    """NaN counts as low, null too."""
    return F.coalesce(F.isnan(x) | (x < least), F.lit(True))


def unpivot_present(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """Long rows (ids, value_type, value), without null values."""
    return df.unpivot(ids, values, "value_type", "value").filter("value is not null")


def prefixed_id(candidates: list[tuple[str, Column]]) -> Column:
    """The first candidate that is there, with its prefix."""
    return F.coalesce(*[F.concat(F.lit(prefix), c.cast("string")) for prefix, c in candidates])
