"""Keys, labels and reaction strings as Column expressions. Nulls stay null unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts that a reaction key leaves out, the levels of a label, the letters that an X does not stand for.
SPECTATORS = ("O", "[H+]")
LABEL_LEVELS = 4
STANDARD_LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def sha256_short(x: Column) -> Column:
    return F.substring(F.sha2(x, 256), 1, 24)


def pair_id(a: Column, b: Column) -> Column:
    """20 hex digits of the SHA-1 of a and b with a NUL between them."""
    return F.substring(F.sha1(F.concat(a, F.lit("\0"), b)), 1, 20)


def slugify(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"[^A-Za-z0-9_.-]+", "_"), r"^[._]+|[._]+$", "")


def strip_whitespace(x: Column) -> Column:
    return F.regexp_replace(x, r"\s+", "")


def undirected_key(x: Column) -> Column:
    """A>>B and B>>A alike; the first >> splits; others unchanged."""
    at = F.instr(x, ">>")
    left, right = F.substr(x, F.lit(1), at - 1), F.substr(x, at + 2)
    return F.when(at > 0, F.concat(F.least(left, right), F.lit(">>"), F.greatest(left, right))).otherwise(x)


def parts(side: Column) -> Column:
    return F.filter(F.transform(F.split(side, r"\."), lambda p: F.trim(p)), lambda p: p != "")


def sides(x: Column) -> tuple[Column, Column]:
    return F.split_part(x, F.lit(">>"), F.lit(1)), F.split_part(x, F.lit(">>"), F.lit(2))


def canonical_reaction(x: Column, canonical=lambda p: p) -> Column:
    """Parts through `canonical`, each side by falling length and then text; null if any part fails or a side is empty."""
    done = []
    for side in sides(x):
        mapped = F.transform(parts(side), canonical)
        order = F.array_sort(mapped, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
        failed = F.exists(mapped, lambda p: p.isNull()) | (F.size(mapped) == 0)
        done.append(F.when(~failed, F.array_join(order, ".")))
    return F.concat(done[0], F.lit(">>"), done[1])


def reaction_key(x: Column, spectators: tuple[str, ...] = SPECTATORS) -> Column:
    """Sorted parts of each side without spectators."""
    done = [F.array_join(F.array_sort(F.filter(parts(s), lambda p: ~p.isin(*spectators))), ".") for s in sides(x)]
    return F.concat(done[0], F.lit(">>"), done[1])


def key_or_fallback(key: Column, fallback: Column) -> Column:
    return F.coalesce(key, fallback)


def accession_base(x: Column) -> Column:
    """What stands before the first bar, trimmed; blank is null."""
    return F.nullif(F.trim(F.substring_index(x, "|", 1)), F.lit(""))


def isoform_root(x: Column) -> Column:
    return F.regexp_replace(x, r"-\d+$", "")


def padded_levels(x: Column, levels: int = LABEL_LEVELS) -> Column:
    """The dotted levels as an array of exactly `levels`, missing ones as -."""
    return F.slice(F.concat(F.split(x, r"\."), F.array_repeat(F.lit("-"), levels)), 1, levels)


def label_token(x: Column, levels: int = LABEL_LEVELS) -> Column:
    """Dotted levels made whole: blank ones go, each keeps its ASCII letters, digits and -, or becomes -; a fourth that is not a number becomes -, missing ones are -. Null without a level."""
    trimmed = F.transform(F.split(x, r"\."), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    own = F.slice(F.filter(trimmed, lambda p: p != ""), 1, levels)
    clean = F.transform(own, lambda p: F.coalesce(F.nullif(F.regexp_replace(p, "[^A-Za-z0-9-]", ""), F.lit("")), F.lit("-")))
    checked = F.transform(clean, lambda p, i: F.when((i == 3) & ~p.rlike(r"^\d+$"), "-").otherwise(p))
    return F.when(F.size(own) > 0, F.array_join(F.slice(F.concat(checked, F.array_repeat(F.lit("-"), levels)), 1, levels), "."))


def label_collection(x: Column) -> Column:
    """Labels found in free text, made whole, in order of first appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(r"(\d+(?:\.(?:\d+|-)){1,3})"), F.lit(1)), lambda t: label_token(t)))


def clean_label(x: Column) -> Column:
    """Trimmed; null and nan become empty."""
    t = F.trim(F.coalesce(x, F.lit("")))
    return F.when(F.lower(t) == "nan", "").otherwise(t)


def parse_equation(x: Column, pattern: str) -> Column:
    """left and right, arrays of (coef, id), and direction, <=> or =>, of two sides with ' <=> ', ' => ' or ' = ' between.

    Terms stand between ' + ', so an id may hold a +. An id is what the pattern (without
    groups) finds first in a term; the coefficient is the text before it, 1 if blank. Null
    where there are not two sides, or a term has no id.
    """
    sides_ = F.split(F.regexp_replace(x, " <=> | => ", " = "), " = ")
    term = lambda t: F.struct(F.coalesce(F.nullif(F.trim(F.regexp_extract(t, f"(.*?){pattern}", 1)), F.lit("")), F.lit("1")).alias("coef"), F.nullif(F.regexp_extract(t, pattern, 0), F.lit("")).alias("id"))
    side = lambda k: F.transform(F.split(F.get(sides_, F.lit(k)), r" \+ "), term)
    found = F.struct(side(0).alias("left"), side(1).alias("right"), F.when(F.contains(x, F.lit("<=>")), "<=>").otherwise("=>").alias("direction"))
    whole = (F.size(sides_) == 2) & ~F.exists(F.concat(side(0), side(1)), lambda t: t["id"].isNull())
    return F.when(whole, found)


def mutate(sequence: Column, edits: Column) -> Column:
    """Apply edits such as A12G, in order; null if an edit is malformed, out of range, or names another residue."""

    def step(s: Column, e: Column) -> Column:
        at = F.regexp_extract(e, r"^[A-Za-z](\d+)[A-Za-z]$", 1).try_cast("int")
        fits = e.rlike(r"^[A-Za-z]\d+[A-Za-z]$") & (at >= 1) & (at <= F.length(s)) & (F.substr(s, at, F.lit(1)) == F.substring(e, 1, 1))
        return F.when(fits, F.overlay(s, F.substring(e, -1, 1), at, F.lit(1)))

    return F.aggregate(edits, sequence, step)


def range_mean(x: Column, bad: float = -999.0) -> Column:
    """Mean of a-b, the number itself, or `bad`."""
    low, high = F.regexp_extract(x, r"^\s*(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)\s*$", 1), F.regexp_extract(x, r"^\s*(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)\s*$", 2)
    mean = (low.try_cast("double") + high.try_cast("double")) / 2
    return F.coalesce(mean, x.try_cast("double"), F.lit(bad))


def first_part(x: Column, sign: str = "::") -> Column:
    return F.trim(F.substring_index(x, sign, 1))


def template_keys(template: Column, key: Column, n: int) -> Column:
    """The template with {key} and {i} filled in, for i from 0 to n - 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.replace(F.replace(template, F.lit("{key}"), key), F.lit("{i}"), i.cast("string")))


def structure_key(x: Column) -> Column:
    """'1abc:P1|A' as 1ABC_A; without a chain, 1ABC."""
    pdb, chain = F.upper(F.split_part(F.split_part(x, F.lit("|"), F.lit(1)), F.lit(":"), F.lit(1))), F.split_part(x, F.lit("|"), F.lit(2))
    return F.concat_ws("_", pdb, F.nullif(chain, F.lit("")))


def source_suffix(x: Column) -> Column:
    found = F.regexp_extract(x, r"_(alpha|beta|gamma)$", 1)
    return F.when(found == "", "none").otherwise(found)


def hash_seed(x: Column) -> Column:
    """The first eight bytes of the SHA-256 as an unsigned number, a decimal(20,0)."""
    return F.conv(F.substring(F.sha2(x, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def sorted_strings(x: Column) -> Column:
    """Distinct non-blank strings, trimmed, sorted; null gives an empty list."""
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(F.transform(x, lambda v: F.trim(v)), lambda v: v != ""))), F.array().cast("array<string>"))


def wildcard_equal(a: Column, b: Column, standard: str = STANDARD_LETTERS) -> Column:
    """Equal length and equal letters, an X in b standing for any letter that is not standard."""
    one = lambda x, y: F.coalesce((x == y) | ((y == "X") & (F.instr(F.lit(standard), x) == 0)), F.lit(False))
    return (F.length(a) == F.length(b)) & F.forall(F.zip_with(F.split(a, ""), F.split(b, ""), one), lambda v: v)
