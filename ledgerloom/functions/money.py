"""Money: raw amounts as cents, and cents as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def number(text: Column) -> Column:
    """A plain decimal number, else null; no suffixes, underscores, NaN or infinity."""
    return F.when(F.rlike(text, F.lit(_NUMBER)), text.try_cast("double"))


def _cents(rand: Column) -> Column:
    return F.bround(rand * 100, 0).cast("long")


def rand_default(value: Column) -> Column:
    """Cents of an amount read as Rand, with or without its prefix."""
    text = F.lower(F.trim(value.cast("string")))
    bare = F.trim(F.regexp_replace(text, "^r", ""))
    return _cents(number(F.replace(bare, F.lit(","), F.lit(""))))


def candidates(value: Column) -> Column:
    """Sorted cent readings of a raw amount.

    With the Rand prefix there is one; a bare number is Rand, and cents too if it is
    whole.  Anything that is no number has none.
    """
    text = F.lower(F.trim(value.cast("string")))
    prefixed = F.startswith(text, F.lit("r"))
    n = number(F.replace(text, F.lit(","), F.lit("")))
    bare = F.when(n == F.floor(n), F.array(_cents(n), n.cast("long"))).when(n.isNotNull(), F.array(_cents(n)))
    rand = rand_default(value)
    found = F.when(prefixed, F.when(rand.isNotNull(), F.array(rand))).otherwise(bare)
    return F.coalesce(F.array_sort(F.array_distinct(found)), F.array().cast("array<bigint>"))


def to_cents(value: Column, known: Column) -> Column:
    """The smallest reading among the known prices, else the amount as Rand."""
    matching = F.filter(candidates(value), lambda c: F.array_contains(known, c))
    return F.when(F.size(candidates(value)) > 0, F.coalesce(F.get(matching, F.lit(0)), rand_default(value)))


def matches_known(value: Column, known: Column) -> Column:
    return F.arrays_overlap(candidates(value), known)


def rand_text(cents: Column) -> Column:
    """R30 for whole Rand, R30.50 otherwise."""
    whole = cents % 100 == 0
    return F.when(whole, F.format_string("R%d", F.floor(cents / 100).cast("long"))).otherwise(
        F.format_string("R%.2f", cents / 100)
    )


def parse_rand(text: Column) -> Column:
    """Positive cents of a typed amount, halves up; null for anything else."""
    n = number(F.replace(F.trim(text), F.lit(","), F.lit("")))
    cents = F.floor(n * 100 + 0.5).cast("long")
    return F.when((cents > 0) & (cents <= F.lit((1 << 53) - 1)), cents)


def parse_non_negative(text: Column) -> Column:
    n = number(F.trim(text))
    return F.when(n >= 0, n)


def clamp_confidence(text: Column, default: float = 0.5) -> Column:
    """A score in [0, 1]; missing, NaN, infinite or no number gives the default."""
    x = text.try_cast("double")
    usable = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.when(usable, F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(default))
