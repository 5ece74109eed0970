"""Value-level expressions: numbers in text, missing values, differences, canonical forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a missing value, as numbers and as text.
MISSING_NUMBERS = (-9999.0, 99999.0, 1.7976931348623157e308, 2.2250738585072014e-308)
MISSING_TEXTS = ("NA", "NaN", "NAN", "nan", "0-*")

#: A decimal number as a whole text; guards casts, which would also take suffixes such as ``1d``.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def number(c: Column) -> Column:
    """The number that a text stands for, else null."""
    text = c.cast("string")
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def as_double(c: Column) -> Column:
    """A numeric column as double; NaN counts as null."""
    value = c.cast("double")
    return F.when(~F.isnan(value), value)


def differs(clean: Column, dirty: Column) -> Column:
    """Whether two cells differ; a null on the dirty side always does."""
    return dirty.isNull() | ~clean.eqNullSafe(dirty)


def missing_number(dirty: Column) -> Column:
    """Whether a numeric cell (NaN already null) is missing: null, infinite or a sentinel."""
    return dirty.isNull() | dirty.isin(*MISSING_NUMBERS) | (F.abs(dirty) == F.lit(float("inf")))


def missing_text(dirty: Column, numeric: bool = False, blank_is_missing: bool = True) -> Column:
    """Whether a text cell is missing: null, a token, blank, or in a ``numeric`` column not a number."""
    found = dirty.isNull() | dirty.isin(*MISSING_TEXTS) | number(dirty).isin(*MISSING_NUMBERS)
    if blank_is_missing:
        found = found | (F.trim(dirty) == "")
    found = found | number(dirty).isNull() if numeric else found
    return F.coalesce(found, F.lit(False))


def canonical(c: Column, numeric: bool) -> Column:
    """A form in which equal values of different types are equal: numbers as doubles, other text as it is."""
    value = as_double(c) if numeric else number(c)
    return F.coalesce(value.cast("string"), c.cast("string"))


def jaccard(a: Column, b: Column) -> Column:
    """Share of the characters of either text that both have; 1 for two texts without characters."""
    x, y = (F.filter(F.array_distinct(F.split(t, "")), lambda s: s != "") for t in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def euclid(a: Column, b: Column) -> Column:
    """Distance of two vectors of equal length."""
    parts = F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double"))
    return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v))


def percent_difference(generated: Column, original: Column) -> Column:
    """|generated - original| as a percentage of generated; 0 if generated is 0."""
    return F.when(generated == 0, 0.0).otherwise(F.abs(generated - original) / F.abs(generated) * 100)
