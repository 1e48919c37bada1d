"""Numbers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How availability is told.
AVAILABLE = "instock|in_stock|limitedavailability|onlineonly|preorder"
NOT_AVAILABLE = "outofstock|out_of_stock|soldout|discontinued|backorder"


def number(text: Column) -> Column:
    """Digits and points of a text as a number; null if they make none."""
    return F.nullif(F.nullif(F.regexp_replace(text, r"[^0-9.]", ""), F.lit("")), F.lit(".")).try_cast("double")


def price(text: Column) -> Column:
    """The first number of a text, commas as separators; null unless it is above 0."""
    found = F.regexp_extract(F.replace(text, F.lit(" "), F.lit("")), r"([\d,]+(?:\.\d+)?)", 1)
    value = F.nullif(F.replace(found, F.lit(","), F.lit("")), F.lit("")).try_cast("double")
    return F.get(F.filter(F.array(value), lambda v: v > 0), F.lit(0))


def available(text: Column) -> Column:
    """Whether an availability is one that can be bought; null if it says neither. Sold-out words go first."""
    low = F.lower(F.regexp_replace(text, r"(?i)https?://|schema\.org/", ""))
    return F.when(low.rlike(NOT_AVAILABLE), F.lit(False)).when(low.rlike(AVAILABLE), F.lit(True))


def confidence(value: Column) -> Column:
    """A number within 0 and 1; 0 for what is no finite number."""
    x = value.try_cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).otherwise(F.lit(0.0))


def sane_price(value: Column) -> Column:
    """A finite price above 0 to two places; null for any other."""
    x = value.try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (x != float("inf")) & (x > 0), F.round(x, 2))


def first_truthy(*values: Column) -> Column:
    """The first number that is neither null nor 0, else the last one."""
    return F.coalesce(*(F.nullif(v, F.lit(0)) for v in values[:-1]), values[-1])
