"""Quantities in text: numbers with units, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How units are written. (alias, kind, unit, factor to the common unit, offset)
# Money is in rupees (a currency has factor 1 in itself), memory in MB.
ALIASES = [
    ("indian rupee", "currency", "INR", 1.0, 0.0), ("indian rupees", "currency", "INR", 1.0, 0.0), ("inr", "currency", "INR", 1.0, 0.0), ("₹", "currency", "INR", 1.0, 0.0),
    ("us dollar", "currency", "USD", 1.0, 0.0), ("us dollars", "currency", "USD", 1.0, 0.0), ("usd", "currency", "USD", 1.0, 0.0), ("us$", "currency", "USD", 1.0, 0.0),
    ("$", "currency", "USD", 1.0, 0.0), ("dollar", "currency", "USD", 1.0, 0.0), ("dollars", "currency", "USD", 1.0, 0.0),
    ("aed", "currency", "AED", 1.0, 0.0), ("dhs", "currency", "AED", 1.0, 0.0), ("dh", "currency", "AED", 1.0, 0.0), ("dirham", "currency", "AED", 1.0, 0.0), ("dirhams", "currency", "AED", 1.0, 0.0),
    ("eur", "currency", "EUR", 1.0, 0.0), ("€", "currency", "EUR", 1.0, 0.0), ("euro", "currency", "EUR", 1.0, 0.0), ("euros", "currency", "EUR", 1.0, 0.0),
    ("lkr", "currency", "LKR", 1.0, 0.0), ("rs", "currency", "LKR", 1.0, 0.0), ("රු", "currency", "LKR", 1.0, 0.0), ("ரூ", "currency", "LKR", 1.0, 0.0), ("rupee", "currency", "LKR", 1.0, 0.0), ("rupees", "currency", "LKR", 1.0, 0.0),
    ("thousand", "scale", "thousand", 1e3, 0.0), ("thousands", "scale", "thousand", 1e3, 0.0), ("k", "scale", "thousand", 1e3, 0.0), ("දහස්", "scale", "thousand", 1e3, 0.0), ("ஆயிரம்", "scale", "thousand", 1e3, 0.0), ("'000", "scale", "thousand", 1e3, 0.0),
    ("lakh", "scale", "lakh", 1e5, 0.0), ("lakhs", "scale", "lakh", 1e5, 0.0), ("lac", "scale", "lakh", 1e5, 0.0), ("lacs", "scale", "lakh", 1e5, 0.0), ("ලක්ෂ", "scale", "lakh", 1e5, 0.0), ("லட்சம்", "scale", "lakh", 1e5, 0.0),
    ("million", "scale", "million", 1e6, 0.0), ("millions", "scale", "million", 1e6, 0.0), ("mn", "scale", "million", 1e6, 0.0), ("m", "scale", "million", 1e6, 0.0),
    ("cent", "scale", "cent", 1e-2, 0.0), ("cents", "scale", "cent", 1e-2, 0.0), ("minor units", "scale", "cent", 1e-2, 0.0), ("minor unit", "scale", "cent", 1e-2, 0.0),
    ("terabyte", "memory", "TB", 1048576.0, 0.0), ("terabytes", "memory", "TB", 1048576.0, 0.0), ("tb", "memory", "TB", 1048576.0, 0.0), ("t", "memory", "TB", 1048576.0, 0.0),
    ("gigabyte", "memory", "GB", 1024.0, 0.0), ("gigabytes", "memory", "GB", 1024.0, 0.0), ("gig", "memory", "GB", 1024.0, 0.0), ("gigs", "memory", "GB", 1024.0, 0.0), ("gb", "memory", "GB", 1024.0, 0.0), ("g", "memory", "GB", 1024.0, 0.0),
    ("megabyte", "memory", "MB", 1.0, 0.0), ("megabytes", "memory", "MB", 1.0, 0.0), ("m.b.", "memory", "MB", 1.0, 0.0), ("mb", "memory", "MB", 1.0, 0.0),
]

# Number words before a unit.
NUMBER_WORDS = {"half a": "0.5", "half": "0.5", "quarter": "0.25", "one": "1", "a": "1", "two": "2", "three": "3", "four": "4", "six": "6", "eight": "8", "twelve": "12", "sixteen": "16"}


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def alias_table(spark: SparkSession, *kinds: str) -> DataFrame:
    """The aliases of some kinds as a literal table; its size does not depend on data."""
    rows = ", ".join(f"('{a.replace(chr(39), chr(92) + chr(39))}', '{k}', '{u}', {f}D, {o}D)" for a, k, u, f, o in ALIASES if k in kinds)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(alias, kind, unit, factor, offset)")


def _one_of(kind: str) -> str:
    """A pattern for the aliases of a kind, longest first; words stand alone, signs may touch anything."""
    found = sorted((a for a, k, *_ in ALIASES if k == kind), key=lambda a: (-len(a), a))
    quoted = [a.replace(".", r"\.").replace("$", r"\$") for a in found]
    return "|".join(rf"(?<![a-z]){q}(?![a-z])" if f[0].isascii() and f[0].isalpha() else q for f, q in zip(found, quoted, strict=True))


MEMORY_UNIT = "terabytes?|tb|t|gigabytes?|gigs?|gb|g|megabytes?|m\\.b\\.|mb"
_QUANTITY = rf"(?<![\w.])(\d+(?:\.\d+)?)[\s-]*({MEMORY_UNIT})"
_AFTER = r"(?![a-z0-9])"
_PAIR = (
    rf"(?<![\w.-])(?:(\d{{1,3}})[+/]|(?<![\w.])(\d+(?:\.\d+)?)[\s-]*({MEMORY_UNIT})\s*[+/|]\s*)(\d+(?:\.\d+)?)[\s-]*({MEMORY_UNIT})(?![a-z0-9])(?!\s*(?:of\s+)?(?:ram|memory))"
)
#: A pair that was found, taken apart: without what must not stand around it.
_IN_PAIR = rf"^(?:(\d{{1,3}})[+/]|(\d+(?:\.\d+)?)[\s-]*({MEMORY_UNIT})\s*[+/|]\s*)(\d+(?:\.\d+)?)[\s-]*({MEMORY_UNIT})$"
_RAM = rf"{_QUANTITY}\s*(?:of\s+)?(?:ram|memory)\b"
#: Amounts that are not built in: the size of cards that fit, and space elsewhere.
_CARDS = rf"(?:micro\s?sd|cards?|expand\w*|up\s?to)[\s:]+(?:up\s?)?(?:to\s+)?{_QUANTITY.replace('(?<![\\w.])', '', 1)}{_AFTER}"
_CLOUD = rf"{_QUANTITY}\s+(?:of\s+)?(?:free\s+)?(?:i?cloud|online|drive)\b"


def memory_text(col: Column) -> Column:
    """A text in lower case with digits for number words and without amounts that are not built in."""
    unit = r"(?=tera|giga|gigs?\b|mega|[tgm]b\b)"

    def digits(s: Column) -> Column:
        for word, number in NUMBER_WORDS.items():
            s = F.regexp_replace(s, rf"\b{word}[\s-]+{unit}", f"{number} ")
        return s

    # Each step is taken only by texts that have what it is for.
    s = bound(F.lower(col), lambda s: F.when(s.rlike(rf"\b(?:{'|'.join(NUMBER_WORDS)})[\s-]+{unit}"), digits(s)).otherwise(s))
    s = bound(s, lambda s: F.when(s.rlike(r"sd\b|card|expand|up\s?to"), F.regexp_replace(F.regexp_replace(s, _CARDS, " "), _CARDS, " ")).otherwise(s))
    s = bound(s, lambda s: F.when(s.rlike("cloud|online|drive"), F.regexp_replace(s, _CLOUD, " ")).otherwise(s))
    return F.regexp_replace(s, r"(?<![\w.])5g(?![a-z0-9])(?!\s*(?:of\s+)?(?:ram|memory|rom|storage|internal))", " ")


def _told(number: Column, unit: Column) -> Column:
    """struct(number, unit) of an amount, the unit as it is written; null where there is no number."""
    return F.when(number.isNotNull(), F.struct(number.alias("number"), unit.alias("unit")))


def in_mb(amount: Column) -> Column:
    """MB of a told amount of memory, where no join with the table of aliases is at hand."""
    cases = sorted({(u, f) for _, k, u, f, _ in ALIASES if k == "memory"})
    named = F.upper(F.substring(amount["unit"], 1, 1))
    return amount["number"] * reduce(lambda w, c: w.when(named == c[0][0], F.lit(c[1])), cases[1:], F.when(named == cases[0][0][0], F.lit(cases[0][1])))


def memory_told(s: Column) -> Column:
    """struct(ram, storage): built-in amounts that a ``memory_text`` tells, each struct(number, unit) or null.

    Read are ``8+256GB`` and the like, an amount before RAM or memory, and of the amounts left the first. A number
    without unit in a pair has GB, or MB where the other has MB. Card slots' limits, cloud space and the radio
    standard 5G are no amounts.
    """
    number = lambda text, k, pattern: F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).try_cast("double")
    unit = lambda text, k, pattern: F.regexp_extract(text, pattern, k)

    def of_pair(p: Column) -> Column:
        second = unit(p, 5, _IN_PAIR)
        shared = F.when(second.startswith("m"), F.lit("mb")).otherwise(F.lit("gb"))
        ram = F.coalesce(_told(number(p, 1, _IN_PAIR), shared), _told(number(p, 2, _IN_PAIR), unit(p, 3, _IN_PAIR)))
        return F.struct(ram.alias("ram"), _told(number(p, 4, _IN_PAIR), second).alias("storage"))

    def of_singles(r: Column) -> Column:
        rest = F.when(r != "", F.regexp_replace(s, _RAM, " # ")).otherwise(s)
        ram = _told(number(r, 1, _QUANTITY), unit(r, 2, _QUANTITY))
        return bound(F.regexp_extract(rest, _QUANTITY + _AFTER, 0), lambda q: F.struct(ram.alias("ram"), _told(number(q, 1, _QUANTITY), unit(q, 2, _QUANTITY)).alias("storage")))

    return bound(F.regexp_extract(s, _PAIR, 0), lambda p: F.when(p != "", of_pair(p)).otherwise(bound(F.regexp_extract(s, _RAM, 0), of_singles)))


def memory_of(s: Column) -> Column:
    """struct(ram_mb, storage_mb): ``memory_told`` in MB."""
    return bound(memory_told(s), lambda m: F.struct(in_mb(m["ram"]).alias("ram_mb"), in_mb(m["storage"]).alias("storage_mb")))


def amount_told(s: Column) -> Column:
    """struct(number, unit) of a ``memory_text`` that is an amount and nothing else, such as ``16 GB`` or ``one terabyte``."""
    return bound(F.regexp_extract(s, _QUANTITY + _AFTER, 0), lambda q: _told(F.nullif(F.regexp_extract(q, _QUANTITY, 1), F.lit("")).try_cast("double"), F.regexp_extract(q, _QUANTITY, 2)))


def amount_of(s: Column) -> Column:
    """``amount_told`` in MB."""
    return bound(amount_told(s), in_mb)


CURRENCY, SCALE = f"({_one_of('currency')})", f"({_one_of('scale')})"
_NUMBER = r"\d[\d,.]*\d|\d"
#: What follows a cash price and speaks of instalments.
_INSTALMENTS = r"(?:\s+or\s+\d+\s*x\s.*|\s*/\s*\d+\s+instal.*|\(\s*\d+\s*x\s.*)$"


def price_in(col: Column) -> Column:
    """struct(number, currency, scale): the present cash price of a shown price; units are aliases or ''.

    Instalments are cut off; of several amounts the last is the present one (an old price stands first).
    A number such as 17.890,00 is read with its comma as decimal point unless a scale follows.
    """
    s = F.regexp_replace(F.lower(col), _INSTALMENTS, "")
    last = rf"^(?:.*(?:{_NUMBER}))?([^\d]*?)(?<!\d)(?<!\d[.,])({_NUMBER})([^\d]*)$"
    number = F.regexp_extract(s, last, 2)
    units = F.concat_ws(" ", F.regexp_extract(s, last, 1), F.regexp_extract(s, last, 3))
    scale = F.regexp_extract(units, SCALE, 1)
    turned = number.rlike(r"^\d{1,3}(?:\.\d{3})+(?:,\d+)?$") & (scale == "")
    plain = F.when(turned, F.translate(F.regexp_replace(number, r"\.", ""), ",", ".")).otherwise(F.regexp_replace(number, ",", ""))
    return F.struct(
        plain.try_cast("decimal(24,6)").alias("number"), F.regexp_extract(units, CURRENCY, 1).alias("currency"), scale.alias("scale")
    )
