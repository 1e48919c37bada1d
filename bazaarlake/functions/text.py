"""Texts and HTML as Column expressions. Null in, null out, unless a function says otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = r"(?U)\s+"


def collapsed(text: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def content_hash(*texts: Column) -> Column:
    """MD5 of the first text that is not empty, white space collapsed; all of them empty or null give the hash of ''."""
    return F.md5(collapsed(F.coalesce(*(F.nullif(t, F.lit("")) for t in texts), F.lit(""))))


def first_text(*texts: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*(F.nullif(t, F.lit("")) for t in texts))


def without_tags(html: Column, by: str = " ") -> Column:
    return F.regexp_replace(html, r"<[^>]+>", by)


def visible(html: Column) -> Column:
    """Text without tags; a text that holds no tag stays as it is, null gives ''."""
    text = F.coalesce(html, F.lit(""))
    return F.when(text.contains("<"), without_tags(text)).otherwise(text)


def title(html: Column) -> Column:
    """The text of the title element, or of h1 if there is no title element; 300 characters at most, null if empty."""
    both = F.when(html.rlike(r"(?is)<title[^>]*>.*?</title>"), F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)).otherwise(
        F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    )
    return F.nullif(F.substring(collapsed(without_tags(both, "")), 1, 300), F.lit(""))


def skeleton(html: Column, budget: int) -> Column:
    """HTML without scripts, styles, drawings and their like, white space collapsed, cut at the budget (500 at least)."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|svg|noscript)[^>]*>.*?</\1>", " ")
    return F.substring(F.regexp_replace(bare, SPACE, " "), 1, max(500, budget))


def body_within(html: Column, limit: int = 5_000_000) -> Column:
    """A page's body, '' if it is longer than ``limit`` bytes."""
    return F.when(F.octet_length(html) <= limit, html).otherwise(F.lit(""))


def escaped(text: Column) -> Column:
    """A text fit for an XML attribute; null gives ''."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def json_string(text: Column) -> Column:
    return F.get_json_object(F.to_json(F.struct(text.alias("x"))), "$")


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Unicode's compatibility form. Python sees null for plain ASCII, since a condition around it would not hold rows back."""
    more = text.rlike(r"[^\x00-\x7F]")
    return F.coalesce(_nfkc(F.when(more, text)), text)


def lines_of(text: Column) -> Column:
    """The lines of a form field that are neither blank nor comments, trimmed."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\R"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: (x != "") & ~x.startswith("#"))


def vector(text: Column) -> Column:
    """A vector written as [a,b,...]."""
    return F.from_json(text, "array<float>")


def vector_text(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: v.cast("string")), ","), F.lit("]"))


def pairs_to_map(pairs: Column, key: str = "key", value: str = "value") -> Column:
    """A list of pairs as a map; of a key that comes again the last value counts, null keys go, null gives an empty map."""
    rows = F.filter(F.coalesce(pairs, F.array()), lambda p: p[key].isNotNull())
    last = F.filter(rows, lambda p, i: ~F.exists(F.slice(rows, i + 2, F.size(rows)), lambda q: q[key] == p[key]))
    return F.map_from_arrays(F.transform(last, lambda p: p[key]), F.transform(last, lambda p: p[value]))


def coerced(parsed: Column, text: Column, schema: str, needed: str) -> Column:
    """A structured answer: the parsed one if there is one, else its text read as JSON; null if neither has ``needed``.

    Text around a JSON object, such as a code fence, is left out.
    """
    bare = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    read = F.from_json(F.nullif(bare, F.lit("")), schema)
    return F.coalesce(F.when(parsed[needed].isNotNull(), parsed), F.when(read[needed].isNotNull(), read))
