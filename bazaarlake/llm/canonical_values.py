"""Mapping freely typed values to a list of canonical entries.

Values and entries become sets of pairs of neighbouring letters. A set-similarity join finds the pairs: tokens are
ordered by their rarity over both sides, only each set's rare prefix is joined, pairs are pruned by the length and
the positional filter, and Jaccard is computed exactly for what is left. Letters in another order, which leave few
neighbours together, are found by their equal sorted letters. Pairs are then checked by edit distance, where exchanged
letters count one less, and each value keeps the entry with fewest edits for its length; Jaccard decides among
equals. Only distinct values are joined, however often they occur.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import measures
from ..session import small, stored

#: Least Jaccard of the token sets of a value and its entry.
SIMILARITY = 0.28
#: Most edits between a value and its entry, as a share of the entry's length; names of under four letters must be equal.
EDITS = 0.4
SHORT = 4
#: What rounding may take from a bound that is a whole number.
SLACK = 1e-9

# Letters of other scripts that look like Latin ones, and signs written for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "m", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ø": "o", "ł": "l", "đ": "d",
}
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i"}
# Words around a brand that are no part of it.
BEFORE = r"brand\s*[:=]|brand|make\s*[:=]|m/s\.?|by|from|genuine|original|the|new"
AFTER = r"official(?: store)?|lanka|sri lanka|\(?pvt\)?\.?|co\.?|ltd\.?|limited|intl\.?|international|inc\.?|llc|plc|corp\.?|authori[sz]ed dealer|electronics|mobile|brand|store|group"


def _plain_letters() -> tuple[str, str]:
    """Accented and wide Latin letters and the plain ones they stand for, by rule from the character database."""
    found = dict(LOOKALIKES)
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        base = unicodedata.normalize("NFKD", chr(code))[:1].lower()
        if base.isascii() and base.isprintable() and base != chr(code):
            found.setdefault(chr(code), base)
    return "".join(found), "".join(found.values())


def cleaned(value: Column) -> Column:
    """A value in plain lower-case letters, one space between words, without signs around it."""
    s = F.regexp_replace(F.lower(value), r"[\p{Cf}\x{AD}\x{300}-\x{36F}]+", "")
    s = F.translate(s, *_plain_letters())
    s = F.regexp_replace(F.regexp_replace(s, r"%20|&nbsp;|[™®©℠_\s\x{A0}\p{Z}]+", " "), r"\s*(?:\band\b|&amp;|&|\+)\s*", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"^[^\p{L}\p{N}@$]+", ""), r"[^\p{L}\p{M}\p{N})$]+$", ""))


def stripped(clean: Column) -> Column:
    """A cleaned value without the words around a name; such a word alone stays."""
    s = F.regexp_replace(clean, rf"^(?:(?:{BEFORE})\s+)+(?=\S)", "")
    s = F.regexp_replace(s, rf"(?<=\S)(?:[\s,]+(?:{AFTER})(?![\p{{L}}\p{{N}}]))+[^\p{{L}}\p{{N}}]*$", "")
    return F.trim(s)


def key_of(name: Column) -> Column:
    """The letters that are compared: look-alike digits and signs as letters, nothing else but letters."""
    return F.regexp_replace(F.translate(name, "".join(LEET), "".join(LEET.values())), r"[^\p{L}\p{M}\p{N}]+", "")


def tokens_of(key: Column) -> Column:
    """The set of a key's pairs of neighbours, ends marked; linear in the key's length."""
    letters = F.split(F.concat(F.lit("^"), key, F.lit("$")), "")
    pairs = F.zip_with(F.slice(letters, F.lit(1), F.size(letters) - 1), F.slice(letters, F.lit(2), F.size(letters) - 1), lambda a, b: F.concat(a, b))
    return F.when(F.length(key) > 0, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def set_similarity_join(left: DataFrame, right: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(l, r, jaccard) of the rows (id, tokens) of both sides whose token sets reach ``similarity``.

    Each pair comes once. Rows with an empty set or a null id have no pair. No cap applies: a token that many
    rows share is ordered last and is joined only by sets too small to have rarer ones. The index of the right side
    is sent to all tasks if it is small, so no token is a hot key; a large one is joined by token, where adaptive
    execution splits what is skewed.
    """
    tagged = left.select(F.lit(0).alias("side"), F.col("id"), "tokens").unionByName(right.select(F.lit(1).alias("side"), F.col("id"), "tokens")).where("id is not null and size(tokens) > 0")
    single = tagged.select("side", "id", F.explode("tokens").alias("token"))
    rarity = single.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ordered = (
        single.join(rarity, "token")
        .groupBy("side", "id")  # a group is the tokens of one value
        .agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("sorted"))
        .select("side", "id", F.transform("sorted", lambda x: x["token"]).alias("tokens"), F.size("sorted").alias("size"))
    )
    prefix = F.col("size") - F.ceil(F.lit(similarity) * F.col("size") - SLACK).cast("int") + 1
    indexed = ordered.select("side", "id", "tokens", "size", F.posexplode(F.slice("tokens", F.lit(1), prefix)).alias("at", "token"))
    # Few rows mean much work here, so they are spread by number, not by size.
    spread = max(left.sparkSession.sparkContext.defaultParallelism, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    a = indexed.where("side = 0").repartition(spread).select("token", F.col("id").alias("l"), F.col("tokens").alias("lt"), F.col("size").alias("ls"), F.col("at").alias("la"))
    b = small(indexed.where("side = 1").select("token", F.col("id").alias("r"), F.col("tokens").alias("rt"), F.col("size").alias("rs"), F.col("at").alias("ra")))
    needed = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("ls") + F.col("rs")) - SLACK)
    lengths = (F.col("rs") >= F.lit(similarity) * F.col("ls") - SLACK) & (F.col("ls") >= F.lit(similarity) * F.col("rs") - SLACK)
    position = F.least(F.col("ls") - F.col("la"), F.col("rs") - F.col("ra")) >= needed
    pairs = a.join(b, "token").where(lengths & position)
    # Of a pair's common prefix tokens only the first is kept: there the positions count the whole overlap.
    overlap = measures.bound(F.array_intersect("lt", "rt"), lambda c: F.when(F.element_at(c, 1) == F.col("token"), F.size(c)))
    scored = pairs.select("l", "r", measures.bound(overlap, lambda n: n / (F.col("ls") + F.col("rs") - n)).alias("jaccard"))
    return scored.where(F.col("jaccard") >= similarity)


def _forms(df: DataFrame, name: str, value: str) -> DataFrame:
    """(name, form): the keys under which a value is compared, with and without the words around a name."""
    clean = df.select(F.col(name), cleaned(F.col(value)).alias("c"))
    both = clean.select(name, "c", stripped(F.col("c")).alias("s"))
    return both.select(name, F.explode(F.array_distinct(F.array(key_of(F.col("c")), key_of(F.col("s"))))).alias("form")).where("form <> ''").distinct()


def best_entries(values: DataFrame, entries: DataFrame, similarity: float = SIMILARITY, edits: float = EDITS) -> DataFrame:
    """(value, entry_id, jaccard, edits) for each distinct value of ``values`` (value); 0 where no entry fits.

    ``entries`` has (entry_id, name): the names and aliases of an entry, a row each. A pair counts if its edits are at
    most ``edits`` of the entry's length. Of several entries the one with fewest edits for its length is kept, then
    the one with the highest Jaccard, then the lowest id. A value may lose
    the words around a name. Null and blank values have no row.
    """
    distinct = values.where("value is not null and value rlike '[^\\\\s\\\\p{Z}]'").select("value").distinct()
    typed = stored(_forms(distinct, "value", "value"))  # used for the join and to find the values again
    listed = _forms(entries.where("entry_id is not null and name is not null"), "entry_id", "name")
    sets = lambda df: df.select("form").distinct().select(F.col("form").alias("id"), tokens_of(F.col("form")).alias("tokens"))
    near = set_similarity_join(sets(typed), sets(listed), similarity)
    letters = lambda c: F.array_sort(F.split(F.col(c), ""))
    by_letters = lambda df, name: sets(df).select(F.array_join(letters("id"), "").alias("letters"), F.col("id").alias(name), F.col("tokens").alias(f"{name}_tokens"))
    turned = by_letters(typed, "l").join(small(by_letters(listed, "r")), "letters")
    alike = F.size(F.array_intersect("l_tokens", "r_tokens")) / F.size(F.array_union("l_tokens", "r_tokens"))
    pairs = near.unionByName(turned.select("l", "r", alike.alias("jaccard")).where(F.col("jaccard") < similarity))
    distance = F.levenshtein("l", "r") - F.when((F.col("l") != F.col("r")) & (letters("l") == letters("r")), 1).otherwise(0)
    checked = pairs.select("l", "r", "jaccard", distance.alias("edits")).where(F.col("edits") <= F.when(F.length("r") < SHORT, 0.0).otherwise(F.lit(edits) * F.length("r")))
    named = checked.join(listed.withColumnRenamed("form", "r"), "r")
    order = F.struct(-F.col("edits") / F.length("r"), F.col("jaccard"), -F.col("entry_id"))
    best = named.groupBy("l").agg(F.max(F.struct(order.alias("o"), "entry_id", "jaccard", "edits")).alias("b"))
    found = typed.join(best.withColumnRenamed("l", "form"), "form").groupBy("value").agg(F.max("b").alias("b"))
    return distinct.join(found, "value", "left").select(
        "value", F.coalesce("b.entry_id", F.lit(0)).cast("bigint").alias("entry_id"), F.col("b.jaccard").alias("jaccard"), F.col("b.edits").alias("edits")
    )


def entries_of(reference: DataFrame) -> DataFrame:
    """(entry_id, name): a row for each name and alias of the list of brands."""
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    return reference.select(F.col("brand_id").alias("entry_id"), F.explode(F.concat(F.array("brand_name"), aliases)).alias("name"))


def mapped(sources: list[DataFrame], reference: DataFrame) -> DataFrame:
    """(source_table, record_id, brand_id) of the rows (source_table, record_id, value) that are not exactly a name.

    Null and blank values have no row; repeated rows repeat.
    """
    rows = sources[0]
    for more in sources[1:]:
        rows = rows.unionByName(more)
    names = reference.where("brand_name is not null").select(F.col("brand_name").alias("value")).distinct()
    rows = rows.join(small(names), "value", "left_anti")
    # A hot value is one row here, and its rows meet it by a join that may be split or broadcast.
    best = best_entries(rows, entries_of(reference))
    return rows.join(best.select("value", F.col("entry_id").alias("brand_id")), "value").select("source_table", "record_id", "brand_id")
