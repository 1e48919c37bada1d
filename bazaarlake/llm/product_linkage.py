"""Listings of the same product.

Titles, columns and attributes are parsed to one description with canonical units; equal descriptions are one
node, however many rows have them. Nodes are compared field by field within blocks; how often a field differs
among listings of one product is learnt from rows that tell it twice, how often among others by
expectation-maximisation over the counts of outcomes. Pairs whose weight makes them matches are linked, so that the
links are expected to be right, and clustered; a node that leaves a field open joins the one cluster that fits best.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import measures
from ..operators.units import RAM_KEYS, STORAGE_KEYS, attribute
from ..session import cut, small

#: Marketing that could be taken for a model, an amount or a region; other such words are in no field's way.
MARKETING = "|".join(
    [
        r"-?\d+\s*%(?:\s*(?:off|original|genuine|discount|cash\s?back|interest|instal\w*)\b)?", r"(?:with\s+)?\d+[\s-]*(?:years?|yrs?|months?)\s+(?:\p{L}+\s+)?warranty", r"warranty\s+(?:of\s+|for\s+)?\d+[\s-]*(?:years?|yrs?|months?)", r"\b(?:in|out of) stock\b",
        r"\b(?:deals?|offers?|prices?|delivery) in \p{L}+", r"\b(?:sale|offers?|deals?)\s+(?:19|20)\d\d\b",
    ]
)
# Sub-models, longest first.
SUB_MODELS = ["pro max", "pro", "plus", "lite", "edge", "fold", "flip", "max", "ultra", "mini", "air", "studio", "kids", "duo", "evo", "sport", "neo", "fe", "se"]
# How regions and conditions are told.
REGIONS = [
    ("us", r"\busa\b|\bus\b|\bamerican\b"), ("in", r"\bindian?\b|\bin\b"), ("ae", r"\buae\b|\bae\b|\bdubai\b"), ("jp", r"\bjp\b|\bjapan(?:ese)?\b"), ("cn", r"\bcn\b|\bchin(?:a|ese)\b"), ("eu", r"\beu\b|\beurope(?:an)?\b"),
    ("uk", r"\buk\b|\bbritish\b"), ("kr", r"\bkr\b|\bkorean?\b"), ("sg", r"\bsg\b|\bsingapore\b"), ("hk", r"\bhk\b|\bhong kong\b"),
]
CONDITIONS = [("refurbished", r"\brefurb\w*|\brenewed\b|\breconditioned\b"), ("used", r"\bused\b|\b(?:second|2nd)[\s-]*hand\b|\bpre-?\s?owned\b|භාවිත කළ|பயன்படுத்திய")]
#: Phones whose memory is told in MB.
SMALL_PHONES = r"\b(?:button|keypad|feature)\s+(?:phone|mobile)\b"

FIELDS = ("brand", "line", "number", "sub", "ram", "storage", "region", "condition")
#: Share of the links that must be expected to be right: patterns of outcomes are taken by their probability while this
#: holds for each of them.
PRECISION = 0.8
#: How often matches agree in a field that no row tells twice; how the rest parts is fitted.
AGREES = 0.98
#: Entries that a list of brands may have to be made one pattern.
MOST_BRANDS = 10_000
#: Rounds of expectation-maximisation.
ROUNDS = 60
_NUMBER = r"\d{1,4}[a-z]?"
_SUB = "|".join(s.replace(" ", r"[\s-]?") for s in SUB_MODELS)


def _names(reference: DataFrame) -> str:
    """A pattern for the names and aliases of the list of brands, longest first; the list is of fixed size."""
    rows = reference.select("brand_name", "aliases").limit(MOST_BRANDS + 1).collect()
    if len(rows) > MOST_BRANDS:
        raise ValueError(f"a list of more than {MOST_BRANDS} brands makes no pattern")
    names = sorted({n.strip().lower() for r in rows for n in [r[0], *(r[1] or [])] if n and len(n.strip()) > 2}, key=lambda n: (-len(n), n))
    quote = lambda n: "".join(c if c.isalnum() or c == " " else f"\\{c}" if c.isascii() else c for c in n)
    return r"(?<![\p{L}\p{N}])(" + "|".join(map(quote, names)) + r")(?![\p{L}\p{N}])" if names else r"(?!)"


def _brand_ids(reference: DataFrame) -> DataFrame:
    """(word, name): the name that each name or alias stands for, in lower case."""
    listed = reference.select("brand_name", F.explode(F.concat(F.array("brand_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("word"))
    return listed.groupBy(F.lower(F.trim("word")).alias("word")).agg(F.min(F.lower("brand_name")).alias("name"))


def _plain(title: Column) -> Column:
    """A title in lower case without marketing that could be taken for something else."""
    return measures.bound(F.lower(title), lambda s: F.when(s.rlike("%|warranty|stock|deal|offer|price|delivery|sale"), F.regexp_replace(s, MARKETING, " ; ")).otherwise(s))


def _no_memory(memory_text: Column) -> Column:
    """A ``memory_text`` without its amounts."""
    return F.regexp_replace(F.regexp_replace(memory_text, measures._PAIR, " ; "), measures._QUANTITY + r"(?:(?![a-z0-9])|(?=ram))", " ; ")


def _first(text: Column, rules: list[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def _blank(col: Column) -> Column:
    return F.nullif(F.trim(F.lower(col)), F.lit(""))


def _twice(a: Column, b: Column, close: Column | None = None) -> Column:
    """How two readings of a field of one row compare: 3 equal, 2 close, 0 different, null unless both tell it."""
    return F.when(a.isNull() | b.isNull(), None).when(a == b, 3).when(close if close is not None else F.lit(False), 2).otherwise(0)


def _near(a: Column, b: Column) -> Column:
    """Whether two lines may be one, typed differently."""
    shorter = F.least(F.length(a), F.length(b))
    return (shorter > 3) & (F.levenshtein(a, b) <= F.when(shorter > 5, 2).otherwise(1))


def parsed(products: DataFrame, reference: DataFrame) -> DataFrame:
    """(id, brand, line, number, sub, ram, storage, region, condition, twice): what each row says of its product.

    Titles go before columns, but a column's model line before the title's. Memory is in MB; nothing said
    means new, no sub-model and no region ('' each); null is unknown. A row of nulls is described by nulls.
    ``twice`` tells of each field how its two readings compare where titles and columns both have it.
    """
    names = _names(reference)
    texts = products.where("id is not null").select(
        "id", "brand", "model_family", "sub_model", "storage_gb", "ram_gb", "region_code", "attributes",
        _plain(F.concat_ws(" ", F.coalesce("raw_title", "clean_title"))).alias("title"), _plain(F.coalesce("clean_title", F.lit(""))).alias("clean"),
        measures.memory_text(attribute(F.col("attributes"), RAM_KEYS)).alias("r"), measures.memory_text(attribute(F.col("attributes"), STORAGE_KEYS)).alias("s"),
    )
    told = lambda text: F.nullif(F.regexp_extract(text, names, 1), F.lit(""))
    without = lambda text, word: F.when(word.isNotNull(), F.replace(text, word, F.lit(" ~ "))).otherwise(text)
    first_word = texts.select("*", told(F.col("title")).alias("word1"))
    branded = first_word.select("*", F.coalesce("word1", told(F.col("clean"))).alias("word"), measures.memory_text(without(F.col("title"), F.col("word1"))).alias("m"))
    first = branded.select("*", measures.memory_of(F.col("m")).alias("told"), _no_memory(F.col("m")).alias("rest"), F.regexp_replace(_blank(F.col("model_family")), r"\s+", " ").alias("family"))
    # The clean title is only read where the raw one leaves a size open.
    more = F.when(F.col("told.ram_mb").isNull() | F.col("told.storage_mb").isNull(), measures.bound(measures.memory_text(without(F.col("clean"), F.col("word"))), measures.memory_of))
    model = rf"(?<![\p{{L}}\p{{N}}.])\p{{L}}{{3,}}[\s-]?{_NUMBER}\+?(?![\p{{L}}\p{{N}}.%\"])(?:[\s-]*(?:{_SUB})(?![\p{{L}}\p{{N}}]))?"
    parts = rf"^(\p{{L}}+)[\s-]?({_NUMBER})(\+)?(?:[\s-]*({_SUB}))?$"
    family = rf"^(\p{{L}}+)(?:[\s-]*({_NUMBER}))?$"
    bare = first.select("*", more.alias("told2"), F.regexp_extract("rest", model, 0).alias("found"))
    fields = bare.select(
        "id", "brand", "word", "told", "told2", "r", "s", "storage_gb", "ram_gb", "rest", "title",
        *(F.nullif(F.regexp_extract("found", parts, k), F.lit("")).alias(f"t{k}") for k in (1, 2, 3, 4)), *(F.nullif(F.regexp_extract("family", family, k), F.lit("")).alias(f"f{k}") for k in (1, 2)),
        F.regexp_replace(_blank(F.col("sub_model")), r"[\s-]+", "").alias("column_sub"), _blank(F.col("region_code")).alias("column_region"),
        _first(F.lower(attribute(F.col("attributes"), ("condition",))), CONDITIONS).alias("column_condition"),
    )
    feature = F.col("title").rlike(SMALL_PHONES) | (F.coalesce("told.ram_mb", "told2.ram_mb", measures.amount_of(F.col("r"))) < 1024)
    ram_column = F.when(F.col("ram_gb") >= 1024, F.col("ram_gb").cast("double")).when(feature & (F.col("ram_gb") >= 16), F.col("ram_gb").cast("double")).otherwise(F.col("ram_gb") * 1024.0)
    storage_column = (
        F.when(F.col("storage_gb") > 16384, F.col("storage_gb").cast("double"))
        .when(feature & (F.col("storage_gb") >= 16), F.col("storage_gb").cast("double"))
        .when(~F.coalesce(feature, F.lit(False)) & (F.col("storage_gb") < 16), F.col("storage_gb") * 1048576.0)
        .otherwise(F.col("storage_gb") * 1024.0)
    )
    read = fields.select(
        "id", "f1", "f2", "t1", "t2", "column_sub", "column_region", "column_condition", "word", _blank(F.col("brand")).alias("column_brand"),
        F.when(F.col("t2").isNotNull(), F.when(F.col("t3") == "+", F.lit("plus")).otherwise(F.regexp_replace("t4", r"[\s-]+", ""))).alias("title_sub"),
        F.coalesce("told.ram_mb", "told2.ram_mb", measures.amount_of(F.col("r"))).alias("title_ram"), F.coalesce("told.storage_mb", "told2.storage_mb", measures.amount_of(F.col("s"))).alias("title_storage"),
        ram_column.alias("column_ram"), storage_column.alias("column_storage"), _first(F.col("rest"), REGIONS).alias("title_region"), _first(F.regexp_replace("rest", r"\bnot used\b", " "), CONDITIONS).alias("title_condition"),
    )
    ids = small(_brand_ids(reference))
    named = read.join(ids, "word", "left").withColumnRenamed("name", "title_brand")
    named = named.join(ids.withColumnRenamed("word", "column_brand"), "column_brand", "left").withColumnRenamed("name", "known_brand")
    c = F.col
    twice = F.array(
        _twice(c("title_brand"), c("known_brand")), _twice(c("t1"), c("f1"), _near(c("t1"), c("f1"))), _twice(c("t2"), c("f2")), _twice(c("title_sub"), c("column_sub")), _twice(c("title_ram"), c("column_ram")), _twice(c("title_storage"), c("column_storage")),
        _twice(c("title_region"), c("column_region")), _twice(c("title_condition"), c("column_condition")),
    )
    return named.select(
        "id", F.coalesce("title_brand", "word", "known_brand", "column_brand").alias("brand"), F.coalesce("f1", "t1").alias("line"), F.coalesce("t2", "f2").alias("number"), F.coalesce("title_sub", "column_sub", F.lit("")).alias("sub"),
        F.coalesce("title_ram", "column_ram").cast("bigint").alias("ram"), F.coalesce("title_storage", "column_storage").cast("bigint").alias("storage"), F.coalesce("title_region", "column_region", F.lit("")).alias("region"),
        F.coalesce("title_condition", "column_condition", F.lit("new")).alias("condition"), twice.alias("twice"),
    )


def nodes_of(descriptions: DataFrame) -> DataFrame:
    """(node, rows, fields): each description once, named after its lowest id; a missing brand is that of the line.

    A line's brand is used only if all rows of the line that tell a brand tell the same one.
    """
    lines = descriptions.where("line is not null and brand is not null").groupBy("line").agg(F.min("brand").alias("low"), F.max("brand").alias("high")).where("low = high")
    once = descriptions.groupBy(*FIELDS).agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("rows"))
    known = once.where("brand is not null").select("node", "rows", *FIELDS)
    filled = once.where("brand is null").join(lines.select("line", "low"), "line", "left").select("node", "rows", F.col("low").alias("brand"), *FIELDS[1:])
    return known.unionByName(filled).groupBy(*FIELDS).agg(F.min("node").alias("node"), F.sum("rows").alias("rows"))


def _outcome(name: str) -> Column:
    """How a field of two nodes compares: 3 equal or told by neither, 2 close, 1 told by one only, 0 different."""
    a, b = F.col(f"a.{name}"), F.col(f"b.{name}")
    equal = F.when(a.isNull() & b.isNull(), 3).when(a.isNull() | b.isNull(), 1).when(a == b, 3)
    return (equal.when(_near(a, b), 2) if name == "line" else equal).otherwise(0)


#: Nodes of a block beyond which it is compared in parts.
BLOCK = 1_000


def compared(nodes: DataFrame) -> DataFrame:
    """(a, b, pairs, outcome of each field) of the nodes that share a block, each pair once with a < b.

    Blocks are a brand with a number, a line with a number and, for nodes without number, a line with its memory. A
    block holds distinct descriptions, so a product with a third of all rows makes it no larger; a large block's
    nodes are spread by hash over parts, each of which meets every node of the block.
    """
    memory = F.concat_ws("|", F.coalesce(F.col("ram").cast("string"), F.lit("-")), F.coalesce(F.col("storage").cast("string"), F.lit("-")))
    has = lambda *names: reduce(lambda x, y: x & y, (F.col(n).isNotNull() for n in names))
    keys = F.array_compact(F.array(
        F.when(has("line", "number"), F.concat_ws("|", F.lit("l"), "line", "number")), F.when(has("brand", "number"), F.concat_ws("|", F.lit("b"), "brand", "number")),
        F.when(has("line") & F.col("number").isNull(), F.concat_ws("|", F.lit("m"), "line", memory)),
    ))
    blocks = nodes.select("*", F.explode(keys).alias("block"))
    parts = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("block", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    sized = blocks.join(parts, "block")
    left = sized.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    right = sized.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = left.alias("a").join(right.alias("b"), (F.col("a.block") == F.col("b.block")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.node") < F.col("b.node")))
    # A pair that shares the block of its line and number is kept there only.
    again = F.col("a.block").startswith("b|") & (F.col("a.line") == F.col("b.line"))
    open_ = lambda x: sum(F.col(f"{x}.{f}").isNull().cast("int") for f in FIELDS)
    return both.where(~F.coalesce(again, F.lit(False))).select(
        F.col("a.node").alias("a"), F.col("b.node").alias("b"), (F.col("a.rows") * F.col("b.rows")).alias("pairs"), (open_("a") > open_("b")).alias("a_opener"), *(_outcome(f).alias(f) for f in FIELDS)
    )


def fit(patterns: list[tuple[tuple[int, ...], float]], twice: list[dict[int, float]] | None = None, rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """The probability of a match for each pattern of outcomes, fitted to their counts by expectation-maximisation.

    Fields are independent given match or not. ``twice`` are counts of outcomes of each field that are known to be
    of matches: a row that tells a field twice is one. How often matches differ is learnt from them where there are
    any; else they agree in ``AGREES`` of all cases, and how the rest parts is fitted, as all else is. A field that only
    one side tells (1) says nothing. Counts are smoothed, so no outcome is impossible.
    """
    total = sum(n for _, n in patterns)
    if not total:
        return {}
    width = len(patterns[0][0])
    twice = twice or [{} for _ in range(width)]
    levels = [sorted({p[k] for p, _ in patterns} | set(twice[k]) | {0, 3} - {1}) for k in range(width)]
    spread = lambda k, agree: {v: (agree if v == 3 else (1 - agree) / max(1, len(levels[k]) - 1)) for v in levels[k]}
    known = [sum(twice[k].values()) for k in range(width)]
    match = [{v: (twice[k].get(v, 0) + 0.5) / (known[k] + 0.5 * len(levels[k])) for v in levels[k]} if known[k] else spread(k, AGREES) for k in range(width)]
    other, share = [spread(k, 0.5) for k in range(width)], 0.2
    found: dict[tuple[int, ...], float] = {}

    def weight(k: int, v: int) -> float:
        """What an outcome adds to the log odds; blocks hold what agrees, so equal must not speak against a match, nor different for one."""
        told = math.log(match[k][v] / other[k][v])
        return max(0.0, told) if v == 3 else min(0.0, told) if v == 0 else told

    for _ in range(rounds):
        found = {}
        for p, _n in patterns:
            odds = math.log(share / (1 - share)) + sum(weight(k, v) for k, v in enumerate(p) if v != 1)
            found[p] = 1 / (1 + math.exp(min(700.0, max(-700.0, -odds))))
        share = min(0.99, max(1e-6, sum(n * found[p] for p, n in patterns) / total))
        for k in range(width):
            misses = dict.fromkeys(levels[k], 1e-3)
            hits = dict.fromkeys(levels[k], 0.5)
            for p, n in patterns:
                if p[k] != 1:
                    hits[p[k]] += n * found[p]
                    misses[p[k]] += n * (1 - found[p])
            other[k] = {v: x / sum(misses.values()) for v, x in misses.items()}
            if not known[k]:
                rest = sum(x for v, x in hits.items() if v != 3)
                match[k] = {v: AGREES if v == 3 else (1 - AGREES) * x / rest for v, x in hits.items()}
    return found


def accepted(chance: dict[tuple[int, ...], float], precision: float = PRECISION) -> list[tuple[int, ...]]:
    """The patterns that are links: their pairs are expected to be right at ``precision``, and numbers told differ in none."""
    number = FIELDS.index("number")
    return [p for p, x in chance.items() if x >= precision and p[number] != 0]


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b): the lowest node of its connected component.

    Labels travel along links until none changes; each round is written to the shared folder.
    """
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("next"), "label")
        # The label of one's label shortens chains.
        jump = step.select(F.col("node").alias("at"), F.col("next").alias("further"))
        now = cut(step.join(jump, step["next"] == jump["at"], "left").select("node", F.least("next", F.coalesce("further", "next")).alias("label"), (F.col("label") > F.least("next", F.coalesce("further", "next"))).alias("moved")))
        labels = now.select("node", "label")
        if now.where("moved").isEmpty():
            return labels


def _readings(described: DataFrame) -> list[dict[int, float]]:
    """How often each field's two readings are equal, close or different in rows that tell it twice: a few numbers."""
    row = described.agg(*(F.count_if(F.get("twice", F.lit(k)) == v).alias(f"c{k}_{v}") for k in range(len(FIELDS)) for v in (0, 2, 3))).first()
    return [{v: float(row[f"c{k}_{v}"]) for v in (0, 2, 3) if row[f"c{k}_{v}"]} for k in range(len(FIELDS))]


def groups(products: DataFrame, reference: DataFrame, precision: float = PRECISION) -> DataFrame:
    """(id, group_id) of every row: rows of one group describe the same product; group_id is the group's lowest id.

    Rows of equal descriptions are together. Descriptions that tell the same fields are linked if their pattern of
    outcomes is a match at ``precision``; only unequal numbers refuse a link whatever its weight. A description that
    leaves fields open which the other tells joins the cluster of the likeliest one, if all clusters that it might
    join leave that one a probability of ``precision``; so it never joins two, nor one of several that fit alike. Rows
    without id are left out; a row that tells neither line nor number is a group by itself unless its whole
    description is equal to another's. Repeated rows have one group.
    """
    described = cut(parsed(products, reference))
    nodes = cut(nodes_of(described))
    pairs = cut(compared(nodes))
    counts = pairs.groupBy(*FIELDS).agg(F.sum("pairs").cast("double").alias("n"))
    within = nodes.agg(F.sum(F.col("rows") * (F.col("rows") - 1) / 2)).first()[0]
    # One row for each pattern of outcomes: at most 4 ** 8, whatever the number of pairs.
    patterns = {tuple(r[f] for f in FIELDS): r["n"] for r in counts.collect()}
    whole = (3,) * len(FIELDS)
    patterns[whole] = patterns.get(whole, 0.0) + float(within or 0)
    chance = fit([(p, n) for p, n in patterns.items() if n > 0], _readings(described))
    key = F.concat_ws(",", *(F.col(f).cast("string") for f in FIELDS))
    name = lambda p: ",".join(map(str, p))
    matches = accepted(chance, precision)
    told = [name(p) for p in matches if 1 not in p]
    linked = pairs.where(key.isin(told) if told else F.lit(False))
    labels = components(linked.select("a", "b"))
    labelled = nodes.join(labels, "node", "left").select(*FIELDS, "node", F.coalesce("label", "node").alias("group_id"))
    likely = {name(p): x / (1 - min(x, 1 - 1e-9)) for p, x in chance.items() if 1 in p and p[FIELDS.index("number")] != 0}
    if likely:
        odds = F.create_map(*(F.lit(v) for pair in likely.items() for v in pair))[key]
        # One of the two leaves open what the other tells; a pair in which each tells what the other does not links neither.
        open_ = pairs.select(F.when(F.col("a_opener"), F.col("a")).otherwise(F.col("b")).alias("node"), F.when(F.col("a_opener"), F.col("b")).otherwise(F.col("a")).alias("to"), odds.alias("odds")).where("odds is not null")
        fits = open_.join(labelled.select(F.col("node").alias("to"), F.col("group_id").alias("cluster")), "to").groupBy("node", "cluster").agg(F.max("odds").alias("odds"))
        best = fits.groupBy("node").agg(F.max_by("cluster", F.struct("odds", -F.col("cluster"))).alias("cluster"), F.max("odds").alias("most"), F.sum("odds").alias("all"))
        # Clusters that hold an opener of their own are joined by components again, from node to cluster.
        joins = cut(best.where(F.col("most") / (1 + F.col("all")) >= precision).select("node", "cluster"))
        ends = labelled.select("node", F.col("group_id").alias("mine")).join(joins, "node").select(F.col("mine").alias("a"), F.col("cluster").alias("b"))
        moved = components(ends)
        labelled = labelled.join(moved.select(F.col("node").alias("group_id"), "label"), "group_id", "left").select(*FIELDS, "node", F.coalesce("label", "group_id").alias("group_id"))
    named = labelled.select(*FIELDS, "group_id")
    # Rows find their node again by all fields; a missing brand was filled from the line.
    lines = nodes.where("brand is not null and line is not null").groupBy("line").agg(F.min("brand").alias("low"), F.max("brand").alias("high")).where("low = high")
    filled = described.where("brand is null").join(lines.select("line", "low"), "line", "left").select("id", F.col("low").alias("brand"), *FIELDS[1:])
    rows = described.where("brand is not null").select("id", *FIELDS).unionByName(filled)
    same = [F.coalesce(F.col(f).cast("string"), F.lit("\0")) for f in FIELDS]
    rows = rows.select("id", F.concat_ws("\1", *same).alias("key"))
    return rows.join(named.select("group_id", F.concat_ws("\1", *same).alias("key")), "key").select("id", "group_id")


#: Members of a group beyond which its pairs are made in several tasks.
SPLIT = 2_000


def pairs_of(members: DataFrame) -> DataFrame:
    """(id_a, id_b) of all pairs of a group (id, group_id), id_a < id_b; a large group's pairs are made in parts."""
    one = members.distinct()
    sizes = one.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group_id", F.ceil(F.col("n") / SPLIT).cast("int").alias("parts"))
    several = cut(one.join(sizes, "group_id"))
    left = several.select("group_id", F.col("id").alias("id_a"), F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"))
    right = several.select("group_id", F.col("id").alias("id_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return left.join(right, ["group_id", "part"]).where("id_a < id_b").select("id_a", "id_b")
