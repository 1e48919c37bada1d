"""Quantities of different units and scales, brought to one unit.

All of it is SQL: number and unit are extracted by pattern, the unit's alias is normalised by a join with the
table of aliases, the unit is the first known of text, source note and default, and factor and offset apply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import measures
from ..session import small

#: A number this near to an amount, relatively, is in the amount's unit: shown prices are rounded, such as 25.9k.
NEAR = 0.02

_DATED = r"(?:from|since)\s+(\d{4}-\d{2}-\d{2})"


def _note_units(notes: DataFrame) -> DataFrame:
    """(merchant_id, turn, before, after): the unit words of a source's notes.

    ``before`` holds for times before ``turn``, ``after`` from then on; without a date both are the same.
    """
    s = F.lower("feed_notes")
    turn = F.to_date(F.nullif(F.regexp_extract(s, _DATED, 1), F.lit("")))
    clause = F.regexp_extract(s, _DATED + r"([^;,]*)", 2)
    rest = F.regexp_replace(s, _DATED + r"[^;,]*", " ")
    rest = F.regexp_replace(rest, r"\(1/100 rupee\)", " ")
    return notes.select(
        F.col("id").alias("merchant_id"),
        turn.alias("turn"),
        *(
            F.regexp_extract(text, pattern, 1).alias(name)
            for text, when in ((rest, "before"), (F.when(turn.isNotNull(), clause).otherwise(rest), "after"))
            for pattern, name in ((measures.CURRENCY, f"{when}_currency"), (measures.SCALE, f"{when}_scale"))
        ),
    )


def rates_as_of(fx_rates: DataFrame) -> DataFrame:
    """(currency, since, until, rate): each rate with the days for which it is the last one known."""
    known = fx_rates.where("rate_date is not null and currency is not null and lkr_per_unit is not null")
    one = known.groupBy(F.upper("currency").alias("currency"), F.col("rate_date").alias("since")).agg(F.max("lkr_per_unit").alias("rate"))
    return one.withColumn("until", F.lead("since").over(Window.partitionBy("currency").orderBy("since")))


def rates_or_default(days: DataFrame, rates: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """(day, currency, rate, stale) for each day of ``days`` (day) and each currency of ``defaults``: the rate as of the day.

    Where no rate is known by then, the default holds and is marked as stale. ``rates`` are those of ``rates_as_of``.
    """
    wanted = days.where("day is not null").distinct().withColumn("currency", F.explode(F.array(*(F.lit(c) for c in defaults))))
    held = (F.col("w.currency") == F.col("r.currency")) & (F.col("day") >= F.col("since")) & (F.col("until").isNull() | (F.col("day") < F.col("until")))
    usual = F.create_map(*(F.lit(x) for c, v in defaults.items() for x in (c, float(v))))
    return wanted.alias("w").join(small(rates).alias("r"), held, "left").select("day", "w.currency", F.coalesce(F.col("rate").cast("double"), usual[F.col("w.currency")]).alias("rate"), F.col("rate").isNull().alias("stale"))


def _join_alias(df: DataFrame, column: str, kind: str, name: str) -> DataFrame:
    table = measures.alias_table(df.sparkSession, kind).select(F.col("alias").alias(column), F.col("unit").alias(name), F.col("factor").alias(f"{name}_factor"), F.col("offset").alias(f"{name}_offset"))
    return df.join(F.broadcast(table), column, "left")


def price_amounts(items: DataFrame, merchants: DataFrame, fx_rates: DataFrame) -> DataFrame:
    """(item_id, given, exact, amount, in_unit): what each price is in rupees.

    given: price_lkr as it came. exact: rupees with fractions, null if nothing tells an amount. amount: whole
    rupees, halves up. in_unit: whether ``given`` already is that amount. A unit in price_text goes before the
    merchant's notes; without either a number is in rupees. Foreign amounts take the last rate not after the
    day of the scrape; without such a rate, or without the time of the scrape, they have no amount.
    """
    shown = items.select("item_id", "merchant_id", F.col("price_lkr").alias("given"), F.to_date("scraped_timestamp").alias("day"), measures.price_in(F.col("price_text")).alias("p"))
    noted = shown.join(small(_note_units(merchants)), "merchant_id", "left")
    told = (F.col("p.currency") != "") | (F.col("p.scale") != "")
    early = F.col("turn").isNotNull() & (F.col("day") < F.col("turn"))
    undated = F.col("turn").isNotNull() & F.col("day").isNull()

    def unit(kind: str) -> Column:
        note = F.when(undated, F.lit("")).when(early, F.col(f"before_{kind}")).otherwise(F.col(f"after_{kind}"))
        return F.when(F.coalesce(told, F.lit(False)), F.col(f"p.{kind}")).otherwise(F.coalesce(note, F.lit("")))

    parts = noted.select(
        "item_id", "given", "day",
        F.when(F.coalesce(told, F.lit(False)), F.col("p.number")).otherwise(F.coalesce(F.col("given").try_cast("decimal(24,6)"), F.col("p.number"))).alias("number"),
        unit("currency").alias("currency_alias"), unit("scale").alias("scale_alias"),
        F.coalesce(told, F.lit(False)).alias("told"),
    )
    named = _join_alias(_join_alias(parts, "currency_alias", "currency", "currency"), "scale_alias", "scale", "scale")
    rates = rates_as_of(fx_rates)
    rated = (
        named.withColumn("currency", F.coalesce("currency", F.lit("LKR")))
        .alias("a")
        .join(
            small(rates).alias("r"),  # a row per currency and day of rates, whatever the number of prices
            (F.col("a.currency") == F.col("r.currency")) & (F.col("day") >= F.col("since")) & (F.col("until").isNull() | (F.col("day") < F.col("until"))),
            "left",
        )
        .select("a.*", "rate")
    )
    rupees = F.when(F.col("currency") == "LKR", F.lit(1).cast("decimal(12,2)")).otherwise(F.col("rate"))
    scaled = (F.col("number") * F.coalesce("scale_factor", F.lit(1.0)).cast("decimal(12,2)") + F.coalesce("scale_offset", F.lit(0.0)).cast("decimal(12,2)")).cast("decimal(28,6)")
    exact = (scaled * rupees).cast("decimal(38,6)")
    return rated.withColumn("exact", exact).select(
        "item_id", "given", "exact", F.round("exact").cast("bigint").alias("amount"),
        (F.abs(F.col("given") - F.col("exact").cast("double")) <= NEAR * F.abs(F.col("exact").cast("double"))).alias("in_unit"),
    )


# The names under which attributes tell amounts.
STORAGE_KEYS = ("storage", "Internal memory", "Capacity")
RAM_KEYS = ("RAM", "ram size", "System RAM")


def attribute(json: Column, names: tuple[str, ...]) -> Column:
    """The value of the first of some keys, whatever their case, in a JSON object; null if it is none."""
    pairs = F.map_entries(F.from_json(json, "map<string,string>"))
    keys = F.array(*(F.lit(n.lower()) for n in names))
    return F.get(F.filter(pairs, lambda e: F.array_contains(keys, F.lower(e["key"]))), 0)["value"]


def memory_amounts(products: DataFrame) -> DataFrame:
    """(id, ram_gb, storage_gb, ram_told, storage_told): MB told by raw_title, else clean_title, else the attributes."""
    # Projections in steps: an expression used more than once is computed once.
    texts = products.select(
        "id", "ram_gb", "storage_gb", measures.memory_text(F.col("raw_title")).alias("a"), measures.memory_text(F.col("clean_title")).alias("b"),
        measures.memory_text(attribute(F.col("attributes"), RAM_KEYS)).alias("r"), measures.memory_text(attribute(F.col("attributes"), STORAGE_KEYS)).alias("s"),
    )
    told = texts.select("id", "ram_gb", "storage_gb", measures.memory_told(F.col("a")).alias("a"), measures.memory_told(F.col("b")).alias("b"), measures.amount_told(F.col("r")).alias("r"), measures.amount_told(F.col("s")).alias("s"))
    first = told.select("id", "ram_gb", "storage_gb", F.coalesce("a.ram", "b.ram", "r").alias("ram"), F.coalesce("a.storage", "b.storage", "s").alias("storage"))
    units = first.select("*", F.col("ram.unit").alias("ram_alias"), F.col("storage.unit").alias("storage_alias"))
    named = _join_alias(_join_alias(units, "ram_alias", "memory", "ram_unit"), "storage_alias", "memory", "storage_unit")
    mb = lambda name: F.col(f"{name}.number") * F.col(f"{name}_unit_factor") + F.col(f"{name}_unit_offset")
    return named.select("id", "ram_gb", "storage_gb", mb("ram").alias("ram_told"), mb("storage").alias("storage_told"))


def wrong_units(items: DataFrame, merchants: DataFrame, fx_rates: DataFrame, products: DataFrame) -> DataFrame:
    """(source_table, record_id, field_name, amount): fields whose number is missing or in another unit.

    Prices are in whole rupees, memory in MB. A price of which no number is known, and memory that no text
    tells, have no row; numbers that are in the unit of their name have none either. Repeated rows repeat.
    """
    prices = price_amounts(items, merchants, fx_rates).where("amount is not null and (given is null or not in_unit)")
    fields = memory_amounts(products).select(
        "id",
        F.explode(
            F.array(
                F.struct(F.lit("storage_gb").alias("field_name"), F.col("storage_gb").alias("given"), F.col("storage_told").alias("told")),
                F.struct(F.lit("ram_gb").alias("field_name"), F.col("ram_gb").alias("given"), F.col("ram_told").alias("told")),
            )
        ).alias("f"),
    )
    memory = fields.where("f.told is not null and (f.given is null or f.given * 1024.0D <> f.told)")
    return prices.select(
        F.lit("scraped_items").alias("source_table"), F.col("item_id").alias("record_id"), F.lit("price_lkr").alias("field_name"), "amount"
    ).unionByName(
        memory.select(F.lit("canonical_products").alias("source_table"), F.col("id").alias("record_id"), F.col("f.field_name"), F.round("f.told").cast("bigint").alias("amount"))
    )
