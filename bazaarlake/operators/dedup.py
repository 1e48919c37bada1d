"""Repeated addresses, pages and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def once(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key by ``order``; rows with a null or an empty key are dropped.

    Keys and order meet first; whole rows are taken by their place, with a combine before the shuffle.
    """
    tagged = df.withColumn("__bl_key", key).where(F.col("__bl_key").isNotNull() & (F.col("__bl_key").cast("string") != ""))
    best = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("__bl_row")
    return tagged.groupBy("__bl_key").agg(best).select("__bl_row.*")


def ring(pages: DataFrame, url: Column, digest: Column, order: list[str]) -> DataFrame:
    """``pages`` with ``outcome``: duplicate_url, duplicate_content or new, as they would come one after another.

    ``order`` must be unique; a column named outcome is replaced. A page whose address was seen is a duplicate and leaves no digest; of the others one whose digest was seen
    is a duplicate too. Equal empty bodies have equal digests.
    """
    none = F.lit("\0")  # a missing address or digest is one of its own
    seen = pages.withColumn("__bl_u", F.coalesce(url, none)).withColumn("__bl_d", F.coalesce(digest, none)).withColumn("__bl_o", F.struct(*order))

    def flagged(df: DataFrame, key: str, among: DataFrame, flag: str) -> DataFrame:
        """``df`` with whether a row is the first of its key; joined by key and place, so a hot key is no hot task."""
        firsts = among.groupBy(key).agg(F.min("__bl_o").alias("__bl_o")).withColumn(flag, F.lit(True))
        return df.join(firsts, [key, "__bl_o"], "left")

    by_url = flagged(seen, "__bl_u", seen, "__bl_first")
    # Only first addresses count for digests, so the two rings are taken one after the other.
    by_both = flagged(by_url, "__bl_d", by_url.where("__bl_first"), "__bl_new")
    outcome = F.when(F.col("__bl_first").isNull(), "duplicate_url").when(F.col("__bl_new").isNull(), "duplicate_content").otherwise("new")
    return by_both.withColumn("outcome", outcome).select(*(c for c in pages.columns if c != "outcome"), "outcome")


def evidence(snippets: DataFrame, group: list[str], text: str, order: list[str], head: int = 160, most: int = 5) -> DataFrame:
    """At most ``most`` snippets of each group, in order, no two with the same first ``head`` characters.

    ``order`` must be unique within a group. Heads and order are ranked alone; whole rows are joined to the few that are
    kept. Null and empty texts are none; null groups are no group.
    """
    heads = snippets.select(*group, *order, F.substring(text, 1, head).alias("__bl_head")).where("__bl_head <> ''")
    first = heads.groupBy(*group, "__bl_head").agg(F.min(F.struct(*order)).alias("__bl_o"))
    kept = first.withColumn("__bl_r", F.row_number().over(Window.partitionBy(*group).orderBy("__bl_o"))).where(F.col("__bl_r") <= most)
    return snippets.join(kept.select(*group, "__bl_o.*"), [*group, *order], "left_semi")
