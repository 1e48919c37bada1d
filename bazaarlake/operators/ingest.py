"""From fetched pages to the rows of all tables in one batch."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import cut
from . import pages as P
from . import titles


class Rows(NamedTuple):
    """What a batch of pages adds: all frames are of the same pages, so they fit each other."""

    results: DataFrame  #: (url, status, tier, fingerprint, price, in_stock): one row per page
    merchants: DataFrame  #: (domain, first_seen, last_seen)
    products: DataFrame  #: products that are new: (spec_fingerprint, brand, model_family, ..., raw_title), as first seen
    listings: DataFrame  #: (spec_fingerprint, domain, listing_url, price, in_stock, updated_at), as last seen
    prices: DataFrame  #: (spec_fingerprint, domain, price, in_stock, logged_at): each usable page
    jobs: DataFrame  #: (spec_fingerprint, domain, listing_url, enqueued_at): one for each new product


def ingested(fetched: DataFrame, known: DataFrame, url: str = "url", html: str = "html", at: str = "fetched_at") -> Rows:
    """The rows that pages (url, html, fetched_at, price_selector, extraction_tier) add to the tables.

    ``known`` has the fingerprints (spec_fingerprint) of the products there are. A page without price or title adds
    nothing but its result, extract_failed; others are delta_updated or new_product_queued, by whether their
    product was known before the batch. The pages are read once, what they tell is written to the shared folder, and every frame
    is made from there; upserts take the state of the latest page, inserts that of the first.
    """
    told = cut(P.cascade(fetched, html).select(F.col(url).alias("url"), F.col(at).alias("at"), "fact", "usable", U.host(F.col(url)).alias("domain")))
    named = titles.normalised(told.withColumn("__title", F.coalesce("fact.title", "url")).withColumn("__brand", F.col("fact.brand")), "__title", "__brand")
    flat = named.select(
        "url", "at", "domain", "usable", F.col("fact.tier").alias("tier"), F.col("fact.price").alias("price"), F.col("fact.in_stock").alias("in_stock"), F.col("__title").alias("raw_title"), "spec.*"
    )
    before = known.select("spec_fingerprint").where("spec_fingerprint is not null").distinct().withColumn("known", F.lit(True))
    rows = cut(flat.join(before, "spec_fingerprint", "left").withColumn("known", F.coalesce("known", F.lit(False))))
    good = rows.where("usable")
    when, spec = F.struct("at", "url"), ["brand", "model_family", "sub_model", "ram_gb", "storage_gb", "region_code", "raw_title"]
    status = F.when(~F.col("usable"), "extract_failed").when(F.col("known"), "delta_updated").otherwise("new_product_queued")
    fresh = good.where("not known").groupBy("spec_fingerprint").agg(F.min_by(F.struct(*spec, "domain", F.col("url").alias("listing_url"), "at"), when).alias("f"))
    listings = good.groupBy("spec_fingerprint", "domain").agg(F.max_by(F.struct(F.col("url").alias("listing_url"), "price", "in_stock", F.col("at").alias("updated_at")), when).alias("l"))
    return Rows(
        rows.select("url", status.alias("status"), "tier", F.when(F.col("usable"), F.col("spec_fingerprint")).alias("fingerprint"), "price", "in_stock"),
        good.groupBy("domain").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen")),
        fresh.select("spec_fingerprint", *(f"f.{c}" for c in spec), F.col("f.at").alias("first_seen_at")),
        listings.select("spec_fingerprint", "domain", "l.*"),
        good.select("spec_fingerprint", "domain", "price", "in_stock", F.col("at").alias("logged_at")),
        fresh.select("spec_fingerprint", "f.domain", "f.listing_url", F.col("f.at").alias("enqueued_at")),
    )
