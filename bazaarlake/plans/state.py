"""Queries on change logs: upserts, statuses, runs and changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import folds
from .general import _table
from .serve import _JOBS, _jobs

_ORDER = ["updated_at", "received_at", "update_id"]


def _log(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "listing_updates").where("listing_id is not null")


def m4_upsert_listing(spark: SparkSession, d: str) -> DataFrame:
    """The listing that the last update leaves, nulls and all."""
    out = folds.upserted(_log(spark, d), ["listing_id"], _ORDER, last_wins=["current_price_lkr", "in_stock", "feed"])
    return out.select("listing_id", F.col("current_price_lkr").cast("double").alias("price"), "in_stock", "feed")


def m9_coalesce_merge(spark: SparkSession, d: str) -> DataFrame:
    """The listing in which each update only overwrites what it tells."""
    out = folds.upserted(_log(spark, d), ["listing_id"], _ORDER, known_wins=["current_price_lkr", "in_stock"], first_wins=["feed"])
    return out.select("listing_id", F.col("current_price_lkr").cast("double").alias("price"), "in_stock", F.col("feed").alias("first_feed"))


def m2_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """Of each address the first title that was loaded, and the time of the last load."""
    items = _table(spark, d, "scraped_items").withColumn("key", U.canonical(F.col("product_url")))
    first = folds.upserted(items, ["key"], ["loaded_at", "item_id"], first_wins=["raw_title"])
    return first.select("key", F.col("raw_title").alias("title"))


def m1_upsert_merchant(spark: SparkSession, d: str) -> DataFrame:
    """The brand last seen at each merchant, and when it was first and last seen."""
    items = _table(spark, d, "scraped_items")
    out = items.groupBy("merchant_id").agg(folds.last_known("brand", ["loaded_at", "item_id"]), F.min("loaded_at").alias("a"), F.max("loaded_at").alias("b"))
    return out.select("merchant_id", "brand", F.date_format("a", "yyyy-MM-dd HH:mm:ss").alias("first_seen"), F.date_format("b", "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


def m15_counters(spark: SparkSession, d: str) -> DataFrame:
    kinds = {f"n_{k}": F.col("feed") == k for k in ("crawl", "delta_poll", "manual", "nightly")}
    return folds.upserted(_log(spark, d), ["merchant_id"], _ORDER, counts=kinds)


def m3_merged_attributes(spark: SparkSession, d: str) -> DataFrame:
    """The attributes of all of a brand's products, the later product's values first."""
    return folds.merged_json(_table(spark, d, "canonical_products").where("brand is not null"), ["brand"], ["id"], "attributes")


def m4_second_owner(spark: SparkSession, d: str) -> DataFrame:
    """Scrapes whose address came second for its listing."""
    items = _table(spark, d, "scraped_items").where("listing_id is not null")
    kept, rejected = folds.split_second_owner(items, "product_url", ["listing_id"], ["loaded_at", "item_id"])
    return kept.select("item_id", F.lit(True).alias("kept")).unionByName(rejected.select("item_id", F.lit(False).alias("kept")))


def m12_unseen_urls(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of scrapes that no inspection has, each with its first scrape."""
    batch = _table(spark, d, "scraped_items").select(U.canonical(F.col("product_url")).alias("url"), F.col("item_id").alias("pos"))
    known = _table(spark, d, "page_inspections").select(U.canonical(F.col("url")).alias("url"))
    return folds.unseen(batch, known, "url")


def a6_enqueue_delta(spark: SparkSession, d: str) -> DataFrame:
    return m12_unseen_urls(spark, d).agg(F.count(F.lit(1)).alias("added"))


def m20_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Listings that would go with the products that are not complete."""
    done = _table(spark, d, "canonical_products").where("pipeline_status = 'complete'")
    return folds.orphaned(_table(spark, d, "listings"), done, "product_id", "id").select("id", "product_id")


def m16_upsert_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Of each label the vector written last, by its first numbers."""
    out = folds.upserted(_table(spark, d, "embeddings"), ["label"], ["vec_id"], last_wins=["vec_id", "embedding"])
    return out.select("label", "vec_id", *(F.round(F.get("embedding", F.lit(k)).cast("double"), 5).alias(f"v{k}") for k in range(3)))


def q_status_fold(spark: SparkSession, d: str) -> DataFrame:
    out = folds.latest_status(_jobs(spark, d), "product_id", "status", ["enqueued_at", "id"], "enqueued_at")
    return out.select("product_id", "status", "attempts")


def w5_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of at least three failures in a row of one user."""
    events = _table(spark, d, "events")
    return folds.runs(events, "user_id", ["ts", "event_id"], F.col("event_type") == "error", F.date_format("ts", "yyyyMM")).where("length >= 3").select("user_id", "length", F.date_format("begins", "yyyy-MM-dd HH:mm:ss").alias("begins"))


def w4_price_changes(spark: SparkSession, d: str) -> DataFrame:
    """Updates that bring another price or stock than the update before."""
    log = _log(spark, d).select("listing_id", *_ORDER, F.col("current_price_lkr").alias("price"), "in_stock").distinct()
    return folds.changes(log, ["listing_id"], _ORDER, "price", "in_stock", F.date_format("updated_at", "yyyyMM")).select("listing_id", "update_id", F.col("price").cast("double").alias("price"), F.col("price_before").cast("double").alias("price_before"))


def w8_fifo(spark: SparkSession, d: str) -> DataFrame:
    """The place of each pending job in its product's line."""
    place = F.row_number().over(Window.partitionBy("product_id").orderBy("enqueued_at", "id"))
    return _jobs(spark, d).where("status = 'pending'").select("id", place.cast("bigint").alias("place"))


def a9_phases(spark: SparkSession, d: str) -> DataFrame:
    """How many of a listing's feeds have spoken: all, some, or one."""
    per = _log(spark, d).groupBy("listing_id").agg(F.countDistinct("feed").alias("n"))
    return per.groupBy(F.when(F.col("n") == 4, "complete").when(F.col("n") > 1, "partial").otherwise("single").alias("state")).agg(F.count(F.lit(1)).alias("listings"))


_FIRST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY {o}) AS pick FROM {t}) WHERE pick = 1"
_CANON = "regexp_replace(regexp_replace({u}, '[?#].*$', ''), '(.)/+$', '\\1')"
_LAST = "updated_at DESC, received_at DESC, update_id DESC"

SQL = {
    "m4_upsert_listing": f"SELECT listing_id, CAST(current_price_lkr AS DOUBLE) AS price, in_stock, feed FROM ({_FIRST.format(k='listing_id', o=_LAST, t='listing_updates')})",
    "m9_coalesce_merge": """SELECT listing_id, CAST(arg_max(current_price_lkr, (updated_at, received_at, update_id)) AS DOUBLE) AS price, arg_max(in_stock, (updated_at, received_at, update_id)) AS in_stock,
 arg_min(feed, (updated_at, received_at, update_id)) AS first_feed FROM listing_updates GROUP BY listing_id""",
    "m2_first_wins": f"SELECT key, raw_title AS title FROM ({_FIRST.format(k='key', o='loaded_at, item_id', t='(SELECT *, ' + _CANON.format(u='product_url') + ' AS key FROM scraped_items)')})",
    "m1_upsert_merchant": """SELECT merchant_id, arg_max(brand, (loaded_at, item_id)) AS brand, strftime(min(loaded_at), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(loaded_at), '%Y-%m-%d %H:%M:%S') AS last_seen
 FROM scraped_items GROUP BY merchant_id""",
    "m15_counters": "SELECT merchant_id, " + ", ".join(f"count(*) FILTER (feed = '{k}') AS n_{k}" for k in ("crawl", "delta_poll", "manual", "nightly")) + " FROM listing_updates GROUP BY merchant_id",
    "m3_merged_attributes": """SELECT b.brand, '{' || coalesce(string_agg('"' || e.key || '":' || e.value, ',' ORDER BY e.key), '') || '}' AS attributes FROM (
 SELECT brand, key, arg_max(CAST(value AS VARCHAR), id) AS value FROM (SELECT p.brand, p.id, j.key, j.value FROM canonical_products p, json_each(p.attributes) j WHERE p.brand IS NOT NULL) GROUP BY brand, key) e
 JOIN (SELECT DISTINCT brand FROM canonical_products WHERE attributes <> '{}') b ON b.brand = e.brand GROUP BY b.brand""",
    "m4_second_owner": """WITH f AS (SELECT listing_id, arg_min(product_url, (loaded_at, item_id)) AS url FROM scraped_items WHERE listing_id IS NOT NULL GROUP BY listing_id)
SELECT i.item_id, i.product_url = f.url AS kept FROM scraped_items i JOIN f ON f.listing_id = i.listing_id""",
    "m12_unseen_urls": f"SELECT url, min(item_id) AS pos FROM (SELECT {_CANON.format(u='product_url')} AS url, item_id FROM scraped_items) WHERE url NOT IN (SELECT {_CANON.format(u='url')} FROM page_inspections WHERE url IS NOT NULL) GROUP BY url",
    "a6_enqueue_delta": f"SELECT count(DISTINCT url) AS added FROM (SELECT {_CANON.format(u='product_url')} AS url FROM scraped_items) WHERE url NOT IN (SELECT {_CANON.format(u='url')} FROM page_inspections WHERE url IS NOT NULL)",
    "m20_orphans": "SELECT id, product_id FROM listings WHERE product_id NOT IN (SELECT id FROM canonical_products WHERE pipeline_status = 'complete')",
    "m16_upsert_vectors": "SELECT label, max(vec_id) AS vec_id, " + ", ".join(f"round(CAST(arg_max(embedding[{k + 1}], vec_id) AS DOUBLE), 5) AS v{k}" for k in range(3)) + " FROM embeddings GROUP BY label",
    "q_status_fold": f"SELECT product_id, arg_max(status, (enqueued_at, id)) AS status, count(*) FILTER (status = 'claimed') AS attempts FROM {_JOBS} GROUP BY product_id",
    "w5_runs": """SELECT user_id, count(*) AS length, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS begins FROM (
 SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events) WHERE event_type = 'error' GROUP BY user_id, island HAVING count(*) >= 3""",
    "w4_price_changes": """SELECT listing_id, update_id, CAST(price AS DOUBLE) AS price, CAST(before AS DOUBLE) AS price_before FROM (
 SELECT *, lag(price) OVER w AS before, lag(in_stock) OVER w AS stock_before, row_number() OVER w AS n FROM (SELECT DISTINCT listing_id, updated_at, received_at, update_id, current_price_lkr AS price, in_stock FROM listing_updates)
 WINDOW w AS (PARTITION BY listing_id ORDER BY updated_at, received_at, update_id)) WHERE n > 1 AND coalesce(abs(price - before) > 0.01 OR in_stock IS DISTINCT FROM stock_before, false)""",
    "w8_fifo": f"SELECT id, row_number() OVER (PARTITION BY product_id ORDER BY enqueued_at, id) AS place FROM {_JOBS} WHERE status = 'pending'",
    "a9_phases": "SELECT CASE WHEN n = 4 THEN 'complete' WHEN n > 1 THEN 'partial' ELSE 'single' END AS state, count(*) AS listings FROM (SELECT listing_id, count(DISTINCT feed) AS n FROM listing_updates GROUP BY listing_id) GROUP BY 1",
}

QUERIES = {name: globals()[name] for name in SQL}
