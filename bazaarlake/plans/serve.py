"""Catalog, queue, crawl and detail queries.

The crawl queue is read from page_inspections (200 is completed, an error status failed, none pending), jobs
from events, dossiers from the documents that name a product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import folds, neighbours
from ..session import small
from .general import _table


def _queue(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("http_status") == 200, "completed").when(F.col("http_status") >= 400, "failed").when(F.col("http_status").isNull(), "pending").otherwise("in_progress")
    return _table(spark, d, "page_inspections").select(
        F.col("inspection_id").alias("id"), "url", U.host(F.col("url")).alias("domain"), status.alias("status"), F.col("inspected_at").alias("at"), F.when(F.col("http_status") >= 400, F.col("page_title")).alias("error_msg"), "merchant_id"
    )


_QUEUE = """(SELECT inspection_id AS id, url, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS domain,
  CASE WHEN http_status = 200 THEN 'completed' WHEN http_status >= 400 THEN 'failed' WHEN http_status IS NULL THEN 'pending' ELSE 'in_progress' END AS status,
  inspected_at AS found_at, CASE WHEN http_status >= 400 THEN page_title END AS error_msg, merchant_id FROM page_inspections)"""


def _jobs(spark: SparkSession, d: str, signup: str = "pending") -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "done").when(kind == "error", "failed").when(kind == "click", "claimed").when(kind == "signup", signup).otherwise("pending")
    return _table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("product_id"), status.alias("status"), F.col("ts").alias("enqueued_at"))


_JOBS = """(SELECT event_id AS id, user_id AS product_id,
  CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'claimed' ELSE 'pending' END AS status, ts AS enqueued_at FROM events)"""


def _placed(page: DataFrame, order: list[Column], offset: int = 0) -> DataFrame:
    """A page of results with the place of each row; a page is as small as its limit says."""
    return page.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint") + offset)


def catalog(spark: SparkSession, d: str, search: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Products with their lowest price, listings and documents, newest first; ``place`` is the place in that order.

    A page of results is chosen before anything is joined to it, and it is sorted again at the end.
    """
    products = _table(spark, d, "canonical_products")
    if search and search.strip():
        like = f"%{search.strip()}%"
        products = products.where(F.col("clean_title").ilike(like) | F.col("raw_title").ilike(like) | F.col("brand").ilike(like) | F.col("model_family").ilike(like))
    order = [F.desc("first_seen_at"), F.desc("id")]
    chosen = products.select("id", "clean_title", "brand", "first_seen_at").orderBy(*order).offset(offset).limit(limit)
    page = _placed(chosen, order, offset)
    ids = small(page.select(F.col("id").alias("product_id")))
    listed = _table(spark, d, "listings").join(ids, "product_id", "left_semi")
    prices = listed.groupBy("product_id").agg(F.min("current_price_lkr").alias("low"), F.count("id").alias("n"))
    notes = _table(spark, d, "documents").join(ids, "product_id", "left_semi").groupBy("product_id").agg(F.count("doc_id").alias("docs"))
    full = page.join(prices, page["id"] == prices["product_id"], "left").drop("product_id").join(notes, F.col("id") == notes["product_id"], "left")
    return full.orderBy("place").select(
        "place", F.col("id").alias("product_id"), "clean_title", "brand", F.col("low").cast("double").alias("lowest_price"), F.coalesce("n", F.lit(0)).alias("listing_count"), F.coalesce("docs", F.lit(0)).alias("document_count")
    )


def _catalog_sql(where: str, tail: str) -> str:
    return f"""WITH page AS (SELECT id, clean_title, brand, row_number() OVER (ORDER BY first_seen_at DESC, id DESC) AS place FROM canonical_products {where} ORDER BY first_seen_at DESC, id DESC {tail})
SELECT p.place, p.id AS product_id, p.clean_title, p.brand, CAST(min(l.current_price_lkr) AS DOUBLE) AS lowest_price, count(l.id) AS listing_count,
       (SELECT count(*) FROM documents d WHERE d.product_id = p.id) AS document_count
FROM page p LEFT JOIN listings l ON l.product_id = p.id GROUP BY p.place, p.id, p.clean_title, p.brand"""


def e1_system_counters(spark: SparkSession, d: str) -> DataFrame:
    """One row of counts: each table is read once for all counts on it."""
    jobs = _jobs(spark, d).agg(*(F.count_if(F.col("status") == s).alias(f"jobs_{s}") for s in ("pending", "claimed", "done", "failed")))
    count = lambda t, n: _table(spark, d, t).agg(F.count(F.lit(1)).alias(n))
    out = jobs
    for t, n in (("canonical_products", "products"), ("merchants", "merchants"), ("listings", "listings"), ("listing_updates", "price_points"), ("documents", "documents")):
        out = out.crossJoin(F.broadcast(count(t, n)))  # rows of one row each
    return out


def e3_queue_jobs(spark: SparkSession, d: str, status: str | None = "failed", limit: int = 50) -> DataFrame:
    """The newest jobs with the titles of their products, newest first; the page is chosen first and sorted again at the end."""
    jobs = _jobs(spark, d)
    jobs = jobs if status is None else jobs.where(F.col("status") == status)
    order = [F.desc("enqueued_at"), F.desc("id")]
    page = _placed(jobs.orderBy(*order).limit(limit), order)
    titles = _table(spark, d, "canonical_products").select(F.col("id").alias("product_id"), "clean_title", "brand")
    return page.join(titles, "product_id", "left").orderBy("place").select("place", "id", "product_id", "status", "clean_title", "brand")


def e5_product_listings(spark: SparkSession, d: str) -> DataFrame:
    """Each listing with its merchant, ranked by price within its product; no price or none above 0 comes last."""
    merchants = _table(spark, d, "merchants").select(F.col("id").alias("merchant_id"), "domain", "is_verified_agent")
    rows = _table(spark, d, "listings").join(small(merchants), "merchant_id")
    rank = F.row_number().over(Window.partitionBy("product_id").orderBy(F.nullif(F.col("current_price_lkr"), F.lit(0)).asc_nulls_last(), "id"))
    return rows.select("product_id", F.col("id").alias("listing_id"), "domain", "is_verified_agent", F.col("current_price_lkr").cast("double").alias("price"), rank.cast("bigint").alias("rank"))


def e5_recent_prices(spark: SparkSession, d: str, n: int = 5) -> DataFrame:
    """The newest price points of each listing. Groups are limited as they sort, so a hot listing sends few rows on."""
    rank = F.row_number().over(Window.partitionBy("listing_id").orderBy(F.desc("updated_at"), F.desc("received_at"), F.desc("update_id")))
    log = _table(spark, d, "listing_updates").where("listing_id is not null").select("listing_id", "update_id", "updated_at", "received_at", "current_price_lkr").distinct()
    return log.withColumn("n", rank).where(F.col("n") <= n).select("listing_id", "update_id", F.col("n").cast("bigint").alias("n"), F.col("current_price_lkr").cast("double").alias("price"))


def e5_bundle(spark: SparkSession, d: str) -> DataFrame:
    """One row per product with all that is known of it: the bundle of product, listings and documents in one pass."""
    offers = e5_product_listings(spark, d).groupBy("product_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "listing_id", "price"))).alias("listings")  # a product's listings: at most one per merchant
    )
    docs = _table(spark, d, "documents").where("product_id is not null").groupBy("product_id").agg(F.count(F.lit(1)).alias("documents"), F.max("crawled_at").alias("seen"))
    base = _table(spark, d, "canonical_products").select(F.col("id").alias("product_id"), "pipeline_status")
    owners = _table(spark, d, "listings").select(F.col("id").alias("listing_id"), "product_id")
    newest = F.row_number().over(Window.partitionBy("product_id").orderBy(F.desc("updated_at"), F.desc("received_at"), F.desc("update_id")))
    points = _table(spark, d, "listing_updates").where("updated_at is not null").select("listing_id", "update_id", "updated_at", "received_at").distinct().join(owners, "listing_id").withColumn("n", newest).where("n <= 5")
    logs = points.groupBy("product_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "update_id"))), lambda x: x["update_id"].cast("string")), ",").alias("log_ids"))  # five at most
    return base.join(offers, "product_id", "left").join(docs, "product_id", "left").join(logs, "product_id", "left").select(
        "product_id", "pipeline_status", F.coalesce(F.size("listings"), F.lit(0)).cast("bigint").alias("listing_count"), F.get("listings", F.lit(0))["listing_id"].alias("cheapest_listing"),
        F.array_join(F.transform("listings", lambda x: x["listing_id"].cast("string")), ",").alias("listing_ids"), F.coalesce("documents", F.lit(0)).alias("documents"),
        "log_ids",
    )


def _crawl_counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in ("pending", "in_progress", "completed", "failed"))]


def e7_crawl_stats(spark: SparkSession, d: str, domain: str | None = None) -> DataFrame:
    q = _queue(spark, d)
    q = q if domain is None else q.where(F.col("domain") == domain)
    return q.agg(*_crawl_counts(), F.count_if(F.col("at") >= F.lit("2026-06-01 00:00:00").cast("timestamp_ntz")).alias("since_june"))


def e7_domain_stats(spark: SparkSession, d: str) -> DataFrame:
    """The same for each domain, with its last error."""
    q = _queue(spark, d).where("domain <> ''")
    last = F.max_by("error_msg", F.when(F.col("error_msg").isNotNull(), F.struct("at", "id"))).alias("last_error")
    return q.groupBy("domain").agg(*_crawl_counts(), F.count_if(F.col("at") >= F.lit("2026-06-01 00:00:00").cast("timestamp_ntz")).alias("since_june"), last)


def e7_last_error(spark: SparkSession, d: str) -> DataFrame:
    return _queue(spark, d).where("error_msg is not null").orderBy(F.col("at").desc_nulls_last(), F.desc("id")).limit(1).select("id", "domain", "error_msg")


def e8_domain_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Each domain's counts, that with the newest find first; a row per domain."""
    per = _queue(spark, d).groupBy("domain").agg(*_crawl_counts(), F.max(F.col("at")).alias("m"))
    order = [F.col("m").desc_nulls_last(), F.col("domain").asc_nulls_first()]
    return _placed(per, order).orderBy("place").select("place", "domain", "total", "pending", "completed", "failed", F.date_format("m", "yyyy-MM-dd HH:mm:ss").alias("last_discovered"))


def e9_domain_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Pages with the profile of their site, looked up by host without www."""
    sites = _table(spark, d, "merchants").select(F.col("domain").alias("site"), F.col("id").alias("profile_id"), "city")
    return _queue(spark, d).withColumn("site", F.regexp_replace("domain", r"^www\.", "")).join(small(sites), "site", "left").select("id", "site", "profile_id", "city")


def e10_complete_products(spark: SparkSession, d: str, k: int = 10, search: str | None = None) -> DataFrame:
    """The newest complete products among four times as many of the newest that a search finds: the status filter stays above the limit."""
    products = _table(spark, d, "canonical_products")
    if search:
        products = products.where(F.col("clean_title").ilike(f"%{search}%") | F.col("brand").ilike(f"%{search}%"))
    order = [F.desc("first_seen_at"), F.desc("id")]
    newest = products.orderBy(*order).limit(4 * k)
    return newest.where("pipeline_status = 'complete'").orderBy(*order).limit(k).select("id", "pipeline_status")


def e10_complete_search(spark: SparkSession, d: str) -> DataFrame:
    return e10_complete_products(spark, d, 5, "plus")


def j4_listing_merchants(spark: SparkSession, d: str) -> DataFrame:
    """Each listing with its merchant, and with what inspections of the merchant's pages found, if there were any."""
    found = _table(spark, d, "page_inspections").where("merchant_id is not null").groupBy("merchant_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("http_status") >= 400).alias("errors"))
    merchants = _table(spark, d, "merchants").select(F.col("id").alias("merchant_id"), "domain", "display_name")
    both = merchants.join(small(found), "merchant_id", "left")  # a row per merchant
    return _table(spark, d, "listings").select(F.col("id").alias("listing_id"), "merchant_id").join(small(both), "merchant_id").select("listing_id", "domain", "display_name", "pages", "errors")


def s16_rates(spark: SparkSession, d: str) -> DataFrame:
    """The rates of the days of scraping and of the days two years before, for which there are none."""
    from ..operators import units

    days = _table(spark, d, "scraped_items").select(F.explode(F.array(F.to_date("scraped_timestamp"), F.date_sub(F.to_date("scraped_timestamp"), 730))).alias("day"))
    out = units.rates_or_default(days, units.rates_as_of(_table(spark, d, "fx_rates")), {"USD": 305.0, "AED": 83.1})
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "currency", "rate", "stale")


def a3_status_tally(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "canonical_products").groupBy(F.col("pipeline_status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def a13_site_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _queue(spark, d).groupBy("domain").agg(F.count_if(F.col("status") == "completed").alias("successes"), F.count_if(F.col("status") == "failed").alias("failures"))


def j6_new_vs_known(spark: SparkSession, d: str) -> DataFrame:
    """Scraped titles that are a known product's raw title, and those that are not; one probe by hash, no broadcast."""
    known = _table(spark, d, "canonical_products").select(F.sha2("raw_title", 256).alias("fp")).distinct().withColumn("known", F.lit(True))
    items = _table(spark, d, "scraped_items").where("raw_title is not null").select("item_id", F.sha2("raw_title", 256).alias("fp"))
    return items.join(known, "fp", "left").groupBy(F.coalesce("known", F.lit(False)).alias("known")).agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("first_item"))


def j10_authorised(spark: SparkSession, d: str) -> DataFrame:
    """Scraped offers by brand, and how many are at a host that holds the name of a merchant authorised for the brand.

    Brands must be equal, the name must be contained in the host; distinct pairs of both are compared, not rows.
    """
    agents = _table(spark, d, "merchants").select(F.explode("authorized_brands").alias("brand"), F.regexp_extract("domain", r"^([^.]+)", 1).alias("agent")).where("agent <> ''").distinct()
    offers = _table(spark, d, "scraped_items").where("brand is not null").groupBy("brand", U.host(F.col("product_url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))
    told = offers.alias("o").join(small(agents).alias("a"), (F.col("o.brand") == F.col("a.brand")) & F.col("o.host").contains(F.col("a.agent")), "left_semi").withColumn("ok", F.lit(True))
    return offers.join(told.select("brand", "host", "ok"), ["brand", "host"], "left").groupBy("brand").agg(F.sum("n").alias("offers"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("n"))), F.lit(0)).alias("authorised"))


def e6_dossiers(spark: SparkSession, d: str) -> DataFrame:
    """Each product's dossier, null where nobody wrote of it; documents stand in for what is told of a product."""
    docs = _table(spark, d, "documents").where("product_id is not null")
    told = docs.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("documents"), F.countDistinct("source").alias("source_count"), F.max_by("doc_id", F.struct("crawled_at", "doc_id")).alias("latest"), F.min("crawled_at").alias("a"), F.max("crawled_at").alias("b")
    )
    when = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    base = _table(spark, d, "canonical_products").select(F.col("id").alias("product_id"))
    return base.join(told, "product_id", "left").select("product_id", "documents", "source_count", "latest", when("a").alias("generated_at"), when("b").alias("updated_at"))


def j11_rates(spark: SparkSession, d: str) -> DataFrame:
    """The rate that holds on the day of each foreign day of scraping, per currency."""
    from ..operators.units import rates_as_of

    days = _table(spark, d, "scraped_items").select(F.to_date("scraped_timestamp").alias("day")).where("day is not null").distinct()
    rates = rates_as_of(_table(spark, d, "fx_rates"))
    held = days.join(small(rates), (F.col("day") >= F.col("since")) & (F.col("until").isNull() | (F.col("day") < F.col("until"))))
    return held.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "currency", F.col("rate").cast("double").alias("rate"))


def m21_monthly_history(spark: SparkSession, d: str) -> DataFrame:
    """Price points by month, as the partitions of a history are named."""
    log = _table(spark, d, "listing_updates").where("updated_at is not null")
    return log.groupBy(F.date_format("updated_at", "yyyy_MM").alias("month")).agg(F.count(F.lit(1)).alias("points"), F.sum("current_price_lkr").cast("double").alias("total"))


def o7_knn(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 100, against all vectors."""
    v = _table(spark, d, "embeddings")
    found = neighbours.nearest(v, v.where("vec_id % 100 = 0"), 10)
    return found.select("query", "rank", "vec_id", F.round("distance", 4).alias("distance"))


def q1_claim(spark: SparkSession, d: str) -> DataFrame:
    return folds.claimed(_jobs(spark, d), 25).select("id", "product_id")


def q2_claim_of_domain(spark: SparkSession, d: str) -> DataFrame:
    """The two oldest pending addresses of each domain as they are once claimed: in progress, with one attempt more.

    Attempts so far are the failed inspections of the address.
    """
    q = _queue(spark, d).withColumn("enqueued_at", F.col("at"))
    tried = q.where("status = 'failed'").groupBy("url").agg(F.count(F.lit(1)).alias("attempts"))
    first = folds.claimed_per(q, 2, "domain")
    return first.join(tried, "url", "left").select("domain", "id", F.lit("in_progress").alias("status"), (F.coalesce("attempts", F.lit(0)) + 1).alias("attempts"))


def q13_stale_claims(spark: SparkSession, d: str) -> DataFrame:
    """Jobs whose claim is older than a day at a moment and that nothing ended since."""
    jobs = folds.job_states(_jobs(spark, d), "product_id", "status", ["enqueued_at", "id"], "enqueued_at")
    return folds.stale_claims(jobs, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), 86_400).select("product_id", F.date_format("claimed_at", "yyyy-MM-dd HH:mm:ss").alias("claimed_at"))


def m11_job_states(spark: SparkSession, d: str) -> DataFrame:
    """What a log of claims, ends and retries leaves of each job: a retry takes claim, end and error away again."""
    out = folds.job_states(_jobs(spark, d, "retried"), "product_id", "status", ["enqueued_at", "id"], "enqueued_at")
    when = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return out.select("product_id", "status", "attempts", when("claimed_at").alias("claimed_at"), when("completed_at").alias("completed_at"))


def s22_context(spark: SparkSession, d: str) -> DataFrame:
    """Each product's offers as an escaped XML block, cheapest first."""
    rows = e5_product_listings(spark, d).withColumn("line", F.format_string('<listing merchant="%s" rank="%d"/>', T.escaped(F.col("domain")), F.col("rank")))
    inner = rows.groupBy("product_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "").alias("l"))
    return inner.select("product_id", F.concat(F.lit("<local_listings>"), "l", F.lit("</local_listings>")).alias("context"))


def pred12_usable(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "scraped_items").where((F.col("price_lkr") > 0) & (F.coalesce("raw_title", F.lit("")) != "")).groupBy("merchant_id").agg(F.count(F.lit(1)).alias("usable"))


def e4_catalog_listing(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d)


def e4_catalog_search(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d, search=" pro max ", limit=100)


def e4_catalog_page2(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d, limit=20, offset=20)


_COUNTS = ", ".join(["count(*) AS total", *(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("pending", "in_progress", "completed", "failed"))])
_LISTINGS = """(SELECT l.product_id, l.id AS listing_id, m.domain, m.is_verified_agent, CAST(l.current_price_lkr AS DOUBLE) AS price,
  row_number() OVER (PARTITION BY l.product_id ORDER BY nullif(l.current_price_lkr, 0) ASC NULLS LAST, l.id) AS rank
  FROM listings l JOIN merchants m ON m.id = l.merchant_id)"""

SQL = {
    "e4_catalog_listing": _catalog_sql("", "LIMIT 50"),
    "e4_catalog_search": _catalog_sql("WHERE clean_title ILIKE '%pro max%' OR raw_title ILIKE '%pro max%' OR brand ILIKE '%pro max%' OR model_family ILIKE '%pro max%'", "LIMIT 100"),
    "e4_catalog_page2": _catalog_sql("", "LIMIT 20 OFFSET 20"),
    "e1_system_counters": f"""SELECT {", ".join(f"(SELECT count(*) FROM {_JOBS} WHERE status = '{s}') AS jobs_{s}" for s in ("pending", "claimed", "done", "failed"))},
 (SELECT count(*) FROM canonical_products) AS products, (SELECT count(*) FROM merchants) AS merchants, (SELECT count(*) FROM listings) AS listings,
 (SELECT count(*) FROM listing_updates) AS price_points, (SELECT count(*) FROM documents) AS documents""",
    "e3_queue_jobs": f"""SELECT j.place, j.id, j.product_id, j.status, p.clean_title, p.brand FROM (SELECT *, row_number() OVER (ORDER BY enqueued_at DESC, id DESC) AS place FROM {_JOBS} WHERE status = 'failed' ORDER BY enqueued_at DESC, id DESC LIMIT 50) j
 LEFT JOIN canonical_products p ON p.id = j.product_id""",
    "e5_product_listings": f"SELECT * FROM {_LISTINGS}",
    "e5_recent_prices": """SELECT listing_id, update_id, n, CAST(current_price_lkr AS DOUBLE) AS price FROM (
 SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY updated_at DESC, received_at DESC, update_id DESC) AS n
 FROM (SELECT DISTINCT listing_id, update_id, updated_at, received_at, current_price_lkr FROM listing_updates WHERE listing_id IS NOT NULL)) WHERE n <= 5""",
    "e5_bundle": f"""SELECT p.id AS product_id, p.pipeline_status, coalesce(o.n, 0) AS listing_count, o.cheapest AS cheapest_listing, o.ids AS listing_ids, coalesce(dd.n, 0) AS documents, g.ids AS log_ids
 FROM canonical_products p
 LEFT JOIN (SELECT product_id, count(*) AS n, min(listing_id) FILTER (rank = 1) AS cheapest, string_agg(CAST(listing_id AS VARCHAR), ',' ORDER BY rank) AS ids FROM {_LISTINGS} GROUP BY product_id) o ON o.product_id = p.id
 LEFT JOIN (SELECT product_id, count(*) AS n FROM documents WHERE product_id IS NOT NULL GROUP BY product_id) dd ON dd.product_id = p.id
 LEFT JOIN (SELECT product_id, string_agg(CAST(update_id AS VARCHAR), ',' ORDER BY n) AS ids FROM (SELECT l.product_id, u.update_id, row_number() OVER (PARTITION BY l.product_id ORDER BY u.updated_at DESC, u.received_at DESC, u.update_id DESC) AS n
   FROM (SELECT DISTINCT listing_id, update_id, updated_at, received_at FROM listing_updates WHERE updated_at IS NOT NULL) u JOIN listings l ON l.id = u.listing_id) WHERE n <= 5 GROUP BY product_id) g ON g.product_id = p.id""",
    "e7_crawl_stats": f"SELECT {_COUNTS}, count(*) FILTER (found_at >= TIMESTAMP '2026-06-01') AS since_june FROM {_QUEUE}",
    "e7_domain_stats": f"SELECT domain, {_COUNTS}, count(*) FILTER (found_at >= TIMESTAMP '2026-06-01') AS since_june, arg_max(error_msg, (found_at, id)) FILTER (error_msg IS NOT NULL) AS last_error FROM {_QUEUE} WHERE domain <> '' GROUP BY domain",
    "e10_complete_search": "SELECT id, pipeline_status FROM (SELECT * FROM canonical_products WHERE clean_title ILIKE '%plus%' OR brand ILIKE '%plus%' ORDER BY first_seen_at DESC, id DESC LIMIT 20) WHERE pipeline_status = 'complete' ORDER BY first_seen_at DESC, id DESC LIMIT 5",
    "j4_listing_merchants": """SELECT l.id AS listing_id, m.domain, m.display_name, p.pages, p.errors FROM listings l JOIN merchants m ON m.id = l.merchant_id
 LEFT JOIN (SELECT merchant_id, count(*) AS pages, count(*) FILTER (http_status >= 400) AS errors FROM page_inspections GROUP BY merchant_id) p ON p.merchant_id = m.id""",
    "s16_rates": """SELECT strftime(day, '%Y-%m-%d') AS day, currency, coalesce(rate, CASE currency WHEN 'USD' THEN 305.0 ELSE 83.1 END) AS rate, rate IS NULL AS stale FROM (SELECT day, currency,
  CAST((SELECT arg_max(lkr_per_unit, rate_date) FROM fx_rates f WHERE f.currency = c.currency AND f.rate_date <= x.day) AS DOUBLE) AS rate
  FROM (SELECT DISTINCT unnest([CAST(scraped_timestamp AS DATE), CAST(scraped_timestamp AS DATE) - 730]) AS day FROM scraped_items) x, (SELECT unnest(['USD', 'AED']) AS currency) c WHERE day IS NOT NULL)""",
    "e7_last_error": f"SELECT id, domain, error_msg FROM {_QUEUE} WHERE error_msg IS NOT NULL ORDER BY found_at DESC NULLS LAST, id DESC LIMIT 1",
    "e8_domain_rollup": f"SELECT row_number() OVER (ORDER BY m DESC NULLS LAST, domain ASC NULLS FIRST) AS place, domain, total, pending, completed, failed, strftime(m, '%Y-%m-%d %H:%M:%S') AS last_discovered FROM (SELECT domain, {_COUNTS}, max(found_at) AS m FROM {_QUEUE} GROUP BY domain)",
    "e9_domain_profiles": f"SELECT q.id, regexp_replace(q.domain, '^www\\.', '') AS site, m.id AS profile_id, m.city FROM {_QUEUE} q LEFT JOIN merchants m ON m.domain = regexp_replace(q.domain, '^www\\.', '')",
    "e10_complete_products": "SELECT id, pipeline_status FROM (SELECT * FROM canonical_products ORDER BY first_seen_at DESC, id DESC LIMIT 40) WHERE pipeline_status = 'complete' ORDER BY first_seen_at DESC, id DESC LIMIT 10",
    "a3_status_tally": "SELECT pipeline_status AS status, count(*) AS n FROM canonical_products GROUP BY 1",
    "a13_site_outcomes": f"SELECT domain, count(*) FILTER (status = 'completed') AS successes, count(*) FILTER (status = 'failed') AS failures FROM {_QUEUE} GROUP BY domain",
    "j6_new_vs_known": "SELECT known, count(*) AS n, min(item_id) AS first_item FROM (SELECT item_id, raw_title IN (SELECT raw_title FROM canonical_products WHERE raw_title IS NOT NULL) AS known FROM scraped_items WHERE raw_title IS NOT NULL) GROUP BY known",
    "j10_authorised": """WITH a AS (SELECT DISTINCT brand, regexp_extract(domain, '^([^.]+)', 1) AS agent FROM (SELECT unnest(authorized_brands) AS brand, domain FROM merchants)),
 o AS (SELECT brand, lower(regexp_extract(product_url, '://([^/?#:]*)', 1)) AS host FROM scraped_items WHERE brand IS NOT NULL)
SELECT brand, count(*) AS offers, count(*) FILTER (EXISTS (SELECT 1 FROM a WHERE a.brand = o.brand AND contains(o.host, a.agent))) AS authorised FROM o GROUP BY brand""",
    "e6_dossiers": """SELECT p.id AS product_id, t.documents, t.source_count, t.latest, strftime(t.a, '%Y-%m-%d %H:%M:%S') AS generated_at, strftime(t.b, '%Y-%m-%d %H:%M:%S') AS updated_at FROM canonical_products p LEFT JOIN (
 SELECT product_id, count(*) AS documents, count(DISTINCT source) AS source_count, arg_max(doc_id, (crawled_at, doc_id)) AS latest, min(crawled_at) AS a, max(crawled_at) AS b FROM documents WHERE product_id IS NOT NULL GROUP BY product_id) t ON t.product_id = p.id""",
    "j11_rates": """SELECT strftime(d.day, '%Y-%m-%d') AS day, f.currency, CAST(f.lkr_per_unit AS DOUBLE) AS rate FROM (SELECT DISTINCT CAST(scraped_timestamp AS DATE) AS day FROM scraped_items WHERE scraped_timestamp IS NOT NULL) d
 JOIN fx_rates f ON f.rate_date = (SELECT max(g.rate_date) FROM fx_rates g WHERE g.currency = f.currency AND g.rate_date <= d.day)""",
    "m21_monthly_history": "SELECT strftime(updated_at, '%Y_%m') AS month, count(*) AS points, CAST(sum(current_price_lkr) AS DOUBLE) AS total FROM listing_updates WHERE updated_at IS NOT NULL GROUP BY 1",
    "o7_knn": """SELECT query, rank, vec_id, round(distance, 4) AS distance FROM (
 SELECT q.vec_id AS query, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), v.vec_id) AS rank, list_cosine_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS distance
 FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0) WHERE rank <= 10""",
    "q1_claim": f"SELECT id, product_id FROM {_JOBS} WHERE status = 'pending' ORDER BY enqueued_at, id LIMIT 25",
    "q2_claim_of_domain": f"""SELECT q.domain, q.id, 'in_progress' AS status, 1 + (SELECT count(*) FROM {_QUEUE} f WHERE f.url = q.url AND f.status = 'failed') AS attempts
 FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY found_at, id) AS n FROM {_QUEUE} WHERE status = 'pending') q WHERE q.n <= 2""",
    "q13_stale_claims": f"""SELECT product_id, strftime(claimed, '%Y-%m-%d %H:%M:%S') AS claimed_at FROM (SELECT product_id, arg_max(status, (enqueued_at, id)) FILTER (status <> 'pending') AS s, max(enqueued_at) FILTER (status = 'claimed') AS claimed FROM {_JOBS} GROUP BY product_id)
 WHERE s = 'claimed' AND claimed < TIMESTAMP '2024-01-30 00:00:00'""",
    "m11_job_states": """WITH e AS (SELECT user_id AS product_id, event_id, ts, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'claimed' WHEN 'signup' THEN 'retried' ELSE 'pending' END AS s FROM events),
 r AS (SELECT product_id, max((ts, event_id)) FILTER (s = 'retried') AS reset FROM e GROUP BY product_id),
 f AS (SELECT e.product_id, arg_max(s, (ts, event_id)) FILTER (s <> 'pending') AS s, count(*) FILTER (s = 'claimed') AS attempts, max(ts) FILTER (s = 'claimed' AND (reset IS NULL OR (ts, event_id) > reset)) AS c,
  max(ts) FILTER (s IN ('done', 'failed') AND (reset IS NULL OR (ts, event_id) > reset)) AS d FROM e JOIN r ON r.product_id = e.product_id GROUP BY e.product_id)
SELECT product_id, CASE WHEN s IS NULL OR s = 'retried' THEN 'pending' ELSE s END AS status, attempts, strftime(c, '%Y-%m-%d %H:%M:%S') AS claimed_at, strftime(d, '%Y-%m-%d %H:%M:%S') AS completed_at FROM f""",
    "s22_context": f"SELECT product_id, '<local_listings>' || string_agg('<listing merchant=\"' || replace(replace(replace(domain, '&', '&amp;'), '<', '&lt;'), '\"', '&quot;') || '\" rank=\"' || rank || '\"/>', '' ORDER BY rank) || '</local_listings>' AS context FROM {_LISTINGS} GROUP BY product_id",
    "pred12_usable": "SELECT merchant_id, count(*) AS usable FROM scraped_items WHERE price_lkr > 0 AND coalesce(raw_title, '') <> '' GROUP BY merchant_id",
}

QUERIES = {name: globals()[name] for name in SQL}
