"""Queries of the general data problems."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history, units
from ..session import ship

_STATE = ["current_price_lkr", "in_stock"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history.versions(_table(spark, sf_dir, "listing_updates"), "listing_id", _STATE)
    return found.select(
        "listing_id",
        F.unix_seconds(F.col("valid_from").cast("timestamp")).alias("valid_from_s"),
        F.coalesce(F.unix_seconds(F.col("valid_to").cast("timestamp")), F.lit(0)).cast("bigint").alias("valid_to_s"),
        (F.col("current_price_lkr") * 100).cast("bigint").alias("price_cents"),
    )


def p4_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each listing at a moment, read from one era of the store."""
    store = history.store_of(_table(spark, sf_dir, "listing_updates"), "listing_id", _STATE)
    return store.as_of(datetime(2025, 10, 15, 12)).select("listing_id", F.col("current_price_lkr").cast("double").alias("price"), "in_stock")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.wrong_units(*(_table(spark, sf_dir, t) for t in ("scraped_items", "merchants", "fx_rates", "canonical_products")))


def p5_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scraped price in whole rupees, as far as anything tells it."""
    return units.price_amounts(*(_table(spark, sf_dir, t) for t in ("scraped_items", "merchants", "fx_rates"))).select("item_id", "amount", F.coalesce("in_unit", F.lit(False)).alias("in_unit"))


def p5_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RAM and storage of every product in MB, however its titles or attributes tell them; null where nothing does."""
    told = units.memory_amounts(_table(spark, sf_dir, "canonical_products"))
    return told.select("id", F.round("ram_told").cast("bigint").alias("ram_mb"), F.round("storage_told").cast("bigint").alias("storage_mb"))


_LAST_RECEIVED = """
    SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY listing_id, updated_at
                                   ORDER BY received_at DESC NULLS LAST, update_id DESC NULLS LAST) AS pick
      FROM listing_updates WHERE listing_id IS NOT NULL AND updated_at IS NOT NULL) t
    WHERE pick = 1"""

def _sql_currency(text: str) -> str:
    return f"""CASE WHEN {text} SIMILAR TO '.*(indian rupee|inr|₹).*' THEN 'INR' WHEN {text} SIMILAR TO '.*(dollar|usd|[$]).*' THEN 'USD' WHEN {text} SIMILAR TO '.*(aed|dhs|dirham).*' THEN 'AED'
  WHEN {text} SIMILAR TO '.*(eur|€).*' THEN 'EUR' WHEN regexp_matches({text}, '\\blkr\\b|\\brs\\b|රු|rupee') THEN 'LKR' END"""


def _sql_scale(text: str) -> str:
    return f"""CASE WHEN regexp_matches({text}, 'thousand|\\bk\\b|දහස්|''000') THEN 1000 WHEN regexp_matches({text}, 'lakh|lac|ලක්ෂ') THEN 100000
  WHEN regexp_matches({text}, 'million|\\bmn\\b|\\bm\\b') THEN 1000000 WHEN regexp_matches({text}, 'cent|minor unit') THEN 0.01 END"""


SQL = {
    "p5_prices": f"""
WITH cut AS (
  SELECT item_id, merchant_id, price_lkr, CAST(scraped_timestamp AS DATE) AS day,
         regexp_replace(lower(price_text), '(\\s+or\\s+[0-9]+\\s*x\\s.*|\\s*/\\s*[0-9]+\\s+instal.*|\\(\\s*[0-9]+\\s*x\\s.*)$', '') AS s FROM scraped_items),
parts AS (
  SELECT *, regexp_extract(s, '([0-9][0-9,.]*)[^0-9]*$', 1) AS raw,
         regexp_extract(s, '([^0-9]*)[0-9][0-9,.]*([^0-9]*)$', 1) || ' ' || regexp_extract(s, '([^0-9]*)[0-9][0-9,.]*([^0-9]*)$', 2) AS u FROM cut),
told AS (
  SELECT *, {_sql_currency('u')} AS cur, {_sql_scale('u')} AS scale, regexp_replace(raw, '[,.]+$', '') AS n FROM parts),
shown AS (
  SELECT *, TRY_CAST(nullif(CASE WHEN scale IS NULL AND regexp_full_match(n, '[0-9]{{1,3}}(\\.[0-9]{{3}})+(,[0-9]+)?') THEN replace(replace(n, '.', ''), ',', '.') ELSE replace(n, ',', '') END, '') AS DECIMAL(24,6)) AS number FROM told),
notes AS (
  SELECT id, lower(feed_notes) AS f, TRY_CAST(nullif(regexp_extract(lower(feed_notes), '(from|since)\\s+([0-9-]{{10}})', 2), '') AS DATE) AS turn FROM merchants),
noted AS (
  SELECT i.*, CASE WHEN turn IS NULL THEN {_sql_currency('f')} WHEN day >= turn THEN 'LKR' END AS note_cur,
         CASE WHEN turn IS NULL THEN {_sql_scale("replace(f, '(1/100 rupee)', '')")} WHEN day < turn THEN 0.01 END AS note_scale
  FROM shown i LEFT JOIN notes ON notes.id = i.merchant_id),
unit AS (
  SELECT *, cur IS NOT NULL OR scale IS NOT NULL AS by_text FROM noted),
final AS (
  SELECT item_id, price_lkr, day, CASE WHEN by_text THEN number ELSE coalesce(TRY_CAST(price_lkr AS DECIMAL(24,6)), number) END AS number,
         coalesce(CASE WHEN by_text THEN cur ELSE note_cur END, 'LKR') AS cur, coalesce(CASE WHEN by_text THEN scale ELSE note_scale END, 1) AS scale FROM unit),
exact AS (
  SELECT item_id, price_lkr, CAST(number * scale AS DECIMAL(28,6)) * CASE WHEN cur = 'LKR' THEN CAST(1 AS DECIMAL(12,2)) ELSE
    (SELECT arg_max(r.lkr_per_unit, r.rate_date) FROM fx_rates r WHERE r.currency = final.cur AND r.rate_date <= final.day) END AS v FROM final)
SELECT item_id, CAST(round(v) AS BIGINT) AS amount, coalesce(abs(price_lkr - CAST(v AS DOUBLE)) <= 0.02 * CAST(v AS DOUBLE), false) AS in_unit FROM exact""",
    "p4_found": f"""
WITH one AS ({_LAST_RECEIVED}),
filled AS (
  SELECT listing_id, updated_at,
         last_value(current_price_lkr IGNORE NULLS) OVER w AS price,
         last_value(in_stock IGNORE NULLS) OVER w AS stock
  FROM one WINDOW w AS (PARTITION BY listing_id ORDER BY updated_at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
marked AS (
  SELECT *, lag(price) OVER w AS price_was, lag(stock) OVER w AS stock_was, row_number() OVER w AS n
  FROM filled WINDOW w AS (PARTITION BY listing_id ORDER BY updated_at)),
starts AS (
  SELECT * FROM marked
  WHERE n = 1 OR price IS DISTINCT FROM price_was OR stock IS DISTINCT FROM stock_was)
SELECT listing_id,
       CAST(epoch(updated_at) AS BIGINT) AS valid_from_s,
       CAST(coalesce(epoch(lead(updated_at) OVER (PARTITION BY listing_id ORDER BY updated_at)), 0) AS BIGINT) AS valid_to_s,
       CAST(price * 100 AS BIGINT) AS price_cents
FROM starts""",
    "p4_as_of": f"""
WITH one AS ({_LAST_RECEIVED} AND updated_at <= TIMESTAMP '2025-10-15 12:00:00')
SELECT listing_id, CAST(arg_max(current_price_lkr, updated_at) AS DOUBLE) AS price, arg_max(in_stock, updated_at) AS in_stock
FROM one GROUP BY listing_id""",
}

QUERIES = {"p4_found": p4_found, "p4_as_of": p4_as_of, "p5_found": p5_found, "p5_prices": p5_prices, "p5_memory": p5_memory}
