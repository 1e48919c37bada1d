"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import byte_bpe, canonical_values, mixing, product_linkage, shared_spans, template_residue


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_residue.found(_table(spark, sf_dir, "page_inspections"), _table(spark, sf_dir, "scraped_items"))


def p1_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_residue.residue(template_residue.fields_of(_table(spark, sf_dir, "page_inspections"), _table(spark, sf_dir, "scraped_items")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = [
        _table(spark, sf_dir, table).select(F.lit(table).alias("source_table"), F.col(key).alias("record_id"), F.col("brand").alias("value"))
        for table, key in (("scraped_items", "item_id"), ("tech_specs", "spec_id"))
    ]
    return canonical_values.mapped(sources, _table(spark, sf_dir, "brand_reference"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_linkage.pairs_of(product_linkage.groups(_table(spark, sf_dir, "canonical_products"), _table(spark, sf_dir, "brand_reference")))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_linkage.groups(_table(spark, sf_dir, "canonical_products"), _table(spark, sf_dir, "brand_reference"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_corpus(_table(spark, sf_dir, "documents"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_chars(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_fields, p2_found, p3_found, p3_groups, p6_ids, p7_mixture, p7_shares, p8_found)}


def _p2_sql() -> str:
    """Every value beside every name: no tokens, no prefixes; letters by letters."""
    cv, quote = canonical_values, lambda t: "'" + t.replace("'", "''") + "'"
    old, new = cv._plain_letters()
    clean = f"translate(regexp_replace(lower(v), '[\\p{{Cf}}\\x{{AD}}\\x{{300}}-\\x{{36F}}]+', '', 'g'), {quote(old)}, {quote(new)})"
    clean = f"regexp_replace(regexp_replace({clean}, '%20|&nbsp;|[™®©℠_\\s\\x{{A0}}\\p{{Z}}]+', ' ', 'g'), '\\s*(?:\\band\\b|&amp;|&|\\+)\\s*', ' ', 'g')"
    clean = f"trim(regexp_replace(regexp_replace({clean}, '^[^\\p{{L}}\\p{{N}}@$]+', ''), '[^\\p{{L}}\\p{{M}}\\p{{N}})$]+$', ''))"
    bare = f"trim(regexp_replace(regexp_replace(c, {quote(f'^(?:(?:{cv.BEFORE})[ ]+)+([^ ])')}, '\\1'), {quote(f'([^ ])(?:[ ,]+(?:{cv.AFTER}))+[^{chr(92)}p{{L}}{chr(92)}p{{N}}]*$')}, '\\1'))"
    key = lambda x: f"regexp_replace(translate({x}, {quote(''.join(cv.LEET))}, {quote(''.join(cv.LEET.values()))}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', '', 'g')"
    forms = lambda rows, name: f"SELECT DISTINCT {name}, unnest([{key('c')}, {key(bare)}]) AS form FROM (SELECT {name}, {clean} AS c FROM ({rows}))"
    grams = "list_distinct(list_transform(range(0, length(form) + 1), lambda i: substring('^' || form || '$', i + 1, 2)))"
    told = lambda name: f"SELECT {name}, form, {grams} AS g, list_sort(string_split(form, '')) AS l FROM {name}_forms WHERE form <> ''"
    return f"""
WITH r AS (SELECT 'scraped_items' AS source_table, item_id AS record_id, brand AS v FROM scraped_items UNION ALL SELECT 'tech_specs', spec_id, brand FROM tech_specs),
t AS (SELECT * FROM r WHERE regexp_matches(v, '[^\\s\\p{{Z}}]') AND v NOT IN (SELECT brand_name FROM brand_reference WHERE brand_name IS NOT NULL)),
v_forms AS ({forms("SELECT DISTINCT v FROM t", "v")}), e_forms AS ({forms("SELECT e, v FROM (SELECT brand_id AS e, unnest(list_prepend(brand_name, coalesce(aliases, []))) AS v FROM brand_reference) WHERE v IS NOT NULL", "e")}),
p AS (SELECT a.v, b.e, levenshtein(a.form, b.form) - CASE WHEN a.form <> b.form AND a.l = b.l THEN 1 ELSE 0 END AS d, length(b.form) AS n, len(list_intersect(a.g, b.g)) / len(list_distinct(a.g || b.g)) AS j, a.l = b.l AS turned FROM ({told("v")}) a, ({told("e")}) b),
k AS (SELECT * FROM p WHERE (j >= {cv.SIMILARITY} - 1e-9 OR turned) AND d <= CASE WHEN n < {cv.SHORT} THEN 0 ELSE {cv.EDITS} * n END),
f AS (SELECT v, e FROM (SELECT v, e, row_number() OVER (PARTITION BY v ORDER BY d / n, j DESC, e) AS pick FROM k) WHERE pick = 1)
SELECT t.source_table, t.record_id, coalesce(f.e, 0) AS brand_id FROM t LEFT JOIN f ON f.v = t.v"""


def _p8_sql() -> str:
    """Every window of every document as it is: those that two documents have, and the characters that they cover."""
    n = shared_spans.SPAN
    return f"""
WITH w AS (SELECT doc_id, i, substring(text, i, {n}) AS w FROM (SELECT doc_id, text, unnest(range(1, CAST(length(text) AS BIGINT) - {n - 2})) AS i FROM documents WHERE length(text) >= {n})),
s AS (SELECT w FROM w GROUP BY w HAVING min(doc_id) < max(doc_id)),
h AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w WHERE w IN (SELECT w FROM s))
SELECT doc_id, CAST(sum(least({n}, i - coalesce(before, i - {n}))) AS BIGINT) AS shared_chars FROM h GROUP BY doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": _p2_sql(), "p8_found": _p8_sql()}
