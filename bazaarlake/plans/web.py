"""Queries on addresses, texts and pages.

Pages are made from scraped items, a quarter of them with each way of markup, so what extraction must find is
known from the items' own columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..functions import urls as U
from ..operators import commerce, dedup, graph, ingest, pages, titles
from ..sources import web
from ..session import small
from .general import _table

_WAYS = ("jsonld", "opengraph", "microdata", "text")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """(id, url, way, html, in_stock, price): pages made of scraped items that have a title and a price."""
    items = _table(spark, d, "scraped_items").where("raw_title is not null and trim(raw_title) <> '' and price_lkr > 0")
    plain = F.regexp_replace("raw_title", "[\"'<>&]", "")
    price = F.col("price_lkr").cast("decimal(18,2)").cast("string")
    stock = F.when(F.col("in_stock"), "InStock").otherwise("OutOfStock")
    product = F.to_json(
        F.struct(
            F.lit("Product").alias("@type"), F.col("raw_title").alias("name"), F.struct(F.col("brand").alias("name")).alias("brand"),
            F.array(F.struct(price.alias("price"), F.concat(F.lit("https://schema.org/"), stock).alias("availability"))).alias("offers"),
        )
    )
    meta = lambda name, value: F.concat(F.lit(f'<meta {name} content="'), value, F.lit('">'))
    body = {
        "jsonld": F.concat(F.lit("<script>var x = {\"price\": broken</script><script type=\"application/ld+json\">not json</script><script type=\"application/ld+json\">{\"@graph\":["), product, F.lit("]}</script>")),
        "opengraph": F.concat(meta('property="og:title"', plain), F.concat(F.lit('<meta content="'), price, F.lit('" property="product:price:amount">')), meta('property="product:availability"', stock)),
        "microdata": F.concat(meta('itemprop="name"', plain), F.lit('<span itemprop="price" content="'), price, F.lit('"></span>'), meta('itemprop="availability"', stock)),
        "text": F.concat(F.lit("<p>Rs. "), price, F.lit("</p>"), F.when(F.col("in_stock"), '<button class="btn">Add to cart</button>').otherwise('<button class="btn" disabled data-x="add-to-cart">Sold out</button>')),
    }
    way = F.element_at(F.array(*(F.lit(w) for w in _WAYS)), (F.pmod("item_id", F.lit(4)) + 1).cast("int"))
    markup = F.coalesce(*(F.when(way == w, b) for w, b in body.items()))
    links = F.concat(
        F.lit('<a href="#top">up</a><a href="/product/'), F.col("item_id").cast("string"), F.lit('">a</a><a href=\'../shop/x\'>b</a><a href="https://other.example/p/1">c</a><a href="//cdn.example/i.png">d</a><a href="about?ref=home&amp=1">e</a>')
    )
    html = F.concat(F.lit("<html><head><title> "), plain, F.lit("  </title><style>p {color: red}</style></head><body>"), markup, links, F.lit("</body></html>"))
    return items.select(F.col("item_id").alias("id"), F.col("product_url").alias("url"), way.alias("way"), html.alias("html"), "in_stock", F.col("price_lkr").cast("decimal(18,2)").cast("double").alias("price"))


_ITEMS = """(SELECT *, trim(regexp_replace(regexp_replace(raw_title, '["''<>&]', '', 'g'), '[\\s\\x{a0}]+', ' ', 'g')) AS plain, CAST(CAST(price_lkr AS DECIMAL(18,2)) AS DOUBLE) AS price,
  ['jsonld', 'opengraph', 'microdata', 'text'][item_id % 4 + 1] AS way
  FROM scraped_items WHERE raw_title IS NOT NULL AND trim(raw_title) <> '' AND price_lkr > 0)"""


def _facts(df: DataFrame, fact: Column) -> DataFrame:
    return df.select("id", fact.alias("f")).where("f is not null").select("id", T.collapsed(F.col("f.title")).alias("title"), F.col("f.price").alias("price"), F.col("f.in_stock").alias("in_stock"), F.col("f.tier").alias("tier"))


def _facts_sql(way: str) -> str:
    title = "trim(regexp_replace(raw_title, '[\\s\\x{a0}]+', ' ', 'g'))" if way == "jsonld" else "plain"
    return f"SELECT item_id AS id, {title} AS title, price, coalesce(in_stock, false) AS in_stock, way AS tier FROM {_ITEMS} WHERE way = '{way}'"


def x1_jsonld(spark: SparkSession, d: str) -> DataFrame:
    return _facts(_pages(spark, d), pages.jsonld(F.col("html")))


def x2_opengraph(spark: SparkSession, d: str) -> DataFrame:
    return _facts(_pages(spark, d), pages.opengraph(F.col("html")))


def x3_microdata(spark: SparkSession, d: str) -> DataFrame:
    return _facts(_pages(spark, d), pages.microdata(F.col("html")))


def x4_remembered(spark: SparkSession, d: str) -> DataFrame:
    """Every page by its site's remembered way: the markup it has, or a pattern where it has none."""
    mine = _pages(spark, d)
    way = F.when(F.col("way") == "text", F.lit(r"re:Rs\. ([\d.]+)")).when(F.col("way") == "opengraph", "og").otherwise(F.col("way"))
    return _facts(mine, pages.remembered(F.col("html"), way, F.lit(None).cast("string"))).drop("in_stock")


def x6_cascade(spark: SparkSession, d: str) -> DataFrame:
    ready = _pages(spark, d).withColumn("price_selector", F.lit(r"re:Rs\. ([\d.]+)")).withColumn("extraction_tier", F.lit(None).cast("string"))
    return pages.cascade(ready).groupBy(F.col("fact.tier").alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("fact.price").cast("decimal(18,2)")).cast("double").alias("total"), F.count_if("usable").alias("usable"))


def _votes(mine: DataFrame) -> DataFrame:
    html = F.col("html")
    voted = mine.select("id", pages.vote(pages.button_signal(html), pages.schema_signal(html), pages.text_signal(html)).alias("v"))
    return voted.select("id", F.col("v.in_stock").alias("in_stock"), F.col("v.confidence").cast("bigint").alias("confidence"), F.col("v.agreed").alias("agreed"))


def x13_stock_votes(spark: SparkSession, d: str) -> DataFrame:
    """The votes of all pages' signals, whatever markup they have."""
    return _votes(_pages(spark, d))


def _polls(mine: DataFrame) -> DataFrame:
    html, before = F.col("html"), F.coalesce("in_stock", F.lit(False))
    polled = mine.select("id", pages.polled_price(html).alias("price"), F.col("price").alias("p0"), pages.polled_stock(html, F.lit(200), before).alias("stock"), before.alias("before"))
    return polled.select("id", "price", "stock", pages.changed(F.col("price"), F.col("p0"), F.col("stock"), F.col("before")).alias("news"))


def x17_polled(spark: SparkSession, d: str) -> DataFrame:
    """What a poll of every page brings, and whether it is news against the price and the stock before; stock that a page does not tell is as before."""
    return _polls(_pages(spark, d))


def x15_links(spark: SparkSession, d: str) -> DataFrame:
    return pages.links(_pages(spark, d).select("url", "html")).groupBy(F.regexp_replace("link", r"\d+$", "").alias("link")).agg(F.count(F.lit(1)).alias("n"))


def x16_child_links(spark: SparkSession, d: str) -> DataFrame:
    once = _pages(spark, d).groupBy("url").agg(F.min_by("html", "id").alias("html"))
    return pages.child_links(once).groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


_ADDRESS = """concat(CASE WHEN item_id % 5 = 0 THEN 'HTTPS' WHEN item_id % 5 = 1 THEN 'http' ELSE 'https' END, '://', CASE WHEN item_id % 7 = 0 THEN 'User:pw@' ELSE '' END, CASE WHEN item_id % 2 = 0 THEN 'WWW.Shop' ELSE 'shop' END, merchant_id, '.Example',
  CASE WHEN item_id % 6 = 0 THEN ':443' WHEN item_id % 6 = 1 THEN ':80' WHEN item_id % 6 = 2 THEN ':8443' ELSE '' END, '/Item/', item_id % 50, CASE WHEN item_id % 4 = 0 THEN '//' WHEN item_id % 4 = 1 THEN '/' ELSE '' END,
  CASE WHEN item_id % 3 = 0 THEN concat('?utm_source=feed&b=', item_id % 9, '&a=2&gclid=x') WHEN item_id % 3 = 1 THEN concat('?Sort=z&page=', item_id % 4, '&ref=home&a=') ELSE '' END, CASE WHEN item_id % 11 = 0 THEN '#top' ELSE '' END)"""


def f1_canonical_url(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of items written in many ways, in one form: ports, users, cases, parameters in any order."""
    return _table(spark, d, "scraped_items").select("item_id", U.canonical(F.expr(_ADDRESS)).alias("url"))


def f2_canonical_keeping_query(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "scraped_items").select("item_id", U.canonical_keeping_query(F.col("product_url")).alias("url"))


def f4_hosts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return _table(spark, d, "page_inspections").select("inspection_id", U.host(u).alias("host"), U.netloc(u).alias("netloc"), U.site_of(u).alias("site"), U.origin(u).alias("origin"))


def pred8_product_urls(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return _table(spark, d, "page_inspections").select("inspection_id", U.is_product(u).alias("product"), U.hints_at_product(u).alias("hint"))


def f6_content_hash(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


def f35_titles(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("id", T.title(F.col("html")).alias("title"))


def f36_visible_text(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", F.md5(T.visible(F.col("text"))).alias("visible"))


def f44_escaped(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "canonical_products").select("id", T.escaped(F.col("raw_title")).alias("escaped"))


def f11_prices(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("price_text")
    return _table(spark, d, "scraped_items").select("item_id", N.price(text).alias("price"), N.number(F.regexp_replace(text, r"[.]", "")).alias("digits"))


def f18_confidence(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "page_inspections").select("inspection_id", N.confidence(F.col("confidence_score") * 3 - 1).alias("confidence"))


def f20_first_truthy(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "scraped_items").select("item_id", N.first_truthy(F.col("original_price_lkr"), F.col("price_lkr")).alias("price"))


_STOCK = """CASE id % 12 WHEN 0 THEN 'https://schema.org/InStock' WHEN 1 THEN 'http://schema.org/OutOfStock' WHEN 2 THEN 'PreOrder' WHEN 3 THEN 'schema.org/SoldOut' WHEN 4 THEN 'LimitedAvailability' WHEN 5 THEN 'in_stock' WHEN 6 THEN 'Discontinued' WHEN 7 THEN pipeline_status
  WHEN 8 THEN '' WHEN 9 THEN 'OnlineOnly' WHEN 10 THEN 'BackOrder, InStock soon' END"""


def f39_available(spark: SparkSession, d: str) -> DataFrame:
    """Availability as it is told in many ways, nulls among them."""
    return _table(spark, d, "canonical_products").select("id", N.available(F.expr(_STOCK)).alias("a"))


def c1_preflight(spark: SparkSession, d: str) -> DataFrame:
    html = F.concat_ws(" ", "page_title", "page_text")
    verdict = pages.preflight(html, F.col("http_status"), 40)
    return _table(spark, d, "page_inspections").select("inspection_id", verdict["page_type"].alias("page_type"), verdict["confidence"].alias("confidence"))


def u2_ring(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "page_inspections").select("inspection_id", "url", "page_text")
    out = dedup.ring(p, U.canonical(F.col("url")), T.content_hash(F.col("page_text")), ["inspection_id"])
    return out.select("inspection_id", "outcome")


def u1_first_of_url(spark: SparkSession, d: str) -> DataFrame:
    return dedup.once(_table(spark, d, "page_inspections").select("inspection_id", "url"), U.canonical(F.col("url")), ["inspection_id"]).select("inspection_id")


def u3_evidence(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").where("product_id is not null and text is not null").select("product_id", "doc_id", "text")
    return dedup.evidence(docs, ["product_id"], "text", ["doc_id"]).select("product_id", "doc_id")


_ROBOTS = """concat('# robots of ', domain, chr(10), 'User-agent: *', chr(10), chr(10), CASE WHEN id % 3 = 0 THEN 'Disallow: /cart' WHEN id % 3 = 1 THEN concat('disallow:/private/', id, chr(10), ' DISALLOW :  /x?y=1:2 ') ELSE 'Disallow:' END, chr(10),
  CASE WHEN id % 4 = 0 THEN concat('SITEMAP: https://', domain, '/sitemap.xml', chr(13)) WHEN id % 4 = 1 THEN concat('Sitemap:https://', domain, ':8080/a.xml', chr(10), '#Sitemap: https://no.example/x.xml') ELSE 'no colon here' END, chr(10), 'Allow: /', chr(10), 'Sitemap: https://', domain, '/more', id % 7, '.xml')"""


def s11_robots(spark: SparkSession, d: str) -> DataFrame:
    files = _table(spark, d, "merchants").select("domain", F.expr(_ROBOTS).alias("body"))
    rules = web.robots_rules(files, "domain")
    return rules.select("domain", F.array_join("sitemaps", " ").alias("sitemaps"), F.array_join("disallows", " ").alias("disallows"))


#: Inspections whose addresses one sitemap file holds at most.
_FILE = 10_000


def _sitemaps(spark: SparkSession, d: str) -> DataFrame:
    """The locations in sitemap files of each merchant's pages, bounded in size, and in each merchant's index of its files."""
    sites = _table(spark, d, "merchants").select("id", "domain")
    pages_ = _table(spark, d, "page_inspections").select("url", "merchant_id", F.floor(F.col("inspection_id") / _FILE).alias("file"))
    # A group is one file's addresses.
    one = pages_.join(small(sites), F.col("merchant_id") == F.col("id")).groupBy("domain", "file").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("<loc> "), "url", F.lit("</loc>")))), "").alias("l"))
    name = F.concat(F.lit("https://"), "domain", F.lit("/pages"), F.coalesce("file", F.lit(0)).cast("string"), F.lit(".xml"))
    leaf = one.select(name.alias("url"), F.concat(F.lit("<urlset>"), "l", F.lit("</urlset>")).alias("body"))
    files = sites.select("domain").join(one.select("domain", "file"), "domain", "left").select("domain", name.alias("loc"))  # a merchant without pages names a file that isn't there
    index = files.groupBy("domain").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<sitemap><loc>"), "loc", F.lit("</loc></sitemap>")))), "").alias("l"))
    index = index.select(F.concat(F.lit("https://"), "domain", F.lit("/sitemap.xml")).alias("url"), F.concat(F.lit("<SitemapIndex>"), "l", F.lit("<loc></loc></SitemapIndex>")).alias("body"))
    return web.sitemap_locations(leaf.unionByName(index))


def s12_sitemap_locs(spark: SparkSession, d: str) -> DataFrame:
    return _sitemaps(spark, d).groupBy("is_index").agg(F.count(F.lit(1)).alias("n"))


def s13_sitemap_walk(spark: SparkSession, d: str) -> DataFrame:
    starts = _table(spark, d, "merchants").select(F.concat(F.lit("https://"), "domain", F.lit("/sitemap.xml")).alias("url"))
    return graph.sitemap_leaves(_sitemaps(spark, d), starts)


def s13_sitemap_products(spark: SparkSession, d: str) -> DataFrame:
    """The product pages of every merchant's own site that its sitemaps lead to."""
    starts = _table(spark, d, "merchants").select(F.concat(F.lit("https://"), "domain", F.lit("/sitemap.xml")).alias("url"))
    return graph.sitemap_products(_sitemaps(spark, d), starts, max_sitemaps=1_000_000).select("site", "url")


#: Listings of a merchant that are at most so far from each other are linked.
_NEAR = 40


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Products that one merchant lists next to each other, as links.

    Listings meet in buckets of neighbours, each bucket with itself and the next, so a merchant with a third of all
    listings is many small groups.
    """
    a = _table(spark, d, "listings").select("merchant_id", "product_id", "id", F.floor(F.col("id") / _NEAR).alias("bucket"))
    left = a.withColumn("bucket", F.explode(F.array("bucket", F.col("bucket") + 1)))
    both = left.alias("a").join(a.alias("b"), (F.col("a.merchant_id") == F.col("b.merchant_id")) & (F.col("a.bucket") == F.col("b.bucket")) & (F.col("b.id") - F.col("a.id")).between(1, _NEAR))
    return both.select(F.col("a.product_id").alias("src"), F.col("b.product_id").alias("dst"))


def q7_reached(spark: SparkSession, d: str) -> DataFrame:
    """What is reached in three steps from the first listing of each merchant."""
    seeds = _table(spark, d, "listings").groupBy("merchant_id").agg(F.min_by("product_id", "id").alias("node")).select("node")
    return graph.reached(_edges(spark, d), seeds, 3).select("node", F.col("depth").cast("bigint").alias("depth"))


def f25_conditions(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("raw_title")
    return _table(spark, d, "canonical_products").select("id", titles.condition(t).alias("condition"), titles.sub_model(t).alias("sub_model"), titles.memory(t)["ram_gb"].alias("ram_gb"), titles.memory(t)["storage_gb"].alias("storage_gb"), titles.no_phone(t).alias("no_phone"))


def f7_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return _table(spark, d, "canonical_products").select("id", titles.fingerprint(c("brand"), c("model_family"), c("sub_model"), c("ram_gb"), c("storage_gb"), c("region_code"), F.lit("new"), F.lit("")).alias("fp"))


def x20_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Every product's raw title normalised; its parts are checked by tests with known titles."""
    return titles.normalised(_table(spark, d, "canonical_products").select("id", "raw_title", "brand"), "raw_title", "brand").select("id", "spec.*")


_PAYMENTS = """concat_ws(' ', text,
  CASE WHEN doc_id % 5 = 0 THEN concat('Pay ', 2 + doc_id % 64, ' x Rs. ', 1000 + doc_id * 37 % 90000, ' with ', {p}, '.')
       WHEN doc_id % 5 = 1 THEN concat({p}, ': ', 2 + doc_id % 64, ' installments of LKR ', 1000 + doc_id * 37 % 90000, '.50 only.')
       WHEN doc_id % 5 = 2 THEN concat('Pay in ', 2 + doc_id % 64, ' of 1,', 100 + doc_id % 900, '/- by ', {p}, ' or ', {q}, '.')
       WHEN doc_id % 5 = 3 THEN concat('Choose ', {p}, ' and make ', 2 + doc_id % 64, ' payments of rs ', 1000 + doc_id * 37 % 90000, '; ', {q}, ' too.')
       ELSE concat({p}, ' is accepted here.') END,
  concat({a}, ' credit cards ', doc_id % 97, '% off for ', 3 + doc_id % 30, ' months.'), CASE WHEN doc_id % 3 > 0 THEN concat({b}, ' offers 0% interest for ', 6 + doc_id % 9, ' month plans.') END,
  CASE WHEN doc_id % 4 = 0 THEN concat('A ', doc_id % 5, '.5% credit card surcharge applies.') WHEN doc_id % 4 = 1 THEN concat('Convenience fee of Rs. ', 100 + doc_id % 400, '.')
       WHEN doc_id % 4 = 2 THEN concat('Visa payment has a fee of ', 1 + doc_id % 6, '%. Processing surcharge of LKR ', doc_id % 90 + 10) ELSE concat('payment processing fee ', 1 + doc_id % 3, '.25%') END)"""


def _payments(pick) -> str:
    """An expression, the same in both engines, for a document's text with what shops say of paying beside it; ``pick`` takes the k-th of some words."""
    providers, banks = "'Koko', 'MintPay', 'payhere', 'KKO', 'WebXPay', 'Afterpay'", "'HNB', 'combank', 'Sampath Bank', 'Peoples Bank', 'BOC', 'HSBC', 'Seylan', 'Commercial  Bank', 'NDB', 'Amana Bank', 'No Bank'"
    return _PAYMENTS.format(p=pick(providers, "doc_id % 6"), q=pick(providers, "(doc_id * 5 + 2) % 6"), a=pick(banks, "doc_id % 11"), b=pick(banks, "(doc_id * 7 + 3) % 11"))


def _paying(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", F.expr(_payments(lambda words, k: f"element_at(array({words}), CAST({k} AS INT) + 1)")).alias("text"))


_PAYING = f"(SELECT doc_id, {_payments(lambda words, k: f'([{words}])[{k} + 1]')} AS t FROM documents)"


def x7_plans(spark: SparkSession, d: str) -> DataFrame:
    """Instalment plans in the texts of all documents, each with what a shop says of paying beside it."""
    return _paying(spark, d).select("doc_id", F.explode(commerce.plans(F.col("text"))).alias("p")).select("doc_id", "p.*")


def x8_offers(spark: SparkSession, d: str) -> DataFrame:
    """Bank offers in the same texts."""
    return _paying(spark, d).select("doc_id", F.explode(commerce.offers(F.col("text"))).alias("p")).select("doc_id", "p.*")


def x9_surcharges(spark: SparkSession, d: str) -> DataFrame:
    """Fees in the same texts: how many there are, and the sums of those in percent and in rupees."""
    return _paying(spark, d).select("doc_id", F.explode(commerce.surcharges(F.col("text"))).alias("s")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("s.surcharge_pct").alias("percent"), F.sum("s.surcharge_lkr").alias("rupees"))


def x14_page_signals(spark: SparkSession, d: str) -> DataFrame:
    """All that the text of every document tells beside a product, in one pass."""
    b = pages.bundle(F.col("text"), F.lit(100_000.0))
    docs = _paying(spark, d).select("doc_id", b.alias("b"))
    return docs.select("doc_id", F.size("b.plans").alias("plans"), F.size("b.offers").alias("offers"), F.size("b.surcharges").alias("surcharges"), F.col("b.stock.in_stock").alias("in_stock"), F.round(F.array_max(F.transform("b.plans", lambda p: p["markup_pct"])), 2).alias("markup"))


def _ingested(spark: SparkSession, d: str):
    known = titles.normalised(_table(spark, d, "canonical_products").select("raw_title", "brand"), "raw_title", "brand").select("spec.spec_fingerprint")
    fetched = _pages(spark, d).withColumn("price_selector", F.lit(r"re:Rs\. ([\d.]+)")).withColumn("extraction_tier", F.lit(None).cast("string")).withColumn("fetched_at", F.timestamp_seconds(F.col("id")))
    return ingest.ingested(fetched, known)


def e12_ingested(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of every page of a batch: its status, and the fingerprint, price and stock of its product."""
    return _ingested(spark, d).results


def m19_rows(spark: SparkSession, d: str) -> DataFrame:
    """How many rows a batch of pages adds to each table."""
    out = _ingested(spark, d)
    parts = [frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rows_of"), "n") for name, frame in out._asdict().items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def s15_defect_queries(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "canonical_products")
    return p.select("id", F.array_join(web.defect_queries(F.col("brand"), F.col("clean_title"), F.col("model_family")), "|").alias("queries"))


def s3_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors through their text form and back, by their sum, their norm and their last number."""
    v = _table(spark, d, "embeddings").select("vec_id", T.vector(T.vector_text(F.col("embedding"))).alias("v"))
    total = lambda f: F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + f(x.cast("double"))), 4)
    return v.select("vec_id", F.size("v").cast("bigint").alias("dim"), total(lambda x: x).alias("total"), total(lambda x: x * x).alias("norm"), F.round(F.element_at("v", -1).cast("double"), 5).alias("last"))


def s18_form_lines(spark: SparkSession, d: str) -> DataFrame:
    """The addresses that fields of bounded size hold, counted by merchant."""
    p = _table(spark, d, "page_inspections").groupBy("merchant_id", F.floor(F.col("inspection_id") / _FILE).alias("form")).agg(F.array_join(F.array_sort(F.collect_list("url")), "\n # no\n\n ").alias("field"))
    return p.select("merchant_id", F.explode(web.form_urls(F.col("field"))).alias("url")).groupBy("merchant_id").agg(F.countDistinct("url").alias("n"))


_BLANKS = "[\\s\\x{b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
_HASH = f"md5(trim(regexp_replace(coalesce(%s, ''), '{_BLANKS}', ' ', 'g')))"
_BARE = "CASE WHEN {0} = '' THEN {0} ELSE regexp_replace({0}, '/+$', '') END"
_CANON = "regexp_replace(regexp_replace({u}, '[?#].*$', ''), '(.)/+$', '\\1')"
_B, _S = "\\b", "\\s+"
_quoted = lambda words: "|".join(w.replace("|", "\\|").replace(".", "\\.").replace("'", "''") for w in words)



def _normalised_sql() -> str:
    """The normaliser step by step; words end at ASCII boundaries here, which is the same on these titles."""
    lit = lambda p: "'(?i)" + p.replace("'", "''") + "'"
    word = lambda p: lit(rf"\b(?:{p})\b")
    one = lambda p, k=1: f"nullif(regexp_extract(c, {lit(p)}, {k}), '')"
    junk = "|".join(rf"\b{j.replace(' ', _S)}" + ("" if j.startswith("\\") else r"\b") for j in titles.JUNK)
    conditions = " ".join(f"WHEN regexp_matches(raw_title, {word(p)}) THEN '{n}'" for n, p in titles.CONDITIONS)
    subs = " ".join(f"WHEN regexp_matches(c, {word(m.replace(' ', _S))}) THEN '{m.lower()}'" for m in titles.SUB_MODELS)
    pair, single, region = r"(\d+)\s*gb?\s*/\s*(\d+)\s*gb|(\d+)\s*/\s*(\d+)\s*gb", r"\d+\s*gb", r"\b(" + "|".join(titles.REGIONS) + r")\b"
    def part(row) -> str:
        shown = [f"CASE WHEN {one(p)} IS NOT NULL THEN replace('{t}', '{{}}', regexp_replace(lower({one(p)}), '[\\s.]+', '', 'g')) END" for p, t in row]
        return f"coalesce({', '.join(shown)})"

    parts = [part(row) for row in titles.ATTRIBUTES]
    symbol = "[^\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}\\x{200c}\\x{200d}\\s\\x{b}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
    return f"""
WITH a AS (SELECT id, brand, raw_title, CASE {conditions} ELSE 'new' END AS k,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(raw_title, ''), '{titles.EMOJI}', ' ', 'g'), {lit(junk)}, ' ', 'g'), '\\([^)]{{0,60}}\\)', ' ', 'g'), '[★✓✅☆►•·\\-]{{2,}}', ' ', 'g'), '{_BLANKS}', ' ', 'g')) AS c FROM canonical_products),
b AS (SELECT *, coalesce(lower({one(_B + '(' + '|'.join(titles.BRANDS) + ')' + _B)}), trim(lower(brand)), '') AS b, CASE {subs} ELSE '' END AS s, lower(regexp_extract(c, {lit(region)}, 1)) AS r,
  regexp_matches(c, {lit(pair)}) AS paired FROM a),
m AS (SELECT *, CASE WHEN paired THEN TRY_CAST(coalesce({one(pair, 1)}, {one(pair, 3)}) AS INTEGER) END AS ram, TRY_CAST(CASE WHEN paired THEN coalesce({one(pair, 2)}, {one(pair, 4)}) ELSE {one(r"(\d+)\s*gb")} END AS INTEGER) AS sto,
  coalesce(array_to_string(list_sort(list_distinct(list_filter([{", ".join(parts)}], lambda x: x IS NOT NULL))), '_'), '') AS att,
  CASE WHEN b <> '' THEN regexp_replace(c, '(?i)\\b' || regexp_escape(b) || '\\b', '', 'g') ELSE c END AS f1 FROM b),
f AS (SELECT *, CASE WHEN s <> '' THEN regexp_replace(f1, '(?i)\\b' || regexp_escape(s) || '\\b', '', 'g') ELSE f1 END AS f2 FROM m),
g AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(f2, {lit(pair)}, '', 'g'), {lit(single)}, '', 'g'), {lit(region)}, '', 'g'), '{symbol}', ' ', 'g'), '{_BLANKS}', ' ', 'g')) AS f3 FROM f),
h AS (SELECT *, array_to_string(string_split(lower(f3), ' ')[1:5], ' ') AS f4 FROM g),
i AS (SELECT *, CASE WHEN length(f4) < 3 AND att <> '' THEN att ELSE f4 END AS fam FROM h)
SELECT id, b AS brand, trim(fam) AS model_family, s AS sub_model, ram AS ram_gb, sto AS storage_gb, r AS region_code, k AS condition, att AS technical_attributes,
  sha256(trim(b) || '|' || trim(lower(fam)) || '|' || s || '|' || coalesce(CAST(ram AS VARCHAR), '') || '|' || coalesce(CAST(sto AS VARCHAR), '') || '|' || r || CASE WHEN k <> 'new' OR att <> '' THEN '|' || k || '|' || lower(att) ELSE '' END) AS spec_fingerprint
FROM i"""


def _quote(pattern: str) -> str:
    return "'(?is)" + pattern.replace("'", "''") + "'"


_PLANS = f"""
WITH p AS (SELECT doc_id, t, unnest(range(1, CAST(length(t) AS BIGINT) + 1)) AS pos FROM {_PAYING} WHERE regexp_matches(lower(t), '{"|".join(commerce.PROVIDERS)}')),
w AS (SELECT doc_id, n.name, substring(t, greatest(1, pos - {commerce.BEFORE_PLAN}), pos + {commerce.AFTER_PLAN} - greatest(1, pos - {commerce.BEFORE_PLAN})) AS w FROM p JOIN (SELECT unnest({commerce.PROVIDERS}) AS name) n ON lower(substring(t, pos, length(n.name))) = n.name),
m AS (SELECT doc_id, name, k, regexp_extract(w, CASE k WHEN 0 THEN {_quote(commerce.CYCLES[0])} ELSE {_quote(commerce.CYCLES[1])} END, 1) AS n, regexp_extract(w, CASE k WHEN 0 THEN {_quote(commerce.CYCLES[0])} ELSE {_quote(commerce.CYCLES[1])} END, 2) AS v, w FROM w, (SELECT unnest([0, 1]) AS k)),
c AS (SELECT doc_id, name, w, k, TRY_CAST(n AS INTEGER) AS n, TRY_CAST(replace(v, ',', '') AS DOUBLE) AS v FROM m),
f AS (SELECT doc_id, name, w, arg_min(n, k) AS n, arg_min(v, k) AS v FROM c WHERE n BETWEEN {commerce.LEAST_CYCLES} AND {commerce.MOST_CYCLES} AND v > 0 GROUP BY doc_id, name, w)
SELECT DISTINCT doc_id, CASE name WHEN 'kko' THEN 'koko' ELSE name END AS provider, n AS cycles, v AS installment_amount, round(n * v, 2) AS total_payable FROM f"""

_BANK_HITS = " UNION ALL ".join(
    f"SELECT doc_id, t, '{bank.replace(chr(39), chr(39) * 2)}' AS bank, length(regexp_extract(t, {_quote('^(.*?)(?:' + p + ')')}, 1)) AS b, length(regexp_extract(t, {_quote('^.*?(?:' + p + ')')}, 0)) AS e FROM d WHERE regexp_matches(t, {_quote(p)})" for bank, p in commerce.BANKS
)
_OFFERS = f"""
WITH d AS (SELECT * FROM {_PAYING}), h AS ({_BANK_HITS}),
n AS (SELECT *, greatest(coalesce(lag(e) OVER w, 0), b - {commerce.BEFORE_OFFER}) AS l, least(coalesce(lead(b) OVER w, length(t)), e + {commerce.AFTER_OFFER}) AS r FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY b, e, bank)),
s AS (SELECT doc_id, bank, substring(t, l + 1, r - l) AS a, substring(t, e + 1, r - e) AS f FROM n)
SELECT doc_id, bank, TRY_CAST(coalesce(nullif(regexp_extract(f, {_quote(commerce.PERCENT)}, 1), ''), nullif(regexp_extract(a, {_quote(commerce.PERCENT)}, 1), '')) AS DOUBLE) AS discount_pct,
 TRY_CAST(coalesce(nullif(regexp_extract(f, {_quote(commerce.MONTHS)}, 1), ''), nullif(regexp_extract(a, {_quote(commerce.MONTHS)}, 1), '')) AS INTEGER) AS installment_months,
 substring(regexp_replace(a, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g'), 1, {commerce.OFFER_SHOWN}) AS raw_text FROM s WHERE regexp_matches(a, {_quote(commerce.OFFER)})"""

_FEES = f"""
WITH m AS ({" UNION ALL ".join(f"SELECT doc_id, '{method}' AS method, unnest(regexp_extract_all(t, {_quote(p)}, 0)) AS m FROM {_PAYING}" for method, p in commerce.SURCHARGES)}),
v AS (SELECT DISTINCT doc_id, method, contains(m, '%') AS pct, TRY_CAST(replace(regexp_extract(m, '[0-9][0-9,]*(?:[.][0-9]{{1,2}})?'), ',', '') AS DOUBLE) AS v FROM m)
SELECT doc_id, count(*) AS n, sum(v) FILTER (pct) AS percent, sum(v) FILTER (NOT pct) AS rupees FROM v WHERE v IS NOT NULL GROUP BY doc_id"""

SQL = {
    "x7_plans": _PLANS,
    "x20_normalised": _normalised_sql(),
    **{f"x{k}_{way}": _facts_sql(way) for k, way in ((1, "jsonld"), (2, "opengraph"), (3, "microdata"))},
    "x4_remembered": f"SELECT item_id AS id, CASE way WHEN 'jsonld' THEN trim(regexp_replace(raw_title, '[\\s\\x{{a0}}]+', ' ', 'g')) ELSE plain END AS title, price, 'cached' AS tier FROM {_ITEMS}",
    "x6_cascade": f"SELECT CASE way WHEN 'text' THEN 'cached' ELSE way END AS tier, count(*) AS n, CAST(sum(CAST(price_lkr AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS usable FROM {_ITEMS} GROUP BY 1",
    "x15_links": f"""SELECT link, count(*) AS n FROM (
 SELECT unnest([regexp_extract(product_url, '^(https?://[^/?#]*)', 1) || '/product/', regexp_replace(regexp_extract(regexp_replace(product_url, '[?#].*$', ''), '^(.*/)', 1), '([^/:]/)[^/]+/$', '\\1') || 'shop/x', 'https://other.example/p/', 'https://cdn.example/i.png',
   regexp_extract(regexp_replace(product_url, '[?#].*$', ''), '^(.*/)', 1) || 'about?ref=home&amp=']) AS link FROM {_ITEMS}) GROUP BY link""",
    "x16_child_links": f"SELECT r.rank, count(DISTINCT product_url) AS n FROM {_ITEMS}, (SELECT unnest([0, 1, 2]) AS rank) r GROUP BY r.rank",
    "f25_conditions": f"""SELECT id, CASE WHEN regexp_matches(t, '\\b(refurbished|renewed|refurb)\\b') THEN 'refurbished' WHEN regexp_matches(t, '\\b(used|pre-owned|preowned|second\\s*hand|2nd\\s*hand)\\b') THEN 'used'
  WHEN regexp_matches(t, '\\b(open\\s*box|open-box|demo\\s*unit|display\\s*unit)\\b') THEN 'open_box' ELSE 'new' END AS condition,
 CASE {" ".join(f"WHEN regexp_matches(t, '{_B}{m.lower().replace(' ', _S)}{_B}') THEN '{m.lower()}'" for m in titles.SUB_MODELS)} ELSE '' END AS sub_model,
 TRY_CAST(nullif(regexp_extract(t, '([0-9]+)\\s*(gb?)?\\s*/\\s*[0-9]+\\s*gb', 1), '') AS BIGINT) AS ram_gb,
 TRY_CAST(nullif(coalesce(nullif(regexp_extract(t, '[0-9]+\\s*(gb?)?\\s*/\\s*([0-9]+)\\s*gb', 2), ''), regexp_extract(t, '([0-9]+)\\s*gb', 1)), '') AS BIGINT) AS storage_gb,
 regexp_matches(t, '\\b(monitor|display|keyboard|ssd|nvme|drone|headphones?|earbuds?|tws|charger|powerbank|power\\s+bank|mouse|gpu|graphics\\s+card)\\b') AS no_phone
 FROM (SELECT id, lower(raw_title) AS t FROM canonical_products)""",
    "x8_offers": _OFFERS,
    "x9_surcharges": _FEES,
    "f1_canonical_url": f"""WITH u AS (SELECT item_id, {_ADDRESS} AS u FROM scraped_items),
 p AS (SELECT item_id, lower(regexp_extract(u, '^([A-Za-z]+):', 1)) AS s, lower(regexp_extract(u, '://(?:[^@/]*@)?([^:/?#]*)', 1)) AS h, regexp_extract(u, '://(?:[^@/]*@)?[^:/?#]*:([0-9]+)', 1) AS port, regexp_replace(regexp_extract(u, '://[^/]*([^?#]*)', 1), '/+$', '') AS path, regexp_extract(u, '[?]([^#]*)', 1) AS q FROM u),
 k AS (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_|gclid=|ref=)'))) AS ps FROM p)
SELECT item_id, s || '://' || h || CASE WHEN port = '' OR (s = 'http' AND port = '80') OR (s = 'https' AND port = '443') THEN '' ELSE ':' || port END || path || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END AS url FROM k""",
    "f2_canonical_keeping_query": "SELECT item_id, regexp_replace(regexp_replace(regexp_replace(product_url, '#.*$', ''), '/+([?]|$)', '\\1'), '[?]$', '') AS url FROM scraped_items",
    "f4_hosts": """SELECT inspection_id, h AS host, h AS netloc, CASE WHEN len(p) <= 2 THEN h ELSE array_to_string(p[-2:], '.') END AS site, 'https://' || h || '/' AS origin
 FROM (SELECT inspection_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS h, string_split(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '.') AS p FROM page_inspections)""",
    "pred8_product_urls": f"SELECT inspection_id, regexp_matches(url, '{U.PRODUCT_PAGE}') AND NOT regexp_matches(url, '{U.NO_PRODUCT}') AS product, regexp_matches(lower(url), 'product|/p/|/dp/|item|catalogue|-p-|buy') AS hint FROM page_inspections",
    "f6_content_hash": f"SELECT doc_id, {_HASH % 'text'} AS hash FROM documents",
    "f35_titles": f"SELECT item_id AS id, nullif(plain, '') AS title FROM {_ITEMS}",
    "f36_visible_text": "SELECT doc_id, md5(CASE WHEN contains(coalesce(text, ''), '<') THEN regexp_replace(text, '<[^>]+>', ' ', 'g') ELSE coalesce(text, '') END) AS visible FROM documents",
    "f44_escaped": "SELECT id, replace(replace(replace(replace(replace(coalesce(raw_title, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM canonical_products",
    "f11_prices": """SELECT item_id, CASE WHEN p > 0 THEN p END AS price, TRY_CAST(nullif(regexp_replace(price_text, '[^0-9]', '', 'g'), '') AS DOUBLE) AS digits FROM (
 SELECT *, TRY_CAST(nullif(replace(regexp_extract(replace(price_text, ' ', ''), '([0-9,]+(\\.[0-9]+)?)', 1), ',', ''), '') AS DOUBLE) AS p FROM scraped_items)""",
    "f18_confidence": "SELECT inspection_id, coalesce(greatest(0.0, least(1.0, confidence_score * 3 - 1)), 0.0) AS confidence FROM page_inspections",
    "f20_first_truthy": "SELECT item_id, coalesce(nullif(original_price_lkr, 0), price_lkr) AS price FROM scraped_items",
    "f39_available": f"SELECT id, CASE WHEN regexp_matches(lower(t), '{N.NOT_AVAILABLE}') THEN false WHEN regexp_matches(lower(t), '{N.AVAILABLE}') THEN true END AS a FROM (SELECT id, {_STOCK} AS t FROM canonical_products)",
    "c1_preflight": f"""SELECT inspection_id, CASE WHEN regexp_matches(h, '{_quoted(pages.CHALLENGES)}') THEN 'BOT_CHALLENGE_CAPTCHA' WHEN http_status IN (404, 410) THEN 'ERROR_404_PAGE' WHEN http_status >= 500 THEN 'UNKNOWN_JUNK'
  WHEN length(trim(h, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) < 40 THEN 'UNKNOWN_JUNK' WHEN regexp_matches(h, '{_quoted(pages.NOT_FOUND)}') THEN 'ERROR_404_PAGE' END AS page_type,
 CASE WHEN regexp_matches(h, '{_quoted(pages.CHALLENGES)}') THEN 0.97 WHEN http_status IN (404, 410) THEN 0.98 WHEN http_status >= 500 THEN 0.85
  WHEN length(trim(h, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) < 40 THEN 0.9 WHEN regexp_matches(h, '{_quoted(pages.NOT_FOUND)}') THEN 0.85 END AS confidence
 FROM (SELECT inspection_id, http_status, lower(concat_ws(' ', page_title, page_text)) AS h FROM page_inspections)""",
    "u2_ring": f"""SELECT inspection_id, CASE WHEN un > 1 THEN 'duplicate_url' WHEN row_number() OVER (PARTITION BY un = 1, d ORDER BY inspection_id) > 1 THEN 'duplicate_content' ELSE 'new' END AS outcome
 FROM (SELECT inspection_id, {_HASH % 'page_text'} AS d, row_number() OVER (PARTITION BY {_CANON.format(u='url')} ORDER BY inspection_id) AS un FROM page_inspections)""",
    "u1_first_of_url": f"SELECT min(inspection_id) AS inspection_id FROM page_inspections GROUP BY {_CANON.format(u='url')}",
    "u3_evidence": """SELECT product_id, doc_id FROM (SELECT product_id, doc_id, row_number() OVER (PARTITION BY product_id ORDER BY doc_id) AS r FROM (
 SELECT product_id, doc_id, row_number() OVER (PARTITION BY product_id, left(text, 160) ORDER BY doc_id) AS n FROM documents WHERE product_id IS NOT NULL AND text IS NOT NULL AND text <> '') WHERE n = 1) WHERE r <= 5""",
    "s11_robots": f"""WITH l AS (SELECT domain, unnest(string_split(body, chr(10))) AS line, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS n FROM (SELECT domain, {_ROBOTS} AS body FROM merchants)),
 t AS (SELECT domain, n, trim(line, ' ' || chr(13)) AS line FROM l), k AS (SELECT domain, n, lower(trim(regexp_extract(line, '^([^:]*):', 1))) AS k, trim(regexp_extract(line, '^[^:]*:(.*)$', 1)) AS v FROM t WHERE contains(line, ':') AND NOT starts_with(line, '#'))
SELECT domain, coalesce(string_agg(v, ' ' ORDER BY n) FILTER (k = 'sitemap' AND v <> ''), '') AS sitemaps, coalesce(string_agg(v, ' ' ORDER BY n) FILTER (k = 'disallow' AND v <> ''), '') AS disallows FROM k GROUP BY domain""",
    "s12_sitemap_locs": f"""SELECT false AS is_index, count(*) AS n FROM (SELECT DISTINCT m.domain, p.url, p.inspection_id // {_FILE} FROM page_inspections p JOIN merchants m ON m.id = p.merchant_id)
 UNION ALL SELECT true, count(*) FROM (SELECT DISTINCT m.domain, p.inspection_id // {_FILE} FROM merchants m LEFT JOIN page_inspections p ON m.id = p.merchant_id)""",
    "s13_sitemap_products": f"""SELECT DISTINCT regexp_replace(m.domain, '^.*?([^.]+[.](?:(?:com|co|net|org|gov|ac|edu)[.][a-z][a-z]|[^.]+))$', '\\1') AS site, {_CANON.format(u='p.url')} AS url FROM page_inspections p JOIN merchants m ON m.id = p.merchant_id
 WHERE regexp_matches({_CANON.format(u='p.url')}, '{U.PRODUCT_PAGE}') AND NOT regexp_matches({_CANON.format(u='p.url')}, '{U.NO_PRODUCT}') AND contains(regexp_extract(p.url, '://([^/?#]*)', 1), m.domain)""",
    "s13_sitemap_walk": "SELECT DISTINCT p.url AS loc FROM page_inspections p JOIN merchants m ON m.id = p.merchant_id",
    "q7_reached": """WITH RECURSIVE e AS (SELECT a.product_id AS src, b.product_id AS dst FROM listings a JOIN listings b ON a.merchant_id = b.merchant_id AND b.id - a.id BETWEEN 1 AND 40),
 w AS (SELECT arg_min(product_id, id) AS node, 0 AS depth FROM listings GROUP BY merchant_id UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 3)
SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM w GROUP BY node""",
    "f7_fingerprint": """SELECT id, sha256(trim(lower(coalesce(brand, ''))) || '|' || trim(lower(coalesce(model_family, ''))) || '|' || trim(lower(coalesce(sub_model, ''))) || '|' || coalesce(CAST(ram_gb AS VARCHAR), '') || '|'
 || coalesce(CAST(storage_gb AS VARCHAR), '') || '|' || trim(lower(coalesce(region_code, '')))) AS fp FROM canonical_products""",
    "s15_defect_queries": """SELECT id, array_to_string(list_distinct_in_order, '|') AS queries FROM (SELECT id, [a, b] AS list_distinct_in_order FROM (SELECT id,
 trim(regexp_replace(trim(coalesce(brand, '')) || ' ' || trim(coalesce(nullif(model_family, ''), clean_title, '')) || ' hardware problems site:reddit.com', '[\\s\\x{a0}]+', ' ', 'g')) AS a,
 trim(regexp_replace(trim(clean_title) || ' known defects issues teardown', '[\\s\\x{a0}]+', ' ', 'g')) AS b FROM canonical_products))""",
    "s3_vectors": "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dim, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)), 4) AS norm, round(CAST(embedding[-1] AS DOUBLE), 5) AS last FROM embeddings",
    "s18_form_lines": "SELECT merchant_id, count(DISTINCT regexp_replace(url, '^#.*', '')) AS n FROM page_inspections WHERE url IS NOT NULL GROUP BY merchant_id",
}

_NAMES = [*SQL, "x13_stock_votes", "x17_polled", "x14_page_signals", "e12_ingested", "m19_rows"]
QUERIES = {name: globals()[name] for name in _NAMES}
