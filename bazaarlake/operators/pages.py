"""Facts from pages: products in their markup, links, stock signals, and the state of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..functions import urls as U
from ..functions.measures import bound
from . import commerce

# Marks of bot checks and phrases of missing pages.
CHALLENGES = [
    "cf-chl", "cf_chl_opt", "/cdn-cgi/challenge-platform", "challenge-platform", "just a moment...", "attention required! | cloudflare", "turnstile", "g-recaptcha", "grecaptcha", "h-captcha", "hcaptcha",
    "px-captcha", "_px3", "datadome", "please verify you are a human", "enable javascript and cookies to continue", "checking your browser before accessing",
]
NOT_FOUND = ["404 not found", "error 404", "page not found", "this page could not be found", "the page you requested could not be found", "http error 404"]
# How pages tell stock.
SOLD_OUT = ["out of stock", "sold out", "out-of-stock", "currently unavailable", "unavailable", "no longer available", "call for availability", "pre-order", "preorder", "notify me when"]
IN_STOCK = ["in stock", "in-stock", "available now", "add to cart", "add to basket", "buy now", "ready to ship"]

# How markup and polled pages are read.
LD_BLOCK = r"(?is)<script[^>]+type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
LOOSE_PRICE = r"(?i)itemprop\s*=\s*[\"']price[\"'][^>]*\bcontent\s*=\s*[\"']([\d,.]+)[\"']"
AVAILABILITY = r"(?i)availability\W+(?:https?://schema\.org/)?(InStock|OutOfStock|SoldOut|PreOrder|BackOrder|Discontinued)"
POLLED_PRICES = (r"(?i)\"price\"\s*:\s*[\"']?([\d,]+(?:\.\d{2})?)[\"']?", r"(?i)(?:Rs\.?|LKR)\s*([\d,]{3,}(?:\.\d{2})?)")
POLLED_OUT, POLLED_IN = r"(?i)\b(out of stock|sold out|unavailable|discontinued|no stock)\b", r"(?i)\b(in stock|add to cart|buy now|available)\b"

FACT = "struct<title:string,brand:string,price:double,in_stock:boolean,tier:string>"


def _any(text: Column, words: list[str]) -> Column:
    quoted = "|".join("".join(c if c.isalnum() or c in " _" else f"\\{c}" for c in w) for w in words)
    return text.rlike(quoted)


def _fact(title: Column, brand: Column, price: Column, stock: Column, tier: str) -> Column:
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    fact = F.struct(blank(title).alias("title"), blank(brand).alias("brand"), price.alias("price"), stock.alias("in_stock"), F.lit(tier).alias("tier"))
    return F.get(F.filter(F.array(fact), lambda f: f["price"].isNotNull()), F.lit(0))  # the price is computed once


def _text(v: Column, at: str) -> Column:
    return F.try_variant_get(v, at, "string")


def _truthy(text: Column) -> Column:
    """A JSON value as text, null where it is empty, zero or false."""
    return F.when(~text.isin("", "0", "0.0", "false"), text)


#: Levels of lists and graphs within each other that are looked through in a JSON-LD block.
LEVELS = 5


def _nodes(block: Column) -> Column:
    """The objects of a JSON-LD block: itself, the elements of lists and those of @graph, however they lie in each other (``LEVELS`` deep)."""
    listed = lambda v, at: F.coalesce(F.try_variant_get(v, at, "array<variant>"), F.array().cast("array<variant>"))
    one = lambda v: F.filter(F.array(F.try_variant_get(v, "$['@graph']", "variant")), lambda g: F.coalesce(F.schema_of_variant(g).startswith("OBJECT"), F.lit(False)))
    inner = lambda v: F.concat(listed(v, "$"), listed(v, "$['@graph']"), one(v))

    def below(level: Column, left: int) -> Column:
        if not left:
            return level
        return F.concat(level, bound(F.flatten(F.transform(level, inner)), lambda deeper: F.when(F.size(deeper) > 0, below(deeper, left - 1)).otherwise(deeper)))

    whole = F.filter(F.array(F.try_parse_json(F.trim(block))), lambda v: v.isNotNull())
    return bound(whole, lambda first: below(first, LEVELS))


def jsonld(html: Column) -> Column:
    """The first product with a price in the JSON-LD blocks of a page; null if there is none.

    Blocks that are no JSON are skipped. The price is the first offer's price or lowPrice; a brand may be an
    object with a name.
    """
    blocks = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(LD_BLOCK), F.lit(1))
    nodes = F.flatten(F.transform(blocks, _nodes))

    def is_product(v: Column) -> Column:
        kinds = F.coalesce(F.try_variant_get(v, "$['@type']", "array<string>"), F.array(_text(v, "$['@type']")))
        return F.exists(kinds, lambda k: F.lower(k) == "product")

    def fact(v: Column) -> Column:
        offer = lambda name: F.coalesce(_text(v, f"$.offers[0].{name}"), _text(v, f"$.offers.{name}"))
        price = N.price(F.coalesce(_truthy(offer("price")), _truthy(offer("lowPrice"))))
        return _fact(_text(v, "$.name"), F.coalesce(_text(v, "$.brand.name"), _text(v, "$.brand")), price, N.available(offer("availability")), "jsonld")

    found = F.transform(F.filter(nodes, lambda v: F.coalesce(is_product(v), F.lit(False))), fact)
    return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))


def meta(html: Column, *keys: str) -> Column:
    """The content of the first meta element that carries one of the keys, whatever the order of its attributes."""
    out = []
    for key in keys:
        quoted = "".join(c if c.isalnum() else f"\\{c}" for c in key)
        name = rf"(?:property|name|itemprop)\s*=\s*[\"']{quoted}[\"']"
        for pattern in (rf"(?i)<meta[^>]+{name}[^>]*\bcontent\s*=\s*[\"']([^\"']+)[\"']", rf"(?i)<meta[^>]+\bcontent\s*=\s*[\"']([^\"']+)[\"'][^>]*{name}"):
            out.append(F.nullif(F.regexp_extract(html, pattern, 1), F.lit("")))
    return F.trim(F.coalesce(*out))


def opengraph(html: Column) -> Column:
    price = N.price(meta(html, "product:price:amount", "og:price:amount", "og:product:price:amount"))
    return _fact(meta(html, "og:title"), F.lit(None).cast("string"), price, N.available(meta(html, "product:availability", "og:availability")), "opengraph")


def microdata(html: Column) -> Column:
    loose = F.nullif(F.regexp_extract(html, LOOSE_PRICE, 1), F.lit(""))
    price = F.coalesce(N.price(meta(html, "price")), N.price(loose))
    return _fact(meta(html, "name"), F.lit(None).cast("string"), price, N.available(meta(html, "availability")), "microdata")


def remembered(html: Column, selector: Column, tier: Column, facts: tuple[Column, Column, Column] | None = None) -> Column:
    """The fact by a site's remembered way: jsonld, og, microdata or re:<pattern> with the price in its first group.

    A site without way gives null, as does a pattern without match. Facts carry the tier 'cached' and fall
    back on the page's title. ``facts`` are those of the markup where they are computed already.
    """
    way = F.trim(F.coalesce(selector, F.lit("")))
    kind = F.trim(F.coalesce(tier, F.lit("")))
    ld, og, data = facts or (jsonld(html), opengraph(html), microdata(html))
    pattern = F.concat(F.lit("(?is)"), F.substring(way, F.lit(4), F.length(way)))
    matched = N.price(F.when(way.startswith("re:") & html.isNotNull(), F.call_function("regexp_extract", html, pattern, F.lit(1))))
    found = (
        F.when((way == "jsonld") | (kind == "jsonld"), ld)
        .when((way == "og") | (kind == "opengraph"), og)
        .when((way == "microdata") | (kind == "microdata"), data)
        .when(way.startswith("re:"), _fact(F.lit(None).cast("string"), F.lit(None).cast("string"), matched, F.lit(None).cast("boolean"), "cached"))
    )
    title = lambda f: F.coalesce(f["title"], T.title(html))
    return bound(found, lambda f: F.when(f.isNotNull(), F.struct(title(f).alias("title"), f["brand"].alias("brand"), f["price"].alias("price"), f["in_stock"].alias("in_stock"), F.lit("cached").alias("tier"))))


def accepted_pattern(pattern_price: Column, told_price: Column) -> Column:
    """Whether a pattern's price is near enough a told one, 1 or two percent, for the pattern to be remembered."""
    return F.coalesce(F.abs(pattern_price - told_price) <= F.greatest(F.lit(1.0), told_price * 0.02), F.lit(False))


def cascade(pages: DataFrame, html: str = "html", selector: str = "price_selector", tier: str = "extraction_tier", told: str | None = None) -> DataFrame:
    """``pages`` with ``fact`` and ``usable``: JSON-LD, else OpenGraph, microdata, the site's way, what a model told.

    The first that has a price wins, even without a title, which is then the page's. Stock is that of two
    agreeing signals, else the fact's, else in stock. A page without price has a fact of tier 'none'.
    """
    page = F.col(html)
    # Each way of markup is read once; later steps refer to what it gave.
    read = pages.withColumns({"__bl_ld": jsonld(page), "__bl_og": opengraph(page), "__bl_md": microdata(page)})
    facts = (F.col("__bl_ld"), F.col("__bl_og"), F.col("__bl_md"))
    tiers = [*facts, remembered(page, F.col(selector), F.col(tier), facts)]
    if told:
        tiers.append(F.col(told))
    none = F.struct(F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("brand"), F.lit(None).cast("double").alias("price"), F.lit(None).cast("boolean").alias("in_stock"), F.lit("none").alias("tier"))
    first = read.withColumns({"__bl_fact": F.coalesce(*tiers, none), "__bl_vote": vote(button_signal(page), schema_signal(page), text_signal(page))["in_stock"]})
    f = F.col("__bl_fact")
    full = F.struct(
        F.coalesce(f["title"], T.title(page)).alias("title"), f["brand"].alias("brand"), f["price"].alias("price"), F.coalesce("__bl_vote", f["in_stock"], F.lit(True)).alias("in_stock"), f["tier"].alias("tier")
    )
    out = first.withColumn("fact", full).drop("__bl_ld", "__bl_og", "__bl_md", "__bl_fact", "__bl_vote")
    return out.withColumn("usable", F.coalesce(F.col("fact.price") > 0, F.lit(False)) & F.col("fact.title").isNotNull())


def schema_signal(html: Column) -> Column:
    """Stock by the first schema.org availability; only InStock is in stock here."""
    token = F.lower(F.regexp_extract(html, AVAILABILITY, 1))
    return F.when(token != "", token == "instock")


def text_signal(html: Column) -> Column:
    """Stock by words; sold-out words win over others."""
    low = F.lower(html)
    return F.when(_any(low, SOLD_OUT), F.lit(False)).when(_any(low, IN_STOCK), F.lit(True))


def button_signal(html: Column) -> Column:
    """Stock by the buy button: one that is disabled or marked sold out, or one that can be pressed."""
    cart = r"add[\s_-]?to[\s_-]?cart"
    shut = html.rlike(rf"(?i){cart}[^>]*\bdisabled\b|\bdisabled\b[^>]*{cart}|(?:btn|button)[^>]*(?:out-?of-?stock|sold-?out|unavailable)")
    return F.when(html.contains("<"), F.when(shut, F.lit(False)).when(html.rlike(rf"(?i){cart}|buy[\s_-]?now"), F.lit(True)))


def vote(button: Column, schema: Column, text: Column) -> Column:
    """struct(in_stock, confidence, agreed): what at least two of three signals say; null if no two agree."""
    signals = (button, schema, text)
    yes = sum((F.coalesce(s.cast("int"), F.lit(0)) for s in signals), F.lit(0))
    no = sum((F.coalesce((~s).cast("int"), F.lit(0)) for s in signals), F.lit(0))
    said = F.when(yes >= 2, F.lit(True)).when(no >= 2, F.lit(False))
    return F.struct(said.alias("in_stock"), F.when(yes >= 2, yes).when(no >= 2, no).otherwise(0).alias("confidence"), said.isNotNull().alias("agreed"))


def polled_price(html: Column) -> Column:
    """The price of a page polled again: the first JSON price, else the first after Rs or LKR."""
    first, second = (F.regexp_extract(html, p, 1) for p in POLLED_PRICES)
    value = lambda s: F.nullif(F.replace(s, F.lit(","), F.lit("")), F.lit("")).try_cast("double")
    return F.coalesce(*(F.when(value(s) > 0, value(s)) for s in (first, second)))


def polled_stock(html: Column, status: Column, before: Column) -> Column:
    """The stock of a page polled again; here in-stock words win, and a missing page is sold out."""
    out, there = html.rlike(POLLED_OUT), html.rlike(POLLED_IN)
    return F.when(status == 404, F.lit(False)).when((status == 200) & out & ~there, F.lit(False)).when((status == 200) & there, F.lit(True)).otherwise(before)


def changed(price: Column, before: Column, stock: Column, stock_before: Column) -> Column:
    """Whether a poll brings news: a known price more than a cent off, or other stock."""
    return F.coalesce(F.abs(price - before) > 0.01, F.lit(False)) | ~stock.eqNullSafe(stock_before)


def preflight(html: Column, status: Column, least: int = 500) -> Column:
    """struct(page_type, is_valid, confidence, rule): a page's state where cheap rules tell it, else null."""
    text = F.coalesce(html, F.lit(""))
    low = F.lower(text)
    is_ = lambda kind, sure, rule: F.struct(F.lit(kind).alias("page_type"), F.lit(False).alias("is_valid"), F.lit(sure).alias("confidence"), F.lit(rule).alias("rule"))
    return (
        F.when(_any(low, CHALLENGES), is_("BOT_CHALLENGE_CAPTCHA", 0.97, "challenge"))
        .when(status.isin(404, 410), is_("ERROR_404_PAGE", 0.98, "status"))
        .when(status >= 500, is_("UNKNOWN_JUNK", 0.85, "server"))
        .when(F.length(T.collapsed(text)) < least, F.when(F.length(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")) < least, is_("UNKNOWN_JUNK", 0.9, "short")))
        .when(_any(low, NOT_FOUND), is_("ERROR_404_PAGE", 0.85, "phrase"))
    )


def inspected(pages: DataFrame, told: str | None = None, html: str = "html", status: str = "status") -> DataFrame:
    """``pages`` with ``verdict`` and ``by_rules``: the rules' verdict, else a model's, else unknown."""
    unknown = F.struct(F.lit("UNKNOWN_JUNK").alias("page_type"), F.lit(False).alias("is_valid"), F.lit(0.0).alias("confidence"), F.lit("failed").alias("rule"))
    ruled = pages.withColumn("__bl_ruled", preflight(F.col(html), F.col(status)))
    return ruled.withColumn("verdict", F.coalesce("__bl_ruled", *([F.col(told)] if told else []), unknown)).withColumn("by_rules", F.col("__bl_ruled").isNotNull()).drop("__bl_ruled")


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, pos, link): every reference of a page as an absolute http address, in order; repeated ones repeat."""
    refs = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"(?i)href\s*=\s*[\"']([^\"'#\s]+)[\"']"), F.lit(1))
    found = pages.select(F.col(url).alias("url"), F.posexplode(refs).alias("pos", "href"))
    full = found.select("url", "pos", U.resolved(F.col("url"), F.col("href")).alias("link"))
    return full.where(F.col("link").rlike(r"^https?://"))


def all_links(pages: DataFrame, hrefs: str = "hrefs", url: str = "url", html: str = "html") -> DataFrame:
    """(url, pos, link): the references that a browser found (an array), then those in the HTML; repeated ones repeat."""
    told = pages.select(F.col(url).alias("url"), F.posexplode(F.coalesce(F.col(hrefs), F.array())).alias("pos", "link")).where("link is not null and link <> ''")
    return told.withColumn("pos", F.col("pos").cast("bigint")).unionByName(links(pages, url, html).select("url", (F.col("pos") + (1 << 30)).cast("bigint").alias("pos"), "link"))


def _children(canon: DataFrame, mine: Column, most: int) -> DataFrame:
    """(url, rank, link) of the links (url, pos, link) that are of the page's site, each once, product-like first."""
    once = canon.where(mine & (F.col("link") != U.canonical(F.col("url")))).groupBy("url", "link").agg(F.min("pos").alias("pos"))
    # A group is one page's links.
    ordered = once.groupBy("url").agg(F.slice(F.array_sort(F.collect_list(F.struct((~U.hints_at_product(F.col("link"))).alias("other"), "pos", "link"))), 1, most).alias("l"))
    return ordered.select("url", F.posexplode("l").alias("rank", "l")).select("url", F.col("rank").cast("bigint").alias("rank"), F.col("l.link").alias("link"))


def child_links(pages: DataFrame, most: int = 20, url: str = "url", html: str = "html") -> DataFrame:
    """(url, rank, link): links to other pages of the same host, each once in canonical form, product-like first.

    Each page keeps its first ``most`` links.
    """
    canon = links(pages, url, html).select("url", "pos", U.canonical(F.col("link")).alias("link"))
    return _children(canon, U.host(F.col("link")) == U.host(F.col("url")), most)


def internal_links(pages: DataFrame, most: int = 20, hrefs: str = "hrefs", url: str = "url") -> DataFrame:
    """(url, rank, link): as ``child_links``, of references as a browser told them (an array), within the registered domain.

    References are not resolved here, so relative ones have no host and are left out.
    """
    told = pages.select(F.col(url).alias("url"), F.posexplode(F.coalesce(F.col(hrefs), F.array())).alias("pos", "href")).where("href <> ''")
    canon = told.select("url", "pos", U.canonical(F.col("href")).alias("link"))
    return _children(canon, (U.host(F.col("link")) != "") & (U.site_of(F.col("link")) == U.site_of(F.col("url"))), most)


def bundle(html: Column, cash: Column) -> Column:
    """struct(plans, stock, offers, surcharges): all that a page's text tells beside its product; null is an empty page.

    Stock is the vote of the buy button and the words, without markup; plans carry what they cost beyond ``cash``.
    """
    raw = F.coalesce(html, F.lit(""))
    text = T.visible(raw)
    none = F.lit(None).cast("boolean")
    return F.struct(
        commerce.with_markup(commerce.plans(text), cash).alias("plans"), vote(button_signal(raw), none, text_signal(raw)).alias("stock"), commerce.offers(text).alias("offers"), commerce.surcharges(text).alias("surcharges")
    )
