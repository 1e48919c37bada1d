"""What crawlers bring home, as rows: robots files, sitemaps, search results, markdown and result pages.

Fetching itself is not done here: bodies arrive as columns of a table or a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U

# Where search providers put their results, and the fields of title, address and snippet.
PROVIDERS = {
    "tavily": ("struct<results:array<struct<title:string,url:string,content:string,snippet:string>>>", "results", "title", "url", ("content", "snippet")),
    "brave": ("struct<web:struct<results:array<struct<title:string,url:string,description:string>>>>", "web.results", "title", "url", ("description",)),
    "serpapi": ("struct<organic_results:array<struct<title:string,link:string,snippet:string>>>", "organic_results", "title", "link", ("snippet",)),
}


def robots_rules(files: DataFrame, key: str = "url", body: str = "body") -> DataFrame:
    """(key, sitemaps, disallows): the values of these two keys in each robots file, in its order.

    Blank lines, comments and lines without a colon are skipped; a value keeps its own colons. A null body
    gives empty lists.
    """
    lines = F.transform(F.split(F.coalesce(F.col(body), F.lit("")), r"\R"), lambda x: F.trim(x))
    pairs = F.transform(
        F.filter(lines, lambda x: (x != "") & ~x.startswith("#") & x.contains(":")),
        lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, r"^([^:]*)", 1))).alias("k"), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("v")),
    )
    parsed = files.select(key, pairs.alias("pairs"))
    of = lambda name: F.transform(F.filter("pairs", lambda p: (p["k"] == name) & (p["v"] != "")), lambda p: p["v"])
    return parsed.select(key, of("sitemap").alias("sitemaps"), of("disallow").alias("disallows"))


def sitemap_locations(files: DataFrame, key: str = "url", body: str = "body") -> DataFrame:
    """(key, is_index, pos, loc): every location of a sitemap or an index, in its order."""
    text = F.coalesce(F.col(body), F.lit(""))
    locs = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")
    return files.select(key, F.lower(text).contains("<sitemapindex").alias("is_index"), F.posexplode(locs).alias("pos", "loc"))


def search_results(answers: DataFrame, limit: int, key: str = "query", provider: str = "provider", body: str = "body") -> DataFrame:
    """(key, rank, title, url, snippet, source): at most ``limit`` results of each answer; broken answers give none."""
    parts = []
    for name, (schema, at, title, link, snippets) in PROVIDERS.items():
        mine = answers.where(F.col(provider) == name).select(key, F.from_json(body, schema).alias("j"))
        rows = mine.select(key, F.posexplode(F.slice(F.col(f"j.{at}"), 1, limit)).alias("rank", "r"))
        parts.append(
            rows.select(
                key, "rank", F.coalesce(f"r.{title}", F.lit("")).alias("title"), F.coalesce(f"r.{link}", F.lit("")).alias("url"),
                F.coalesce(*(F.nullif(F.col(f"r.{s}"), F.lit("")) for s in snippets), F.lit("")).alias("snippet"), F.lit(name).alias("source"),
            )
        )
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def defect_queries(brand: Column, name: Column, model: Column) -> Column:
    """The two search phrases for a product's problems; blanks collapsed, repeated and empty ones left out."""
    ident = F.trim(F.coalesce(F.nullif(model, F.lit("")), name, F.lit("")))
    maker, whole = F.trim(F.coalesce(brand, F.lit(""))), F.trim(F.coalesce(name, F.lit("")))
    first = F.when((maker != "") | (ident != ""), F.concat_ws(" ", maker, ident, F.lit("hardware problems site:reddit.com")))
    second = F.when(whole != "", F.concat_ws(" ", whole, F.lit("known defects issues teardown")))
    return F.array_distinct(F.filter(F.transform(F.array(first, second), lambda q: T.collapsed(q)), lambda q: q.isNotNull() & (q != "")))


def result_snippets(html: Column, count: int = 5) -> Column:
    """The texts of the first ``count`` result anchors of a search page, tags stripped, empty ones left out."""
    found = F.regexp_extract_all(html, F.lit(r'(?is)<a[^>]+class="result__snippet"[^>]*>(.*?)</a>'), F.lit(1))
    return F.filter(F.transform(F.slice(found, 1, count), lambda x: F.trim(F.regexp_replace(x, r"<[^>]+>", ""))), lambda x: x != "")


def markdown(fit: Column, raw: Column, plain: Column) -> Column:
    """The first of a page's markdown forms that is not empty."""
    return T.first_text(fit, raw, plain)


def form_urls(text: Column) -> Column:
    """The addresses typed in a form field, each once, in order."""
    return F.array_distinct(T.lines_of(text))


def same_site(url: Column, other: Column) -> Column:
    return U.site_of(url) == U.site_of(other)
