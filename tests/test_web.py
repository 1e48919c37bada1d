import json
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from bazaarlake.functions import numbers as N
from bazaarlake.functions import text as T
from bazaarlake.functions import urls as U
from bazaarlake.operators import commerce, dedup, folds, graph, neighbours, pages
from bazaarlake.sources import web


def one(spark, value, *columns, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(*columns).first()


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://User:pw@Shop.Example:443/A/b//?utm_source=x&b=2&a=1&gclid=7#top", "https://shop.example/A/b?a=1&b=2"), ("http://x.example:8080", "http://x.example:8080/"), ("http://x.example:80/", "http://x.example/"),
        ("https://x.example/?q=a+b&e=&t=%7E*", "https://x.example/?e=&q=a+b&t=~%2A"), ("//x.example/p/", "https://x.example/p"), ("", "https:///"), (None, None),
    ],
)
def test_canonical(spark, url, want):
    assert one(spark, url, U.canonical(F.col("v")))[0] == want


def test_hosts_and_sites(spark):
    v = F.col("v")
    assert tuple(one(spark, "https://u@WWW.Tudo.com.lk:8443/x", U.host(v), U.netloc(v), U.site_of(v), U.port(v))) == ("www.tudo.com.lk", "u@www.tudo.com.lk:8443", "tudo.com.lk", 8443)
    assert tuple(one(spark, "https://a.b.tudo.lk/x", U.site_of(v), U.netloc(F.lit("nothing")))) == ("tudo.lk", "unknown")
    assert one(spark, "Tudo.lk/x", U.origin(v))[0] == "https://tudo.lk/"


@pytest.mark.parametrize(("url", "want"), [("https://x/product/1", True), ("https://x/a-p-1", True), ("https://x/?sku=3", True), ("https://x/cart/product/1", False), ("https://x/product/a.css", False), ("https://x/about", False)])
def test_product_addresses(spark, url, want):
    assert one(spark, url, U.is_product(F.col("v")))[0] is want


BASES = ["https://x.example", "https://x.example/", "https://x.example/a", "https://x.example/a/", "https://x.example/a/b?q=1#f", "http://x.example:81/a/b/c"]
HREFS = ["/r", "n", "n/m?x=1", "../u", "../../u", "./d", "//cdn.example/i", "https://o.example/z", "?q=2", "mailto:a@b", "a/../b", "..", "."]


def test_references_resolve_as_by_the_standard(spark):
    df = spark.createDataFrame([(b, h) for b in BASES for h in HREFS], "b string, h string")
    for r in df.select("b", "h", U.resolved(F.col("b"), F.col("h")).alias("u")).collect():
        assert r.u == urljoin(r.b, r.h), (r.b, r.h)


def test_texts(spark):
    v = F.col("v")
    html = "<html><title> A  <b>b</b>\n</title><script>x</script><h1>no</h1>t</html>"
    assert one(spark, html, T.title(v))[0] == "A b"
    assert one(spark, "<title></title><h1>h</h1>", T.title(v))[0] is None
    assert one(spark, "<h1> h </h1>", T.title(v))[0] == "h"
    assert "x" not in one(spark, html, T.skeleton(v, 10))[0]
    assert one(spark, None, T.content_hash(v))[0] == one(spark, "  \n", T.content_hash(v))[0]
    assert one(spark, None, T.escaped(v))[0] == ""
    assert one(spark, "ﬁ ①Ａ", T.nfkc(v))[0] == "fi 1A"
    assert list(one(spark, " a \n\n#c\r\nb", T.lines_of(v))[0]) == ["a", "b"]
    assert one(spark, "abc", T.body_within(v, 2))[0] == ""
    assert list(one(spark, "[1.5,2]", T.vector(v))[0]) == [1.5, 2.0]


def test_numbers(spark):
    v = F.col("v")
    assert [one(spark, t, N.price(v))[0] for t in ("Rs. 45,900", "1 299.00", "0", "free", None)] == [45900.0, 1299.0, None, None, None]
    assert [one(spark, t, N.number(v))[0] for t in ("27,000.00", ".", "1.2.3", "")] == [27000.0, None, None, None]
    assert [one(spark, t, N.confidence(v))[0] for t in ("0.4", "7", "-1", "nan", "x", None)] == [0.4, 1.0, 0.0, 0.0, 0.0, 0.0]
    assert [one(spark, t, N.available(v))[0] for t in ("https://schema.org/InStock", "PreOrder", "BackOrder", "SoldOut", "?", None)] == [True, True, False, False, None, None]


def page(ld, extra=""):
    return f'<html><head><title>T</title><script type="application/ld+json">{ld}</script>{extra}</head></html>'


def test_jsonld_finds_the_first_priced_product(spark):
    product = {"@type": ["Thing", "Product"], "name": "P", "brand": "B", "offers": [{"lowPrice": "1,500"}, {"price": 2}]}
    cases = [
        (page(json.dumps(product)), ("P", "B", 1500.0, None)), (page("nonsense"), None), (page(json.dumps({"@type": "Product", "name": "x"})), None), ("", None), (None, None),
        (page(json.dumps([{"@type": "Org"}, {"@graph": [{"@type": "product", "name": " Q ", "brand": {"name": "C"}, "offers": {"price": 0, "lowPrice": 9, "availability": "https://schema.org/OutOfStock"}}]}])), ("Q", "C", 9.0, False)),
    ]
    for html, want in cases:
        f = one(spark, html, pages.jsonld(F.col("v")).alias("f")).f
        assert (None if f is None else (f.title, f.brand, f.price, f.in_stock)) == want


def test_cascade_order_and_defaults(spark):
    og = '<meta property="og:title" content="O"><meta property="og:price:amount" content="7">'
    rows = [(1, page('{"@type":"Product","offers":{"price":5}}', og), None, None), (2, page("x", og), None, None), (3, "<title>L</title>Cost: 88 only", r"re:Cost: (\d+)", None), (4, "<p>none</p>", None, None), (5, None, None, None)]
    df = spark.createDataFrame(rows, "id int, html string, price_selector string, extraction_tier string")
    got = {r.id: (r.fact.tier, r.fact.title, r.fact.price, r.fact.in_stock, r.usable) for r in pages.cascade(df).collect()}
    assert got == {1: ("jsonld", "T", 5.0, True, True), 2: ("opengraph", "O", 7.0, True, True), 3: ("cached", "L", 88.0, True, True), 4: ("none", None, None, True, False), 5: ("none", None, None, True, False)}


def test_stock_signals_and_votes(spark):
    v = F.col("v")
    assert one(spark, '<button disabled class="add-to-cart">', pages.button_signal(v))[0] is False
    assert one(spark, "<a>Buy Now</a>", pages.button_signal(v))[0] is True
    assert one(spark, "buy now", pages.button_signal(v))[0] is None
    assert one(spark, '"availability":"https://schema.org/PreOrder"', pages.schema_signal(v))[0] is False
    assert one(spark, "sold out, add to cart", pages.text_signal(v))[0] is False
    vote = lambda *s: tuple(one(spark, "", pages.vote(*(F.lit(x).cast("boolean") for x in s)).alias("x")).x)
    assert [vote(True, None, True), vote(False, None, False), vote(None, None, None), vote(False, True, True), vote(True, False, None)] == [(True, 2, True), (False, 2, True), (None, 0, False), (True, 2, True), (None, 0, False)]


def test_states_of_pages(spark):
    long = "x" * 600
    rows = [(1, "Just a moment... " + long, 403), (2, long, 404), (3, long, 502), (4, "short", 200), (5, "Page not found " + long, 200), (6, long, 200), (7, None, None)]
    df = pages.inspected(spark.createDataFrame(rows, "id int, html string, status int"))
    assert {r.id: (r.verdict.page_type, r.by_rules) for r in df.collect()} == {
        1: ("BOT_CHALLENGE_CAPTCHA", True), 2: ("ERROR_404_PAGE", True), 3: ("UNKNOWN_JUNK", True), 4: ("UNKNOWN_JUNK", True), 5: ("ERROR_404_PAGE", True), 6: ("UNKNOWN_JUNK", False), 7: ("UNKNOWN_JUNK", True)
    }


def test_child_links_prefer_products(spark):
    html = "".join(f'<a href="{h}">x</a>' for h in ["/about", "/product/2", "/product/1", "/product/2#a", "https://other.example/product/9", "/", "/help"])
    df = spark.createDataFrame([("https://s.example/", html), ("https://e.example/", None)], "url string, html string")
    got = [r.link for r in pages.child_links(df, 3).orderBy("rank").collect()]
    assert got == ["https://s.example/product/2", "https://s.example/product/1", "https://s.example/about"]


def test_polled(spark):
    v = F.col("v")
    assert [one(spark, t, pages.polled_price(v))[0] for t in ('{"price": "385,000.00"}', "LKR 410,000", '{"price":"0"} Rs. 1,200', "x")] == [385000.0, 410000.0, 1200.0, None]
    stock = lambda t, s: one(spark, t, pages.polled_stock(v, F.lit(s), F.lit(None).cast("boolean")))[0]
    assert [stock("sold out", 200), stock("sold out but in stock", 200), stock("x", 404), stock("x", 500)] == [False, True, False, None]


def test_robots_sitemaps_and_results(spark):
    body = "User-agent: *\n# x\nSitemap: https://a/s.xml\nDISALLOW:/cart\nDisallow:\nno colon"
    r = web.robots_rules(spark.createDataFrame([("a", body), ("b", None)], "url string, body string")).orderBy("url").collect()
    assert (r[0].sitemaps, r[0].disallows, r[1].sitemaps) == (["https://a/s.xml"], ["/cart"], [])
    maps = spark.createDataFrame([("i", "<sitemapindex><loc> l </loc><loc></loc></sitemapindex>"), ("l", "<urlset><loc>p1</loc><LOC>p2</LOC></urlset>"), ("z", "<urlset><loc>lost</loc></urlset>")], "url string, body string")
    leaves = graph.sitemap_leaves(web.sitemap_locations(maps), spark.createDataFrame([("i",), ("l",)], "url string"))
    assert {x.loc for x in leaves.collect()} == {"p1", "p2"}
    answers = spark.createDataFrame([("q", "tavily", '{"results":[{"title":"t","url":"u","content":""},{"snippet":"s"}]}'), ("q", "brave", '{"web":{"results":[{"description":"d"}]}}'), ("q", "serpapi", "broken")], "query string, provider string, body string")
    assert {(x.rank, x.title, x.snippet, x.source) for x in web.search_results(answers, 1).collect()} == {(0, "t", "", "tavily"), (0, "", "d", "brave")}
    assert one(spark, "Pixel", web.defect_queries(F.lit(" G "), F.col("v"), F.lit("")))[0] == ["G Pixel hardware problems site:reddit.com", "Pixel known defects issues teardown"]
    assert one(spark, '<a class="result__snippet" href="x">a <b>b</b></a>', web.result_snippets(F.col("v")))[0] == ["a b"]


def test_instalments_offers_and_fees(spark):
    said = lambda text: [p.asDict() for p in one(spark, text, commerce.plans(F.col("v")).alias("p")).p]
    assert said("Pay 12 x Rs. 10,000 with Koko or 3 x USB cables") == [{"provider": "koko", "cycles": 12, "installment_amount": 10000.0, "total_payable": 120000.0}]
    assert said("3 x 9,900") == said(None) == said("koko " * 3000) == []
    assert [(p["provider"], p["cycles"]) for p in said("😍 KKO: 4 of Rs 500. " + "x" * 300 + " webxpay pay in 61 of 5, pay in 6 of 700/-")] == [("koko", 4)]
    got = one(spark, "Mintpay: 3 installments of 9,900", commerce.with_markup(commerce.plans(F.col("v")), F.lit(27000.0)).alias("p")).p
    assert [(p.provider, p.cycles, p.markup_pct) for p in got] == [("mintpay", 3, 10.0)]
    offers = one(spark, "👍🏽 HNB cards 15% off for 12 months. Sampath Bank credit card 10% discount", commerce.offers(F.col("v")).alias("o")).o
    assert [(o.bank, o.discount_pct, o.installment_months) for o in offers] == [("HNB", 15.0, 12), ("Sampath Bank", 10.0, 12)]  # silent after its name, so what stands before counts
    assert offers[1].raw_text == "cards 15% off for 12 months. Sampath Bank credit card 10% discount" and one(spark, None, commerce.offers(F.col("v")))[0] == []
    fees = one(spark, "3% credit card surcharge. Convenience fee of Rs. 250. convenience fee of Rs 250. processing fee 2.5%", commerce.surcharges(F.col("v")).alias("s")).s
    assert [(f.method, f.surcharge_pct, f.surcharge_lkr) for f in fees] == [("credit_card", 3.0, None), ("convenience_fee", None, 250.0), ("processing_fee", 2.5, None)]
    assert one(spark, None, commerce.surcharges(F.col("v")))[0] == []


def test_python_sees_only_what_needs_it(spark):
    """Rows that expressions can do come to Python as nulls."""
    import pandas as pd
    from pyspark.sql.types import StringType

    seen = spark.sparkContext.accumulator(0)

    def count(*columns: pd.Series) -> pd.Series:
        seen.add(int(columns[0].notna().sum()))
        return columns[-1]

    df = spark.createDataFrame([("plain", "https://a.example/x", "/p/1")] * 50 + [("ｗide", "https://a.example/x/", "../y")] * 3, "t string, base string, href string")
    for module, name, column in ((T, "_nfkc", lambda: T.nfkc(F.col("t"))), (U, "_join", lambda: U.resolved(F.col("base"), F.col("href")))):
        real, seen.value = getattr(module, name), 0
        setattr(module, name, F.pandas_udf(count, StringType()))
        try:
            df.select(column().alias("x")).collect()
        finally:
            setattr(module, name, real)
        assert seen.value == 3
    assert {r.x for r in df.select(T.nfkc(F.col("t")).alias("x")).collect()} == {"plain", "wide"}


def test_rings_and_evidence(spark):
    rows = [(1, "a", "x"), (2, "a", "y"), (3, "b", "x"), (4, "c", "y"), (5, "d", ""), (6, "e", ""), (7, None, "q")]
    df = spark.createDataFrame(rows, "id int, u string, t string")
    got = {r.id: r.outcome for r in dedup.ring(df, F.col("u"), F.md5("t"), ["id"]).collect()}
    assert got == {1: "new", 2: "duplicate_url", 3: "duplicate_content", 4: "new", 5: "new", 6: "duplicate_content", 7: "new"}
    assert sorted(r.id for r in dedup.once(df, F.col("u"), ["id"]).collect()) == [1, 3, 4, 5, 6]
    kept = dedup.evidence(spark.createDataFrame([("p", k, ("s" * 160) + str(k // 2)) for k in range(20)] + [("p", 30, "t")], "g string, k int, t string"), ["g"], "t", ["k"])
    assert sorted(r.k for r in kept.collect()) == [0, 30]


def test_folds_with_nulls_ties_and_nothing(spark):
    schema = "k string, t int, seq int, a int, b string, x string"
    log = spark.createDataFrame([("p", 1, 1, 1, "q", None), ("p", 2, 1, None, None, None), ("p", 2, 1, None, None, None), (None, 1, 1, 5, "z", None)], schema)
    got = {r.k: (r.a, r.b, r.x, r.n) for r in folds.upserted(log, ["k"], ["t", "seq"], last_wins=["a"], known_wins=["b"], first_wins=["x"], counts={"n": F.col("a").isNotNull()}).collect()}
    assert got == {"p": (None, "q", None, 1), None: (5, "z", None, 1)}
    assert folds.upserted(log.limit(0), ["k"], ["t"], last_wins=["a"]).count() == 0
    merged = folds.merged_json(spark.createDataFrame([("p", 1, '{"a":1,"b":{"c":[1]}}'), ("p", 2, '{"a":"x"}'), ("q", 1, None), ("r", 1, "broken")], "k string, t int, j string"), ["k"], ["t"], "j")
    assert {r.k: json.loads(r.j) for r in merged.collect()} == {"p": {"a": "x", "b": {"c": [1]}}}


def test_walks(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "y"), ("a", None)], "src string, dst string")
    seeds = spark.createDataFrame([("a",), (None,), ("a",)], "node string")
    assert {(r.node, r.depth) for r in graph.reached(edges, seeds, 3).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert [r.node for r in graph.reached(edges, seeds, 9, most=2).orderBy("depth").collect()] == ["a", "b"]
    assert [r.node for r in graph.spider(edges, seeds, 3, 9, F.col("node") > "b").collect()] == ["c", "d"]
    assert graph.reached(edges, seeds.limit(0), 3).count() == 0


def test_neighbours_equal_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.integers(-3, 4, (60, 4)))] + [(100, None), (101, []), (102, [0.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    good = {i: np.array(v) for i, v in rows if v and any(v)}
    cos = lambda a, b: 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    got = {}
    for r in neighbours.nearest(df, df.where("vec_id % 7 = 0 or vec_id > 99"), 5, block=6).collect():
        got.setdefault(r.query, []).append((r.rank, round(r.distance, 9)))
    want = {q: [(k + 1, round(d, 9)) for k, d in enumerate(sorted(cos(good[q], good[i]) for i in good if i != q)[:5])] for q in good if q % 7 == 0}
    assert {q: sorted(v) for q, v in got.items()} == want
    assert neighbours.nearest(df, df.limit(0), 5).count() == 0
    assert neighbours.nearest_to(df, [1.0, 0.0, 0.0, 0.0], 3).count() == 3


def test_votes_and_polls_of_all_pages(spark, data):
    """Against plain Python, page by page, whatever their markup."""
    import re

    from bazaarlake.plans import web as plans

    find = lambda p, s: re.search(p, s, re.I | re.A)
    rows = plans._pages(spark, data).collect()
    votes = {r.id: (r.in_stock, r.confidence, r.agreed) for r in plans.QUERIES["x13_stock_votes"](spark, data).collect()}
    polls = {r.id: (r.price, r.stock, r.news) for r in plans.QUERIES["x17_polled"](spark, data).collect()}
    assert {r.way for r in rows} == set(plans._WAYS) and len(rows) == len(votes) == len(polls)
    cart = r"add[\s_-]?to[\s_-]?cart"
    with_schema = 0
    for r in rows:
        low = r.html.lower()
        shut = find(rf"{cart}[^>]*\bdisabled\b|\bdisabled\b[^>]*{cart}|(?:btn|button)[^>]*(?:out-?of-?stock|sold-?out|unavailable)", r.html)
        button = False if shut else True if find(rf"{cart}|buy[\s_-]?now", r.html) else None
        schema = find(r"availability\W+(?:https?://schema\.org/)?(InStock|OutOfStock|SoldOut|PreOrder|BackOrder|Discontinued)", r.html)
        schema = schema and schema[1].lower() == "instock"
        words = False if any(w in low for w in pages.SOLD_OUT) else True if any(w in low for w in pages.IN_STOCK) else None
        signals = [button, schema, words]
        said = next((v for v in (True, False) if signals.count(v) >= 2), None)
        assert votes[r.id] == (said, signals.count(said) if said is not None else 0, said is not None), r
        with_schema += schema is not None

        found = [find(r'"price"\s*:\s*["\']?([\d,]+(?:\.\d{2})?)', r.html), find(r"(?:Rs\.?|LKR)\s*([\d,]{3,}(?:\.\d{2})?)", r.html)]
        numbers = [float(m[1].replace(",", "")) for m in found if m and m[1].strip(",")]
        price = next((n for n in numbers if n > 0), None)
        before = bool(r.in_stock)
        there = find(r"\b(in stock|add to cart|buy now|available)\b", r.html)
        out = find(r"\b(out of stock|sold out|unavailable|discontinued|no stock)\b", r.html)
        stock = True if there else False if out else before
        assert polls[r.id] == (price, stock, (price is not None and abs(price - r.price) > 0.01) or stock != before), r
    assert with_schema > 0


def test_walks_from_every_merchant(spark, data):
    """Against plain Python, with every merchant's index and first listing."""
    from bazaarlake.plans import web as plans

    read = lambda name, *columns: [tuple(r) for r in spark.read.parquet(f"{data}/{name}.parquet").select(*columns).collect()]
    domains = dict(read("merchants", "id", "domain"))
    leaves = {(domains[m], u) for m, u in read("page_inspections", "merchant_id", "url") if m in domains and u}
    assert {r.loc for r in plans.QUERIES["s13_sitemap_walk"](spark, data).collect()} == {u for _, u in leaves}
    assert dict(map(tuple, plans.QUERIES["s12_sitemap_locs"](spark, data).collect())) == {False: len(leaves), True: len(domains)}

    mine = {}
    for k, m, p in sorted(read("listings", "id", "merchant_id", "product_id")):
        mine.setdefault(m, []).append((k, p))
    after = {}
    for listed in mine.values():
        for k, p in listed:
            after.setdefault(p, set()).update(q for j, q in listed if 1 <= j - k <= 40)
    depth = {listed[0][1]: 0 for listed in mine.values()}
    edge = set(depth)
    for step in (1, 2, 3):
        edge = {q for p in edge for q in after.get(p, ())} - set(depth)
        depth |= dict.fromkeys(edge, step)
    assert dict(map(tuple, plans.QUERIES["q7_reached"](spark, data).collect())) == depth


def test_pages_without_an_index_are_not_reached(spark):
    from bazaarlake.sources import web

    files = spark.createDataFrame([("a/sitemap.xml", "<sitemapindex><sitemap><loc>a/pages.xml</loc></sitemap></sitemapindex>"), ("a/pages.xml", "<urlset><loc>a/1</loc></urlset>"), ("b/pages.xml", "<urlset><loc>b/1</loc></urlset>")], "url string, body string")
    starts = spark.createDataFrame([("a/sitemap.xml",), ("b/sitemap.xml",)], "url string")
    assert [r.loc for r in graph.sitemap_leaves(web.sitemap_locations(files), starts).collect()] == ["a/1"]


def test_nested_json_ld_is_looked_through(spark):
    page = lambda ld: f'<script type="application/ld+json">{ld}</script>'
    product = '{"@type":"Product","name":"Lens","offers":{"price":"5"}}'
    deep = '[{"@type":"WebSite"},{"@graph":[{"@type":"Thing","@graph":{"@type":"List","@graph":[' + product + "]}}]}]"
    for ld in (product, f"[{product}]", f'{{"@graph":{product}}}', f'{{"@graph":[[{product}]]}}', deep):
        assert one(spark, page(ld), pages.jsonld(F.col("v")).alias("f")).f.title == "Lens", ld


def test_links_of_browsers(spark):
    html = '<a href="/shop/x">a</a>'
    rows = [("https://www.a.example/p", ["https://a.example/product/1?utm_source=x", "about", None, "https://other.example/p/1", "https://a.example/help", "https://a.example/product/1"], html), ("https://b.example/", None, html)]
    df = spark.createDataFrame(rows, "url string, hrefs array<string>, html string")
    assert [(r.rank, r.link) for r in pages.internal_links(df).orderBy("url", "rank").collect()] == [(0, "https://a.example/product/1"), (1, "https://a.example/help")]
    assert [r.link for r in pages.all_links(df).where("url like '%b.%'").orderBy("pos").collect()] == ["https://b.example/shop/x"]
    assert [r.link for r in pages.all_links(df).where("url like '%a.%'").orderBy("pos").collect()][-1] == "https://www.a.example/shop/x"


def test_all_that_a_page_tells(spark):
    html = "<p>Pay 3 x Rs. 9,900 with Koko. HNB cards 15% off. Convenience fee of Rs 250.</p><button disabled data-x='add-to-cart'>Sold out</button>"
    b = one(spark, html, pages.bundle(F.col("v"), F.lit(27000.0)).alias("b")).b
    assert (b.plans[0].markup_pct, b.stock.in_stock, b.offers[0].bank, b.surcharges[0].surcharge_lkr) == (10.0, False, "HNB", 250.0)
    b = one(spark, None, pages.bundle(F.col("v"), F.lit(None).cast("double")).alias("b")).b
    assert (b.plans, b.offers, b.surcharges, b.stock.agreed) == ([], [], [], False)


def test_structured_answers_and_pairs(spark):
    schema = "title string, price double"
    none = F.lit(None).cast(f"struct<{schema.replace(' ', ':')}>".replace(",:", ","))
    told = lambda text, parsed=none: one(spark, text, T.coerced(parsed, F.col("v"), schema, "title").alias("x")).x
    assert told('Sure:\n```json\n{"title": "a", "price": 5}\n```').price == 5.0
    assert told("no json") is None and told(None) is None and told('{"price": 5}') is None
    assert told("{}", F.struct(F.lit("p").alias("title"), F.lit(1.0).alias("price"))).title == "p"
    pairs = spark.createDataFrame([([("a", "1"), (None, "x"), ("b", None), ("a", "2")],), (None,)], "p array<struct<key:string,value:string>>")
    assert [r.m for r in pairs.select(T.pairs_to_map(F.col("p")).alias("m")).collect()] == [{"b": None, "a": "2"}, {}]


def test_fingerprints_of_any_goods(spark):
    import hashlib

    from bazaarlake.operators import titles

    df = spark.createDataFrame([({"watt": "65", "ports": '2"C'},), ({"ports": '2"C', "watt": "65"},), (None,), ({},)], "a map<string,string>")
    lit = lambda v: F.lit(v).cast("string")
    got = [r[0] for r in df.select(titles.universal_fingerprint(lit(" Anker "), lit("Prime"), lit(None), F.lit(None).cast("int"), F.lit(64), lit("US"), lit("new"), F.col("a"))).collect()]
    base = "anker|prime|||64|us"
    want = hashlib.sha256((base + "|new|" + json.dumps({"ports": '2"C', "watt": "65"}, sort_keys=True)).encode()).hexdigest()
    assert got == [want, want, *[hashlib.sha256(base.encode()).hexdigest()] * 2]


def test_pages_to_rows(spark):
    from datetime import datetime

    from bazaarlake.operators import ingest, titles

    at = lambda h: datetime(2026, 1, 1, h)
    page = lambda title, price: f'<html><head><title>{title}</title></head><p>Rs. {price}</p><button class="btn">Add to cart</button></html>'
    rows = [
        ("https://a.example/p/1", page("Pixel 8 8/128GB", 1000), at(1)), ("https://a.example/p/1", page("Pixel 8 8/128GB", 900), at(3)), ("https://b.example/p/1", page("Pixel 8 8/128GB", 950), at(2)),
        ("https://b.example/p/2", page("Galaxy S9 64GB", 700), at(2)), ("https://b.example/p/3", "<title>No price</title>", at(2)), ("https://b.example/p/4", None, at(2)),
    ]
    df = spark.createDataFrame([(*r, r"re:Rs\. ([\d.]+)", None) for r in rows], "url string, html string, fetched_at timestamp, price_selector string, extraction_tier string")
    known = titles.normalised(spark.createDataFrame([("Galaxy S9 64GB",)], "t string"), "t").select("spec.spec_fingerprint")
    out = ingest.ingested(df, known)
    assert sorted((r.url[-5:], r.status) for r in out.results.collect()) == [("e/p/1", "new_product_queued")] * 3 + [("e/p/2", "delta_updated"), ("e/p/3", "extract_failed"), ("e/p/4", "extract_failed")]
    assert {(r.domain, r.first_seen.hour, r.last_seen.hour) for r in out.merchants.collect()} == {("a.example", 1, 3), ("b.example", 2, 2)}
    assert [(r.raw_title, r.first_seen_at.hour) for r in out.products.collect()] == [("Pixel 8 8/128GB", 1)]
    assert sorted((r.domain, r.price) for r in out.listings.collect()) == [("a.example", 900.0), ("b.example", 700.0), ("b.example", 950.0)]
    assert out.prices.count() == 4 and [(r.domain, r.listing_url, r.enqueued_at.hour) for r in out.jobs.collect()] == [("a.example", "https://a.example/p/1", 1)]
    assert {f.count() for f in ingest.ingested(df.limit(0), known)} == {0}


def test_walk_of_one_site(spark):
    maps = [("https://a.example/sitemap.xml", "<sitemapindex><loc>https://a.example/one.xml</loc><loc>https://evil.example/x.xml</loc><loc>https://a.example/sitemap.xml</loc></sitemapindex>"),
            ("https://a.example/one.xml", "<urlset><loc>https://A.example/product/1?utm_source=x</loc><loc>https://a.example/product/1</loc><loc>https://b.example/product/9</loc><loc>https://a.example/about</loc></urlset>"),
            ("https://evil.example/x.xml", "<urlset><loc>https://a.example/product/7</loc></urlset>")]
    places = web.sitemap_locations(spark.createDataFrame(maps, "url string, body string"))
    starts = spark.createDataFrame([("https://a.example/sitemap.xml",), ("https://a.example/gone.xml",)], "url string")
    assert [(r.site, r.url) for r in graph.sitemap_products(places, starts).collect()] == [("a.example", "https://a.example/product/1")]
    assert graph.sitemap_products(places, starts, max_sitemaps=2).count() == 0


def test_jobs_with_retries(spark):
    log = spark.createDataFrame([("a", 1, "pending"), ("a", 2, "claimed"), ("a", 3, "failed"), ("a", 4, "retried"), ("b", 1, "claimed"), ("c", 1, "pending"), ("d", 1, "retried"), ("d", 2, "claimed"), ("d", 3, "done"), ("d", 4, "pending")], "k string, t int, s string")
    got = {r.k: (r.status, r.attempts, r.claimed_at, r.completed_at) for r in folds.job_states(log, "k", "s", ["t"], "t").collect()}
    assert got == {"a": ("pending", 1, None, None), "b": ("claimed", 1, 1, None), "c": ("pending", 0, None, None), "d": ("done", 1, 2, 3)}
    assert folds.job_states(log.limit(0), "k", "s", ["t"], "t").count() == 0


@pytest.mark.parametrize("size", [1, 3, 50])
def test_runs_across_periods(spark, size):
    import random

    rng = random.Random(size)
    rows = [(k, t, rng.random() < 0.75) for k in ("a", "b", None) for t in range(60)] + [("c", t, True) for t in range(10)] + [("d", 1, None)]
    df = spark.createDataFrame(rows, "k string, t int, hit boolean")
    want = set()
    for k in {r[0] for r in rows}:
        mine, begun = [r for r in rows if r[0] == k], None
        for r in [*mine, (k, None, False)]:
            if r[2] and begun is None:
                begun = r[1]
            if not r[2] and begun is not None:
                want.add((k, last - begun + 1, begun, last))
                begun = None
            last = r[1]
    for period in (None, (F.col("t") / size).cast("int")):
        got = folds.runs(df, "k", ["t"], F.col("hit"), period).collect()
        assert {(r.k, r.length, r.begins, r.ends) for r in got} == want and len(got) == len(want)
