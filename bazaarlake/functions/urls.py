"""Addresses as Column expressions. Null in, null out, unless a function says otherwise."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Parameters that only track visitors, beside all that begin with utm_.
TRACKING = ["gclid", "fbclid", "mc_cid", "mc_eid", "_ga", "ref", "ref_src", "igshid", "yclid", "msclkid", "spm", "scm"]
# Parts of addresses that hint at products, that mark product pages, and that rule them out.
PRODUCT_HINTS = ["product", "products", "/p/", "/dp/", "item", "catalogue", "-p-", "buy"]
PRODUCT_PAGE = r"(?i)/product/|/products/|/p/|/item/|/items/|/buy/|/dp/|-p-|/shop/|[?&]sku=|[?&]product_id=|[?&]pid="
NO_PRODUCT = (
    r"(?i)\.(?:jpg|jpeg|png|gif|webp|svg|ico|css|js|pdf|zip|mp4|woff2?|ttf|xml|json)(?:$|\?)|/cart|/checkout|/login|/register|/account|/wishlist|/wp-admin|/wp-login|/cdn-cgi/|#|tel:|mailto:|javascript:"
)
# Second-level labels that belong to the public suffix under a two-letter top level.
SECOND_LEVEL = ["com", "co", "net", "org", "gov", "ac", "edu"]

_SCHEME = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*):"
_AUTHORITY = r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"


def _part(url: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(url, pattern, group)


def scheme(url: Column) -> Column:
    """The scheme in lower case, https where there is none."""
    return F.coalesce(F.nullif(F.lower(_part(url, _SCHEME)), F.lit("")), F.when(url.isNotNull(), F.lit("https")))


def netloc(url: Column) -> Column:
    """User, host and port in lower case; 'unknown' where an address has none, and for null."""
    return F.coalesce(F.nullif(F.lower(_part(url, _AUTHORITY)), F.lit("")), F.lit("unknown"))


def host(url: Column) -> Column:
    """The host in lower case without user and port; '' where an address has none."""
    bare = F.regexp_replace(_part(url, _AUTHORITY), r"^.*@", "")
    return F.lower(F.regexp_replace(bare, r":\d*$", ""))


def port(url: Column) -> Column:
    """The port as a number; null where none is given."""
    return F.nullif(_part(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*:(\d+)(?=[/?#]|\s*$)"), F.lit("")).try_cast("int")


def path(url: Column) -> Column:
    """The path without slashes at its end; / where it is empty."""
    whole = _part(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)")
    cut = F.regexp_replace(F.rtrim(whole), r"(?<=.)/+$", "")
    return F.when(cut == "", F.lit("/")).otherwise(cut)


def query(url: Column) -> Column:
    """What stands between ? and #; '' where there is none."""
    return _part(url, r"^[^?#]*\?([^#]*)")


def _address(url: Column) -> Column:
    """Host and port; the port that a scheme has anyway is left out."""
    usual = ((scheme(url) == "http") & (port(url) == 80)) | ((scheme(url) == "https") & (port(url) == 443))
    shown = F.when(port(url).isNotNull() & (port(url) != 0) & ~usual, F.concat(F.lit(":"), port(url).cast("string"))).otherwise(F.lit(""))
    return F.concat(host(url), shown)


def is_tracking(name: Column) -> Column:
    low = F.lower(name)
    return low.isin(TRACKING) | low.startswith("utm_")


def _plus_encoded(text: Column) -> Column:
    """Form encoding; ~ stays and * is escaped, as browsers' forms do not agree on either."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def clean_query(text: Column) -> Column:
    """The parameters of a query sorted by name and value, without those that track visitors; blank values stay."""
    pairs = F.filter(F.split(text, "&"), lambda p: p != "")
    decode = lambda s: F.coalesce(F.try_url_decode(s), s)
    split = F.transform(
        pairs,
        lambda p: F.struct(decode(F.regexp_extract(p, r"^([^=]*)", 1)).alias("k"), decode(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("v")),
    )
    kept = F.array_sort(F.filter(split, lambda p: ~is_tracking(p["k"])))
    return F.array_join(F.transform(kept, lambda p: F.concat(_plus_encoded(p["k"]), F.lit("="), _plus_encoded(p["v"]))), "&")


def canonical(url: Column) -> Column:
    """One form of an address: lower-case scheme and host, no usual port, user, fragment or tracking, sorted parameters."""
    text = clean_query(query(url))
    return F.concat(scheme(url), F.lit("://"), _address(url), path(url), F.when(text != "", F.concat(F.lit("?"), text)).otherwise(F.lit("")))


def canonical_keeping_query(url: Column) -> Column:
    """As ``canonical``, with the query as it is."""
    text = query(url)
    return F.concat(scheme(url), F.lit("://"), _address(url), path(url), F.when(text != "", F.concat(F.lit("?"), text)).otherwise(F.lit("")))


def origin(site: Column) -> Column:
    """Scheme, host and any port of a site typed with or without scheme, with / as path."""
    full = F.when(F.trim(site).rlike("(?i)^https?://"), F.trim(site)).otherwise(F.concat(F.lit("https://"), F.trim(site)))
    shown = F.when(port(full) > 0, F.concat(F.lit(":"), port(full).cast("string"))).otherwise(F.lit(""))
    return F.concat(scheme(full), F.lit("://"), host(full), shown, F.lit("/"))


def site_of(url: Column) -> Column:
    """The registered domain by rule: two labels, or three under a two-letter top level with a public second level."""
    labels = F.split(host(url), r"\.")
    n = F.size(labels)
    public = F.element_at(labels, -2).isin(SECOND_LEVEL) & (F.length(F.element_at(labels, -1)) == 2)
    return F.when(n <= 2, host(url)).otherwise(F.array_join(F.slice(labels, F.when(public, -3).otherwise(-2), F.when(public, 3).otherwise(2)), "."))


def is_product(url: Column) -> Column:
    """Whether an address looks like a product's page and like nothing that is none."""
    return ~url.rlike(NO_PRODUCT) & url.rlike(PRODUCT_PAGE)


def hints_at_product(url: Column) -> Column:
    low = F.lower(url)
    found = F.lit(False)
    for h in PRODUCT_HINTS:
        found = found | low.contains(h)
    return found


@F.pandas_udf(StringType())
def _join(base: pd.Series, href: pd.Series) -> pd.Series:
    def one(b, h):
        try:
            return urljoin(b, h)
        except ValueError:
            return None

    out = pd.Series([None] * len(base), dtype=object)
    told = (base.notna() & href.notna()).to_numpy().nonzero()[0]
    for k in told:
        out.iat[k] = one(base.iat[k], href.iat[k])
    return out


def resolved(base: Column, href: Column) -> Column:
    """A reference against the address of its page, by RFC 3986.

    Absolute ones, those from the root and plain names are joined by expressions; for them Python sees nulls, which it
    passes on. Only those with dot segments or a query alone are joined there.
    """
    site = F.concat(F.lower(_part(base, _SCHEME)), F.lit("://"), _part(base, _AUTHORITY))
    folder = F.regexp_replace(F.regexp_extract(base, r"^[^?#]*", 0), r"(?<=[^/:]/)[^/]*$", "")
    folder = F.when(folder.rlike(r"^[^/]*//[^/]*$"), F.concat(folder, F.lit("/"))).otherwise(F.regexp_replace(folder, r"/[^/]*$", "/"))
    dotted = href.rlike(r"(?:^|/)\.{1,2}(?:/|$|\?)") | href.rlike(r"^[?#;]|^$|[\s]")
    simple = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(F.lower(_part(base, _SCHEME)), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(site, href))
        .otherwise(F.concat(folder, href))
    )
    return F.when(dotted, _join(F.when(dotted, base), F.when(dotted, href))).otherwise(simple)
