"""URL column functions. All are plain regex and array expressions, NULL on input that is not a usable URL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed_values as fixed
from .scalars import first_where, let, strip

PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
SCHEME, AUTHORITY, PATH, QUERY = 1, 2, 3, 4


def _part(url: Column, index: int) -> Column:
    return F.regexp_extract(url, PARTS, index)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, SCHEME))


def path(url: Column) -> Column:
    return _part(url, PATH)


def query(url: Column) -> Column:
    return _part(url, QUERY)


HOSTNAME = (r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\[\]]*)(?::[^/?#]*)?(?:[/?#].*)?$")


def hostname(url: Column) -> Column:
    """Lower-case host without port and credentials; NULL when there is none or the brackets are broken."""
    return let(F.lower(F.regexp_extract(url, HOSTNAME, 1)), lambda name: F.nullif(name, F.lit("")))


def without_www(name: Column) -> Column:
    return F.regexp_replace(name, r"^www\.", "")


def host(url: Column) -> Column:
    """Host without ``www.``; the scheme may be missing."""
    return without_www(let(strip(url), lambda u: hostname(F.when(u.contains("//"), u).otherwise(F.concat(F.lit("//"), u)))))


def origin(url: Column) -> Column:
    """Scheme and authority as written."""
    return F.concat(scheme(url), F.lit("://"), _part(url, AUTHORITY))


def _pairs(raw_query: Column) -> Column:
    """Decoded ``key, value`` pairs of a query string in order."""
    def decode(text: Column) -> Column:
        return F.coalesce(F.try_url_decode(text), text)

    items = F.filter(F.split(raw_query, "&"), lambda p: p != "")
    return F.transform(items, lambda p: F.struct(
        decode(F.regexp_extract(p, "^([^=]*)", 1)).alias("key"),
        decode(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("value")))


def _encode(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _join_query(pairs: Column) -> Column:
    joined = F.array_join(F.transform(pairs, lambda p: F.concat(_encode(p["key"]), F.lit("="), _encode(p["value"]))), "&")
    return let(joined, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))


def _is_utm(pair: Column) -> Column:
    return F.lower(pair["key"]).startswith("utm_")


def normalize_url(url: Column) -> Column:
    """One spelling per page: http(s) only, no credentials, default port, tracking keys or fragment, sorted query."""
    def build(p: Column) -> Column:
        kept = F.filter(_pairs(p["query"]), lambda q: ~_is_utm(q) & ~F.lower(q["key"]).isin(fixed.TRACKING_KEYS))
        default = ((p["kind"] == "http") & (p["port"] == "80")) | ((p["kind"] == "https") & (p["port"] == "443")) | p["port"].isin("", "0")
        return F.when(
            p["kind"].isin("http", "https") & p["name"].isNotNull() & ~p["authority"].contains("@"),
            F.concat(p["kind"], F.lit("://"), p["name"], F.when(default, "").otherwise(F.concat(F.lit(":"), p["port"])),
                     F.when(p["path"] == "", "/").otherwise(p["path"]), _join_query(F.array_sort(kept))))

    def split(text: Column) -> Column:
        authority = _part(text, AUTHORITY)
        return let(F.struct(scheme(text).alias("kind"), hostname(text).alias("name"), authority.alias("authority"),
                            F.regexp_extract(authority, r":(\d+)$", 1).alias("port"), path(text).alias("path"), query(text).alias("query")), build)

    return let(let(url, lambda u: F.when(u.contains("://"), u).otherwise(F.concat(F.lit("https://"), u))), split)


def clean_url(url: Column) -> Column:
    """The URL without ``utm_`` keys and fragment."""
    kept = F.filter(_pairs(query(url)), lambda p: ~_is_utm(p))
    return F.concat(F.regexp_extract(url, r"^([^?#]*)", 1), _join_query(kept))


def page_key(url: Column, keep_case: bool = False) -> Column:
    """Host and path, so that two spellings of one page compare equal."""
    def key(u: Column) -> Column:
        where = F.regexp_replace(path(u), "/+$", "")
        return F.concat(F.coalesce(host(u), F.lit("")), where if keep_case else F.lower(where))

    return let(url, key)


def safe_link(url: Column) -> Column:
    """The URL when it is a well-formed http(s) link, else NULL."""
    return let(strip(url), lambda u: F.when(scheme(u).isin("http", "https") & hostname(u).isNotNull(), u))


def crawlable(url: Column) -> Column:
    where = path(url)
    return (query(url) == "") & ~where.rlike(fixed.EXCLUDED_PATH) & ~where.rlike(fixed.BINARY_PATH)


def classify(url: Column) -> Column:
    """Page class by the first path rule that matches."""
    def label(where: Column) -> Column:
        rules = [(where.rlike(f"(?:^|/)(?:{pattern})"), name) for name, pattern in fixed.PAGE_CLASSES]
        return first_where([(where == "", "homepage"), *rules], "other")

    return let(F.regexp_replace(F.lower(path(url)), "^/+|/+$", ""), label)


def class_confidence(label: Column) -> Column:
    return F.when(label == "homepage", 0.95).when(label == "other", 0.3).otherwise(0.75)


def belongs_to(name: Column, domain: Column) -> Column:
    """The host is the domain or one of its subdomains."""
    return (name == domain) | name.endswith(F.concat(F.lit("."), domain))
