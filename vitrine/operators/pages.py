"""Columns of the page record, read from the parsed ``dom``. All row-local: no shuffle until rows meet per site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fixed
from ..functions.scalars import blank, first_where, strip
from ..functions.urls import class_confidence, classify, normalize_url, origin

NODES = "dom.nodes"
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]


def _is_json_ld(node: Column) -> Column:
    return F.lower(F.coalesce(node["attrs"]["type"], F.lit(""))) == "application/ld+json"


def _rel(node: Column) -> Column:
    return F.split(F.lower(F.coalesce(node["attrs"]["rel"], F.lit(""))), r"\s+")


def _web(url: Column) -> Column:
    """Normalised address of an already absolute http(s) URL."""
    return F.when(url.rlike("(?i)^https?://"), normalize_url(url))


def closed(*tags: str) -> Column:
    """Elements with gathered text, in the order they were closed."""
    found = F.filter(NODES, lambda n: n["tag"].isin(*tags) & n["closed"].isNotNull())
    return F.array_sort(found, lambda a, b: a["closed"] - b["closed"])


def texts(*tags: str) -> Column:
    return F.transform(closed(*tags), lambda n: n["text"])


def metas() -> Column:
    """``(key, content)`` of every meta tag in page order; a later tag of the same key wins (see ``meta``)."""
    return F.transform(F.filter(NODES, lambda n: n["tag"] == "meta"), lambda n: F.struct(
        F.lower(F.coalesce(n["attrs"]["name"], n["attrs"]["property"], F.lit(""))).alias("key"),
        F.coalesce(n["attrs"]["content"], F.lit("")).alias("value")))


def meta(key: str, source: Column | None = None) -> Column:
    tags = F.col("metas") if source is None else source
    return F.try_element_at(F.filter(tags, lambda m: m["key"] == key), F.lit(-1))["value"]


def links() -> Column:
    """Anchors with a usable target: normalised web links, and ``tel:``/``mailto:`` as written."""
    found = F.transform(closed("a"), lambda n: F.struct(
        F.coalesce(_web(n["url"]), F.when(n["attrs"]["href"].rlike("^(tel|mailto):"), n["attrs"]["href"])).alias("url"),
        n["text"].alias("text"), F.coalesce(n["attrs"]["rel"], F.lit("")).alias("rel")))
    return F.filter(found, lambda n: n["url"].isNotNull())


def headings() -> Column:
    return F.transform(closed(*HEADINGS), lambda n: F.struct(
        F.substring(n["tag"], 2, 1).cast("int").alias("level"), n["text"].alias("text")))


def images() -> Column:
    return F.transform(F.filter(NODES, lambda n: (n["tag"] == "img") & n["shown"]), lambda n: F.struct(
        _web(n["url"]).alias("url"), n["attrs"]["alt"].alias("alt"), n["attrs"]["title"].alias("title")))


def _link_tags(rel: str) -> Column:
    return F.filter(NODES, lambda n: (n["tag"] == "link") & F.array_contains(_rel(n), rel))


def canonical() -> Column:
    return _web(F.try_element_at(_link_tags("canonical"), F.lit(-1))["url"])


def feeds() -> Column:
    found = F.filter(_link_tags("alternate"), lambda n: n["attrs"]["type"].isin(fixed.FEED_TYPES))
    return F.transform(found, lambda n: F.struct(_web(n["url"]).alias("url"), n["attrs"]["type"].alias("type")))


def stylesheets() -> Column:
    return F.filter(F.transform(_link_tags("stylesheet"), lambda n: _web(n["url"])), lambda u: u.isNotNull())


def icons() -> Column:
    found = F.filter(NODES, lambda n: (n["tag"] == "link") & F.arrays_overlap(_rel(n), F.array(F.lit("icon"), F.lit("apple-touch-icon"))))
    return F.transform(found, lambda n: F.struct(
        n["attrs"]["rel"].alias("rel"), _web(n["url"]).alias("href"), n["attrs"]["sizes"].alias("sizes")))


def _sourced() -> Column:
    """Script and iframe elements with a source."""
    return F.filter(NODES, lambda n: n["tag"].isin("script", "iframe") & ~_is_json_ld(n)
                    & (F.coalesce(n["attrs"]["src"], F.lit("")) != ""))


def script_srcs() -> Column:
    return F.transform(_sourced(), lambda n: n["attrs"]["src"])


def script_sources() -> Column:
    return F.array_sort(F.array_distinct(F.transform(_sourced(), lambda n: F.coalesce(_web(n["url"]), n["attrs"]["src"]))))


def inline_script() -> Column:
    found = F.filter(NODES, lambda n: (n["tag"] == "script") & ~_is_json_ld(n) & n["closed"].isNotNull())
    return F.array_join(F.transform(found, lambda n: n["text"]), "\n")


def css() -> Column:
    blocks = F.filter(NODES, lambda n: ((n["tag"] == "style") & n["closed"].isNotNull()) | n["attrs"]["style"].contains("font"))
    return F.array_join(F.transform(blocks, lambda n: F.when(n["tag"] == "style", n["text"]).otherwise(n["attrs"]["style"])), "\n")


def json_types() -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.col("dom.objects"), lambda o: o["types"]))))


def _text() -> Column:
    return F.array_join(F.col("dom.lines"), "\n")


def _web_links() -> Column:
    return F.filter("links", lambda n: n["url"].rlike("^https?://"))


def _emails() -> Column:
    mailto = F.transform(F.filter("links", lambda n: n["url"].startswith("mailto:")), lambda n: F.regexp_extract(n["url"], r"^mailto:([^?]*)", 1))
    return F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all(_text(), F.lit(fixed.EMAIL), 0), mailto)))


def _phones() -> Column:
    return F.array_sort(F.array_distinct(F.transform(
        F.filter("links", lambda n: n["url"].startswith("tel:")), lambda n: F.substr(n["url"], F.lit(5)))))


def _ctas() -> Column:
    calls = F.filter(_web_links(), lambda n: n["text"].rlike(fixed.CALL_WORDS))
    buttons = F.filter(texts("button"), lambda b: b != "")
    return F.concat(
        F.transform(calls, lambda n: F.struct(n["text"].alias("text"), n["url"].alias("url"), F.lit(0.65).alias("confidence"))),
        F.transform(buttons, lambda b: F.struct(b.alias("text"), F.lit(None).cast("string").alias("url"), F.lit(0.5).alias("confidence"))))


def _keyed(test) -> Column:
    return F.filter("metas", lambda m: test(m["key"]))


def _dates() -> Column:
    return _keyed(lambda key: key.isin("article:published_time", "article:modified_time", "date", "datepublished", "datemodified"))


def _times() -> Column:
    return F.transform(closed("time"), lambda n: F.struct(n["text"].alias("text"), n["attrs"]["datetime"].alias("datetime")))


def _quotations() -> Column:
    return F.transform(closed("blockquote"), lambda n: F.struct(n["text"].alias("text"), n["attrs"]["cite"].alias("cite")))


def _trustpilot_widgets() -> Column:
    return F.size(F.filter(NODES, lambda n: F.array_contains(F.split(F.coalesce(n["attrs"]["class"], F.lit("")), r"\s+"), "trustpilot-widget")))


# Column of the page record -> how it is built. ``metas`` and ``links`` come first: others read them.
COLUMNS = {
    "metas": metas, "links": links,
    "title": lambda: F.array_join(texts("title"), " "), "meta_description": lambda: meta("description"), "canonical_url": canonical,
    "headings": headings, "lines": lambda: F.col("dom.lines"), "visible_text": _text, "web_links": _web_links, "images": images,
    "feeds": feeds, "stylesheets": stylesheets, "icons": icons, "script_srcs": script_srcs, "script_sources": script_sources,
    "inline_script": inline_script, "css": css, "json_types": json_types, "author": lambda: meta("author"),
    "robots_meta": lambda: _keyed(lambda key: key.isin("robots", "googlebot", "bingbot")),
    "social_meta": lambda: _keyed(lambda key: key.rlike("^(og|twitter|fb):")), "dates": _dates, "times": _times,
    "addresses": lambda: texts("address"), "quotation_candidates": _quotations, "emails": _emails, "telephone_numbers": _phones,
    "ctas": _ctas, "trustpilot_widgets": _trustpilot_widgets, "label": lambda: classify(F.col("url")),
    "label_confidence": lambda: class_confidence(classify(F.col("url"))),
}
_READS = {"metas": ("meta_description", "author", "robots_meta", "social_meta", "dates"), "links": ("web_links", "emails", "telephone_numbers", "ctas")}


def page_record(pages: DataFrame, *names: str) -> DataFrame:
    """The named columns of the page record (all of them when none is named) beside the columns already there."""
    wanted = set(names or COLUMNS)
    for base, readers in _READS.items():
        if wanted.intersection((base, *readers)):
            pages = pages.withColumn(base, COLUMNS[base]())
    return pages.select("*", *[build().alias(name) for name, build in COLUMNS.items() if name in wanted and name not in _READS])


def usable_pages(pages: DataFrame) -> DataFrame:
    """Pages with readable text that are not canonical duplicates."""
    return pages.filter(~blank(F.col("visible_text")) & F.col("duplicate_of").isNull())


def page_status(status: Column, error: Column, content_type: Column, body: Column) -> Column:
    """EXTRACTED for HTML, UNSUPPORTED_CONTENT_TYPE for other successful bodies, NULL when there was none."""
    mime = F.lower(F.coalesce(content_type, F.lit("")))
    html = mime.contains("html") | ((mime == "") & strip(body).startswith("<"))
    ok = status.between(200, 299) & error.isNull()
    return F.when(ok & html, "EXTRACTED").when(ok, "UNSUPPORTED_CONTENT_TYPE")


def run_status(pages: DataFrame, skipped: DataFrame, keys: list[str]) -> DataFrame:
    """PARTIAL when a run has an error, a skipped URL, a truncated or unextracted page, or no page at all."""
    flaw = F.col("error").isNotNull() | F.col("truncated") | ~F.col("extraction_status").eqNullSafe("EXTRACTED")
    both = pages.select(*keys, F.lit(1).alias("page"), flaw.cast("int").alias("flaw")).unionByName(
        skipped.select(*keys, F.lit(0).alias("page"), F.lit(1).alias("flaw")))
    totals = both.groupBy(*keys).agg(F.sum("page").alias("pages"), F.sum("flaw").alias("flaws"))
    return totals.select(*keys, "pages", F.when((F.col("flaws") > 0) | (F.col("pages") == 0), "PARTIAL").otherwise("COMPLETE").alias("status"))


def exclusion_reason() -> Column:
    """Why a page takes no part in the accessibility summary; NULL when it does."""
    return first_where([
        (F.col("error").isNotNull(), "retrieval_error"), (F.col("truncated"), "truncated_response"),
        (F.col("duplicate_of").isNotNull(), "duplicate_canonical"), (F.col("dom").isNull(), "no_accessibility_capture")])


def duplicate_canonicals(pages: DataFrame, keys: list[str], order: str, canonical_col: str = "canonical_url") -> DataFrame:
    """Adds ``duplicate_of``: the canonical address when an earlier page of the run already claimed it.

    The first claim per canonical is a partial aggregate, so a canonical shared by a third of all pages costs one row per
    map task; the join back has one row per canonical on its right side.
    """
    same_site = origin(F.col(canonical_col)) == origin(F.col("url")) if canonical_col == "canonical_url" else F.lit(True)
    claims = pages.filter(F.col(canonical_col).isNotNull() & same_site).groupBy(*keys, canonical_col).agg(F.min(order).alias("_first"))
    named = pages.filter(F.col(canonical_col).isNotNull()).join(claims, [*keys, canonical_col], "left").withColumn(
        "duplicate_of", F.when(F.col(order) > F.col("_first"), F.col(canonical_col)))
    # Pages without one claim nothing and would all meet on one key.
    rest = pages.filter(F.col(canonical_col).isNull()).withColumn("duplicate_of", F.lit(None).cast("string"))
    columns = [*pages.columns, "duplicate_of"] if "duplicate_of" not in pages.columns else pages.columns
    return named.select(columns).unionByName(rest.select(columns))


def link_inventory(pages: DataFrame, keys: list[str]) -> DataFrame:
    return pages.select(*keys, F.col("url").alias("source"), F.explode("web_links").alias("l")).select(
        *keys, "source", "l.url", "l.text", "l.rel")


def feed_inventory(pages: DataFrame, keys: list[str]) -> DataFrame:
    return pages.select(*keys, F.col("url").alias("source"), F.explode("feeds").alias("f")).select(*keys, "source", "f.url", "f.type")


def html_signals(pages: DataFrame, keys: list[str]) -> DataFrame:
    return pages.select(*keys, "url", "canonical_url", F.size("feeds").alias("feeds"), F.array_join("json_types", ",").alias("types"))


def indexing_report(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Whether indexing is refused in the page or its headers, and how much text could be read."""
    header = F.coalesce(F.try_element_at("headers", F.lit("x-robots-tag")), F.lit(""))
    said = F.lower(F.concat_ws(" ", F.transform("robots_meta", lambda m: m["value"]), header))
    tokens = F.split(F.replace(said, F.lit(","), F.lit(" ")), r"\s+")
    size = F.length("visible_text")
    return pages.select(
        *keys, "url", F.arrays_overlap(tokens, F.array(F.lit("noindex"), F.lit("none"))).alias("noindex"),
        size.cast("bigint").alias("extracted_characters"),
        F.when(size.isNull(), "UNKNOWN").when(size < 200, "WARNING").otherwise("PASS").alias("extractability"))
