"""Per-page checks of link previews, security headers, search basics, fonts and measurement, with site summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fixed
from ..functions.scalars import blank, clean, strip, whole
from ..functions.urls import origin, query
from .pages import meta
from .ranking import first_n


# ---- link previews -----------------------------------------------------------------------------------------------
def preview_issues(pages: DataFrame) -> DataFrame:
    """Adds ``preview_issues ARRAY<STRUCT<severity, code, tag>>`` from ``social_meta`` and ``canonical_url``."""
    tags = F.col("social_meta")

    def tag(name: str) -> Column:
        return F.coalesce(meta(name, tags), F.lit(""))

    def issue(condition: Column, severity: str, code: str, name: str) -> Column:
        return F.when(condition, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(name).alias("tag")))

    image = tag("og:image")
    slash = lambda url: F.regexp_replace(url, "/+$", "")
    found = [issue(tag(n) == "", "error" if n in fixed.PREVIEW_ERRORS else "warning", "missing", n) for n in fixed.PREVIEW_REQUIRED]
    found += [
        issue(tag("twitter:card") == "", "warning", "missing", "twitter:card"),
        issue((image != "") & ~image.startswith("https://"), "error", "image_not_absolute_https", "og:image"),
        issue((image != "") & ((tag("og:image:width") == "") | (tag("og:image:height") == "")), "warning", "image_dimensions_missing",
              "og:image:width/height"),
        issue((tag("og:url") != "") & (slash(tag("og:url")) != slash(F.col("canonical_url"))), "warning", "og_url_not_canonical", "og:url"),
        issue(F.length(tag("og:title")) > 90, "warning", "title_may_truncate", "og:title"),
        issue(F.length(tag("og:description")) > 200, "warning", "description_may_truncate", "og:description")]
    return pages.withColumn("preview_issues", F.array_compact(F.array(*found)))


def preview_summary(pages: DataFrame, keys: list[str]) -> DataFrame:
    return pages.select(*keys, F.explode("preview_issues").alias("i")).groupBy(*keys, "i.severity", "i.code", "i.tag").agg(F.count("*").alias("pages"))


def most_used_images(pages: DataFrame, keys: list[str], limit: int = 5) -> DataFrame:
    image = meta("og:image", F.col("social_meta"))
    used = pages.select(*keys, image.alias("image")).filter(F.coalesce("image", F.lit("")) != "").groupBy(*keys, "image").agg(F.count("*").alias("pages"))
    return first_n(used, keys, [F.desc("pages"), F.asc("image")], limit, "place")


# ---- security headers --------------------------------------------------------------------------------------------
def header(name: str) -> Column:
    return F.try_element_at("headers", F.lit(name))


def security_row(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Missing headers, insecure resources and cookie flags of every page that answered."""
    https = F.col("url").startswith("https://")
    missing = [F.when(header(h).isNull() & (https if h == "strict-transport-security" else F.lit(True)), F.lit(h)) for h in fixed.SECURITY_HEADERS]
    framed = header("x-frame-options").isNotNull() | F.coalesce(header("content-security-policy"), F.lit("")).contains("frame-ancestors")
    missing.append(F.when(~framed, F.lit(fixed.FRAME_PROTECTION)))
    resources = F.concat("script_sources", F.transform("images", lambda i: F.coalesce(i["url"], F.lit(""))))
    mixed = F.when(https, F.filter(resources, lambda u: u.startswith("http://"))).otherwise(F.array().cast("array<string>"))
    cookie = F.nullif(header("set-cookie"), F.lit(""))
    flags = {flag: F.when(cookie.isNotNull(), F.lower(cookie).contains(flag)) for flag in ("secure", "httponly", "samesite")}
    return pages.filter((F.col("status") > 0) & (F.col("status") < 400)).select(
        *keys, "url", https.alias("https"), F.array_compact(F.array(*missing)).alias("missing_headers"), mixed.alias("mixed_content"),
        *[c.alias(f"cookie_{f}") for f, c in flags.items()], header("server").alias("server"), header("x-powered-by").alias("powered_by"))


def security_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Pages per missing header."""
    return rows.select(*keys, F.explode("missing_headers").alias("header")).groupBy(*keys, "header").agg(F.count("*").alias("pages"))


def https_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("pages_checked"), F.bool_and("https").alias("https"),
                                   F.count_if(F.size("mixed_content") > 0).alias("mixed_pages"))


# ---- search basics -----------------------------------------------------------------------------------------------
def _h1_count() -> Column:
    return F.size(F.filter("headings", lambda h: h["level"] == 1))


def seo_problems(pages: DataFrame, title_max: int = fixed.TITLE_MAX) -> DataFrame:
    """Adds ``seo_problems``: what a page card reports about title, description, H1, indexing and canonical."""
    title, description = strip(F.coalesce("title", F.lit(""))), strip(F.coalesce("meta_description", F.lit("")))
    noindex = F.exists("robots_meta", lambda m: F.lower(m["value"]).contains("noindex")) | F.coalesce("noindex", F.lit(False))
    slash = lambda c: F.regexp_replace(c, "/+$", "")
    found = [
        F.when(title == "", "no title").when(F.length(title) > title_max, "long title"),
        F.when(description == "", "no description").when(F.length(description) > fixed.DESCRIPTION_MAX, "long description"),
        F.when(_h1_count() == 0, "no h1").when(_h1_count() > 1, "several h1"),
        F.when(noindex, "noindex"),
        F.when(slash(F.col("canonical_url")) != slash(F.col("url")), "canonical elsewhere"),
        F.when(F.col("extractability").isin("WARNING", "FAIL"), "little text")]
    return pages.withColumn("seo_problems", F.array_compact(F.array(*found)))


def seo_worklist(pages: DataFrame, keys: list[str], title_max: int = fixed.TITLE_MAX) -> DataFrame:
    """Pages to fix, with the stricter description rule and the missing canonical."""
    title, description = clean(F.coalesce("title", F.lit(""))), clean(F.coalesce("meta_description", F.lit("")))
    found = F.array_compact(F.array(
        F.when(title == "", "no title").when(F.length(title) > title_max, F.concat(F.lit("title is "), F.length(title), F.lit(" characters"))),
        F.when(description == "", "no meta description").when(
            ~F.length(description).between(fixed.DESCRIPTION_MIN, fixed.DESCRIPTION_MAX), F.concat(F.lit("meta description is "), F.length(description), F.lit(" characters"))),
        F.when(_h1_count() != 1, F.concat(_h1_count(), F.lit(" H1 headings"))),
        F.when(blank(F.coalesce("canonical_url", F.lit(""))), "no canonical link")))
    rows = pages.filter((F.col("status") == 200) & (F.col("extraction_status") == "EXTRACTED"))
    return rows.select(*keys, "url", found.alias("problems")).filter(F.size("problems") > 0)


def seo_counts(pages: DataFrame, keys: list[str]) -> DataFrame:
    return pages.groupBy(*keys).agg(F.count("*").alias("checked"), F.count_if(F.size("seo_problems") > 0).alias("failing"))


# ---- fonts -------------------------------------------------------------------------------------------------------
def font_families(css: Column) -> Column:
    """Families of ``font-family`` declarations, one level of ``var()`` resolved within the same text."""
    variable = r"(--[\w-]+)\s*:\s*([^;}{]+)"
    names, values = F.regexp_extract_all(css, F.lit(variable), 1), F.regexp_extract_all(css, F.lit(variable), 2)
    use = r"(var\(\s*(--[\w-]+)[^)]*\))"

    def resolved(value: Column) -> Column:
        spots = F.arrays_zip(F.regexp_extract_all(value, F.lit(use), 1).alias("a"), F.regexp_extract_all(value, F.lit(use), 2).alias("b"))
        known = lambda name: F.try_element_at(F.filter(F.arrays_zip(names.alias("n"), values.alias("v")), lambda z: z["n"] == name), F.lit(-1))["v"]
        return F.aggregate(spots, value, lambda text, s: F.replace(text, s["a"], F.coalesce(known(s["b"]), s["a"])))

    declared = F.regexp_extract_all(css, F.lit(r"(?i)font-family\s*:\s*([^;}{]+)"), 1)
    parts = F.flatten(F.transform(declared, lambda v: F.split(resolved(v), ",")))
    tidy = F.transform(parts, lambda p: strip(F.regexp_replace(strip(F.replace(p, F.lit("!important"), F.lit(""))), "^['\"]+|['\"]+$", "")))
    return F.array_sort(F.array_distinct(F.filter(tidy, lambda p: p != "")))


def stylesheet_source(url: Column, scope: Column) -> Column:
    name = F.regexp_extract(url, "^https?://([^/?#:]+)", 1)
    return F.when(name == "fonts.googleapis.com", "Google Fonts").when(name == "use.typekit.net", "Adobe Fonts").when(
        origin(url) != scope, "third-party").otherwise("first-party")


def families_in_url(url: Column) -> Column:
    """Families a font service's URL asks for."""
    values = F.transform(F.filter(F.split(query(url), "&"), lambda p: p.startswith("family=")),
                         lambda p: F.coalesce(F.try_url_decode(F.substr(p, F.lit(8))), p))
    return F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform(values, lambda v: F.split(v, r"\|"))), lambda f: F.split_part(f, F.lit(":"), F.lit(1)))))


def stylesheets(pages: DataFrame, bodies: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Distinct stylesheets of a site with their families; with ``limit`` only a site's first first-party ones are read.

    ``bodies``: url, body of captured stylesheets.
    """
    seen = pages.select(*keys, origin(F.col("url")).alias("scope"), F.col("page_no"), F.posexplode("stylesheets").alias("pos", "sheet"))
    sheets = seen.groupBy(*keys, "sheet").agg(F.min(F.struct("page_no", "pos")).alias("first"), F.first("scope").alias("scope")).withColumn(
        "source", stylesheet_source(F.col("sheet"), F.col("scope")))
    own = sheets.filter(F.col("source") == "first-party")
    if limit is not None:
        own = first_n(own, keys, [F.col("first"), F.col("sheet")], limit, "place")
    read = own.select(*keys, "sheet").join(bodies.select(F.col("url").alias("sheet"), "body"), "sheet").select(*keys, "sheet", font_families(F.col("body")).alias("read"))
    none = F.array().cast("array<string>")
    families = F.when(F.col("source") == "Google Fonts", families_in_url(F.col("sheet"))).otherwise(F.coalesce("read", none))
    return sheets.join(read, [*keys, "sheet"], "left").select(*keys, "sheet", "source", families.alias("families"))


def page_fonts(pages: DataFrame, sheets: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, page_no, family)``: a page's inline families and those of its stylesheets."""
    inline = pages.select(*keys, "page_no", F.explode(font_families(F.col("css"))).alias("family"))
    used = pages.select(*keys, "page_no", F.explode(F.array_distinct("stylesheets")).alias("sheet"))
    linked = used.join(sheets, [*keys, "sheet"]).select(*keys, "page_no", F.explode("families").alias("family"))
    return inline.unionByName(linked).distinct()


def font_summary(fonts: DataFrame, keys: list[str]) -> DataFrame:
    return fonts.groupBy(*keys, "family").agg(F.count("*").alias("pages")).withColumn("named", ~F.lower("family").isin(fixed.GENERIC_FONTS))


def named_font_count(summary: DataFrame, keys: list[str]) -> DataFrame:
    return summary.groupBy(*keys).agg(F.count("*").alias("distinct_families"), F.count_if("named").alias("named_families"))


# ---- measurement -------------------------------------------------------------------------------------------------
def detect_tools(pages: DataFrame) -> DataFrame:
    """Adds ``tools ARRAY<STRUCT<tool, category, ids, source, match>>``: one entry per signature that matches."""
    sources, inline = F.col("script_srcs"), F.col("inline_script")
    found = []

    def matches(regex: str):
        return lambda text: text.rlike(regex)

    def id_texts(regex: str):
        return lambda text: F.regexp_extract_all(text, F.lit(regex), 1)

    for tool, category, pattern, id_pattern, group in fixed.SIGNATURES:
        regex = f"(?i){pattern}"
        hits = F.filter(F.concat(sources, F.array(inline)), matches(regex))
        ids = F.array().cast("array<string>")
        if id_pattern:
            wrapped = id_pattern if group else f"({id_pattern})"
            ids = F.array_sort(F.array_distinct(F.flatten(F.transform(hits, id_texts(wrapped)))))
        by_source = F.exists(sources, matches(regex))
        near = F.regexp_extract(inline, f"(?s)(?i)(.{{0,40}}?(?:{pattern}).{{0,40}})", 1)
        match = F.left(clean(F.when(by_source, F.get(hits, 0)).otherwise(near)), F.lit(200))
        found.append(F.when(by_source | inline.rlike(regex), F.struct(
            F.lit(tool).alias("tool"), F.lit(category).alias("category"), ids.alias("ids"),
            F.when(by_source, "src").otherwise("inline").alias("source"), match.alias("match"))))
    return pages.withColumn("tools", F.array_compact(F.array(*found)))


def _measured() -> Column:
    return F.exists("tools", lambda x: x["category"].isin(fixed.MEASURING))


def tool_summary(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Pages carrying each tool, with the pages of the site."""
    totals = pages.groupBy(*keys).agg(F.count("*").alias("pages_total"))
    per_tool = pages.select(*keys, F.explode("tools").alias("t")).groupBy(*keys, "t.tool", "t.category").agg(F.count("*").alias("pages_present"))
    return per_tool.join(totals, keys)


def tool_ids(pages: DataFrame, keys: list[str]) -> DataFrame:
    return pages.select(*keys, F.explode("tools").alias("t")).select(*keys, "t.tool", F.explode("t.ids").alias("id")).groupBy(
        *keys, "tool", "id").agg(F.count("*").alias("pages"))


def tool_missing_on(pages: DataFrame, keys: list[str], order: str, limit: int = 50) -> DataFrame:
    """For each tool of a site the first pages without it. A site has at most as many tools as there are signatures, so
    its tool list travels to its pages, and each page subtracts its own."""
    have = pages.select(*keys, F.explode("tools.tool").alias("tool")).groupBy(*keys).agg(F.collect_set("tool").alias("_all"))
    lacking = pages.join(have, keys).select(*keys, order, "url", F.explode(F.array_except("_all", "tools.tool")).alias("tool"))
    return first_n(lacking, [*keys, "tool"], [F.col(order)], limit, "place")


def measurement_flags(pages: DataFrame, keys: list[str]) -> DataFrame:
    return pages.groupBy(*keys).agg(
        F.count("*").alias("pages_checked"), F.bool_or(_measured()).alias("has_measurement"),
        F.bool_or(F.exists("tools", lambda x: x["category"] == "consent")).alias("has_consent_tool"), F.count_if(~_measured()).alias("untagged"))


def ad_signals(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Ad pixels and tag managers seen; ads belong in the report when either is there."""
    pixel = F.exists("tools", lambda x: x["tool"].isin(fixed.ADS_PIXELS))
    manager = F.exists("tools", lambda x: x["category"] == "tag_manager")
    return pages.groupBy(*keys).agg(F.bool_or(pixel).alias("ad_pixel"), F.bool_or(manager).alias("tag_manager"),
                                    F.bool_or(pixel | manager).alias("shows_ads"))


def shows_ads(signals: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs without any measurement keep their ads areas."""
    return runs.select(*keys).join(signals.select(*keys, "shows_ads"), keys, "left").withColumn("shows_ads", F.coalesce("shows_ads", F.lit(True)))


def share_tagged(flags: DataFrame) -> DataFrame:
    return flags.withColumn("analytics_pct", whole((F.col("pages_checked") - F.col("untagged")) / F.col("pages_checked") * 100))
