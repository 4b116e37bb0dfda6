"""Pages that answers cite, and whether each one mentions the business."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fixed
from ..functions.scalars import literal, strip
from ..functions.urls import belongs_to, host, page_key
from ..session import cut
from .ranking import beside, first_n

BEST_FIRST = ("answers", "citations")


def _under_profile(url: Column, profiles: Column) -> Column:
    keys = F.filter(F.transform(profiles, lambda p: page_key(p)), lambda k: k != "")
    return F.exists(keys, lambda k: F.startswith(page_key(url), k))


def mark_owned(cited: DataFrame, profiles: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``owned``: the site's domain, one of its subdomains, or under one of its official profiles."""
    own = profiles.select(*keys, F.col("domain").alias("_domain"), F.col("profiles").alias("_profiles"))
    joined = beside(cited, own, keys, "left")
    mine = belongs_to(host(F.col("url")), F.col("_domain")) | _under_profile(F.col("url"), F.col("_profiles"))
    return joined.withColumn("owned", F.coalesce(mine, F.lit(False))).drop("_domain", "_profiles")


def cited_to_check(marked: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Third-party pages with ``to_check``: all of them, or with ``limit`` a site's most cited ones."""
    others = marked.filter(~F.col("owned"))
    if limit is None:
        return others.withColumn("to_check", F.lit(True))
    best = first_n(others, keys, [F.desc("answers"), F.desc("citations"), F.asc("url")], limit).select(*keys, "url", F.lit(True).alias("to_check"))
    return others.join(best, [*keys, "url"], "left").withColumn("to_check", F.coalesce("to_check", F.lit(False)))


def matched_terms(text: Column, links: Column, profile: dict[str, Column]) -> Column:
    """``(by, term)`` for every fingerprint term the page shows."""
    domain = profile["domain"]
    linked = F.exists(links, lambda u: F.coalesce(belongs_to(host(u), domain), F.lit(False)))
    empty = F.array().cast("array<struct<by:string,term:string>>")

    def pair(by: str, term: Column) -> Column:
        return F.struct(F.lit(by).alias("by"), term.alias("term"))

    def words(by: str, terms: Column) -> Column:
        usable = F.filter(F.transform(terms, strip), lambda x: F.length(x) >= 3)
        seen = F.filter(usable, lambda x: F.regexp_like(text, F.concat(F.lit(r"(?iU)(?<!\w)"), literal(x), F.lit(r"(?!\w)"))))
        return F.transform(seen, lambda x: pair(by, x))

    site = F.when(linked, F.array(pair("link", domain))).when(F.lower(text).contains(domain), F.array(pair("domain", domain))).otherwise(empty)
    listed = F.filter(profile["profiles"], lambda p: (page_key(p) != "") & F.exists(links, lambda u: F.startswith(page_key(u), page_key(p))))
    return F.concat(site, F.transform(listed, lambda p: pair("profile", p)), words("name", profile["names"]), words("person", profile["people"]))


def citation_check(cited: DataFrame, captured: DataFrame, profiles: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Every cited page with its status; third-party pages are compared with their captured bodies.

    ``captured``: url, allowed, status, content_type, text, links. One pass over the cited pages: a page that is owned, or with
    ``limit`` not among a site's most cited ones, looks for no body.
    """
    # The cited pages are read for the limit and for the check; they are counted from the answers once.
    marked = cut(mark_owned(cited, profiles, keys))
    if limit is None:
        rows = marked.withColumn("to_check", ~F.col("owned"))
    else:
        best = cited_to_check(marked, keys, limit).filter("to_check").select(*keys, "url", "to_check")
        rows = marked.join(best, [*keys, "url"], "left").withColumn("to_check", F.coalesce("to_check", F.lit(False)))
    own = profiles.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("domain", "profiles", "names", "people")])
    bodies = captured.select(F.col("url").alias("_wanted"), "allowed", F.col("status").alias("_status"), "content_type", "text", "links")
    # Pages without a body to look for have a null key and so meet nothing; each keeps a place of its own by its address.
    wanted = F.when(F.col("to_check"), F.col("url"))
    read = rows.join(bodies, wanted == F.col("_wanted"), "left")
    read = beside(read, own, keys, "left")
    read = read.withColumn("found", matched_terms(F.col("text"), F.col("links"), {c: F.col(f"_{c}") for c in ("domain", "profiles", "names", "people")}))
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    status = F.when(F.col("owned"), "owned").when(~F.col("to_check"), "not_checked").when(F.col("allowed").eqNullSafe(False), "blocked_by_robots").when(
        F.col("_status").isNull() | (F.col("_status") >= 400), "unreachable").when(
        ~(kind.contains("html") | (kind == "") | kind.startswith("text/")), "unreadable").when(
        F.size("found") > 0, "mentioned").otherwise("not_mentioned")
    strong = F.exists("found", lambda f: f["by"].isin("link", "domain", "profile"))
    return read.withColumn("status", status).withColumn("match", F.when(F.col("status") == "mentioned", F.when(strong, "strong").otherwise("name_only"))).select(
        *marked.columns, "status", "match")


def citation_gap_domains(checked: DataFrame, keys: list[str]) -> DataFrame:
    status = F.col("status")
    return checked.filter(status != "owned").groupBy(*keys, "domain").agg(
        F.count("*").alias("pages"), F.sum("citations").alias("citations"),
        F.when(F.bool_or(status == "mentioned"), True).when(F.bool_or(status == "not_mentioned"), False).alias("mentioned"))


def citation_gap_summary(checked: DataFrame, keys: list[str]) -> DataFrame:
    status = F.col("status")
    counts = [F.count_if(status == s).alias(s) for s in ("mentioned", "not_mentioned", "unreachable", "blocked_by_robots", "unreadable", "not_checked")]
    return checked.groupBy(*keys).agg(
        F.count("*").alias("cited_pages"), F.count_if(status == "owned").alias("owned"), F.count_if(status != "owned").alias("third_party"), *counts,
        F.count_if(F.col("match") == "name_only").alias("mentioned_name_only"),
        F.when(F.bool_or(status.isin("unreachable", "blocked_by_robots")), "PARTIAL").otherwise("COMPLETE").alias("status"))
