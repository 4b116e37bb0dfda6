"""Rows of work per area: what a check found that somebody can change on the site.

Every list is a filter over page records or check results with the site's keys, ready for ``dashboard.work_items``. Lists of
pages, elements, questions and people are row-local; lists about a whole site have a few rows per site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fixed


def _present(*items: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(condition, F.lit(text)) for condition, text in items]))


def analytics_worklist(pages: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, kind, url)`` from pages with ``tools``: a site without any analytics, pages that load none where others do, no consent tool."""
    measured = F.exists("tools", lambda x: x["category"].isin(fixed.MEASURING))
    consent = F.exists("tools", lambda x: x["category"] == "consent")
    flags = pages.groupBy(*keys).agg(F.bool_or(measured).alias("_measured"), F.bool_or(consent).alias("_consent"))
    kinds = _present((~F.col("_measured"), "no_analytics"), (~F.col("_consent"), "no_consent_tool"))
    site = flags.select(*keys, F.explode(kinds).alias("kind"), F.lit(None).cast("string").alias("url"))
    some = flags.filter("_measured").select(*keys)
    missing = pages.filter(~measured).join(some, keys, "left_semi").select(*keys, F.lit("page_without_analytics").alias("kind"), "url")
    return site.unionByName(missing)


def header_worklist(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, problem, pages)`` from security rows: each header that pages lack, and pages that are not served over HTTPS."""
    lacking = rows.select(*keys, F.explode("missing_headers").alias("problem"))
    plain = rows.filter(~F.col("https")).select(*keys, F.lit("not served over HTTPS").alias("problem"))
    return lacking.unionByName(plain).groupBy(*keys, "problem").agg(F.count("*").alias("pages"))


def structured_worklist(pages: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, url, severity, problem)`` from pages with ``dom`` and ``issues``: blocks that do not parse, then each issue once a page."""
    broken = pages.filter(F.col("dom.json_errors") > 0).select(*keys, "url", F.lit("error").alias("severity"), F.lit("JSON-LD doesn't parse").alias("problem"))
    named = F.concat_ws(" ", "i.type", "i.code", "i.property")
    found = pages.select(*keys, "url", F.explode(F.array_distinct("issues")).alias("i")).select(*keys, "url", "i.severity", named.alias("problem"))
    return broken.unionByName(found)


def preview_worklist(pages: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, url, issues)`` of pages whose link preview has an issue; an issue is its tag and code."""
    issues = F.transform("preview_issues", lambda i: F.concat_ws(" ", i["tag"], i["code"]))
    return pages.filter(F.size("preview_issues") > 0).select(*keys, "url", issues.alias("issues"))


def accessibility_worklist(findings: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, url, rule, wcag, problem, element)``: one row per element to mend."""
    return findings.select(*keys, "url", "rule", F.col("criterion").alias("wcag"), F.col("criterion_title").alias("problem"), F.col("html").alias("element"))


def proof_worklist(summary: DataFrame, google: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, problem)``: no proof shown, nobody asked for any, no Google reviews.

    ``summary``: keys, has_proof, has_ask. ``google``: keys, found, reviews; a site that was not looked up has no row.
    """
    state = F.when(~F.col("found"), "no Google listing matched").when(F.coalesce("reviews", F.lit(0)) <= 0, "the Google listing has no reviews")
    looked = google.select(*keys, state.alias("problem")).filter(F.col("problem").isNotNull())
    shown = _present((~F.col("has_proof"), "no reviews or testimonials shown"), (~F.col("has_ask"), "no review, testimonial or referral asked for"))
    return summary.select(*keys, F.explode(shown).alias("problem")).unionByName(looked)


def question_worklist(questions: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, question, coverage, best_url, gap)`` of buyer questions that the site answers partly or not at all."""
    return questions.filter(F.col("coverage").isin("missing", "partial")).select(*keys, "question", "coverage", "best_url", "gap")


def practitioner_worklist(people: DataFrame, keys: list[str], reviewed: DataFrame | None = None) -> DataFrame:
    """``(keys, name, page, missing)`` of people whose profile lacks a page of its own, Person data or links.

    ``people``: keys, name, profile_url, dedicated_page, person_schema, same_as. ``reviewed``: keys, verdict, name; where it has
    rows for a site, a PASS means nothing to do and the names it gives are the only people that count.
    """
    missing = _present((~F.col("dedicated_page"), "own page"), (~F.col("person_schema"), "Person schema"), (~F.col("same_as"), "sameAs links"))
    rows = people.withColumn("missing", missing).filter(F.size("missing") > 0)
    if reviewed is not None:
        passed = reviewed.filter(F.col("verdict") == "PASS").select(*keys).distinct()
        named = reviewed.filter(F.col("name").isNotNull()).select(*keys, F.lower("name").alias("_name")).distinct()
        rows = rows.join(passed, keys, "left_anti").withColumn("_name", F.lower("name"))
        sites = named.select(*keys).distinct().withColumn("_named", F.lit(True))
        kept = named.withColumn("_kept", F.lit(True))
        rows = rows.join(sites, keys, "left").join(kept, [*keys, "_name"], "left").filter(F.col("_named").isNull() | F.col("_kept"))
    return rows.select(*keys, "name", F.col("profile_url").alias("page"), "missing")
