"""Static accessibility rules over the elements of a page, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fixed
from ..functions.scalars import lookup
from .pages import NODES, exclusion_reason


def _attr(node: Column, name: str) -> Column:
    """The attribute's text; empty when absent or valueless."""
    return F.coalesce(node["attrs"][name], F.lit(""))


def _has(node: Column, name: str) -> Column:
    return F.map_contains_key(node["attrs"], name)


def _inside(inner: Column, outer: Column) -> Column:
    return (inner["idx"] > outer["idx"]) & (inner["idx"] <= outer["last"])


def _named(node: Column) -> Column:
    """By aria-labelledby (an existing element with text), aria-label or title."""
    return node["refers"] | (F.trim(_attr(node, "aria-label")) != "") | (F.trim(_attr(node, "title")) != "")


def _control_missing(node: Column) -> Column:
    kind = F.when(node["tag"] == "input", F.lower(F.coalesce(node["attrs"]["type"], F.lit("text")))).otherwise(node["tag"])
    filled = F.trim(_attr(node, "value")) != ""
    by_type = F.when(kind.isin("submit", "reset"), ~_has(node, "value") | filled).when(kind == "button", filled).when(
        kind == "image", F.trim(_attr(node, "alt")) != "").otherwise(F.lit(False))
    return ~(_named(node) | node["labelled"] | by_type)


def accessibility_elements(pages: DataFrame, keys: list[str]) -> DataFrame:
    """One row per checked element: rule, place in the source, and whether the rule's condition is missing."""
    prepared = pages.filter(exclusion_reason().isNull()).select(*keys, "url", "dom")
    head = F.filter(NODES, lambda n: n["tag"] == "head")
    title = F.get(F.filter(NODES, lambda n: (n["tag"] == "title") & F.exists(head, lambda h: _inside(n, h))), 0)
    root = F.get(F.filter(NODES, lambda n: n["tag"] == "html"), 0)

    def row(rule: Column, node: Column, missing: Column) -> Column:
        return F.struct(rule.alias("rule"), F.coalesce(node["line"], F.lit(1)).alias("line"), F.coalesce(node["col"], F.lit(1)).alias("col"),
                        node["html"].alias("html"), F.coalesce(missing, F.lit(True)).alias("missing"))

    seen = F.filter(NODES, lambda n: ~n["hidden"] & (
        (n["tag"] == "img") | ((n["tag"] == "input") & (F.lower(_attr(n, "type")) != "hidden")) | n["tag"].isin("select", "textarea", "button", "iframe")
        | ((n["tag"] == "a") & _has(n, "href"))))
    rule = lambda n: lookup(n["tag"], {"img": "image-alternative", "input": "control-name", "select": "control-name", "textarea": "control-name",
                                       "button": "button-name", "a": "link-name", "iframe": "frame-name"})
    missing = lambda n: F.when(n["tag"] == "img", ~_has(n, "alt") & ~_named(n) & ~_attr(n, "role").isin("none", "presentation")).when(
        n["tag"].isin("input", "select", "textarea"), _control_missing(n)).when(n["tag"] == "iframe", ~_named(n)).otherwise(
        ~(_named(n) | n["has_text"] | n["names_inside"]))
    whole_page = F.array(row(F.lit("page-title"), title, ~title["has_text"]), row(F.lit("html-lang"), root, F.trim(_attr(root, "lang")) == ""))
    rows = F.concat(whole_page, F.transform(seen, lambda n: row(rule(n), n, missing(n))))
    return prepared.select(*keys, "url", F.explode(rows).alias("r")).select(*keys, "url", "r.*")


def accessibility_findings(elements: DataFrame) -> DataFrame:
    criterion = lookup(F.col("rule"), {rule: wcag[0] for rule, wcag in fixed.WCAG.items()})
    title = lookup(F.col("rule"), {rule: wcag[1] for rule, wcag in fixed.WCAG.items()})
    return elements.filter("missing").drop("missing").withColumn("criterion", criterion).withColumn("criterion_title", title)


def rule_checks(elements: DataFrame, keys: list[str]) -> DataFrame:
    return elements.groupBy(*keys, "url", "rule").agg(
        F.count("*").alias("elements"), F.when(F.bool_or("missing"), "WARNING").otherwise("PASS").alias("status"))


def accessibility_summary(pages: DataFrame, elements: DataFrame, keys: list[str]) -> DataFrame:
    """Pages checked, pages left out, findings and status per site."""
    reason = exclusion_reason()
    checked = pages.groupBy(*keys).agg(F.count_if(reason.isNull()).alias("pages_checked"), F.count_if(reason.isNotNull()).alias("pages_excluded"))
    found = elements.groupBy(*keys).agg(F.count_if("missing").alias("findings"))
    joined = checked.join(found, keys, "left").na.fill(0, ["findings"])
    return joined.withColumn("status", F.when(F.col("pages_checked") == 0, "UNKNOWN").when(F.col("findings") > 0, "WARNING").otherwise("PASS"))


def exclusions(pages: DataFrame, keys: list[str]) -> DataFrame:
    return pages.withColumn("reason", exclusion_reason()).filter(F.col("reason").isNotNull()).groupBy(*keys, "reason").agg(F.count("*").alias("pages"))
