"""Named dimensions of a run: what each one needs and how it is computed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from . import accessibility, checks, citations, evidence, structured, visibility

KEYS = ["site"]
Inputs = dict[str, DataFrame]


@dataclass(frozen=True)
class Dimension:
    """``inputs`` are table names; a result may be the input of a later dimension."""

    inputs: tuple[str, ...]
    collect: Callable[[Inputs], DataFrame]


# In dependency order: citation_gap reads what ai_search collected.
DIMENSIONS: dict[str, Dimension] = {
    "security": Dimension(("pages",), lambda t: checks.https_summary(checks.security_row(t["pages"], KEYS), KEYS)),
    "fonts": Dimension(("pages", "stylesheets"), lambda t: checks.font_summary(checks.page_fonts(t["pages"], t["stylesheets"], KEYS), KEYS)),
    "accessibility": Dimension(("pages",), lambda t: accessibility.accessibility_summary(t["pages"], accessibility.accessibility_elements(t["pages"], KEYS), KEYS)),
    "structured_data": Dimension(("pages",), lambda t: structured.issue_summary(structured.with_issues(t["pages"]), KEYS)),
    "meta_ads": Dimension(("ads",), lambda t: evidence.ad_pages(t["ads"], KEYS)),
    "llm_reputation": Dimension(("answers", "profiles"), lambda t: visibility.leaderboard(visibility.answer_positions(t["answers"], t["profiles"], KEYS), KEYS)),
    "ai_search": Dimension(("search_answers",), lambda t: visibility.cited_pages(t["search_answers"], KEYS)),
    "citation_gap": Dimension(("ai_search", "captured", "profiles"), lambda t: citations.citation_gap_summary(
        citations.citation_check(t["ai_search"], t["captured"], t["profiles"], KEYS), KEYS)),
    "answer_coverage": Dimension(("questions",), lambda t: evidence.coverage_summary(t["questions"], KEYS)),
    "practitioners": Dimension(("people",), lambda t: evidence.practitioner_summary(t["people"], KEYS)),
}


def collect(tables: Inputs, names: list[str] | None = None) -> tuple[Inputs, dict[str, str]]:
    """Results by dimension and a status for each: UNKNOWN when an input is missing, with the missing inputs named."""
    found, status = dict(tables), {}
    results: Inputs = {}
    for name in names or DIMENSIONS:
        dimension = DIMENSIONS[name]
        missing = [i for i in dimension.inputs if i not in found]
        if missing:
            status[name] = f"UNKNOWN: needs {', '.join(missing)}"
            continue
        results[name] = found[name] = dimension.collect(found)
        status[name] = "COLLECTED"
    return results, status


def status_rows(tables: Inputs, sites: DataFrame) -> DataFrame:
    """One row per site and dimension with its status."""
    _, status = collect(tables)
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.lit(s).alias("status")) for n, s in status.items()])).alias("d")
    return sites.select("site", rows).select("site", "d.*")
