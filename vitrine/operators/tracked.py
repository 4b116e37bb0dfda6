"""What moved in each tracked check since the newest earlier run that has it: typed rules over both runs' stored results."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .runs import finite, shift, since_last, trend

#: The parts of a stored result that the rules read; other parts are not parsed, absent ones are NULL.
RESULT = ("struct<scores:struct<rank:double,mention_rate:double,share_of_voice:double,sentiment:struct<score:double>,"
          "sources:array<struct<domain:string,answers:double,is_target:boolean>>,leaderboard:array<struct<company:string,is_target:boolean>>>,"
          "summary:struct<answered:double,partial:double,missing:double,practitioners:double,with_dedicated_page:double,with_person_schema:double,with_same_as:double>,"
          "practitioners:array<struct<name:string>>,reviews:struct<rating:double,count:double>,mismatches:array<string>>")

REPUTATION = ("llm_reputation", "ai_search")


@dataclass(frozen=True)
class Number:
    """A number of a check: ``higher`` is better, worse (False) or neither (None). ``shown`` says which results have it at all."""
    checks: tuple[str, ...]
    label: str
    value: Callable[[Column], Column]
    higher: bool | None = True
    unit: str = "number"
    shown: Callable[[Column], Column] | None = None


@dataclass(frozen=True)
class Names:
    """A list of names of a check, in its order."""
    checks: tuple[str, ...]
    label: str
    value: Callable[[Column], Column]


def _own_answers(result: Column) -> Column:
    """Answers that cite the site itself: 0 where others are cited only, NULL where no source is known."""
    sources = result["scores"]["sources"]
    own = F.get(F.filter(sources, lambda s: s["is_target"]), 0)
    return F.when(own.isNotNull(), own["answers"]).when(F.size(sources) > 0, 0.0)


def _others(rows: Column, name: str, first: int) -> Column:
    return F.transform(F.filter(F.slice(rows, 1, first), lambda r: ~F.coalesce(r["is_target"], F.lit(False)) & r[name].isNotNull()), lambda r: r[name])


NUMBERS = [
    Number(REPUTATION, "Rank", lambda r: F.nullif(r["scores"]["rank"], F.lit(0.0)), False, "rank"),
    Number(REPUTATION, "Mention rate", lambda r: r["scores"]["mention_rate"], unit="share"),
    Number(REPUTATION, "Share of voice", lambda r: r["scores"]["share_of_voice"], unit="share"),
    Number(REPUTATION, "Sentiment", lambda r: r["scores"]["sentiment"]["score"], unit="signed"),
    Number(REPUTATION, "Answers citing your site", _own_answers, shown=lambda r: r["scores"]["sources"].isNotNull()),
    Number(("answer_coverage",), "Answered", lambda r: r["summary"]["answered"]),
    Number(("answer_coverage",), "Partly answered", lambda r: r["summary"]["partial"], None),
    Number(("answer_coverage",), "Not answered", lambda r: r["summary"]["missing"], False),
    Number(("practitioners",), "Practitioners", lambda r: r["summary"]["practitioners"]),
    Number(("practitioners",), "With their own page", lambda r: r["summary"]["with_dedicated_page"]),
    Number(("practitioners",), "With Person schema", lambda r: r["summary"]["with_person_schema"]),
    Number(("practitioners",), "With sameAs links", lambda r: r["summary"]["with_same_as"]),
    Number(("google_business",), "Rating", lambda r: r["reviews"]["rating"]),
    Number(("google_business",), "Reviews", lambda r: r["reviews"]["count"]),
    Number(("google_business",), "Facts that differ", lambda r: F.coalesce(F.size(r["mismatches"]), F.lit(0)).cast("double"), False),
]
NAMES = [
    Names(REPUTATION, "Top competitors", lambda r: _others(r["scores"]["leaderboard"], "company", 5)),
    Names(REPUTATION, "Top cited sites", lambda r: _others(r["scores"]["sources"], "domain", 10)),
    Names(("practitioners",), "Practitioners", lambda r: F.filter(F.transform(r["practitioners"], lambda p: p["name"]), lambda n: n.isNotNull())),
    Names(("google_business",), "Differs from the website", lambda r: F.filter(r["mismatches"], lambda m: m.isNotNull())),
]


def tracked_pairs(checks: DataFrame, rules: list[Number] | list[Names] = NUMBERS) -> DataFrame:
    """Tracked checks of every run beside the newest earlier run of the site that has the check.

    ``checks``: site, run_id, created_at, name, status, found, data (the stored result as JSON). A result is parsed once, before
    the runs meet, so only what the rules read is shuffled. Results that are no JSON object have NULL in every part.
    """
    tracked = sorted({name for rule in rules for name in rule.checks})
    return since_last(checks.filter(F.col("name").isin(*tracked)).withColumn("data", F.from_json("data", RESULT)))


def tracked_numbers(checks: DataFrame, rules: list[Number] = NUMBERS) -> DataFrame:
    """``(site, run_id, name, earlier_run, label, unit, before, after, trend)``: one row per tracked number of a run."""
    now, then = F.col("data"), F.col("then.data")
    rows = []
    for rule in rules:
        applies = F.col("name").isin(*rule.checks)
        if rule.shown:
            applies = applies & (rule.shown(now) | rule.shown(then))
        rows.append(F.when(applies, F.struct(F.lit(rule.label).alias("label"), F.lit(rule.unit).alias("unit"), F.lit(rule.higher).cast("boolean").alias("higher"),
                                             finite(rule.value(then)).alias("before"), finite(rule.value(now)).alias("after"))))
    each = F.explode(F.array_compact(F.array(*rows))).alias("m")
    found = tracked_pairs(checks, rules).select("site", "run_id", "name", F.col("then.run_id").alias("earlier_run"), each)
    return found.select("site", "run_id", "name", "earlier_run", "m.label", "m.unit", "m.before", "m.after", trend(F.col("m.before"), F.col("m.after"), F.col("m.higher")).alias("trend"))


def tracked_names(checks: DataFrame, rules: list[Names] = NAMES) -> DataFrame:
    """``(site, run_id, name, earlier_run, label, gained, lost)``: names that came or went, in list order; lists that hold the same names have no row."""
    none = F.array().cast("array<string>")
    rows = []
    for rule in rules:
        moved = shift(F.coalesce(rule.value(F.col("then.data")), none), F.coalesce(rule.value(F.col("data")), none))
        rows.append(F.when(F.col("name").isin(*rule.checks), F.struct(F.lit(rule.label).alias("label"), moved.alias("moved"))))
    each = F.explode(F.array_compact(F.array(*rows))).alias("m")
    found = tracked_pairs(checks, rules).select("site", "run_id", "name", F.col("then.run_id").alias("earlier_run"), each)
    return found.select("site", "run_id", "name", "earlier_run", "m.label", "m.moved.gained", "m.moved.lost").filter((F.size("gained") > 0) | (F.size("lost") > 0))
