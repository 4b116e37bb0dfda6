"""Runs of a site over time: index, newest and earlier runs, comparisons and trends.

``runs``: site, run_id, created_at, command, status, pages. ``metrics``: site, run_id, created_at, key, value, where a
missing row means "not measured" and never 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fixed
from ..functions.scalars import lookup, rounded
from .ranking import first_n, previous


def finite(value: Column) -> Column:
    """A real number, else NULL: NaN and infinities are not measurements."""
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), number)


def _newest() -> Column:
    """Of runs of one moment the greater id counts as newer."""
    return F.struct("created_at", "run_id")


def run_index(manifests: DataFrame, present: DataFrame) -> DataFrame:
    """Crawl manifests that can be read, of runs that still exist."""
    crawls = manifests.filter(F.col("counts").isNotNull() & F.col("created_at").isNotNull())
    return crawls.join(present.select("run_id"), "run_id", "left_semi").select(
        "site", "run_id", "created_at", "status", F.col("counts.pages").alias("pages"))


def previous_runs(runs: DataFrame, host: str, before=None) -> DataFrame:
    """Earlier crawl runs of a host, newest first; ``www.`` is ignored and reputation-only runs are left out."""
    same = F.regexp_replace("site", r"^www\.", "") == host.removeprefix("www.")
    found = runs.filter(same & ~F.col("command").eqNullSafe("reputation"))
    return (found.filter(F.col("created_at") < before) if before is not None else found).orderBy(F.desc("created_at"), F.desc("run_id"))


def latest_runs(runs: DataFrame) -> DataFrame:
    newest = runs.groupBy("site").agg(F.max_by(F.struct(*[c for c in runs.columns if c != "site"]), _newest()).alias("r"))
    return newest.select("site", "r.*")


def site_list(runs: DataFrame) -> DataFrame:
    return runs.groupBy("site").agg(F.count("*").alias("runs"), F.max_by("run_id", _newest()).alias("newest_run"),
                                    F.max("created_at").alias("created_at")).orderBy(F.desc("created_at"))


def standalone_reputation(runs: DataFrame, reputation: DataFrame) -> DataFrame:
    """Each crawl with its own reputation scores, or those of the site's newest reputation-only run."""
    alone = runs.filter(F.col("command") == "reputation").select("site", "run_id", "created_at").join(
        reputation.select("run_id", "scores"), "run_id").groupBy("site").agg(
        F.max_by(F.struct("run_id", "scores"), _newest()).alias("stand_in"))
    crawls = runs.filter(F.col("command") != "reputation").join(reputation.select("run_id", "scores"), "run_id", "left")
    return crawls.join(alone, "site", "left").select(
        "site", "run_id", F.coalesce("scores", "stand_in.scores").alias("scores"),
        F.when(F.col("scores").isNull(), F.col("stand_in.run_id")).alias("source"))


def trend(before: Column, after: Column, higher_is_better: Column) -> Column:
    """better, worse or same; NULL when a side is missing or the metric has no good direction."""
    return F.when(before.isNull() | after.isNull(), None).when(before == after, "same").when(
        higher_is_better.isNull(), None).when((after > before) == higher_is_better, "better").otherwise("worse")


def metric_trend(metrics: DataFrame, runs: DataFrame, last: int = fixed.TREND_RUNS,
                 directions: dict[str, bool | None] | None = None) -> DataFrame:
    """This run's value of every metric against the newest earlier one among the last runs.

    Only ``last`` runs per site are kept before the join; the comparison is an aggregate per (site, metric), so it needs
    neither a run-by-metric grid nor a window over a site's history.
    """
    recent = first_n(runs.select("site", "run_id", F.col("created_at").alias("_at")), ["site"], [F.desc("_at"), F.desc("run_id")], last, "_age")
    measured = metrics.withColumn("value", finite(F.col("value"))).filter(F.col("value").isNotNull())
    rows = measured.select("site", "run_id", "key", "value").join(recent, ["site", "run_id"])
    now = F.col("_age") == 1
    sides = rows.groupBy("site", "key").agg(
        F.max(F.when(now, F.col("value"))).alias("now"), F.min_by(F.when(~now, F.col("value")), F.when(~now, F.col("_age"))).alias("before"),
        F.count("*").alias("measured"), F.max("_age").alias("oldest"))
    return trend_rows(sides, directions)


def trend_rows(sides: DataFrame, directions: dict[str, bool | None] | None = None) -> DataFrame:
    """Trends from both sides of every metric: ``site, key, now, before``, how often it was ``measured`` and the age of the ``oldest`` run that has it."""
    change = rounded(F.col("now") - F.col("before"), 2)
    better = lookup(F.col("key"), {k: v for k, v in (directions or fixed.METRIC_DIRECTION).items() if v is not None})
    return sides.select(
        "site", "key", "now", "before", F.when(change != 0, change).alias("delta"), trend(F.col("before"), F.col("now"), better).alias("trend"),
        "measured", (F.col("measured") < F.col("oldest")).alias("has_gap"), (F.col("now").isNull() & F.col("before").isNotNull()).alias("missing"))


def since_last(checks: DataFrame) -> DataFrame:
    """Every check of every run with the newest earlier run of the site that has the check.

    ``checks``: site, run_id, created_at, name, status, found, data. A listing is compared only when both runs found it.
    """
    known = checks.filter(~F.col("status").eqNullSafe("UNKNOWN"))
    paired = previous(known, ["site", "name"], "created_at", F.struct("run_id", "created_at", "found", "data"), "then")
    both = (F.col("name") != "google_business") | (F.col("found") & F.col("then.found"))
    return paired.filter(F.col("then").isNotNull() & both)


def check_diff(pairs: DataFrame, metrics: dict[str, bool | None]) -> DataFrame:
    """Before and after of each numeric field of ``data``, with its trend. ``metrics``: field -> higher is better."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(up).cast("boolean").alias("up"), finite(F.col(f"then.data.{m}")).alias("before"),
                                        finite(F.col(f"data.{m}")).alias("after")) for m, up in metrics.items()])).alias("m")
    rows = pairs.select("site", "run_id", "name", F.col("then.run_id").alias("earlier_run"), each)
    return rows.select("site", "run_id", "name", "earlier_run", "m.metric", "m.before", "m.after", trend(F.col("m.before"), F.col("m.after"), F.col("m.up")).alias("trend"))


def shift(before: Column, after: Column) -> Column:
    """Names gained and lost between two lists, in list order."""
    return F.struct(F.filter(after, lambda x: ~F.array_contains(before, x)).alias("gained"),
                    F.filter(before, lambda x: ~F.array_contains(after, x)).alias("lost"))


COVERAGE_RANK = {"missing": 0, "partial": 1, "answered": 2}


def shared_questions(then: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """Questions asked both times with how their value moved."""
    both = then.select(*keys, "prompt", F.col("rate").alias("before")).join(now.select(*keys, "prompt", F.col("rate").alias("after")), [*keys, "prompt"])
    return both.withColumn("trend", trend(F.col("before"), F.col("after"), F.lit(True)))


def coverage_trend(before: Column, after: Column) -> Column:
    rank = [F.coalesce(lookup(c, COVERAGE_RANK), F.lit(-1)) for c in (before, after)]
    return F.when(rank[1] > rank[0], "better").when(rank[1] < rank[0], "worse").otherwise("same")


def reuse_questions(runs: DataFrame, stored: DataFrame) -> DataFrame:
    """Questions for a run: the stored set wins (emptied means write new ones), else the newest earlier run asked for the
    same customer, place and category. ``runs`` rows hold icp, location, category and the questions they used."""
    same = ["site", "kind", "icp", "location", "category"]
    keyed = runs.select("*", *[F.coalesce(F.trim(c), F.lit("")).alias(f"_{c}") for c in same[2:]]).withColumn(
        "_asked", F.when((F.size("questions") > 0) & ~F.col("status").eqNullSafe("UNKNOWN"), F.struct("run_id", "questions")))
    keys = ["site", "kind", *[f"_{c}" for c in same[2:]]]
    found = previous(keyed, keys, "created_at", F.col("_asked"), "_earlier")
    kept = stored.select("site", "kind", *[F.coalesce(F.trim(c), F.lit("")).alias(f"_{c}") for c in same[2:]], F.col("items").alias("_items"), F.col("run_id").alias("_from"))
    joined = found.join(kept, keys, "left")
    has = F.col("_items").isNotNull()
    full = F.size("_items") > 0
    return joined.select("site", "kind", "run_id", F.when(has & full, F.col("_from")).when(~has, F.col("_earlier.run_id")).alias("questions_from"),
                         F.when(has & full, F.col("_items")).when(~has, F.col("_earlier.questions")).alias("reused"))


def remember(stored: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Question sets after these runs: the first run with questions fills a missing or emptied set, others are kept."""
    first = runs.filter(F.size("items") > 0).groupBy(*keys).agg(F.min_by(F.struct("items", "run_id"), "created_at").alias("new"))
    merged = stored.select(*keys, F.struct("items", "run_id").alias("old")).join(first, keys, "full")
    kept = F.when(F.size("old.items") > 0, F.col("old")).otherwise(F.coalesce("new", "old"))
    return merged.select(*keys, kept.alias("kept")).select(*keys, "kept.items", "kept.run_id")


def snapshot(checks: DataFrame) -> DataFrame:
    """What is kept of a check after its bundle is gone: answers without their text, review numbers without reviews."""
    answers = F.transform("answers", lambda a: F.struct(a["prompt"].alias("prompt"), a["companies"].alias("companies"), a["error"].alias("error")))
    return checks.filter(~F.col("status").eqNullSafe("UNKNOWN")).select(
        "site", "run_id", "created_at", "name", "status", "found", answers.alias("answers"),
        F.struct("reviews.rating", "reviews.count").alias("reviews"))


def wide_metrics(metrics: DataFrame, names: list[str]) -> DataFrame:
    """One row per run with a column per metric; the names are given, so no pass is spent finding them."""
    return metrics.groupBy("site", "run_id").pivot("key", names).agg(F.max(finite(F.col("value"))))
