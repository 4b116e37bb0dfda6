"""Area scores, money at risk and the findings behind them.

``findings``: keys, finding_id, severity, title, impact STRUCT<headline, loss_type, who, mechanism, magnitude>.
``claims``: keys, area, finding_id. ``verdicts``: keys, area, verdict, summary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as fixed
from ..functions.scalars import first_where, lookup, strip, whole
from .ranking import first_n


def word(value: Column) -> Column:
    """The verdict word, UNKNOWN when it is not one."""
    said = F.upper(strip(F.coalesce(value, F.lit("UNKNOWN"))))
    return F.when(said.isin(list(fixed.VERDICT_RANK)), said).otherwise("UNKNOWN")


def weight(value: Column) -> Column:
    return lookup(word(value), fixed.VERDICT_WEIGHT)


def band(score: Column) -> Column:
    return first_where([(score.isNull(), "UNKNOWN"), (score >= 80, "PASS"), (score >= 50, "WARNING")], "FAIL")


def is_open(severity: Column) -> Column:
    return ~word(severity).isin("PASS", "LOW", "INFO")


def merge_findings(findings: DataFrame, keys: list[str]) -> DataFrame:
    """One finding per id: the first detailed source wins field by field."""
    fields = [c for c in findings.columns if c not in (*keys, "finding_id", "source")]
    return findings.groupBy(*keys, "finding_id").agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("source"))).alias(c) for c in fields])


def resolve_findings(claims: DataFrame, pool: DataFrame, keys: list[str]) -> DataFrame:
    """Findings under the areas that claim them; those no area claims make up the website area."""
    claimed = claims.select(*keys, "area", "finding_id").join(pool, [*keys, "finding_id"])
    rest = pool.join(claims.select(*keys, "finding_id"), [*keys, "finding_id"], "left_anti").withColumn("area", F.lit("website"))
    return claimed.unionByName(rest)


def area_scores(resolved: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Mean verdict weight per area as 0-100, from its findings, else from its verdicts. UNKNOWN counts for nothing."""
    said = verdicts.groupBy(*keys, "area").agg(F.avg(weight(F.col("verdict"))).alias("_verdict"))
    severity = word(F.col("severity"))
    found = resolved.groupBy(*keys, "area").agg(
        F.avg(weight(F.col("severity"))).alias("_found"), F.count("*").alias("findings"),
        *[F.count_if(severity == s).alias(s.lower()) for s in ("FAIL", "WARNING", "PASS", "UNKNOWN")])
    joined = found.join(said, [*keys, "area"], "full").na.fill(0, ["findings", "fail", "warning", "pass", "unknown"])
    score = F.when(F.col("findings") > 0, F.col("_found")).otherwise(F.col("_verdict"))
    return joined.select(*keys, "area", whole(score * 100).alias("score"), "findings", "fail", "warning", "pass", "unknown")


def analytics_area(measurement: DataFrame, keys: list[str]) -> DataFrame:
    """The analytics area from the share of tagged pages; none at all is a high risk."""
    checked = F.col("pages_checked")
    bare = F.when(F.col("untagged").between(0, checked), F.col("untagged")).otherwise(0)
    has = F.coalesce("has_measurement", F.lit(False))
    return measurement.filter(checked >= 1).select(
        *keys, F.lit("analytics").alias("area"), F.when(~has, F.lit(0)).otherwise(whole((checked - bare) / checked * 100)).cast("bigint").alias("score"),
        F.when(~has, "FAIL").when(bare > 0, "WARNING").otherwise("PASS").alias("verdict"), (~has).alias("high_risk"))


def overall_and_goal(areas: DataFrame, sites: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the scored areas, the growth goal, and the part of it at risk."""
    mean = areas.groupBy(*keys).agg(whole(F.avg("score")).alias("overall"), F.sum(F.lit(100) - F.col("score")).alias("gaps"))
    joined = mean.join(sites.select(*keys, "ltv", "customers"), keys, "left")
    goal = F.when((F.col("ltv") > 0) & (F.col("customers") > 0) & F.col("overall").isNotNull(), F.col("ltv") * F.col("customers"))
    at_risk = whole(goal * (F.lit(100) - F.col("overall")) / 100)
    return joined.select(*keys, "overall", "gaps", goal.alias("goal"), at_risk.alias("at_risk"), whole(at_risk / 12).alias("monthly"))


def value_at_risk_split(areas: DataFrame, overall: DataFrame, keys: list[str]) -> DataFrame:
    """Each scored area's share of the money at risk, by its share of the gaps."""
    joined = areas.join(overall.select(*keys, F.col("at_risk").alias("_total"), "gaps"), keys)
    part = F.when(F.col("gaps") > 0, whole(F.col("_total") * (F.lit(100) - F.col("score")) / F.col("gaps"))).otherwise(F.lit(0))
    return joined.withColumn("at_risk", F.when(F.col("score").isNotNull() & F.col("_total").isNotNull(), part)).drop("_total", "gaps")


def stage_scores(areas: DataFrame, keys: list[str], stages: dict[str, str] | None = None) -> DataFrame:
    """Mean score and summed money at risk per stage and area, with stage totals from one rollup."""
    staged = areas.withColumn("stage", lookup(F.col("area"), stages or fixed.STAGES, "Also checked"))
    sets = [[*map(F.col, keys), F.col("stage")], [*map(F.col, keys), F.col("stage"), F.col("area")]]
    return staged.groupingSets(sets, *keys, "stage", "area").agg(
        whole(F.avg("score")).alias("score"), F.coalesce(F.sum("at_risk"), F.lit(0)).alias("at_risk"), F.count("*").alias("areas"))


def loss_types(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Open issues per way of losing business."""
    story = lookup(F.col("impact.loss_type"), fixed.LOSS_WORDS)
    told = F.coalesce("impact.headline", F.lit("")) != ""
    return findings.filter(is_open(F.col("severity")) & told & story.isNotNull()).groupBy(*keys, story.alias("loss")).agg(F.count("*").alias("issues"))


def rank_findings(findings: DataFrame, ranked: DataFrame, keys: list[str], limit: int = 3) -> DataFrame:
    """The costliest open findings: in the report's own order when it gives one, else by magnitude."""
    told = F.coalesce("impact.headline", F.lit("")) != ""
    rows = findings.filter(is_open(F.col("severity")) & told).join(ranked.select(*keys, "ranked"), keys, "left").withColumn(
        "_given", F.nullif(F.array_position(F.coalesce("ranked", F.array().cast("array<string>")), F.col("finding_id")), F.lit(0)))
    # A run whose report ranks none of its open findings falls back to magnitude.
    has = rows.filter(F.col("_given").isNotNull()).select(*keys).distinct().withColumn("_has", F.lit(True))
    rows = rows.join(has, keys, "left").filter(F.col("_has").isNull() | F.col("_given").isNotNull())
    size = lookup(F.lower("impact.magnitude"), fixed.MAGNITUDE_RANK, 3)
    order = [F.coalesce(F.col("_given"), size.cast("bigint")), F.col("finding_id")]
    return first_n(rows, keys, order, limit, "place").select(*keys, "finding_id", "place")


def worst_first(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Each area's gravest finding with a story, and whether that story is something the area protects."""
    told = findings.filter(F.coalesce("impact.headline", F.lit("")) != "")
    grave = F.struct(F.coalesce(weight(F.col("severity")), F.lit(2.0)), "finding_id")
    return told.groupBy(*keys, "area").agg(F.min_by(F.struct("finding_id", "severity"), grave).alias("w")).select(
        *keys, "area", "w.finding_id", (~is_open(F.col("w.severity"))).alias("protects"))


def recommendation_fixes(resolved: DataFrame, recommendations: DataFrame, keys: list[str], limit: int = 2) -> DataFrame:
    """The first recommendations that touch an area's findings. ``recommendations``: keys, pos, text, finding_ids."""
    aims = recommendations.select(*keys, "pos", "text", F.explode(F.array_distinct("finding_ids")).alias("finding_id"))
    hits = resolved.select(*keys, "area", "finding_id").join(aims, [*keys, "finding_id"]).groupBy(*keys, "area", "pos", "text").agg(F.count("*").alias("findings"))
    return first_n(hits, [*keys, "area"], [F.col("pos")], limit, "place")


def weakest_areas(areas: DataFrame, keys: list[str], below: int = 50, limit: int = 4) -> DataFrame:
    return first_n(areas.filter(F.col("score") < below), keys, [F.col("score"), F.col("area")], limit, "place")


def improve_and_working(areas: DataFrame, keys: list[str]) -> DataFrame:
    """Areas under 80 to improve, the others working; unscored areas are neither."""
    return areas.filter(F.col("score").isNotNull()).select(
        *keys, "area", "score", F.when(F.col("score") < 80, "improve").otherwise("working").alias("list")).orderBy(*keys, "list", "score", "area")


def severity_counts(findings: DataFrame, keys: list[str]) -> DataFrame:
    rank = lookup(word(F.col("severity")), fixed.VERDICT_RANK)
    return findings.groupBy(*keys, word(F.col("severity")).alias("severity"), rank.alias("severity_rank")).agg(F.count("*").alias("findings"))


def verdict_rollup(analysis: DataFrame, keys: list[str]) -> DataFrame:
    """``(area, verdict, summary)`` of each area and of the parts one level below it.

    ``areas``: MAP<STRING, STRUCT<verdict, summary, parts MAP<STRING, STRUCT<verdict, summary>>>>.
    """
    top = analysis.select(*keys, F.explode("areas").alias("area", "a"))
    own = top.filter(F.col("a.verdict").isNotNull()).select(*keys, "area", F.lit(None).cast("string").alias("part"), word(F.col("a.verdict")).alias("verdict"), "a.summary")
    parts = top.select(*keys, "area", F.explode("a.parts").alias("part", "p")).filter(F.col("p.verdict").isNotNull()).select(
        *keys, "area", "part", word(F.col("p.verdict")).alias("verdict"), "p.summary")
    return own.unionByName(parts)


def gap_share(areas: DataFrame, keys: list[str]) -> DataFrame:
    """Each area's share of its run's total gap. A run has a handful of areas, so the window is small by nature."""
    total = F.sum(F.lit(100) - F.col("score")).over(Window.partitionBy(*keys))
    return areas.withColumn("gap_share", (F.lit(100) - F.col("score")) / F.nullif(total, F.lit(0)))
