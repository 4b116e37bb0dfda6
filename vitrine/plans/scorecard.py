"""Scorecards over ``lineitem``: supplier group as site, part group as area, return flag as severity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.scalars import whole
from ..operators import scorecard as S
from .registry import query

KEYS = ["site"]
AREAS = ["ai_search", "google_business", "technical", "social_proof", "security", "copy", "answer_coverage", "brand_new"]
LOSS = ["leads", "trust", "visibility", "wasted_effort", "unheard_of"]


def _pick(values, at):
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def _severity():
    late = F.when(F.col("l_tax") == 0, "UNKNOWN").otherwise("PASS")
    return F.when(F.col("l_returnflag") == "A", "FAIL").when(F.col("l_returnflag") == "R", " warning ").otherwise(late)


def lines(t):
    ident = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return t.lineitem.select(
        (F.col("l_suppkey") % 10).alias("site"), ident.alias("finding_id"), F.col("l_partkey").alias("p"), _severity().alias("severity"),
        F.concat(F.lit("Finding "), ident).alias("title"),
        F.struct(F.when(F.col("l_linenumber") != 2, "Lost business").alias("headline"), _pick(LOSS, F.col("l_partkey") % 5).alias("loss_type"),
                 F.lit("buyers").alias("who"), F.lit("how").alias("mechanism"),
                 F.when(F.col("l_quantity") > 40, "HIGH").when(F.col("l_quantity") > 20, "medium").when(F.col("l_quantity") > 10, "low").otherwise("?").alias("magnitude")).alias("impact"))


def pool(t):
    """Findings whose id occurs once: the finding's own fields decide which area claims it."""
    return lines(t).select("site", "finding_id", "severity", "title", "impact")


def claims(t):
    """A ninth of the findings are claimed by no area."""
    rows = lines(t).filter(F.col("p") % 9 < 8)
    return rows.select("site", _pick(AREAS, F.col("p") % 9).alias("area"), "finding_id")


def verdicts(t):
    """Areas with a verdict: one of them has no finding at all."""
    sites = t.supplier.select((F.col("s_suppkey") % 10).alias("site"), "s_suppkey")
    said = F.explode(F.array(F.struct(F.lit("meta_ads").alias("area"), F.when(F.col("s_suppkey") % 3 == 0, "PASS").otherwise("FAIL").alias("verdict")),
                             F.struct(F.lit("copy").alias("area"), F.lit("FAIL").alias("verdict")),
                             F.struct(F.lit("fonts").alias("area"), F.lit("who knows").alias("verdict")))).alias("v")
    return sites.select("site", said).select("site", "v.area", "v.verdict")


def sites(t):
    rows = t.supplier.select((F.col("s_suppkey") % 10).alias("site")).distinct()
    return rows.select("site", F.when(F.col("site") != 3, 2000).cast("bigint").alias("ltv"), (F.col("site") + 10).alias("customers"))


def resolved(t):
    return S.resolve_findings(claims(t), pool(t), KEYS)


def areas(t):
    return S.area_scores(resolved(t), verdicts(t), KEYS)


FIND_SQL = f"""
with f as (select l_suppkey % 10 as site, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as finding_id, l_partkey as p, l_suppkey,
  case l_returnflag when 'A' then 'FAIL' when 'R' then 'WARNING' else case when l_tax = 0 then 'UNKNOWN' else 'PASS' end end as severity,
  l_linenumber <> 2 as told, {LOSS}[(l_partkey % 5 + 1)::int] as loss_type, case when l_quantity > 40 then 0 when l_quantity > 20 then 1 when l_quantity > 10 then 2 else 3 end as magnitude from lineitem),
r as (select *, case when p % 9 < 8 then {AREAS}[(p % 9 + 1)::int] else 'website' end as area, case severity when 'PASS' then 1.0 when 'WARNING' then 0.5 when 'FAIL' then 0.0 end as w from f),
v as (select s_suppkey % 10 as site, 'meta_ads' as area, avg(case when s_suppkey % 3 = 0 then 1.0 else 0.0 end) as w from supplier group by 1 union all
  select s_suppkey % 10, 'fonts', null from supplier group by 1),
a as (select site, area, round_even(avg(w) * 100, 0)::bigint as score, count(*) as findings, count(*) filter (severity = 'FAIL') as fail, count(*) filter (severity = 'WARNING') as warning,
  count(*) filter (severity = 'PASS') as pass, count(*) filter (severity = 'UNKNOWN') as unknown from r group by 1, 2 union all select site, area, round_even(w * 100, 0)::bigint, 0, 0, 0, 0, 0 from v),
o as (select site, round_even(avg(score), 0)::bigint as overall, sum(100 - score)::bigint as gaps, case when site <> 3 then 2000 * (site + 10) end as goal from a group by 1),
g as (select *, round_even(goal * (100 - overall) / 100.0, 0)::bigint as at_risk from o),
split as (select a.*, case when score is not null then round_even(at_risk * (100 - score)::double / gaps, 0)::bigint end as at_risk from a join g using (site))
"""


@query("resolve_findings", FIND_SQL + "select site, area, severity, count(*) as findings, count(distinct finding_id) as ids from r group by 1, 2, 3")
def _(t):
    return resolved(t).groupBy("site", "area", S.word(F.col("severity")).alias("severity")).agg(F.count("*").alias("findings"), F.countDistinct("finding_id").alias("ids"))


@query("area_scores", FIND_SQL + "select site, area, score, findings, fail, warning, pass, unknown from a")
def _(t):
    return areas(t)


@query("overall_and_goal", FIND_SQL + "select site, overall, gaps, goal, at_risk, round_even(at_risk / 12.0, 0)::bigint as monthly from g")
def _(t):
    return S.overall_and_goal(areas(t), sites(t), KEYS)


@query("value_at_risk_split", FIND_SQL + "select site, area, score, at_risk from split")
def _(t):
    scored = areas(t)
    return S.value_at_risk_split(scored, S.overall_and_goal(scored, sites(t), KEYS), KEYS).select("site", "area", "score", "at_risk")


@query("gap_share", FIND_SQL + "select a.site, area, score, (100 - score)::double / gaps as gap_share from a join g using (site)")
def _(t):
    return S.gap_share(areas(t), KEYS).select("site", "area", "score", "gap_share")


STAGE_CASE = "case " + " ".join(f"when area = '{a}' then '{s}'" for a, s in fixed.STAGES.items()) + " else 'Also checked' end"


@query("stage_scores", FIND_SQL + f"""
select site, stage, area, round_even(avg(score), 0)::bigint as score, coalesce(sum(at_risk), 0)::bigint as at_risk, count(*) as areas
from (select *, {STAGE_CASE} as stage from split) group by grouping sets ((site, stage), (site, stage, area))""")
def _(t):
    scored = areas(t)
    return S.stage_scores(S.value_at_risk_split(scored, S.overall_and_goal(scored, sites(t), KEYS), KEYS), KEYS)


WORDS = "case loss_type " + " ".join(f"when '{k}' then '" + v.replace("'", "''") + "'" for k, v in fixed.LOSS_WORDS.items()) + " end"


@query("loss_types", FIND_SQL + f"select site, {WORDS} as loss, count(*) as issues from f where severity <> 'PASS' and told and {WORDS} is not null group by 1, 2")
def _(t):
    return S.loss_types(pool(t), KEYS)


@query("rank_findings", FIND_SQL + """
, top as (select site, finding_id, row_number() over (partition by site order by length(finding_id) desc, finding_id) as n from f where severity = 'FAIL' and told),
given as (select site, finding_id, n from top where n <= 5 and site % 2 = 0),
x as (select f.site, f.finding_id, coalesce(given.n, f.magnitude) as o from f left join given using (site, finding_id) where severity <> 'PASS' and told and (f.site % 2 = 1 or given.n is not null))
select site, finding_id, place from (select *, row_number() over (partition by site order by o, finding_id) as place from x) where place <= 3""")
def _(t):
    from ..operators.ranking import first_n

    told = pool(t).filter((S.word(F.col("severity")) == "FAIL") & F.col("impact.headline").isNotNull() & (F.col("site") % 2 == 0))
    best = first_n(told, KEYS, [F.desc(F.length("finding_id")), F.asc("finding_id")], 5)
    ranked = best.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "finding_id"))), lambda x: x["finding_id"]).alias("ranked"))
    return S.rank_findings(pool(t), ranked, KEYS)


@query("worst_first", FIND_SQL + """
select site, area, arg_min(finding_id, coalesce(w, 2.0)::varchar || '|' || finding_id) as finding_id, min(coalesce(w, 2.0)) = 1.0 as protects from r where told group by 1, 2""")
def _(t):
    return S.worst_first(resolved(t), KEYS)


@query("recommendation_fixes", FIND_SQL + """
, rec as (select site, p % 12 as pos, list(finding_id) as ids from f where p % 4 = 1 group by 1, 2),
hit as (select r.site, r.area, rec.pos, count(*) as findings from r join (select site, pos, unnest(ids) as finding_id from rec) rec using (site, finding_id) group by 1, 2, 3)
select site, area, 'Fix ' || pos as text, findings, place from (select *, row_number() over (partition by site, area order by pos) as place from hit) where place <= 2""")
def _(t):
    recs = lines(t).filter(F.col("p") % 4 == 1).groupBy("site", (F.col("p") % 12).alias("pos")).agg(F.collect_list("finding_id").alias("finding_ids"))
    found = S.recommendation_fixes(resolved(t), recs.withColumn("text", F.concat(F.lit("Fix "), "pos")), KEYS)
    return found.select("site", "area", "text", "findings", "place")


@query("weakest_areas", FIND_SQL + """
select site, area, score, place from (select *, row_number() over (partition by site order by score, area) as place from a where score < 50) where place <= 4""")
def _(t):
    return S.weakest_areas(areas(t), KEYS).select("site", "area", "score", "place")


@query("improve_and_working", FIND_SQL + "select site, area, score, case when score < 80 then 'improve' else 'working' end as list from a where score is not null")
def _(t):
    return S.improve_and_working(areas(t), KEYS)


@query("severity_counts", FIND_SQL + """
select site, severity, case severity when 'FAIL' then 0 when 'WARNING' then 1 when 'UNKNOWN' then 2 else 4 end as severity_rank, count(*) as findings from f group by 1, 2, 3""")
def _(t):
    return S.severity_counts(pool(t), KEYS)


@query("merge_findings", """
with s as (select l_orderkey as k, l_returnflag as flag, l_linestatus, l_linenumber as src from lineitem),
x as (select k, flag, min(src) filter (l_linestatus = 'F') as a from s group by 1, 2), y as (select l_orderkey as k, l_returnflag as flag, min(l_linenumber) as b from lineitem group by 1, 2)
select k as site, flag as finding_id, 'T' || b as title, 'S' || a as severity from x join y using (k, flag)""")
def _(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("site"), F.col("l_returnflag").alias("finding_id"), F.col("l_linenumber").alias("source"),
                             F.concat(F.lit("T"), "l_linenumber").alias("title"), F.when(F.col("l_linestatus") == "F", F.concat(F.lit("S"), "l_linenumber")).alias("severity"))
    return S.merge_findings(rows, ["site"])


@query("score_bands", """
select p_partkey, (p_size * 2)::bigint as score, case when p_size % 7 = 0 then 'UNKNOWN' when p_size * 2 >= 80 then 'PASS' when p_size * 2 >= 50 then 'WARNING' else 'FAIL' end as band,
 case when p_type = 'PROMO' then 'HIGH' when p_type = 'SMALL' then 'INFO' when p_type = 'MEDIUM' then 'MEDIUM' else 'UNKNOWN' end as word from part""")
def _(t):
    score = (F.col("p_size") * 2).cast("bigint")
    said = F.when(F.col("p_type") == "PROMO", " high").when(F.col("p_type") == "SMALL", "Info").otherwise(F.col("p_type"))
    return t.part.select("p_partkey", score.alias("score"), S.band(F.when(F.col("p_size") % 7 != 0, score)).alias("band"), S.word(said).alias("word"))


@query("analytics_area", """
with m as (select c_nationkey as site, count(*) as pages_checked, count(*) filter (c_mktsegment = 'BUILDING') as untagged, c_nationkey % 4 <> 0 as has from customer group by 1)
select site, 'analytics' as area, case when not has then 0 else round_even((pages_checked - untagged)::double / pages_checked * 100, 0) end::bigint as score,
  case when not has then 'FAIL' when untagged > 0 then 'WARNING' else 'PASS' end as verdict, not has as high_risk from m""")
def _(t):
    m = t.customer.groupBy(F.col("c_nationkey").alias("site")).agg(
        F.count("*").alias("pages_checked"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("untagged")).withColumn("has_measurement", F.col("site") % 4 != 0)
    return S.analytics_area(m, KEYS)


@query("verdict_rollup", """
with s as (select c_custkey as k, c_nationkey as n from customer)
select k as site, 'copy' as area, null as part, 'PASS' as verdict, 'fine' as summary from s where n % 2 = 0 union all
select k, 'technical', 'aeo', case when n % 3 = 0 then 'FAIL' else 'UNKNOWN' end, 'parts' from s""")
def _(t):
    part = F.struct(F.when(F.col("c_nationkey") % 3 == 0, "fail").otherwise("maybe").alias("verdict"), F.lit("parts").alias("summary"))
    none = F.create_map().cast("map<string,struct<verdict:string,summary:string>>")
    copy = F.struct(F.when(F.col("c_nationkey") % 2 == 0, "PASS").alias("verdict"), F.lit("fine").alias("summary"), none.alias("parts"))
    tech = F.struct(F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("string").alias("summary"), F.create_map(F.lit("aeo"), part).alias("parts"))
    rows = t.customer.select(F.col("c_custkey").alias("site"), F.create_map(F.lit("copy"), copy, F.lit("technical"), tech).alias("areas"))
    return S.verdict_rollup(rows, KEYS)
