"""Runs and trends over ``events``: a user is a site, a day a run, an event type a metric."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import runs as R, tracked as K
from ..session import checkpoint_dir
from ..streaming import jobs as J
from .registry import SQL, query

DIRECTIONS = {"click": True, "error": False, "purchase": True, "signup": True, "view": None}
DAY_SQL = """
with d as (select 'www.u' || user_id || '.test' as site, user_id as u, ts::date as day, min(ts) as created_at, count(*) as pages from events group by 1, 2, 3),
runs as (select site, u, day, u || '/' || day as run_id, created_at, pages, case when (u + dayofmonth(day)) % 7 = 0 then 'reputation' else 'scan' end as command from d),
m as (select 'www.u' || user_id || '.test' as site, user_id || '/' || ts::date as run_id, min(ts) as m_at, event_type as key, max(value) as value from events group by 1, 2, 4)
"""


def _site():
    return F.concat(F.lit("www.u"), "user_id", F.lit(".test"))


def _run():
    return F.concat("user_id", F.lit("/"), F.to_date("ts"))


def runs(t):
    day = F.to_date("ts")
    daily = t.events.groupBy(_site().alias("site"), F.col("user_id").alias("u"), day.alias("day"), _run().alias("run_id")).agg(
        F.min(F.col("ts").cast("timestamp")).alias("created_at"), F.count("*").alias("pages"))
    command = F.when((F.col("u") + F.dayofmonth("day")) % 7 == 0, "reputation").otherwise("scan")
    return daily.withColumn("command", command).withColumn("status", F.when(F.col("pages") > 3, "COMPLETE").otherwise("PARTIAL"))


def metrics(t):
    rows = t.events.groupBy(_site().alias("site"), _run().alias("run_id"), F.col("event_type").alias("key")).agg(F.max("value").alias("value"))
    return rows.join(runs(t).select("site", "run_id", "created_at"), ["site", "run_id"])


@query("run_index", DAY_SQL + """
select site, run_id, pages, case when pages > 3 then 'COMPLETE' else 'PARTIAL' end as status from runs where command = 'scan' and pages % 5 <> 0""")
def _(t):
    found = runs(t)
    counts = F.when(F.col("command") == "scan", F.struct("pages"))
    return R.run_index(found.withColumn("counts", counts), found.filter(F.col("pages") % 5 != 0)).select("site", "run_id", "pages", "status")


@query("previous_runs", DAY_SQL + "select run_id, pages from runs where u = 8 and command = 'scan' and created_at < timestamp '2024-01-20'")
def _(t):
    return R.previous_runs(runs(t), "u8.test", F.to_timestamp(F.lit("2024-01-20"))).select("run_id", "pages")


@query("latest_runs", DAY_SQL + "select site, arg_max(run_id, created_at) as run_id, arg_max(pages, created_at) as pages from runs group by 1")
def _(t):
    return R.latest_runs(runs(t)).select("site", "run_id", "pages")


@query("site_list", DAY_SQL + "select site, count(*) as runs, arg_max(run_id, created_at) as newest_run from runs group by 1")
def _(t):
    return R.site_list(runs(t)).select("site", "runs", "newest_run")


@query("standalone_reputation", DAY_SQL + """
, s as (select run_id, pages * 10 as scores from runs where command = 'reputation' or pages % 2 = 0),
alone as (select r.site, arg_max(r.run_id, created_at) as run_id, arg_max(scores, created_at) as scores from runs r join s using (run_id) where command = 'reputation' group by 1)
select r.site, r.run_id, coalesce(s.scores, alone.scores) as scores, case when s.scores is null then alone.run_id end as source
from runs r left join s using (run_id) left join alone on alone.site = r.site where command = 'scan'""")
def _(t):
    found = runs(t)
    scores = found.filter((F.col("command") == "reputation") | (F.col("pages") % 2 == 0)).select("run_id", (F.col("pages") * 10).alias("scores"))
    return R.standalone_reputation(found, scores)


@query("metric_trend", DAY_SQL + """
, recent as (select * from (select site, run_id, row_number() over (partition by site order by created_at desc, run_id desc) as age from runs) where age <= 12),
j as (select * from m join recent using (site, run_id)),
s as (select site, key, max(value) filter (age = 1) as now, arg_min(value, age) filter (age > 1) as before, count(*) as measured, max(age) as oldest from j group by 1, 2),
moved as (select *, case when round_even(now - before, 2) <> 0 then round_even(now - before, 2) end as delta from s)
select site, key, now, before, delta, case when now is null or before is null then null when now = before then 'same' when key = 'view' then null
  when (now > before) = (key <> 'error') then 'better' else 'worse' end as trend, measured, measured < oldest as has_gap, now is null and before is not null as missing from moved""")
def _(t):
    return R.metric_trend(metrics(t), runs(t), directions=DIRECTIONS)


def arriving(t):
    """The runs and their metrics as manifests that have arrived in files."""
    # The rows of ``runs`` and ``metrics`` from one pass over the events; an event without a user or a time is of no run.
    each = t.events.groupBy(_site().alias("site"), _run().alias("run_id"), F.to_date("ts").alias("day"), F.col("user_id"), F.col("event_type").alias("key")).agg(
        F.max("value").alias("value"), F.min(F.col("ts").cast("timestamp")).alias("created_at"), F.count("*").alias("pages"))
    entry = F.when(F.col("site").isNotNull() & F.col("run_id").isNotNull(), F.struct("key", "value"))
    daily = each.groupBy("site", "run_id", "day", "user_id").agg(
        F.collect_list(entry).alias("entries"), F.min("created_at").alias("created_at"), F.sum("pages").alias("pages"))
    rows = daily.select("site", "run_id", "created_at", F.lit("scan").alias("command"), F.lit("COMPLETE").alias("status"), F.struct(F.col("pages").cast("bigint").alias("pages")).alias("counts"),
                        F.when(F.size("entries") > 0, F.map_from_entries("entries")).alias("metrics"))
    folder = f"{checkpoint_dir(t.spark).rstrip('/')}/vitrine-arriving-{uuid.uuid4().hex}"
    # Dealt by run, so that the runs of a site arrive in any order and in several batches.
    rows.repartition(6, "run_id").write.parquet(f"{folder}/in")
    return folder


@query("streamed_metric_trend", SQL["metric_trend"])
def _(t):
    """The trends that a stream holds after all runs have arrived, file by file: the newest batch of every site."""
    folder = arriving(t)
    changes = J.metric_changes(J.read_manifests(t.spark, f"{folder}/in", 2, "parquet"), DIRECTIONS)
    J.run_writer(changes, f"{folder}/out", f"{folder}/state", "update").awaitTermination()
    found = t.spark.read.parquet(f"{folder}/out")
    newest = found.groupBy("site").agg(F.max("batch").alias("batch"))
    return found.join(newest, ["site", "batch"]).drop("batch")


@query("streamed_runs", DAY_SQL + "select site, run_id, created_at, pages::bigint as pages from runs")
def _(t):
    folder = arriving(t)
    J.ingest_runs(J.read_manifests(t.spark, f"{folder}/in", 2, "parquet"), f"{folder}/out", f"{folder}/state").awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").select("site", "run_id", "created_at", "pages")


@query("since_last", DAY_SQL + """
, c as (select r.site, r.run_id, r.created_at, m.key as name, m.value, (r.u + dayofmonth(r.day)) % 4 <> 0 as known, r.pages % 3 <> 0 as found from runs r join m using (site, run_id)),
p as (select *, lag(run_id) over w as then_run, lag(value) over w as then_value, lag(found) over w as then_found from c where known window w as (partition by site, name order by created_at))
select site, run_id, name, then_run as earlier_run, then_value as before, value as after, case when then_value = value then 'same' when (value > then_value) then 'better' else 'worse' end as trend
from p where then_run is not null and (name <> 'purchase' or (found and then_found))""")
def _(t):
    rows = metrics(t).join(runs(t).select("site", "run_id", "u", "day", "pages"), ["site", "run_id"])
    status = F.when((F.col("u") + F.dayofmonth("day")) % 4 != 0, "OBSERVED").otherwise("UNKNOWN")
    # Purchases stand in for the listing, the one check that must be found on both sides.
    name = F.when(F.col("key") == "purchase", "google_business").otherwise(F.col("key"))
    checks = rows.select("site", "run_id", "created_at", name.alias("name"), status.alias("status"), (F.col("pages") % 3 != 0).alias("found"),
                         F.struct("value").alias("data"))
    diff = R.check_diff(R.since_last(checks), {"value": True})
    back = F.when(F.col("name") == "google_business", "purchase").otherwise(F.col("name"))
    return diff.select("site", "run_id", back.alias("name"), "earlier_run", "before", "after", "trend")


@query("wide_metrics", DAY_SQL + """
select site, run_id, max(value) filter (key = 'click') as click, max(value) filter (key = 'error') as error, max(value) filter (key = 'view') as view from m group by 1, 2""")
def _(t):
    return R.wide_metrics(metrics(t), ["click", "error", "view"])


LIST_SQL = DAY_SQL + """, l as (select site, run_id, created_at, u, list_sort(list_distinct(list(key))) as names from m join runs using (site, run_id) group by all),
pair as (select *, lag(names) over (partition by site order by created_at) as old from l)"""


@query("gained_and_lost", LIST_SQL + """
select site, run_id, array_to_string(list_filter(names, lambda x: not list_contains(old, x)), ',') as gained, array_to_string(list_filter(old, lambda x: not list_contains(names, x)), ',') as lost
from pair where old is not null""")
def _(t):
    lists = metrics(t).groupBy("site", "run_id", "created_at").agg(F.array_sort(F.collect_set("key")).alias("names"))
    pairs = R.previous(lists, ["site"], "created_at", F.col("names"), "old").filter(F.col("old").isNotNull())
    moved = R.shift(F.col("old"), F.col("names"))
    return pairs.select("site", "run_id", moved.alias("s")).select("site", "run_id", F.array_join("s.gained", ",").alias("gained"), F.array_join("s.lost", ",").alias("lost"))


@query("shared_questions", """
with q as (select user_id as u, event_type as prompt, ts < timestamp '2024-01-16' as early, round_even(count(*) filter (value > 20)::double / count(*), 3) as rate from events group by 1, 2, 3)
select 'www.u' || a.u || '.test' as site, a.prompt, a.rate as before, b.rate as after, case when a.rate = b.rate then 'same' when b.rate > a.rate then 'better' else 'worse' end as trend
from q a join q b on a.u = b.u and a.prompt = b.prompt and a.early and not b.early""")
def _(t):
    rate = (F.rint(F.count_if(F.col("value") > 20) / F.count("*") * 1000) / 1000).alias("rate")
    half = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    asked = t.events.groupBy(_site().alias("site"), F.col("event_type").alias("prompt"), half.alias("early")).agg(rate)
    return R.shared_questions(asked.filter("early"), asked.filter(~F.col("early")), ["site"])


@query("coverage_trend", """
with q as (select user_id, ts::date as day, min(ts) as t0, ['missing', 'partial', 'answered'][(count(*) % 3 + 1)::int] as coverage from events group by 1, 2),
p as (select *, lag(coverage) over (partition by user_id order by t0) as before from q),
r as (select *, list_position(['missing', 'partial', 'answered'], coverage) as b, list_position(['missing', 'partial', 'answered'], before) as a from p where before is not null)
select case when b > a then 'better' when b < a then 'worse' else 'same' end as trend, before, coverage as after, count(*) as questions from r group by 1, 2, 3""")
def _(t):
    coverage = F.element_at(F.array(F.lit("missing"), F.lit("partial"), F.lit("answered")), (F.col("pages") % 3 + 1).cast("int"))
    asked = R.previous(runs(t).withColumn("coverage", coverage), ["site"], "created_at", F.col("coverage"), "before").filter(F.col("before").isNotNull())
    return asked.groupBy(R.coverage_trend(F.col("before"), F.col("coverage")).alias("trend"), "before", F.col("coverage").alias("after")).agg(F.count("*").alias("questions"))


@query("reuse_questions", """
with r as (select o_custkey as site, o_orderkey as run, o_orderdate + to_seconds(o_orderkey) as t0, case when o_orderstatus = 'P' then '' else o_orderstatus end as icp,
  case when o_orderkey % 4 <> 0 then o_orderkey end as asked from orders),
p as (select *, last_value(asked ignore nulls) over (partition by site, icp order by t0 rows between unbounded preceding and 1 preceding) as earlier from r)
select site, run as run_id, case when icp = 'F' and site % 3 = 0 then case when site % 2 = 0 then -1 end else earlier end as questions_from from p""")
def _(t):
    key = F.col("o_orderkey")
    asked = F.when(key % 4 != 0, F.array(F.lit("Cost?"))).otherwise(F.array().cast("array<string>"))
    found = t.orders.select(F.col("o_custkey").alias("site"), F.lit("ai_search").alias("kind"), key.alias("run_id"),
                            (F.col("o_orderdate") + F.make_dt_interval(secs=key)).cast("timestamp").alias("created_at"), F.lit("COMPLETE").alias("status"),
                            F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("icp"), F.lit(None).cast("string").alias("location"),
                            F.lit(" dentist").alias("category"), asked.alias("questions"))
    sites = t.customer.filter(F.col("c_custkey") % 3 == 0)
    # A third of the sites keep a stored set for one audience; half of those sets were emptied.
    items = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("Stored?"))).otherwise(F.array().cast("array<string>"))
    stored = sites.select(F.col("c_custkey").alias("site"), F.lit("ai_search").alias("kind"), F.lit("F").alias("icp"), F.lit("").alias("location"),
                          F.lit("dentist").alias("category"), items.alias("items"), F.lit(-1).cast("bigint").alias("run_id"))
    return R.reuse_questions(found, stored).select("site", "run_id", "questions_from")


@query("remember_questions", """
with n as (select o_custkey as site, o_orderstatus as icp, arg_min(o_orderkey, o_orderdate + to_seconds(o_orderkey)) as run from orders where o_orderkey % 4 <> 0 group by 1, 2),
s as (select c_custkey as site, 'F' as icp, -1 as run, c_custkey % 2 = 0 as full_set from customer where c_custkey % 3 = 0)
select coalesce(n.site, s.site) as site, coalesce(n.icp, s.icp) as icp, case when full_set then s.run else coalesce(n.run, s.run) end as run_id from n full join s on n.site = s.site and n.icp = s.icp""")
def _(t):
    key = F.col("o_orderkey")
    asked = F.when(key % 4 != 0, F.array(F.lit("Cost?"))).otherwise(F.array().cast("array<string>"))
    found = t.orders.select(F.col("o_custkey").alias("site"), F.col("o_orderstatus").alias("icp"), key.alias("run_id"), asked.alias("items"),
                            (F.col("o_orderdate") + F.make_dt_interval(secs=key)).alias("created_at"))
    items = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("Stored?"))).otherwise(F.array().cast("array<string>"))
    stored = t.customer.filter(F.col("c_custkey") % 3 == 0).select(
        F.col("c_custkey").alias("site"), F.lit("F").alias("icp"), items.alias("items"), F.lit(-1).cast("bigint").alias("run_id"))
    return R.remember(stored, found, ["site", "icp"]).select("site", "icp", "run_id")


@query("snapshot", """
select conv_id as run_id, count(*)::bigint as answers, sum(length(role))::bigint as kept_characters, count(*) / 2.0 as rating from conversations group by 1 having count(*) % 5 <> 0""")
def _(t):
    answer = F.struct(F.col("turn").alias("at"), F.col("role").alias("prompt"), F.col("text").alias("raw_answer"), F.array("role").alias("companies"), F.lit(None).cast("string").alias("error"))
    grouped = t.conversations.groupBy(F.col("conv_id").alias("run_id")).agg(F.array_sort(F.collect_list(answer)).alias("answers"), F.count("*").alias("n"))
    review = F.struct(F.lit("text").alias("text"))
    checks = grouped.select(F.lit("s").alias("site"), "run_id", F.current_timestamp().alias("created_at"), F.lit("ai_search").alias("name"), F.lit(True).alias("found"), "answers",
                            F.when(F.col("n") % 5 == 0, "UNKNOWN").otherwise("COMPLETE").alias("status"),
                            F.struct((F.col("n") / 2.0).alias("rating"), F.col("n").alias("count"), F.array(review).alias("reviews")).alias("reviews"))
    kept = R.snapshot(checks)
    size = F.aggregate("answers", F.lit(0), lambda a, x: a + F.length(x["prompt"]))
    return kept.select("run_id", F.size("answers").cast("bigint").alias("answers"), size.cast("bigint").alias("kept_characters"), "reviews.rating")


#: Which tracked check stands for which event type, and the stored result by the number of the day's events.
TRACKED = {"click": "llm_reputation", "error": "ai_search", "view": "answer_coverage", "signup": "practitioners", "purchase": "google_business"}


def tracked_checks(t):
    """Stored results as JSON, written from the number of a run's events."""
    rows = metrics(t).join(runs(t).select("site", "run_id", "u", "day", F.col("pages").cast("int").alias("k")), ["site", "run_id"])
    k, number = F.col("k"), lambda c: c.cast("double")
    source = lambda domain, own: F.struct(F.lit(domain).alias("domain"), number(k).alias("answers"), F.lit(own).alias("is_target"))
    sources = F.when(k % 3 == 1, F.array(source("other.test", False))).when(k % 3 == 2, F.array(source("other.test", False), source("own.test", True)))
    board = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(F.concat(F.lit("c"), (k + i) % 6).alias("company"), (i == 1).alias("is_target")))
    few = F.slice(F.array(F.lit("city"), F.lit("phone")), F.lit(1), k % 3)
    result = F.to_json(F.struct(
        F.struct((k % 4).alias("rank"), (number(k % 10) / 10).alias("mention_rate"), (number(k % 7) / 8).alias("share_of_voice"), F.struct((k % 3 - 1).alias("score")).alias("sentiment"),
                 sources.alias("sources"), board.alias("leaderboard")).alias("scores"),
        F.struct((k % 5).alias("answered"), (k % 3).alias("partial"), (k % 4).alias("missing"), k.alias("practitioners"), (k % 6).alias("with_dedicated_page"),
                 (k % 2).alias("with_person_schema"), F.when(k % 2 == 1, k).alias("with_same_as")).alias("summary"),
        F.transform(F.sequence(k % 2, k % 3 + 1), lambda i: F.struct(F.concat(F.lit("p"), i).alias("name"))).alias("practitioners"),
        F.struct((number(k % 50) / 10).alias("rating"), (k * 2).alias("count")).alias("reviews"), few.alias("mismatches")))
    status = F.when((F.col("u") + F.dayofmonth("day")) % 4 != 0, "OBSERVED").otherwise("UNKNOWN")
    name = F.coalesce(*[F.when(F.col("key") == event, check) for event, check in TRACKED.items()])
    return rows.select("site", "run_id", "created_at", name.alias("name"), status.alias("status"), (k % 3 != 0).alias("found"), result.alias("data"))


TRACKED_SQL = DAY_SQL + """
, c as (select r.site, r.run_id, r.created_at, case m.key when 'click' then 'llm_reputation' when 'error' then 'ai_search' when 'view' then 'answer_coverage' when 'signup' then 'practitioners' when 'purchase' then 'google_business' end as name,
  r.pages as k, r.pages % 3 <> 0 as found from runs r join m using (site, run_id) where (r.u + dayofmonth(r.day)) % 4 <> 0),
p as (select * from (select site, run_id, name, found, k, lag(run_id) over w as earlier_run, lag(k) over w as j, lag(found) over w as then_found from c where name is not null window w as (partition by site, name order by created_at))
  where earlier_run is not null and (name <> 'google_business' or (found and then_found)))"""


@query("tracked_numbers", TRACKED_SQL + """
, each as (
  select *, unnest([{'label': 'Rank', 'unit': 'rank', 'up': false, 'b': nullif(j % 4, 0)::double, 'a': nullif(k % 4, 0)::double}, {'label': 'Mention rate', 'unit': 'share', 'up': true, 'b': (j % 10)::double / 10, 'a': (k % 10)::double / 10},
    {'label': 'Share of voice', 'unit': 'share', 'up': true, 'b': (j % 7)::double / 8, 'a': (k % 7)::double / 8}, {'label': 'Sentiment', 'unit': 'signed', 'up': true, 'b': (j % 3 - 1)::double, 'a': (k % 3 - 1)::double}]) as x
  from p where name in ('llm_reputation', 'ai_search')
  union all select *, {'label': 'Answers citing your site', 'unit': 'number', 'up': true, 'b': case j % 3 when 1 then 0 when 2 then j end::double, 'a': case k % 3 when 1 then 0 when 2 then k end::double}
  from p where name in ('llm_reputation', 'ai_search') and (j % 3 <> 0 or k % 3 <> 0)
  union all select *, unnest([{'label': 'Answered', 'unit': 'number', 'up': true, 'b': (j % 5)::double, 'a': (k % 5)::double}, {'label': 'Partly answered', 'unit': 'number', 'up': null, 'b': (j % 3)::double, 'a': (k % 3)::double},
    {'label': 'Not answered', 'unit': 'number', 'up': false, 'b': (j % 4)::double, 'a': (k % 4)::double}]) from p where name = 'answer_coverage'
  union all select *, unnest([{'label': 'Practitioners', 'unit': 'number', 'up': true, 'b': j::double, 'a': k::double}, {'label': 'With their own page', 'unit': 'number', 'up': true, 'b': (j % 6)::double, 'a': (k % 6)::double},
    {'label': 'With Person schema', 'unit': 'number', 'up': true, 'b': (j % 2)::double, 'a': (k % 2)::double},
    {'label': 'With sameAs links', 'unit': 'number', 'up': true, 'b': case when j % 2 = 1 then j end::double, 'a': case when k % 2 = 1 then k end::double}]) from p where name = 'practitioners'
  union all select *, unnest([{'label': 'Rating', 'unit': 'number', 'up': true, 'b': (j % 50)::double / 10, 'a': (k % 50)::double / 10}, {'label': 'Reviews', 'unit': 'number', 'up': true, 'b': (j * 2)::double, 'a': (k * 2)::double},
    {'label': 'Facts that differ', 'unit': 'number', 'up': false, 'b': (j % 3)::double, 'a': (k % 3)::double}]) from p where name = 'google_business')
select site, run_id, name, earlier_run, x.label as label, x.unit as unit, x.b as before, x.a as after,
  case when x.b is null or x.a is null then null when x.b = x.a then 'same' when x.up is null then null when (x.a > x.b) = x.up then 'better' else 'worse' end as trend from each""")
def _(t):
    return K.tracked_numbers(tracked_checks(t))


@query("tracked_names", TRACKED_SQL + """
, each as (
  select *, 'Top competitors' as label, ['c' || (j + i) % 6 for i in [0, 2, 3]] as b, ['c' || (k + i) % 6 for i in [0, 2, 3]] as a from p where name in ('llm_reputation', 'ai_search')
  union all select *, 'Top cited sites', case when j % 3 > 0 then ['other.test'] else [] end, case when k % 3 > 0 then ['other.test'] else [] end from p where name in ('llm_reputation', 'ai_search')
  union all select *, 'Practitioners', ['p' || i for i in generate_series(j % 2, j % 3 + 1)], ['p' || i for i in generate_series(k % 2, k % 3 + 1)] from p where name = 'practitioners'
  union all select *, 'Differs from the website', ['city', 'phone'][1:j % 3], ['city', 'phone'][1:k % 3] from p where name = 'google_business')
select site, run_id, name, earlier_run, label, array_to_string(list_filter(a, lambda x: not list_contains(b, x)), ',') as gained, array_to_string(list_filter(b, lambda x: not list_contains(a, x)), ',') as lost
from each where len(list_filter(a, lambda x: not list_contains(b, x))) > 0 or len(list_filter(b, lambda x: not list_contains(a, x))) > 0""")
def _(t):
    found = K.tracked_names(tracked_checks(t))
    return found.withColumn("gained", F.array_join("gained", ",")).withColumn("lost", F.array_join("lost", ","))
