"""Work lists over the checks of captured pages, buyer questions and people."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accessibility as A, checks as C, dashboard as B, social as SO, worklists as W
from ..session import cut
from . import derived as D
from .checks import A11Y_SQL, ISSUE_SQL, P_SQL, PREVIEW_SQL, PROOF_SQL, SECURITY_SQL
from .registry import query

KEYS = ["site"]


ANALYTICS_SQL = P_SQL + """
, f as (select site, bool_or(k % 5 in (1, 2)) as measured, bool_or(k % 5 = 3) as consent from p group by 1),
analytics as (select site, 'no_analytics' as kind, null as url from f where not measured union all select site, 'no_consent_tool', null from f where not consent
  union all select p.site, 'page_without_analytics', url from p join f on p.site = f.site and measured where k % 5 not in (1, 2))"""


def _analytics(t, found=None):
    return W.analytics_worklist(D.with_tools(t, found), KEYS)


@query("analytics_worklist", ANALYTICS_SQL + " select site, kind, url from analytics")
def _(t):
    return _analytics(t)


HEADER_SQL = SECURITY_SQL + """
, headers as (select site, problem, count(*) as pages from (select site, unnest(missing) as problem from s union all select site, 'not served over HTTPS' from s where not https) group by 1, 2)"""


def _headers(t, found=None):
    return W.header_worklist(C.security_row(D.records(t, "script_sources", "images") if found is None else found, KEYS), KEYS)


@query("header_worklist", HEADER_SQL + " select site, problem, pages from headers")
def _(t):
    return _headers(t)


STRUCTURED_SQL = ISSUE_SQL + """
, structured as (select site, k, 'error' as severity, 'JSON-LD doesn''t parse' as problem from p where k % 6 = 4
  union all select site, k, split_part(x, '|', 1), trim(regexp_replace(split_part(x, '|', 2) || ' ' || split_part(x, '|', 3) || ' ' || split_part(x, '|', 4), ' +', ' ', 'g')) from (select distinct site, k, x from i))"""


def _structured(t, found=None):
    return W.structured_worklist(D.with_issues(t, found), [*KEYS, "page_no"])


@query("structured_worklist", STRUCTURED_SQL + " select site, k as page_no, severity, problem from structured")
def _(t):
    return _structured(t).select("site", "page_no", "severity", "problem")


def _previews(t):
    return W.preview_worklist(C.preview_issues(D.records(t, "social_meta", "canonical_url")), [*KEYS, "page_no"])


@query("preview_worklist", PREVIEW_SQL + """
select site, k as page_no, string_agg(split_part(x, '|', 3) || ' ' || split_part(x, '|', 2), ',' order by split_part(x, '|', 3) || ' ' || split_part(x, '|', 2)) as issues from i group by 1, 2""")
def _(t):
    return _previews(t).select("site", "page_no", F.array_join(F.array_sort("issues"), ",").alias("issues"))


def _accessibility(t, found=None):
    return W.accessibility_worklist(A.accessibility_findings(A.accessibility_elements(D.records(t, "lines") if found is None else found, [*KEYS, "page_no"])), [*KEYS, "page_no"])


@query("accessibility_worklist", A11Y_SQL + """
select site, k as page_no, rule, case rule when 'page-title' then '2.4.2' when 'html-lang' then '3.1.1' when 'image-alternative' then '1.1.1' when 'link-name' then '2.4.4' else '4.1.2' end as wcag,
  unnest(range(bad)) as n from e where bad > 0""")
def _(t):
    rows = _accessibility(t).groupBy("site", "page_no", "rule", "wcag").agg(F.count("*").alias("_n"))
    return rows.select("site", "page_no", "rule", "wcag", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("n"))


GOOGLE_SQL = """
, google as (select site, max(k) % 3 <> 0 as found, max(k) % 4 as reviews from p group by 1 having max(k) % 5 <> 0),
proof as (select site, 'no reviews or testimonials shown' as problem from (select site, bool_or(coalesce(kind not in ('review_link', 'referral_ask'), false)) as ok from p left join x using (site, k) group by 1) where not ok
  union all select site, 'no review, testimonial or referral asked for' from (select site, bool_or(coalesce(kind in ('review_link', 'referral_ask'), false)) as ok from p left join x using (site, k) group by 1) where not ok
  union all select site, case when not found then 'no Google listing matched' else 'the Google listing has no reviews' end from google where not found or reviews = 0)"""


def _proof(t):
    pages = D.with_signals(t)
    last = pages.groupBy("site").agg(F.max("page_no").alias("k")).filter(F.col("k") % 5 != 0)
    google = last.select("site", (F.col("k") % 3 != 0).alias("found"), (F.col("k") % 4).alias("reviews"))
    return W.proof_worklist(SO.proof_summary(pages, KEYS), google, KEYS)


@query("proof_worklist", PROOF_SQL + GOOGLE_SQL + " select site, problem from proof")
def _(t):
    return _proof(t)


def _questions(t):
    k = F.col("conv_id") + F.col("turn")
    coverage = F.when(k % 3 == 0, "answered").when(k % 3 == 1, "partial").otherwise("missing")
    asked = t.conversations.filter(F.col("role") == "user").select(
        F.concat(F.lit("s"), F.col("conv_id") % 40).alias("site"), F.col("text").alias("question"), coverage.alias("coverage"),
        F.when(k % 2 == 0, F.concat(F.lit("/p"), k)).alias("best_url"), F.when(k % 3 == 1, "price").alias("gap"))
    return W.question_worklist(asked, KEYS)


QUESTION_SQL = """
with questions as (select 's' || conv_id % 40 as site, text as question, case when (conv_id + turn) % 3 = 1 then 'partial' else 'missing' end as coverage,
  case when (conv_id + turn) % 2 = 0 then '/p' || (conv_id + turn) end as best_url, case when (conv_id + turn) % 3 = 1 then 'price' end as gap from conversations where role = 'user' and (conv_id + turn) % 3 <> 0)"""


@query("question_worklist", QUESTION_SQL + " select site, question, coverage, best_url, gap from questions")
def _(t):
    return _questions(t)


def _practitioners(t):
    k = F.col("c_custkey")
    people = t.customer.select(F.concat(F.lit("s"), F.col("c_nationkey")).alias("site"), F.col("c_name").alias("name"), F.when(k % 4 != 0, F.concat(F.lit("/team/"), k)).alias("profile_url"),
                               (k % 2 == 0).alias("dedicated_page"), (k % 3 == 0).alias("person_schema"), (k % 5 == 0).alias("same_as"))
    n = F.col("n_nationkey")
    verdicts = t.nation.filter(n % 5 == 0).select(F.concat(F.lit("s"), n).alias("site"), F.lit("PASS").alias("verdict"), F.lit(None).cast("string").alias("name"))
    names = t.customer.filter((F.col("c_nationkey") % 5 == 1) & (k % 7 == 0)).select(F.concat(F.lit("s"), F.col("c_nationkey")).alias("site"), F.lit("WARNING").alias("verdict"), F.upper("c_name").alias("name"))
    return W.practitioner_worklist(people, KEYS, verdicts.unionByName(names))


PEOPLE_SQL = """
with c as (select *, c_custkey as k, c_nationkey as n, array_to_string(list_filter([case when c_custkey % 2 <> 0 then 'own page' end, case when c_custkey % 3 <> 0 then 'Person schema' end,
  case when c_custkey % 5 <> 0 then 'sameAs links' end], lambda x: x is not null), ',') as missing from customer),
practitioners as (select 's' || n as site, c_name as name, case when k % 4 <> 0 then '/team/' || k end as page, missing from c where missing <> '' and n % 5 <> 0
  and (k % 7 = 0 or n % 5 <> 1 or not exists (select 1 from c d where d.n = c.n and d.k % 7 = 0)))"""


@query("practitioner_worklist", PEOPLE_SQL + " select site, name, page, missing from practitioners")
def _(t):
    return _practitioners(t).withColumn("missing", F.array_join("missing", ","))


def _after(sql, start=P_SQL):
    """The tables that ``sql`` adds to those it starts with."""
    return "\n, " + sql.removeprefix(start).strip().removeprefix(", ").removeprefix("with ")


RECORD = ["lines", "script_srcs", "inline_script", "script_sources", "images"]


@query("work_item_lists", P_SQL + _after(ANALYTICS_SQL) + _after(HEADER_SQL) + _after(STRUCTURED_SQL) + _after(A11Y_SQL) + _after(QUESTION_SQL) + _after(PEOPLE_SQL) + """
select site, slug, sum(n)::bigint as rows, builder from (select site, 'analytics' as slug, 0 as builder, 1 as n from analytics union all select site, 'security-headers', 1, 1 from headers
  union all select site, 'structured-data', 3, 1 from structured union all select site, 'accessibility', 5, bad from e where bad > 0
  union all select site, 'questions', 7, 1 from questions union all select site, 'practitioners', 10, 1 from practitioners) group by 1, 2, 4""")
def _(t):
    """Tasks from lists of every kind. Pages are parsed once, and their records written for the four lists that read them."""
    found = cut(D.records(t, *RECORD))
    lists = {"analytics": _analytics(t, found), "security-headers": _headers(t, found), "structured-data": _structured(t, found), "accessibility": _accessibility(t, found),
             "questions": _questions(t), "practitioners": _practitioners(t)}
    none = t.pages.limit(0).select(F.lit("").alias("site"), F.lit("").alias("slug"), F.lit(0).alias("finding_id"))
    return B.work_items(lists, none, KEYS).select("site", "slug", "rows", "builder")
