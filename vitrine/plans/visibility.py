"""Assistant answers over ``orders`` and ``lineitem``: an order is an answer, its lines the companies it names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.identity import identity_check
from ..operators import citations as CI, visibility as V
from .registry import SQL, query

KEYS = ["site"]
STATUSES = "site: order status; target: supplier 8"


def profiles(t):
    """One profile per order status. Supplier 8 has a website, supplier 9 only its name."""
    sites = t.orders.select(F.col("o_orderstatus").alias("site")).distinct()
    return sites.select("site", F.lit("s8.example.com").alias("domain"), F.array(F.lit("Supplier 8"), F.lit("Supplier  9")).alias("names"),
                        F.array(F.lit("Austin")).alias("cities"))


def answers(t):
    """An order's lines never exceed seven, so the companies of one answer fit its row."""
    k = F.col("l_suppkey")
    name = F.concat(F.lit(" Supplier "), k, F.when(F.col("l_returnflag") == "R", " ").otherwise(""))
    name = F.when(F.col("l_returnflag") == "A", F.upper(name)).otherwise(name)
    website = F.when(k % 2 == 0, F.concat(F.lit("https://www.s"), k, F.lit(".example.com/x"))).when(k % 5 == 0, "[n/a]")
    city = F.when(F.col("l_linestatus") == "F", "Austin, TX").when(F.col("l_tax") > 0.05, "Denver")
    company = F.struct(name.alias("name"), website.alias("website"), city.alias("city"),
                       F.when(F.col("l_linenumber") < 6, (8 - F.col("l_linenumber")).cast("double")).alias("position"),
                       (F.col("l_discount") * 30 - 1.5).alias("sentiment"))
    lines = t.lineitem.groupBy("l_orderkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", company.alias("c")))), lambda s: s["c"]).alias("companies"))
    return t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderstatus").alias("site"), F.col("o_orderkey").alias("answer_id"), F.col("o_orderpriority").alias("prompt"),
        F.when(F.col("o_orderkey") % 50 == 0, "rate limited").alias("error"), "companies")


MENTION_SQL = """
with m as (select o_orderstatus as site, o_orderkey as answer_id, o_orderpriority as prompt, l_suppkey as k, l_linenumber, l_partkey,
  trim(case when l_returnflag = 'A' then upper(' Supplier ' || l_suppkey) else ' Supplier ' || l_suppkey end) as name,
  case when l_suppkey % 2 = 0 then 's' || l_suppkey || '.example.com' else lower('supplier ' || l_suppkey) end as key0,
  case when l_linestatus = 'F' then true when l_tax > 0.05 then false end as city_ok,
  case when l_linenumber < 6 then 8 - l_linenumber else 1e9 end as place, greatest(-1.0, least(1.0, l_discount * 30 - 1.5)) as sentiment
  from lineitem join orders on l_orderkey = o_orderkey where o_orderkey % 50 <> 0),
k as (select *, case when k = 8 or (k = 9 and coalesce(city_ok, true)) then 's8.example.com' else key0 end as company_key from m),
r as (select *, row_number() over (partition by answer_id, company_key order by place, l_linenumber, l_partkey, k) as dup from k),
p as (select *, row_number() over (partition by answer_id order by place, l_linenumber, l_partkey, k) as position, company_key = 's8.example.com' as is_target from r where dup = 1),
a as (select o_orderstatus as site, o_orderpriority as prompt, count(*) as answers_total,
  count(*) filter (o_orderkey % 50 <> 0 and o_orderkey in (select l_orderkey from lineitem)) as answers_scored from orders group by 1, 2),
spelled as (select site, company_key, is_target, name, count(*) as n, sum(position) as s, min(answer_id * 100 + position) as f from p group by all),
board as (select site, company_key, is_target, sum(n)::bigint as mentions, round_even(sum(s)::double / sum(n)::double, 2) as avg_position,
  arg_min(name, -n * 1000000000 + f) as company from spelled group by all),
ranked as (select *, row_number() over (partition by site order by mentions desc, avg_position, company_key) as rank from board)
"""


def mentions(t):
    return V.answer_positions(answers(t), profiles(t), KEYS)


@query("answer_positions", MENTION_SQL + "select site, answer_id, prompt, company_key, name, sentiment, position, is_target from p")
def _(t):
    return mentions(t)


@query("leaderboard", MENTION_SQL + "select site, company_key, is_target, mentions, avg_position, company from board")
def _(t):
    return V.leaderboard(mentions(t), KEYS)


@query("leaderboard_rank", MENTION_SQL + "select site, company_key, mentions, avg_position, rank from ranked")
def _(t):
    return V.leaderboard_rank(V.leaderboard(mentions(t), KEYS), KEYS).select("site", "company_key", "mentions", "avg_position", "rank")


@query("target_rank", MENTION_SQL + "select site, max(rank) filter (is_target) as rank, count(*) as companies from ranked group by 1")
def _(t):
    return V.target_rank(V.leaderboard(mentions(t), KEYS), KEYS)


@query("scored_answers", MENTION_SQL + "select site, sum(answers_total)::bigint as answers_total, sum(answers_scored)::bigint as answers_scored from a group by 1")
def _(t):
    return V.scored_answers(answers(t), KEYS)


@query("mention_rate", MENTION_SQL + """
select a.site, answers_total, answers_scored, mentions, target_mentions, round_even(target_mentions::double / answers_scored, 3) as mention_rate,
  round_even(target_mentions::double / mentions, 3) as share_of_voice from (select site, sum(answers_total)::bigint as answers_total,
  sum(answers_scored)::bigint as answers_scored from a group by 1) a join (select site, count(*) as mentions, count(*) filter (is_target) as target_mentions from p group by 1) x using (site)""")
def _(t):
    return V.mention_rates(answers(t), mentions(t), KEYS)


@query("question_rate", MENTION_SQL + """
select a.site, a.prompt, round_even(coalesce(x.n, 0)::double / nullif(a.answers_scored, 0), 3) as mention_rate from a left join
  (select site, prompt, count(*) filter (is_target) as n from p group by 1, 2) x using (site, prompt)""")
def _(t):
    return V.question_rate(answers(t), mentions(t), KEYS)


@query("sentiment", MENTION_SQL + """
, s as (select site, 'unbranded' as branch, sentiment from p where is_target union all
  select o_orderstatus, 'branded', greatest(-1.0, least(1.0, avg(o_totalprice) / 200000 - 1)) from orders group by 1)
select site, coalesce(branch, 'overall') as branch, round_even(avg(sentiment) * 100, 0)::bigint as score, count(*) as n,
  round_even(min(sentiment) * 100, 0)::bigint as low, round_even(max(sentiment) * 100, 0)::bigint as high from s group by grouping sets ((site), (site, branch))""")
def _(t):
    branded = t.orders.groupBy(F.col("o_orderstatus").alias("site")).agg((F.avg("o_totalprice") / 200000 - 1).alias("sentiment"))
    return V.sentiment(mentions(t), branded, KEYS)


@query("visibility_verdict", MENTION_SQL + """
, best as (select site, max(rank) filter (is_target) as rank from ranked where company_key <> 's8.example.com' or site <> 'F' group by 1)
select site, recognized, case when rank is not null then 'recommended' when recognized = false then 'not_found' else 'not_recommended' end as visibility
from best, (values (true), (false), (null)) v(recognized)""")
def _(t):
    board = V.leaderboard(mentions(t), KEYS).filter((F.col("site") != "F") | ~F.col("is_target"))
    states = F.explode(F.array(F.lit(True), F.lit(False), F.lit(None).cast("boolean"))).alias("recognized")
    ranks = V.target_rank(board, KEYS).select("site", "rank", states)
    return ranks.select("site", "recognized", V.visibility(F.col("recognized"), F.col("rank")).alias("visibility"))


def sources(t):
    """Cited pages of an answer: the brands of an order's parts; tracking keys and fragments vary by line."""
    brand = F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""))
    url = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "https://www.").otherwise("https://"), brand, F.lit(".example.com/p/"), F.col("p_size"),
                   F.when(F.col("l_linenumber") == 3, "?utm_source=x").when(F.col("l_linenumber") == 4, "#top").otherwise(""))
    url = F.when(F.col("l_linenumber") == 6, "javascript:alert(1)").otherwise(url)
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", url.alias("url"), F.col("p_type").alias("title")))),
                    lambda s: F.struct(s["url"].alias("url"), s["title"].alias("title"))).alias("sources"))
    return t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderstatus").alias("site"), F.col("o_orderkey").alias("answer_id"), F.col("o_orderpriority").alias("prompt"), "sources")


def source_profiles(t):
    sites = t.orders.select(F.col("o_orderstatus").alias("site")).distinct()
    return sites.select("site", F.lit("brand7.example.com").alias("domain"), F.array(F.lit("Brand Seven")).alias("names"),
                        F.array(F.lit("Jane Doe")).alias("people"), F.array(F.lit("https://www.brand11.example.com/p/1/")).alias("profiles"))


SOURCE_SQL = r"""
with s as (select o_orderstatus as site, o_orderkey as answer_id, o_orderpriority as prompt, l_linenumber as n, l_partkey, l_suppkey, p_type as title,
  case when l_linenumber = 6 then null else regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') || '.example.com' end as domain,
  case when l_linenumber % 2 = 0 then 'https://www.' else 'https://' end || regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') || '.example.com/p/' || p_size as url, p_size
  from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey),
pages as (select site, url, domain, count(*) as citations, count(distinct answer_id) as answers, count(distinct prompt) as prompts,
  domain = 'brand7.example.com' or (domain || '/p/' || p_size) like 'brand11.example.com/p/1%' as owned from s where domain is not null group by site, url, domain, p_size),
ranked as (select *, row_number() over (partition by site order by answers desc, citations desc, url) as r from pages where not owned)
"""


@query("cited_domains", SOURCE_SQL + """
select site, coalesce(domain, 'javascript') as domain, count(*) as citations, count(distinct answer_id) as answers,
  coalesce(domain, '') = 'brand7.example.com' as is_target from s group by 1, 2, 5""")
def _(t):
    return V.cited_domains(sources(t), source_profiles(t), KEYS)


@query("cited_pages", SOURCE_SQL + "select site, url, domain, citations, answers, prompts from pages")
def _(t):
    return V.cited_pages(sources(t), KEYS).select("site", "url", "domain", "citations", "answers", F.size("prompts").cast("bigint").alias("prompts"))


@query("cited_owned", SOURCE_SQL + "select site, owned, count(*) as pages, sum(citations)::bigint as citations from pages group by 1, 2")
def _(t):
    marked = CI.mark_owned(V.cited_pages(sources(t), KEYS), source_profiles(t), KEYS)
    return marked.groupBy("site", "owned").agg(F.count("*").alias("pages"), F.sum("citations").alias("citations"))


@query("cited_to_check", SOURCE_SQL + "select site, url, r <= 40 as to_check from ranked")
def _(t):
    marked = CI.mark_owned(V.cited_pages(sources(t), KEYS), source_profiles(t), KEYS)
    return CI.cited_to_check(marked, KEYS, fixed.CITED_TO_CHECK).select("site", "url", "to_check")


def captures(t):
    """Captured bodies of the cited pages: the part's text, naming the business or linking to it by part number."""
    p = t.part.select(F.concat(F.lit("https://"), F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")), F.lit(".example.com/p/"), F.col("p_size")).alias("url"),
                      "p_partkey", "p_name", "p_size").groupBy("url").agg(F.min("p_partkey").alias("k"), F.min_by("p_name", "p_partkey").alias("p_name"))
    k = F.col("k")
    text = F.concat("p_name", F.when(k % 5 == 0, " by Brand Seven").when(k % 5 == 1, " says JANE DOE.").when(k % 5 == 2, " Brand Sevenths").otherwise(""))
    links = F.when(k % 7 == 0, F.array(F.lit("https://shop.brand7.example.com/a"))).when(
        k % 7 == 1, F.array(F.lit("http://brand11.example.com/p/1/team"))).otherwise(F.array().cast("array<string>"))
    return p.select("url", (k % 11 != 3).alias("allowed"), F.when(k % 13 == 0, 503).otherwise(200).alias("status"),
                    F.when(k % 17 == 0, "application/pdf").otherwise("text/html").alias("content_type"), text.alias("text"), links.alias("links"))


CAPTURE_SQL = SOURCE_SQL + r""", cap as (select 'https://' || regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') || '.example.com/p/' || p_size as url, min(p_partkey) as k from part group by 1),
checked as (select r.site, r.url, r.domain, r.citations, case when r.r > 40 then 'not_checked' when k is null then 'unreachable' when k % 11 = 3 then 'blocked_by_robots' when k % 13 = 0 then 'unreachable'
  when k % 17 = 0 then 'unreadable' when k % 7 in (0, 1) or k % 5 in (0, 1) then 'mentioned' else 'not_mentioned' end as status,
  k % 7 in (0, 1) as strong from ranked r left join cap using (url))"""


@query("cited_mentions", CAPTURE_SQL + """
select site, url, status, case when status = 'mentioned' then case when strong then 'strong' else 'name_only' end end as match from checked""")
def _(t):
    rows = CI.citation_check(V.cited_pages(sources(t), KEYS), captures(t), source_profiles(t), KEYS, fixed.CITED_TO_CHECK)
    return rows.filter(F.col("status") != "owned").select("site", "url", "status", "match")


@query("citation_gap_domains", CAPTURE_SQL + """
select site, domain, count(*) as pages, sum(citations)::bigint as citations, case when bool_or(status = 'mentioned') then true when bool_or(status = 'not_mentioned') then false end as mentioned
from checked group by 1, 2""")
def _(t):
    return CI.citation_gap_domains(CI.citation_check(V.cited_pages(sources(t), KEYS), captures(t), source_profiles(t), KEYS, fixed.CITED_TO_CHECK), KEYS)


@query("citation_gap_summary", CAPTURE_SQL + """
, al as (select site, status, strong from checked union all select site, 'owned', true from pages where owned)
select site, count(*) as cited_pages, count(*) filter (status = 'owned') as owned, count(*) filter (status <> 'owned') as third_party, count(*) filter (status = 'mentioned') as mentioned,
 count(*) filter (status = 'not_mentioned') as not_mentioned, count(*) filter (status = 'unreachable') as unreachable, count(*) filter (status = 'blocked_by_robots') as blocked_by_robots,
 count(*) filter (status = 'unreadable') as unreadable, count(*) filter (status = 'not_checked') as not_checked, count(*) filter (status = 'mentioned' and not strong) as mentioned_name_only,
 case when bool_or(status in ('unreachable', 'blocked_by_robots')) then 'PARTIAL' else 'COMPLETE' end as status from al group by 1""")
def _(t):
    return CI.citation_gap_summary(CI.citation_check(V.cited_pages(sources(t), KEYS), captures(t), source_profiles(t), KEYS, fixed.CITED_TO_CHECK), KEYS)


# The same over every third-party page, without the number that a fetch was limited to.
ALL_SQL = CAPTURE_SQL.replace("when r.r > 40 then 'not_checked' ", "")


def _checked(t):
    return CI.citation_check(V.cited_pages(sources(t), KEYS), captures(t), source_profiles(t), KEYS)


@query("cited_mentions_all", ALL_SQL + SQL["cited_mentions"].removeprefix(CAPTURE_SQL))
def _(t):
    return _checked(t).filter(F.col("status") != "owned").select("site", "url", "status", "match")


@query("citation_gap_domains_all", ALL_SQL + SQL["citation_gap_domains"].removeprefix(CAPTURE_SQL))
def _(t):
    return CI.citation_gap_domains(_checked(t), KEYS)


@query("citation_gap_summary_all", ALL_SQL + SQL["citation_gap_summary"].removeprefix(CAPTURE_SQL))
def _(t):
    return CI.citation_gap_summary(_checked(t), KEYS)


@query("answer_citations", """
select conv_id as answer_id, count(distinct turn % 3)::bigint as sources from conversations where role = 'assistant' group by 1""")
def _(t):
    # Every assistant turn is a content block citing one of three pages.
    note = F.struct(F.concat(F.lit("https://x.test/"), F.col("turn") % 3).alias("url"), F.col("role").alias("title"))
    blocks = t.conversations.filter(F.col("role") == "assistant").groupBy(F.col("conv_id").alias("answer_id")).agg(
        F.array_sort(F.collect_list(F.struct("turn", F.array(note).alias("annotations")))).alias("b"))
    found = V.citations(blocks.select("answer_id", F.transform("b", lambda b: F.struct(b["annotations"].alias("annotations"))).alias("blocks")), [])
    return found.select("answer_id", F.size("sources").cast("bigint").alias("sources"))


@query("domain_mentioned", """
select conv_id, turn, contains(lower(text), 'tion.') or contains(lower(text), 'the') as mentioned from conversations""")
def _(t):
    return t.conversations.select("conv_id", "turn", V.domain_mentioned(F.col("text"), F.lit("tion."), F.lit("The")).alias("mentioned"))


PROMPT_SQL = """with q as (select lang as site, doc_id as pos, trim(string_split(text, chr(10))[1]) as prompt from documents)"""


def prompts(t):
    return t.documents.select(F.col("lang").alias("site"), F.col("doc_id").alias("pos"), F.get(F.split("text", "\n"), 0).alias("prompt"))


@query("distinct_prompts", PROMPT_SQL + " select site, prompt, min(pos) as pos from q where prompt <> '' group by 1, 2")
def _(t):
    return V.distinct_prompts(prompts(t), KEYS)


@query("banned_prompts", PROMPT_SQL + r"""
select site, pos, prompt from q where not regexp_matches(lower(prompt), '(^|[^a-z0-9])(the|of and|con\.test|con)([^a-z0-9]|$)')""")
def _(t):
    own = t.documents.select(F.col("lang").alias("site")).distinct().select(
        "site", F.lit("con.test").alias("domain"), F.array(F.lit("The"), F.lit("Of and")).alias("names"))
    return V.banned_filter(prompts(t).withColumn("prompt", F.trim("prompt")), own, KEYS).select("site", "pos", "prompt")


@query("audience", """
select c_custkey, case when c_custkey % 3 = 0 then c_mktsegment when c_custkey % 3 = 1 then c_name else 'buyers' end as value,
  case c_custkey % 3 when 0 then 'user' when 1 then 'site' else 'model' end as source from customer""")
def _(t):
    k = F.col("c_custkey") % 3
    found = V.audience(F.when(k == 0, F.col("c_mktsegment")).otherwise(""), F.when(k <= 1, F.col("c_name")), F.lit("buyers"))
    return t.customer.select("c_custkey", found.alias("a")).select("c_custkey", "a.value", "a.source")


@query("identity_check", """
with s as (select c_custkey as k, c_nationkey as n from customer), f as (select k,
  case k % 4 when 0 then true when 1 then false when 2 then true end as website, case k % 3 when 0 then true when 1 then false end as city,
  case when k % 5 = 0 then n % 2 = 0 end as phone, case when k % 7 < 3 then true end as category, k % 2 = 0 as given from s),
g as (select *, list_filter([case when website and not given then 'website' end, case when city then 'city' end, case when phone then 'phone' end, case when category then 'category' end], lambda x: x is not null) as agree,
  list_filter([case when website = false then 'website' end, case when city = false then 'city' end, case when phone = false then 'phone' end], lambda x: x is not null) as conflict from f)
select k as c_custkey, case when len(conflict) > 0 then 'mismatch' when len(agree) > 0 then 'confirmed' else 'unconfirmed' end as verdict,
 array_to_string(agree, ',') as agree, case when website and given then 'website' else '' end as echoed, array_to_string(conflict, ',') as conflict from g""")
def _(t):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    stated = {"website": F.when(k % 4 == 0, "https://www.acme.test/a").when(k % 4 == 1, "acmedental.test").when(k % 4 == 2, "app.acme.test"),
              "city": F.when(k % 3 == 0, "Round Rock, TX").when(k % 3 == 1, "Denver"),
              "phone": F.when((k % 5 == 0) & (n % 2 == 0), "512-555-0100").when(k % 5 == 0, "(303) 555 0100").otherwise("call us"),
              "category": F.when(k % 7 < 3, "a cosmetic dentist").otherwise("shop")}
    own = {"domain": F.lit("acme.test"), "profiles": F.array(F.lit("https://linkedin.com/company/acme")), "cities": F.array(F.lit("Round Rock"), F.lit("Austin")),
           "phones": F.array(F.lit("5125550100")), "categories": F.array(F.lit("Dentist"))}
    given = F.when(k % 2 == 0, F.array(F.lit("website"))).otherwise(F.array().cast("array<string>"))
    return t.customer.select("c_custkey", identity_check(stated, own, given).alias("c")).select(
        "c_custkey", "c.verdict", *[F.array_join(f"c.{n}", ",").alias(n) for n in ("agree", "echoed", "conflict")])
