"""Captured responses, robots, sitemaps and crawl order, derived from the customer, order and document tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.urls import host
from ..operators import frontier as W, pages as P
from ..operators.registry import collect
from ..session import checkpoint_dir, cut
from ..sources import capture as S
from . import derived as D, evidence as _evidence  # noqa: F401 - registers the SQL that is put together here
from .checks import P_SQL
from .registry import SQL, query

KEYS = ["site"]


def _root(column):
    return F.concat(F.lit("https://n"), column, F.lit(".test"))


@query("response_reports", P_SQL + """
select site, url, case when k % 3 = 0 then 0 when k % 3 = 1 then 1 else 2 end::bigint as hops, k % 3 = 2 or k % 19 = 0 as long from p where k % 3 > 0""")
def _(t):
    k = F.col("page_no")
    hop = F.struct(F.col("url").alias("from"), F.col("url").alias("to"), F.lit(301).alias("status"))
    chain = F.when(k % 3 == 0, F.array().cast("array<struct<from:string,to:string,status:int>>")).when(k % 3 == 1, F.array(hop)).otherwise(F.array(hop, hop))
    captured = D.captured(t).withColumn("final_url", F.col("url")).withColumn("redirects", chain)
    return S.redirect_report(captured, KEYS).select("site", "url", "hops", "long")


@query("header_report", P_SQL + "select site, url, case when k % 19 = 0 then 503 else 200 end as status, 2 = 2 as has_type from p")
def _(t):
    rows = S.header_report(D.captured(t), KEYS)
    return rows.select("site", "url", "status", F.map_contains_key("headers", "content-type").alias("has_type"))


@query("page_status", """
select c_custkey, case when c_custkey % 4 = 0 then null when c_custkey % 4 = 1 then 'EXTRACTED' when c_custkey % 4 = 2 then 'UNSUPPORTED_CONTENT_TYPE' when c_custkey % 8 = 3 then 'EXTRACTED' else 'UNSUPPORTED_CONTENT_TYPE' end as status from customer""")
def _(t):
    k = F.col("c_custkey")
    kind = F.when(k % 4 == 1, "text/HTML; charset=utf-8").when(k % 4 == 2, "application/pdf")
    return t.customer.select("c_custkey", P.page_status(F.when(k % 4 == 0, 404).otherwise(200), F.lit(None).cast("string"), kind, F.when(k % 8 == 3, "  <html>").otherwise("{}")).alias("status"))


@query("run_status", P_SQL + """
select site, count(*) as pages, case when bool_or(k % 19 = 0 or k % 23 = 0 or k % 29 = 0) then 'PARTIAL' else 'COMPLETE' end as status from p group by 1""")
def _(t):
    pages = D.captured(t).withColumn("extraction_status", F.lit("EXTRACTED"))
    return P.run_status(pages, pages.filter(F.col("page_no") % 29 == 0).select("site"), KEYS)


@query("content_names", """
with p as (select doc_id as k, lang as site, source as label, min(doc_id) over (partition by lang, source) as f from documents)
select site, k as page_no, case when k = f then label else label || '-' || lpad(k::varchar, greatest(4, length(k::varchar))::int, '0') end as file from p""")
def _(t):
    pages = t.documents.select(F.col("lang").alias("site"), F.col("doc_id").alias("page_no"), F.col("source").alias("label"))
    return S.content_names(pages, KEYS).select("site", "page_no", "file")


def _folder(t, what):
    return f"{checkpoint_dir(t.spark).rstrip('/')}/vitrine-{what}-{uuid.uuid4().hex}"


@query("stored_responses", P_SQL + "select site, url, case when k % 19 = 0 then 503 else 200 end as status, k % 23 = 0 as truncated, length(html) as characters from p")
def _(t):
    """Captured responses written with the declared schema and read back, the columns asked for only."""
    path, url, k = _folder(t, "responses"), F.col("url"), F.col("page_id")
    given = {"site": host(url), "run_id": F.lit("r"), "url": url, "final_url": url, "status": F.when(k % 19 == 0, 503).otherwise(200), "body": F.col("html"), "truncated": k % 23 == 0,
             "error": F.when(k % 19 == 0, "HTTP 503")}
    t.pages.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in S.RESPONSES.fields]).write.parquet(path)
    return S.read_responses(t.spark, path).select("site", "url", "status", "truncated", F.char_length("body").cast("bigint").alias("characters"))


@query("written_content", """
with p as (select doc_id as k, lang as site, source as label, text, min(doc_id) over (partition by lang, source) as f from documents)
select site, case when k = f then label else label || '-' || lpad(k::varchar, greatest(4, length(k::varchar))::int, '0') end as file,
  '# ' || case when k % 3 = 0 then 'https://s.test/' || k else 'Doc ' || k end || chr(10) || chr(10) || 'Source: https://s.test/' || k || chr(10) || chr(10) || text || chr(10) as value from p""")
def _(t):
    """Readable text written in a folder per site and read back."""
    path, k = _folder(t, "content"), F.col("doc_id")
    pages = t.documents.select(F.col("lang").alias("site"), k.alias("page_no"), F.col("source").alias("label"), F.when(k % 3 != 0, F.concat(F.lit("Doc "), k)).otherwise("").alias("title"),
                               F.concat(F.lit("https://s.test/"), k).alias("url"), F.col("text").alias("visible_text"))
    S.write_content(pages, path, KEYS)
    return t.spark.read.parquet(path).select("site", "file", "value")


@query("dimension_results", f"""
select 'security' as dimension, site, pages_checked as n from ({SQL['https_summary']}) union all select 'accessibility', site, findings from ({SQL['accessibility_summary']}) union all
select 'answer_coverage', site::varchar, questions from ({SQL['coverage_summary']}) union all select 'practitioners', site::varchar, practitioners from ({SQL['practitioner_summary']}) union all
select 'meta_ads', site, sum(ads)::bigint from ({SQL['ad_pages']}) group by site""")
def _(t):
    """Every dimension whose inputs were captured, from one registry call; the pages are parsed once."""
    orders, k = t.orders, F.col("c_custkey")
    bad = (F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 4 == 0)
    coverage = F.when(F.col("o_orderstatus") == "F", "answered").when(F.col("o_orderstatus") == "O", "partial").when(~bad, "missing")
    inputs = {
        "pages": cut(D.records(t, "script_sources", "images")),
        "questions": orders.select(F.col("o_custkey").alias("site"), coverage.alias("coverage"), F.when(bad, "timeout").alias("error")),
        "people": t.customer.select(F.col("c_nationkey").alias("site"), F.when(k % 4 != 0, F.floor(k / 40)).alias("profile_url"), (k % 2 == 0).alias("dedicated_page"), (k % 3 == 0).alias("person_schema"),
                                    (k % 6 == 0).alias("same_as"), (k % 5 != 0).alias("credentials")),
        "ads": t.part.select(F.col("p_type").alias("site"), F.col("p_brand").alias("page_name"))}
    results, status = collect(inputs, ["security", "accessibility", "answer_coverage", "practitioners", "meta_ads", "citation_gap"])
    assert [n for n, s in status.items() if s != "COLLECTED"] == ["citation_gap"]
    number = {"security": "pages_checked", "accessibility": "findings", "answer_coverage": "questions", "practitioners": "practitioners", "meta_ads": "ads"}
    rows = [results[n].groupBy(F.col("site").cast("string").alias("site")).agg(F.sum(c).cast("bigint").alias("n")).select(F.lit(n).alias("dimension"), "site", "n") for n, c in number.items()]
    return reduce(DataFrame.union, rows)


@query("verify_bundle", """
select doc_id::varchar || '.md' as path, case when doc_id % 10 = 3 then 'missing' else 'modified' end as problem from documents where doc_id % 10 in (3, 7) union all
select '../' || doc_id || '.md', 'missing' from documents where doc_id % 100 = 1""")
def _(t):
    k = F.col("doc_id")
    name = F.concat(F.when(k % 100 == 1, "../").otherwise(""), k, F.lit(".md"))
    manifest = t.documents.select(name.alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    files = t.documents.filter(k % 10 != 3).select(name.alias("path"), F.when(k % 10 == 7, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary").alias("content"))
    return S.verify(manifest, files)


@query("bundle_artifacts", "select doc_id || '.md' as path, octet_length(encode(text))::bigint as bytes, sha256(text) as sha256 from documents")
def _(t):
    content = F.col("text").cast("binary")
    files = t.documents.select(F.concat(F.lit("s3://b/run/"), "doc_id", F.lit(".md")).alias("path"), F.octet_length(content).cast("bigint").alias("length"), content.alias("content"))
    return S.artifacts(files, "s3://b/run/")


@query("prospects", "select c_custkey as row_no, case when c_custkey % 7 = 0 then null else c_name end as domain, case when c_custkey % 7 = 0 then 'ERROR' else 'PENDING' end as status from customer")
def _(t):
    rows = t.customer.select(F.col("c_custkey").alias("row_no"), F.when(F.col("c_custkey") % 7 == 0, " ").otherwise(F.concat("c_name", F.lit(" "))).alias("domain"))
    return S.prospects(rows)


@query("prompt_lines", """
with l as (select unnest(string_split(text, chr(10))) as x, doc_id as k from documents), m as (select case when k % 5 = 0 then '#' || x else x end as x from l)
select trim(x) as value, count(*) as lines from m where trim(x) <> '' and not starts_with(trim(x), '#') group by 1""")
def _(t):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("x"))
    rows = lines.select(F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("#"), "x")).otherwise(F.col("x")).alias("value"))
    return S.prompt_lines(rows).groupBy("value").agg(F.count("*").alias("lines"))


@query("llms_txt", """
select n_nationkey as site, case when n_nationkey % 3 = 0 then '200' when n_nationkey % 3 = 1 then '404' else 'UNKNOWN' end as status, case when n_nationkey % 3 = 0 then n_name end as text from nation""")
def _(t):
    n = F.col("n_nationkey")
    sites = t.nation.select(n.alias("site"), _root(n).alias("origin"), F.when(n % 3 != 2, True).alias("allowed"))
    bodies = t.nation.select(F.concat(_root(n), F.lit("/llms.txt")).alias("url"), F.when(n % 3 == 1, 404).otherwise(200).alias("status"), F.col("n_name").alias("body"))
    return S.llms_txt_report(sites, bodies, KEYS)


# ---- robots ------------------------------------------------------------------------------------------------------
ROBOTS = ("# rules\nUser-agent: *\nDisallow: /c1 # ones\nAllow: /\n\nUser-agent: GPTBot\nUser-Agent: ClaudeBot\nCrawl-delay: 2\nDisallow: /\n\n"
          "Disallow: /ignored\nUser-agent: Empty\n\nUser-agent: PerplexityBot\nDisallow:\nSitemap: https://x.test/s.xml\n")


def _robots(t):
    n = F.col("n_nationkey")
    return t.nation.select(n.alias("site"), F.when(n % 3 == 0, 404).when(n % 3 == 1, 200).otherwise(503).alias("status"), F.concat(F.lit(ROBOTS), F.lit("Disallow: /c"), n, F.lit("9\n")).alias("text"))


@query("robots_rules", """
select n_nationkey as site, r.g as "group", r.a as agent, r.k as kind, case when r.v = 'N' then '/c' || n_nationkey || '9' else r.v end as value from nation,
 (values (1, '*', 'disallow', '/c1'), (1, '*', 'allow', '/'), (2, 'gptbot', 'crawl-delay', '2'), (2, 'claudebot', 'crawl-delay', '2'), (2, 'gptbot', 'disallow', '/'), (2, 'claudebot', 'disallow', '/'),
  (4, 'perplexitybot', 'disallow', ''), (4, 'perplexitybot', 'disallow', 'N')) r(g, a, k, v)""")
def _(t):
    return W.robots_rules(_robots(t), KEYS).select("site", F.col("group").cast("int").alias("group"), "agent", "kind", "value")


ACCESS_SQL = """
with u as (select c_nationkey as n, c_custkey as k from customer), b as (select unnest(['GPTBot', 'OAI-SearchBot', 'ChatGPT-User', 'ClaudeBot', 'Claude-User', 'Claude-SearchBot', 'PerplexityBot', 'Google-Extended']) as bot),
a as (select n as site, k, bot, case when n % 3 = 0 then true when n % 3 = 1 then bot not in ('GPTBot', 'ClaudeBot') and (bot = 'PerplexityBot' or not starts_with(k::varchar, '1')) end as allowed from u, b)"""


def _access(t):
    urls = t.customer.select(F.col("c_nationkey").alias("site"), F.concat(_root("c_nationkey"), F.lit("/c"), "c_custkey").alias("url"))
    return W.robots_access(urls, _robots(t), KEYS)


@query("robots_access", ACCESS_SQL + " select site, 'https://n' || site || '.test/c' || k as url, bot, allowed, case when allowed then 'PASS' when not allowed then 'FAIL' else 'UNKNOWN' end as status from a")
def _(t):
    return _access(t)


@query("bot_access_summary", ACCESS_SQL + " select site, bot, count(*) filter (allowed) as allowed, count(*) filter (not coalesce(allowed, false)) as blocked from a group by 1, 2")
def _(t):
    return W.bot_access_summary(_access(t), KEYS)


@query("access_targets", "select c_nationkey as site, count(*) + case when c_nationkey % 2 = 0 then 1 else 0 end as urls from customer group by c_nationkey")
def _(t):
    pages = t.customer.select(F.col("c_nationkey").alias("site"), F.concat(F.lit("/c"), "c_custkey").alias("url"))
    starts = t.nation.select(F.col("n_nationkey").alias("site"), F.when(F.col("n_nationkey") % 2 == 0, "/").alias("url")).filter(F.col("url").isNotNull())
    repeated = starts.unionByName(pages)
    return W.access_targets(repeated, pages, KEYS).groupBy("site").agg(F.count("*").alias("urls"))


# ---- sitemaps ----------------------------------------------------------------------------------------------------
def _sitemaps(t):
    n = F.col("n_nationkey")
    seeds = t.nation.select(n.alias("site"), F.lit(0).alias("pos"), F.concat(_root(n), F.lit("/sitemap.xml")).alias("url"), _root(n).alias("scope"))
    locs = F.transform(F.sequence(F.lit(0), n % 4), lambda m: F.concat(F.lit("<sitemap><loc> "), _root(n), F.lit("/s"), m, F.lit(".xml </loc></sitemap>")))
    index = t.nation.select(F.concat(_root(n), F.lit("/sitemap.xml")).alias("url"), F.concat(
        F.lit('<?xml version="1.0"?><sitemapindex xmlns="x">'), F.array_join(locs, ""), F.lit("<sitemap><loc>"), _root(n), F.lit("/sitemap.xml</loc></sitemap><sitemap><loc>"), _root(n),
        F.lit("/bad.xml</loc></sitemap><sitemap><loc>https://else.test/s.xml</loc></sitemap></sitemapindex>")).alias("body"))
    bad = t.nation.select(F.concat(_root(n), F.lit("/bad.xml")).alias("url"), F.lit("<urlset><url><loc>https://x.test/</loc>").alias("body"))
    c = F.col("c_nationkey")
    address = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("<![CDATA["), _root(c), F.lit("/c"), "c_custkey", F.lit("?b=2&a=1]]>"))).when(
        F.col("c_custkey") % 3 == 1, F.concat(_root(c), F.lit("/c"), "c_custkey", F.lit("?b=2&#38;a=1"))).otherwise(F.concat(_root(c), F.lit("/c"), "c_custkey", F.lit("?b=2&amp;a=1")))
    entry = F.struct("c_custkey", F.concat(F.lit("<url><!-- <loc>https://x.test/no</loc> --><loc>"), address, F.lit("</loc></url>")).alias("x"))
    sets = t.customer.groupBy("c_nationkey", (F.col("c_custkey") % 4).alias("m")).agg(F.array_sort(F.collect_list(entry)).alias("e")).select(
        F.concat(_root(c), F.lit("/s"), "m", F.lit(".xml")).alias("url"),
        F.concat(F.lit("<s:urlset xmlns:s='x'>"), F.array_join(F.transform("e", lambda e: e["x"]), "\n"), F.lit("<url><loc>https://else.test/a</loc></url></s:urlset>\n<!-- end -->\n")).alias("body"))
    return W.sitemap_locs(seeds, index.unionByName(bad).unionByName(sets).withColumn("status", F.lit(200)), KEYS)


@query("sitemap_urls", """
select c_nationkey as site, 'https://n' || c_nationkey || '.test/c' || c_custkey || '?a=1&b=2' as url, row_number() over (partition by c_nationkey order by c_custkey % 4, c_custkey) as place
from customer where c_custkey % 4 <= c_nationkey % 4""")
def _(t):
    return _sitemaps(t)[0]


@query("sitemap_documents", """
with m as (select n_nationkey as n, unnest(range(0, n_nationkey % 4 + 1)) as m from nation)
select n_nationkey as site, 'https://n' || n_nationkey || '.test/sitemap.xml' as doc, 'sitemapindex' as type, n_nationkey % 4 + 4 as locs, false as parse_error from nation union all
select n_nationkey, 'https://n' || n_nationkey || '.test/bad.xml', null, 0, true from nation union all
select n, 'https://n' || n || '.test/s' || m || '.xml', 'urlset', (select count(*) from customer where c_nationkey = n and c_custkey % 4 = m) + 1, false from m""")
def _(t):
    return _sitemaps(t)[1].select("site", "doc", "type", "locs", "parse_error")


# ---- crawl order: a nation's start page links its customers, a customer its orders ---------------------------------
def _crawl(t, max_pages=100):
    n, k, o = F.col("c_nationkey"), F.col("c_custkey"), F.col("o_orderkey")
    starts = t.nation.select(F.col("n_nationkey").alias("site"), F.concat(_root("n_nationkey"), F.lit("/")).alias("url"), _root("n_nationkey").alias("scope"))
    customer = F.concat(_root(n), F.when(k % 10 == 0, "/cart/c").otherwise("/c"), k)
    order = F.concat(_root(n), F.lit("/o"), o)
    both = t.orders.join(t.customer, F.col("o_custkey") == k)
    links = t.customer.select(n.alias("site"), F.concat(_root(n), F.lit("/")).alias("source"), k.alias("pos"), customer.alias("target")).unionByName(
        both.select(n.alias("site"), customer.alias("source"), o.alias("pos"), order.alias("target")))
    first_order = both.groupBy("c_custkey").agg(F.min("o_orderkey").alias("_o"))
    pages = starts.select("site", "url", F.lit(None).cast("string").alias("canonical_url"), F.lit(True).alias("allowed")).unionByName(
        t.customer.join(first_order, "c_custkey", "left").select(n.alias("site"), customer.alias("url"), F.when(k % 9 == 1, F.concat(_root(n), F.lit("/o"), "_o")).alias("canonical_url"), F.lit(True).alias("allowed"))).unionByName(
        both.select(n.alias("site"), order.alias("url"), order.alias("canonical_url"), (o % 7 != 0).alias("allowed")))
    seeds = starts.select("site", "url", F.lit(0).alias("pos"))
    return W.crawl_frontier(starts, seeds, pages, links, KEYS, max_depth=2, max_pages=max_pages)


FRONTIER_SQL = """
with c as (select c_nationkey as site, c_custkey as k, c_custkey % 10 = 0 as cart, (select min(o_orderkey) from orders where o_custkey = c_custkey) as o from customer),
l1 as (select *, case when not cart then 1 + row_number() over (partition by site, cart order by k) end as page_number from c),
l2 as (select l1.site, l1.k, o_orderkey as o, case when l1.k % 9 = 1 and o_orderkey = l1.o then 'duplicate_canonical' when o_orderkey % 7 = 0 then 'robots_disallowed' end as reason
  from l1 join orders on o_custkey = l1.k where l1.page_number <= 100),
n1 as (select site, max(page_number) as n from l1 group by 1),
l3 as (select l2.*, case when reason is null then n1.n + row_number() over (partition by l2.site, reason is null order by k, o) end as page_number from l2 join n1 using (site)),
every as (select n_nationkey as site, '/' as path, 0 as depth, 1 as page_number, null as reason, -1 as a, 0 as b from nation union all
  select site, case when cart then '/cart/c' else '/c' end || k, 1, page_number, case when cart then 'excluded_path_or_query' end, k, -1 from l1 union all select site, '/o' || o, 2, page_number, reason, 1000000000 + k, o from l3),
last as (select site, a, b from every where page_number = 100)
select e.site, 'https://n' || e.site || '.test' || path as url, depth, case when page_number <= 100 then page_number end as page_number,
  case when page_number > 100 or (e.a, e.b) > (last.a, last.b) then 'page_limit' else reason end as reason from every e left join last using (site)"""


@query("crawl_frontier", FRONTIER_SQL)
def _(t):
    return _crawl(t)


@query("skip_reasons", f"select site, reason, count(*) as urls from ({FRONTIER_SQL}) where reason is not null group by 1, 2")
def _(t):
    return S.skip_reasons(_crawl(t).filter(F.col("reason").isNotNull()), KEYS)


# ---- digest ------------------------------------------------------------------------------------------------------
DIGEST_SQL = """
with p as (select doc_id as k, lang as site, repeat('h', (doc_id % 300)::int) as head, text as body, count(*) over (partition by lang) as n from documents),
h as (select *, greatest(0, least(4000, floor(40000.0 / n)))::int as cap from p),
hh as (select site, k, n, body, case when length(head) <= cap then head else left(head, cap) || chr(10) || '[trimmed: ' || (length(head) - cap) || ' more characters]' end as head from h),
r as (select item_id as k, ['de', 'en', 'fr'][(item_id % 3 + 1)::int] as site, text, least(40000, floor(80000.0 / (count(*) over (partition by item_id % 3) + 1)))::int as cap from benchmark),
rr as (select site, k, case when length(text) <= cap then text else left(text, cap) || chr(10) || '[trimmed: ' || (length(text) - cap) || ' more characters]' end as text from r),
u as (select site, any_value(n) as n, 200000 - sum(length(head)) - coalesce((select sum(length(text)) from rr where rr.site = hh.site), 0) as room from hh group by site),
e as (select site, room, greatest(200, floor(room::double / n))::bigint as even from u),
s as (select site, any_value(room) as room, any_value(even) as even, sum(case when length(body) <= even then length(body) else 0 end) as short, count(*) filter (length(body) > even) as long_n from hh join e using (site) group by 1),
x as (select site, case when long_n > 0 then greatest(even, floor((room - short)::double / long_n)) else even end::int as each from s)
select site, 'report' as part, k as pos, text from rr union all
select site, 'page', k, head || chr(10) || case when length(body) <= each then body else left(body, each) || chr(10) || '[trimmed: ' || (length(body) - each) || ' more characters]' end from hh join x using (site)"""


@query("corpus_digest", DIGEST_SQL)
def _(t):
    pages = t.documents.select(F.col("lang").alias("site"), F.col("doc_id").alias("page_no"), F.repeat(F.lit("h"), (F.col("doc_id") % 300).cast("int")).alias("head"), F.col("text").alias("body"))
    language = F.element_at(F.array(F.lit("de"), F.lit("en"), F.lit("fr")), (F.col("item_id") % 3 + 1).cast("int"))
    reports = t.benchmark.select(language.alias("site"), F.col("item_id").alias("pos"), "text")
    return S.corpus_digest(reports, pages, KEYS, budget=200_000)


