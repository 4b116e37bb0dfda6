"""Checks of captured pages (see ``derived``), each against SQL that knows what was written into which page."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import clean
from ..functions.urls import host
from ..operators import accessibility as A, checks as C, pages as P, social as SO, structured as SD
from . import derived as D
from .registry import query
from .urls import AUTH, HOST, PATH, QS, VISIBLE_SQL

KEYS = ["site"]
NORMAL = rf"""(regexp_extract(url, '^([a-z]+)://', 1) || '://' || lower({AUTH}) || case when {PATH} = '' then '/' else {PATH} end || case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end)"""
P_SQL = rf"""
with p0 as (select page_id as k, url, html, {HOST} as site, starts_with(url, 'https://') as https, regexp_extract(url, '^[a-z]+://[^/?#]*') as origin,
  list_sort(list_filter(string_split({QS}, '&'), lambda x: x <> '' and not starts_with(lower(x), 'utm_'))) as q from pages),
p as (select *, {NORMAL} as normal, case k % 4 when 1 then origin || '/c/' || (k // 10) when 2 then {NORMAL} when 3 then 'https://elsewhere.example.org/x/' end as canonical,
  trim(regexp_replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&amp;', '&'), '\s+', ' ', 'g')) as title, len(regexp_extract_all(html, '</h1>')) as h1 from p0)
"""


@query("page_metadata", P_SQL + """
select k as page_no, case k % 3 when 1 then 40 when 2 then case when k % 2 = 0 then 170 else 100 end end as description_length, canonical, case when k % 4 = 1 then 1 else 0 end as feeds,
  case when k % 4 = 2 then 1 else 0 end as icons, 1 + case when k % 5 = 1 then 1 else 0 end as images, case when k % 4 = 2 then 'info@acme.test,sales@acme.test' else '' end as emails,
  case when k % 4 = 1 then '+1 (512) 555-0100' else '' end as phones, case when k % 5 = 1 then 1 else 0 end as ctas from p""")
def _(t):
    # Only the call-to-action buttons are counted: link texts are invented words.
    found = D.records(t, "meta_description", "canonical_url", "feeds", "icons", "images", "emails", "telephone_numbers", "ctas")
    return found.select(
        "page_no", F.length("meta_description").alias("description_length"), F.col("canonical_url").alias("canonical"), F.size("feeds").alias("feeds"), F.size("icons").alias("icons"),
        F.size("images").alias("images"), F.array_join(F.filter("emails", lambda e: e.endswith("acme.test")), ",").alias("emails"), F.array_join("telephone_numbers", ",").alias("phones"),
        F.size(F.filter("ctas", lambda c: c["url"].isNull())).alias("ctas"))


@query("feed_inventory", P_SQL + "select site, url as source, origin || '/feed' as url, 'application/rss+xml' as type from p where k % 4 = 1")
def _(t):
    return P.feed_inventory(D.records(t, "feeds"), KEYS)


@query("html_signals", P_SQL + """
select site, url, canonical as canonical_url, case when k % 4 = 1 then 1 else 0 end as feeds, case k % 6 when 1 then 'Dentist' when 2 then 'Organization,Person,WebSite' when 3 then 'Answer,FAQPage,Question'
  when 5 then 'BreadcrumbList,ListItem,Product,Review' else '' end as types from p""")
def _(t):
    return P.html_signals(D.records(t, "canonical_url", "feeds", "json_types"), KEYS)


@query("indexing_report", P_SQL + "select site, url, k % 11 = 0 or k % 13 = 0 or k % 17 = 0 as noindex from p")
def _(t):
    return P.indexing_report(D.records(t, "robots_meta", "visible_text"), KEYS).select("site", "url", "noindex")


TEXT_LENGTH = VISIBLE_SQL + r""", f as (select page_id as k, sum(length(trim(regexp_replace(line, '\s+', ' ', 'g'))) + 1) - 1 as n from l where trim(regexp_replace(line, '\s+', ' ', 'g')) <> '' group by 1)"""


@query("extractability", TEXT_LENGTH + " select page_id as page_no, coalesce(n, 0)::bigint as extracted_characters, case when coalesce(n, 0) < 200 then 'WARNING' else 'PASS' end as extractability from pages left join f on k = page_id")
def _(t):
    from ..sources.html import parse_html
    from .urls import site_pages

    plain = P.page_record(parse_html(site_pages(t)), "visible_text", "robots_meta").withColumn("headers", F.create_map().cast("map<string,string>"))
    return P.indexing_report(plain, ["page_no"]).select("page_no", "extracted_characters", "extractability")


PREVIEW_SQL = P_SQL + """
, i as (select site, k, unnest(list_filter([
  case when k % 5 = 0 then 'error|missing|og:title' end, case when k % 2 = 1 then 'warning|missing|og:description' end, case when k % 3 = 2 then 'error|missing|og:image' end,
  case when k % 4 in (0, 3) then 'warning|missing|og:url' end, case when k % 2 = 0 then 'warning|missing|og:type' end, case when k % 10 <> 0 then 'warning|missing|twitter:card' end,
  case when k % 3 = 1 then 'error|image_not_absolute_https|og:image' end, case when k % 3 < 2 and k % 9 <> 0 then 'warning|image_dimensions_missing|og:image:width/height' end,
  case when k % 4 = 1 or (k % 4 = 2 and rtrim(url, '/') <> rtrim(canonical, '/')) then 'warning|og_url_not_canonical|og:url' end,
  case when k % 5 <> 0 and k % 6 = 0 then 'warning|title_may_truncate|og:title' end, case when k % 8 = 0 then 'warning|description_may_truncate|og:description' end], lambda x: x is not null)) as x from p)"""


@query("preview_issues", PREVIEW_SQL + " select k as page_no, string_agg(x, ',' order by x) as issues from i group by 1")
def _(t):
    rows = C.preview_issues(D.records(t, "social_meta", "canonical_url"))
    text = F.transform("preview_issues", lambda i: F.concat_ws("|", i["severity"], i["code"], i["tag"]))
    return rows.select("page_no", F.array_join(F.array_sort(text), ",").alias("issues")).filter(F.col("issues") != "")


@query("preview_summary", PREVIEW_SQL + " select site, split_part(x, '|', 1) as severity, split_part(x, '|', 2) as code, split_part(x, '|', 3) as tag, count(*) as pages from i group by all")
def _(t):
    return C.preview_summary(C.preview_issues(D.records(t, "social_meta", "canonical_url")), KEYS)


@query("most_used_images", P_SQL + """
, m as (select site, case when k % 3 = 0 then 'https://img.example.com/' || (k % 7) || '.png' else '/img/1.png' end as image, count(*) as pages from p where k % 3 < 2 group by 1, 2)
select site, image, pages, place from (select *, row_number() over (partition by site order by pages desc, image) as place from m) where place <= 5""")
def _(t):
    return C.most_used_images(D.records(t, "social_meta"), KEYS)


SECURITY_SQL = P_SQL + """
, s as (select site, k, url, https, list_filter([case when k % 2 = 1 and https then 'strict-transport-security' end, case when k % 3 <> 0 then 'content-security-policy' end,
  case when k % 5 = 0 then 'x-content-type-options' end, case when k % 7 <> 0 then 'referrer-policy' end, 'permissions-policy',
  case when k % 4 <> 0 and k % 6 <> 0 then 'x-frame-options/frame-ancestors' end], lambda x: x is not null) as missing, https and k % 3 = 2 as mixed from p where k % 19 <> 0)"""


@query("security_rows", SECURITY_SQL + """
select site, url, https, array_to_string(missing, ',') as missing_headers, case when mixed then 1 else 0 end as mixed, case when k % 8 = 0 then true when k % 4 = 0 then false end as cookie_secure,
  case when k % 8 = 0 then false when k % 4 = 0 then true end as cookie_samesite from s""")
def _(t):
    return C.security_row(D.records(t, "script_sources", "images"), KEYS).select("site", "url", "https", F.array_join("missing_headers", ",").alias("missing_headers"), F.size("mixed_content").alias("mixed"),
                                                    "cookie_secure", "cookie_samesite")


@query("security_summary", SECURITY_SQL + " select site, header, count(*) as pages from (select site, unnest(missing) as header from s) group by 1, 2")
def _(t):
    return C.security_summary(C.security_row(D.records(t, "script_sources", "images"), KEYS), KEYS)


@query("https_summary", SECURITY_SQL + " select site, count(*) as pages_checked, bool_and(https) as https, count(*) filter (mixed) as mixed_pages from s group by 1")
def _(t):
    return C.https_summary(C.security_row(D.records(t, "script_sources", "images"), KEYS), KEYS)


SEO_SQL = P_SQL + """
, s as (select site, k, url, title, array_to_string(list_filter([case when title = '' then 'no title' when length(title) > 40 then 'long title' end,
  case when k % 3 = 0 then 'no description' when k % 3 = 2 and k % 2 = 0 then 'long description' end, case when h1 = 0 then 'no h1' when h1 > 1 then 'several h1' end,
  case when k % 11 = 0 then 'noindex' end, case when rtrim(canonical, '/') <> rtrim(url, '/') then 'canonical elsewhere' end], lambda x: x is not null), ',') as problems from p)"""


def _seo(t):
    rows = D.records(t, "title", "meta_description", "headings", "robots_meta", "canonical_url").withColumn("noindex", F.lit(False)).withColumn("extractability", F.lit("PASS"))
    return C.seo_problems(rows, title_max=40)


@query("seo_rows", SEO_SQL + " select site, url, problems from s where problems <> ''")
def _(t):
    rows = _seo(t).select("site", "url", F.array_join("seo_problems", ",").alias("problems"))
    return rows.filter(F.col("problems") != "")


@query("seo_counts", SEO_SQL + " select site, count(*) as checked, count(*) filter (problems <> '') as failing from s group by 1")
def _(t):
    return C.seo_counts(_seo(t), KEYS)


@query("seo_worklist", P_SQL + """
, s as (select site, url, array_to_string(list_filter([case when title = '' then 'no title' when length(title) > 40 then 'title is ' || length(title) || ' characters' end,
  case when k % 3 = 0 then 'no meta description' when k % 3 = 1 then 'meta description is 40 characters' when k % 2 = 0 then 'meta description is 170 characters' end,
  case when h1 <> 1 then h1 || ' H1 headings' end, case when k % 4 = 0 then 'no canonical link' end], lambda x: x is not null), ',') as problems from p where k % 19 <> 0)
select site, url, problems from s where problems <> ''""")
def _(t):
    return C.seo_worklist(D.records(t, "title", "meta_description", "headings", "canonical_url"), KEYS, title_max=40).select("site", "url", F.array_join("problems", ",").alias("problems"))


FONT_SQL = P_SQL + """
, f as (select distinct site, k, family from (select site, k, unnest(['Georgia', 'Inter', 'serif']) as family from p where k % 6 = 0
  union all select site, k, unnest(['Open Sans', 'Roboto']) from p where k % 4 = 1
  union all select site, k, unnest(['Lato', 'serif']) from p where k % 4 = 2))"""


def _sheets(t):
    pages = D.records(t, "stylesheets")
    bodies = pages.select(F.explode("stylesheets").alias("url")).filter(F.col("url").endswith("/site.css")).distinct().withColumn(
        "body", F.lit("@font-face{font-family: \"Lato\"; src:url(x)} body{ --q: 1; font-family:Lato , serif }"))
    return C.stylesheets(pages, bodies, KEYS)


@query("stylesheets", P_SQL + """
select distinct site, case k % 4 when 1 then 'https://fonts.googleapis.com/css?family=Roboto%3A400%7COpen+Sans' when 2 then origin || '/site.css' else 'https://use.typekit.net/abc.css' end as sheet,
  case k % 4 when 1 then 'Google Fonts' when 2 then case when origin like 'http%' then 'first-party' end else 'Adobe Fonts' end as source, case k % 4 when 1 then 'Open Sans,Roboto' when 2 then 'Lato,serif' else '' end as families
from p where k % 4 <> 0""")
def _(t):
    return _sheets(t).select("site", "sheet", "source", F.array_join("families", ",").alias("families"))


@query("page_fonts", FONT_SQL + " select site, k as page_no, family from f")
def _(t):
    return C.page_fonts(D.records(t, "css", "stylesheets"), _sheets(t), KEYS)


@query("font_summary", FONT_SQL + " select site, family, count(*) as pages, family <> 'serif' as named from f group by 1, 2")
def _(t):
    return C.font_summary(C.page_fonts(D.records(t, "css", "stylesheets"), _sheets(t), KEYS), KEYS)


@query("named_fonts", FONT_SQL + " select site, count(distinct family) as distinct_families, count(distinct family) filter (family <> 'serif') as named_families from f group by 1")
def _(t):
    return C.named_font_count(C.font_summary(C.page_fonts(D.records(t, "css", "stylesheets"), _sheets(t), KEYS), KEYS), KEYS)


TOOL_SQL = P_SQL + """
, tools as (select site, k, url, unnest(case k % 5 when 1 then [{'tool': 'Google tag (gtag.js)', 'category': 'analytics', 'id': 'G-ABC100000' || (k % 3), 'source': 'src'}]
  when 2 then [{'tool': 'Google Tag Manager', 'category': 'tag_manager', 'id': 'GTM-AB100' || (k % 4), 'source': 'inline'}, {'tool': 'Meta Pixel', 'category': 'ads_pixel', 'id': '12345670' || (k % 2), 'source': 'inline'}]
  when 3 then [{'tool': 'Cookiebot', 'category': 'consent', 'id': '', 'source': 'src'}] when 4 then [{'tool': 'Hotjar', 'category': 'session_recording', 'id': '98765', 'source': 'inline'}] else [] end) as x from p),
tt as (select site, k, url, x.tool as tool, x.category as category, x.id as id, x.source as source from tools)"""


@query("detect_tools", TOOL_SQL + " select k as page_no, tool, category, id as ids, source from tt")
def _(t):
    return D.with_tools(t).select("page_no", F.explode("tools").alias("x")).select("page_no", "x.tool", "x.category", F.array_join("x.ids", ",").alias("ids"), "x.source")


@query("tool_summary", TOOL_SQL + " select site, tool, category, count(*) as pages_present, any_value(n) as pages_total from tt join (select site, count(*) as n from p group by 1) using (site) group by 1, 2, 3")
def _(t):
    return C.tool_summary(D.with_tools(t), KEYS)


@query("tool_ids", TOOL_SQL + " select site, tool, id, count(*) as pages from tt where id <> '' group by 1, 2, 3")
def _(t):
    return C.tool_ids(D.with_tools(t), KEYS)


@query("tool_missing_on", TOOL_SQL + """
, have as (select distinct site, tool from tt), miss as (select p.site, tool, k from p join have using (site) where not exists (select 1 from tt where tt.k = p.k and tt.tool = have.tool))
select site, tool, k as page_no, place from (select *, row_number() over (partition by site, tool order by k) as place from miss) where place <= 50""")
def _(t):
    return C.tool_missing_on(D.with_tools(t), KEYS, "page_no").select("site", "tool", "page_no", "place")


@query("measurement_flags", P_SQL + """
select site, count(*) as pages_checked, bool_or(k % 5 in (1, 2)) as has_measurement, bool_or(k % 5 = 3) as has_consent_tool, count(*) filter (k % 5 not in (1, 2)) as untagged,
  round_even(count(*) filter (k % 5 in (1, 2))::double / count(*) * 100, 0)::bigint as analytics_pct from p group by 1""")
def _(t):
    return C.share_tagged(C.measurement_flags(D.with_tools(t), KEYS))


@query("shows_ads", P_SQL + """
select site, case when site like '%.org' then true else bool_or(k % 5 = 2) end as shows_ads from p group by 1""")
def _(t):
    # Sites under .org stand for runs without a measurement report.
    tools = D.with_tools(t)
    signals = C.ad_signals(tools.filter(~F.col("site").endswith(".org")), KEYS)
    return C.shows_ads(signals, t.pages.select(host(F.col("url")).alias("site")).distinct(), KEYS)


ISSUE_SQL = P_SQL + """
, i as (select site, k, unnest(case k % 6 when 1 then ['error|LocalBusiness|missing_required|address'] when 2 then
  ['warning|Person|missing_recommended|url', 'warning|Person|missing_recommended|sameAs', 'error|WebSite|missing_required|url', 'warning|Organization|missing_recommended|logo',
   'warning|Organization|missing_recommended|url', 'warning|Organization|missing_recommended|sameAs', 'warning|Organization|person_organization_conflation|', 'warning||unresolved_reference|', 'error||conflicting_id|']
  when 3 then list_filter(['warning|Question|faq_not_visible|', 'error|Question|incomplete_question|'], lambda x: true)
  when 5 then ['error||missing_context|', 'error|BreadcrumbList|incomplete_list_item|'] else [] end) as x from p)"""


@query("structured_data_issues", ISSUE_SQL + " select k as page_no, string_agg(x, ',' order by x) as issues from i group by 1")
def _(t):
    rows = D.with_issues(t)
    text = F.transform("issues", lambda i: F.concat_ws("|", i["severity"], F.coalesce(i["type"], F.lit("")), i["code"], F.coalesce(i["property"], F.lit(""))))
    return rows.select("page_no", F.array_join(F.array_sort(F.array_distinct(text)), ",").alias("issues")).filter(F.col("issues") != "")


@query("issue_summary", ISSUE_SQL + """
 select site, split_part(x, '|', 1) as severity, nullif(split_part(x, '|', 2), '') as type, split_part(x, '|', 3) as code, nullif(split_part(x, '|', 4), '') as property, count(*) as pages from i group by all""")
def _(t):
    return SD.issue_summary(D.with_issues(t), KEYS)


@query("unresolved_refs", P_SQL + " select k as page_no, '#nobody' as ref from p where k % 6 = 2")
def _(t):
    rows = D.records(t, "lines").select("page_no", F.explode(SD.unresolved_refs()).alias("r"))
    return rows.select("page_no", SD.text_of(F.col("r")).alias("ref"))


@query("conflicting_ids", P_SQL + " select k as page_no, '#org' as id from p where k % 6 = 2")
def _(t):
    return D.records(t, "lines").select("page_no", F.explode(SD.conflicting_ids()).alias("id"))


@query("schema_type_counts", P_SQL + """
select site, type, count(*) as pages from (select site, unnest(case k % 6 when 1 then ['Dentist'] when 2 then ['Organization', 'Person', 'WebSite'] when 3 then ['Answer', 'FAQPage', 'Question']
  when 5 then ['BreadcrumbList', 'ListItem', 'Product', 'Review'] else [] end) as type from p) group by 1, 2""")
def _(t):
    return SD.schema_type_counts(D.records(t, "json_types"), KEYS)


@query("schema_coverage", P_SQL + " select site, count(*) as pages_checked, count(*) filter (k % 6 in (1, 2, 3, 5)) as pages_with_json_ld, count(*) filter (k % 6 = 4) as pages_with_syntax_errors from p group by 1")
def _(t):
    return SD.schema_coverage(D.records(t, "lines"), KEYS)


@query("site_entities", P_SQL + """
select site, case k % 6 when 1 then '#biz' else '#org' end as id, count(*) as pages, case k % 6 when 1 then 1 else 2 end::bigint as names, case k % 6 when 1 then 'Biz @' else 'Org' end as first_name, k % 6 = 2 as conflict
from p where k % 6 in (1, 2) group by site, k % 6""")
def _(t):
    return SD.site_entities(D.records(t, "lines"), KEYS)


@query("jsonld_objects", P_SQL + """
select k as page_no, case k % 6 when 1 then 1 when 2 then 6 when 3 then 6 else 7 end::bigint as objects, case k % 6 when 1 then 1 when 2 then 3 when 3 then 1 else 3 end::bigint as entities,
 case k % 6 when 1 then 1 when 2 then 4 else 1 end::bigint as nodes from p where k % 6 in (1, 2, 3, 5)""")
def _(t):
    rows = SD.jsonld_objects(D.records(t, "lines"), ["page_no"])
    return rows.groupBy("page_no").agg(F.count("*").alias("objects"), F.count_if("is_entity").alias("entities"), F.count_if("is_node").alias("nodes"))


@query("faqs_and_testimonials", P_SQL + """
select k as page_no, 'faq' as kind, unnest(['Unseen question?', 'No answer?', 'Call us']) as text, unnest(['Yes', null, 'Now']) as extra from p where k % 6 = 3 union all
select k, 'testimonial', 'Good', 'Ann' from p where k % 6 = 5""")
def _(t):
    pages = D.records(t, "lines")
    faq = SD.faqs(pages, ["page_no"]).select("page_no", F.lit("faq").alias("kind"), F.col("question").alias("text"), F.col("answer").alias("extra"))
    return faq.unionByName(SD.testimonials(pages, ["page_no"]).select("page_no", F.lit("testimonial").alias("kind"), "text", F.col("author").alias("extra")))


@query("company_names", P_SQL + """
select site, n as name, count(*) as pages from (select site, unnest(case k % 6 when 1 then ['Biz @'] when 2 then ['Org', 'Jane Doe'] else [] end) as n from p) group by 1, 2""")
def _(t):
    return SD.company_names(D.records(t, "lines"), KEYS)


A11Y_SQL = P_SQL + r"""
, a0 as (select k, site, url, title, h1, len(regexp_extract_all(html, '<a ')) as links, regexp_extract(html, '<html lang="([^"]*)"', 1) as lang from p where k % 19 <> 0 and k % 23 <> 0),
e as (select k, site, 'page-title' as rule, 1 as n, (title = '')::int as bad from a0 union all select k, site, 'html-lang', 1, (lang = '')::int from a0
 union all select k, site, 'image-alternative', 1 + (k % 5 = 1)::int, (k % 3 = 0)::int from a0
 union all select k, site, 'control-name', case when k % 4 = 3 then 2 else 1 end, (k % 4 in (0, 3))::int from a0
 union all select k, site, 'button-name', case when k % 5 = 1 then 2 else 1 end, (k % 5 = 0)::int from a0 where k % 5 in (0, 1)
 union all select k, site, 'frame-name', 1, (k % 7 = 0)::int from a0 where k % 7 in (0, 1)
 union all select k, site, 'link-name', links + (k % 8 = 0)::int + (k % 3 = 1)::int + (k % 9 = 0)::int + (k % 7 = 3)::int + (k % 7 = 4)::int + (k % 4 in (1, 2))::int, (k % 8 = 0)::int from a0)"""


@query("rule_checks", A11Y_SQL + " select k as page_no, rule, n::bigint as elements, case when bad > 0 then 'WARNING' else 'PASS' end as status from e where n > 0")
def _(t):
    return A.rule_checks(A.accessibility_elements(D.records(t, "lines"), ["page_no"]), ["page_no"]).select("page_no", "rule", "elements", "status")


@query("accessibility_findings", A11Y_SQL + """
 select site, rule, case rule when 'page-title' then '2.4.2' when 'html-lang' then '3.1.1' when 'image-alternative' then '1.1.1' when 'link-name' then '2.4.4' else '4.1.2' end as criterion, sum(bad)::bigint as findings
 from e group by 1, 2 having sum(bad) > 0""")
def _(t):
    return A.accessibility_findings(A.accessibility_elements(D.records(t, "lines"), KEYS)).groupBy("site", "rule", "criterion").agg(F.count("*").alias("findings"))


@query("accessibility_summary", A11Y_SQL + """
, f as (select site, sum(bad)::bigint as findings from e group by 1), c as (select site, count(*) filter (k % 19 <> 0 and k % 23 <> 0) as pages_checked, count(*) filter (k % 19 = 0 or k % 23 = 0) as pages_excluded from p group by 1)
select site, pages_checked, pages_excluded, coalesce(findings, 0) as findings, case when pages_checked = 0 then 'UNKNOWN' when findings > 0 then 'WARNING' else 'PASS' end as status from c left join f using (site)""")
def _(t):
    pages = D.records(t, "lines")
    return A.accessibility_summary(pages, A.accessibility_elements(pages, KEYS), KEYS)


@query("exclusions", P_SQL + " select site, case when k % 19 = 0 then 'retrieval_error' else 'truncated_response' end as reason, count(*) as pages from p where k % 19 = 0 or k % 23 = 0 group by 1, 2")
def _(t):
    return A.exclusions(D.records(t, "lines"), KEYS)


PROOF_SQL = P_SQL + f"""
, s as (select site, k, unnest(list_filter([case when k % 6 = 5 then 'json_ld_reviews|JSON-LD Review' end, case when k % 5 = 2 then 'testimonial_section|What our clients say' end,
  case when k % 5 = 3 then 'attributed_quote|“{D.QUOTE}”' end, case when k % 11 = 2 then 'review_widget|Trustpilot' end, case when k % 7 = 3 then 'review_link|Leave a review' end,
  case when k % 11 = 1 then 'referral_ask|Refer a friend and save.' end], lambda x: x is not null)) as x from p),
x as (select site, k, split_part(x, '|', 1) as kind, split_part(x, '|', 2) as example from s)"""


@query("proof_signals", PROOF_SQL + " select site, k as page_no, kind, example from x")
def _(t):
    return SO.signals_union(D.with_signals(t), KEYS).select("site", "page_no", "kind", "example")


@query("proof_counts", PROOF_SQL + " select site, kind, count(*) as pages from x group by 1, 2")
def _(t):
    return SO.proof_counts(D.with_signals(t), KEYS)


@query("proof_summary", PROOF_SQL + """
, g as (select p.site, p.k, coalesce(bool_or(kind not in ('review_link', 'referral_ask')), false) as shown, coalesce(bool_or(kind in ('review_link', 'referral_ask')), false) as asked from p left join x using (k) group by 1, 2)
select site, count(*) as pages_checked, count(*) filter (shown) as pages_with_proof, bool_or(shown) as has_proof, bool_or(asked) as has_ask,
  case when bool_or(shown) and bool_or(asked) then 'PASS' when bool_or(shown) or bool_or(asked) then 'WARNING' else 'FAIL' end as status from g group by 1""")
def _(t):
    return SO.proof_summary(D.with_signals(t), KEYS)


@query("proof_examples", PROOF_SQL + """
, o as (select *, list_position(['json_ld_reviews', 'testimonial_section', 'attributed_quote', 'review_widget', 'review_link', 'referral_ask'], kind) as pos from x)
select site, k as page_no, kind, example, place from (select *, row_number() over (partition by site order by k, pos) as place from o) where place <= 10""")
def _(t):
    return SO.proof_examples(D.with_signals(t), KEYS).select("site", "page_no", "kind", "example", "place")


@query("review_profiles", P_SQL + " select distinct site, 'Yelp' as platform, 'https://www.yelp.com/biz/acme' as profile from p where k % 7 = 4")
def _(t):
    return SO.review_profiles(D.records(t, "web_links"), KEYS)


PROFILE_SQL = P_SQL + """
, e as (select site, k, 'https://www.linkedin.com/company/acme' || (k % 2) || '/' as url, 'linkedin' as network, 0.75 as c, k % 4 = 0 as vouched from p where k % 3 = 1
  union all select site, k, 'https://www.linkedin.com/company/biz', 'linkedin', 0.9, true from p where k % 6 = 1 union all select site, k, 'https://biz.example.net/about', 'other', 0.9, true from p where k % 6 = 1
  union all select site, k, 'https://g.page/r/abc/review', 'google-business', 0.75, k % 4 = 0 from p where k % 7 = 3
  union all select site, k, 'https://github.com/org', 'github', 0.9, true from p where k % 6 = 2),
g as (select site, network, url, max(c)::double as confidence, count(distinct k) as evidence, bool_or(vouched) as vouched from (select distinct * from e) group by 1, 2, 3),
o as (select g.* exclude (vouched) from g join (select site, count(*) as n from p group by 1) using (site) where vouched or evidence >= greatest(2.0, n / 3.0))"""


@query("owner_profiles", PROFILE_SQL + " select site, network, url, confidence, evidence from o")
def _(t):
    pages = D.records(t, "metas", "web_links")
    return SO.owner_profiles(SO.profile_evidence(pages, None, KEYS), pages, KEYS)


@query("profile_list", PROFILE_SQL + " select site, network, url, round_even(confidence * 100, 0)::int || '%' as confidence, evidence from o")
def _(t):
    pages = D.records(t, "metas", "web_links")
    return SO.profile_list(SO.owner_profiles(SO.profile_evidence(pages, None, KEYS), pages, KEYS), KEYS)


@query("social_networks", """
select c_custkey, case c_custkey % 5 when 0 then 'linkedin' when 1 then 'x' when 2 then null when 3 then 'google-business' else 'substack' end as network, c_custkey % 3 <> 0 as is_profile from customer""")
def _(t):
    k = F.col("c_custkey")
    name = F.element_at(F.array(*map(F.lit, ["www.linkedin.com", "twitter.com", "notx.company", "maps.google.com", "me.substack.com"])), (k % 5 + 1).cast("int"))
    url = F.concat(F.lit("https://"), name, F.when(k % 3 == 0, "/posts/1").otherwise("/acme"))
    return t.customer.select("c_custkey", SO.social_network(url).alias("network"), SO.is_profile(url).alias("is_profile"))


@query("usable_pages", TEXT_LENGTH + " select page_id as page_no from pages join f on k = page_id")
def _(t):
    from ..sources.html import parse_html
    from .urls import site_pages

    pages = P.page_record(parse_html(site_pages(t)), "visible_text").withColumn("duplicate_of", F.lit(None).cast("string"))
    return P.usable_pages(pages).filter(clean(F.col("visible_text")) != "").select("page_no")
