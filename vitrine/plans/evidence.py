"""Identity, listings, quotes, people and run summaries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.identity import same_city, same_name
from ..operators import checks as C, dashboard as B, evidence as E, identity as I, ranking as R, social as SO
from . import derived as D
from .checks import P_SQL, PROOF_SQL
from .copy import LONG_SQL, SIGNAL_SQL, scored_pages
from .registry import query

KEYS = ["site"]


# ---- identity ----------------------------------------------------------------------------------------------------
@query("identity_profile", """
with v as (select c_nationkey as site, 'names' as kind, upper(c_mktsegment) as value, 0 as r, c_custkey as k from customer where c_custkey % 3 = 0 union all
  select c_nationkey, 'names', '  ' || lower(c_mktsegment) || ' ', 1, c_custkey from customer union all select s_nationkey, 'names', s_name, 2, s_suppkey from supplier union all
  select s_nationkey, 'cities', 'City ' || s_suppkey % 3, 3, s_suppkey from supplier)
select site, kind, arg_min(trim(value), r * 1000000 + k) as value, min(r) as source from v where trim(value) <> '' group by site, kind, lower(trim(value))""")
def _(t):
    def rows(df, site, kind, value, rank, at):
        return df.select(F.col(site).alias("site"), F.lit(kind).alias("kind"), value.alias("value"), F.lit(rank).alias("source_rank"), F.col(at).alias("at"))

    segment = F.col("c_mktsegment")
    values = rows(t.customer.filter(F.col("c_custkey") % 3 == 0), "c_nationkey", "names", F.upper(segment), 0, "c_custkey").unionByName(
        rows(t.customer, "c_nationkey", "names", F.concat(F.lit("  "), F.lower(segment), F.lit(" ")), 1, "c_custkey")).unionByName(
        rows(t.supplier, "s_nationkey", "names", F.col("s_name"), 2, "s_suppkey")).unionByName(
        rows(t.supplier, "s_nationkey", "cities", F.concat(F.lit("City "), F.col("s_suppkey") % 3), 3, "s_suppkey"))
    return I.identity_profile(values, KEYS).select("site", "kind", "value", F.col("first.source_rank").alias("source"))


@query("json_ld_identity", P_SQL + """
, v as (select site, k, unnest(case k % 6 when 1 then ['names|Biz @', 'phones|5125550100', 'categories|Dentist'] when 2 then ['names|Org', 'names|Jane Doe', 'categories|Person'] else [] end) as x from p)
select site, split_part(x, '|', 1) as kind, split_part(x, '|', 2) as value from v group by all""")
def _(t):
    values = I.json_ld_values(D.records(t, "lines"), KEYS).withColumn("source_rank", F.lit(1))
    return I.identity_profile(values, KEYS).select("site", "kind", "value")


@query("same_city", """
select c_custkey, case when c_nationkey % 4 = 0 then null when c_nationkey % 4 = 1 then true when c_nationkey % 4 = 2 then false else false end as same from customer""")
def _(t):
    city = F.element_at(F.array(F.lit(" "), F.lit("near Round Rock, TX"), F.lit("Texas"), F.lit("Xaustinx")), (F.col("c_nationkey") % 4 + 1).cast("int"))
    return t.customer.select("c_custkey", same_city(city, F.array(F.lit("Round Rock"), F.lit("Austin"))).alias("same"))


@query("same_name", """
select c_custkey, case c_custkey % 4 when 0 then 'match' when 1 then 'variant' when 2 then 'differs' end as verdict from customer""")
def _(t):
    listed = F.element_at(F.array(F.lit("Acme Dental, Inc."), F.lit("ACME dental"), F.lit("Beta"), F.lit(None).cast("string")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return t.customer.select("c_custkey", same_name(listed, F.array(F.lit("acme-dental inc"), F.lit("Acme Group"))).alias("verdict"))


@query("suggest_profile", """
with l as (select s_nationkey as site, min(s_name) as found from supplier group by 1)
select c_custkey, case when c_custkey % 2 = 0 then c_name else found end as business_name from customer left join l on c_nationkey = l.site""")
def _(t):
    latest = t.supplier.groupBy(F.col("s_nationkey").alias("nation")).agg(F.min("s_name").alias("business_name"))
    sites = t.customer.select(F.col("c_custkey").alias("site"), "c_nationkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("  ").alias("business_name"))
    per_site = sites.select("site", "c_nationkey").join(latest, F.col("c_nationkey") == F.col("nation"))
    return I.suggest_profile(sites, per_site, ["business_name"]).select(F.col("site").alias("c_custkey"), "business_name")


# ---- listing: customers are the candidates of a supplier's nation -------------------------------------------------
def _places(t):
    k = F.col("c_custkey")
    return t.customer.select(F.col("c_nationkey").alias("site"), k.alias("pos"), F.col("c_name").alias("place_id"),
                             F.when(k % 17 == 0, F.concat(F.lit("https://www.n"), "c_nationkey", F.lit(".test/x"))).otherwise("other.test").alias("website"),
                             F.when(k % 13 == 0, F.concat(F.lit("(512) 555-01"), F.lpad("c_nationkey", 2, "0"))).alias("phone"), F.lit(None).cast("string").alias("phone_intl"))


def _profiles(t):
    n = F.col("n_nationkey")
    return t.nation.select(n.alias("site"), F.concat(F.lit("n"), n, F.lit(".test")).alias("domain"), F.array(F.concat(F.lit("51255501"), F.lpad(n, 2, "0"))).alias("phones"),
                           F.array("n_name", F.lit("Group")).alias("names"), F.array(F.lit("Dentist")).alias("categories"),
                           F.concat(F.lit("12 main street, n1h 1g"), n % 3, F.lit(" we are open")).alias("site_text"))


@query("listing_match", """
with p as (select c_nationkey as site, c_custkey as k, c_name, case when c_custkey % 17 = 0 then 'website' when c_custkey % 13 = 0 then 'phone' end as m from customer)
select site, count(*) as candidates, arg_min(c_name, k) filter (m is not null) as place_id, arg_min(m, k) filter (m is not null) as matched_by, bool_or(m is not null) as found from p group by 1""")
def _(t):
    return I.listing_match(_places(t), _profiles(t), KEYS)


@query("listing_compare", """
with c as (select c_custkey as k, c_nationkey as n from customer)
select k, field, case field when 'name' then case k % 3 when 0 then 'match' when 1 then 'variant' end when 'phone' then case k % 4 when 0 then 'match' when 1 then 'differs' end
  when 'website' then case k % 2 when 0 then 'match' else 'differs' end when 'postal_code' then case when n % 3 = k % 3 then 'match' else 'differs' end
  when 'street_number' then case k % 2 when 0 then 'match' else 'differs' end end as agrees from c, (values ('name'), ('phone'), ('website'), ('postal_code'), ('street_number'), ('category')) f(field)""")
def _(t):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    listing = t.customer.select(
        n.alias("site"), k.alias("k"), F.when(k % 3 == 0, F.concat(F.lit("nation "), n)).when(k % 3 == 1, F.concat(F.lit("NATION_"), n, F.lit(" LLC"))).alias("name"),
        F.when(k % 4 == 0, F.concat(F.lit("+1 512-555-01"), F.lpad(n, 2, "0"))).when(k % 4 == 1, "303-555-0199").alias("phone"), F.lit(None).cast("string").alias("phone_intl"),
        F.when(k % 2 == 0, F.concat(F.lit("http://n"), n, F.lit(".test"))).otherwise("x.test").alias("website"), F.concat(F.lit("N1H 1G"), k % 3).alias("postal_code"),
        F.when(k % 2 == 0, "12").otherwise("7").alias("street_number"), F.lit("dentist").alias("category"))
    # The customer, not its nation, is the site here, so that every listing is compared on its own.
    found = I.listing_compare(listing.drop("site").withColumnRenamed("k", "site"), _by_customer(t), KEYS)
    return found.select(F.col("site").alias("k"), "field", "agrees")


def _by_customer(t):
    own = _profiles(t).withColumnRenamed("site", "nation")
    return t.customer.select(F.col("c_custkey").alias("site"), F.col("c_nationkey").alias("nation")).join(own, "nation")


@query("profile_field_mismatch", """
with c as (select c_custkey as k, c_name as n from customer)
select k as site, 'phone' as field, '303-555-0000' as current, '512-555-0100' as proposed from c where k % 2 = 1 union all
select k, 'title', upper(n), n || '!' from c where k % 3 = 0 union all select k, 'website', 'https://www.b.test', 'a.test' from c where k % 5 = 0""")
def _(t):
    k = F.col("c_custkey")
    have = t.customer.select(k.alias("site"), F.upper("c_name").alias("title"), F.when(k % 2 == 0, "+1 (512) 555 0100").otherwise("303-555-0000").alias("phone"),
                             F.when(k % 5 == 0, "https://www.b.test").otherwise("https://www.a.test/").alias("website"), F.lit("x").alias("description"))
    want = t.customer.select(k.alias("site"), F.when(k % 3 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.concat(F.lit(" "), "c_name")).alias("title"), F.lit("512-555-0100").alias("phone"),
                             F.lit("a.test").alias("website"), F.lit(None).cast("string").alias("description"))
    return I.profile_field_mismatch(have, want, KEYS)


@query("location_match", "select c_custkey, c_custkey % 2 = 0 or c_custkey % 3 = 0 as belongs from customer")
def _(t):
    k = F.col("c_custkey")
    website = F.when(k % 2 == 0, "https://www.acme.test").when(k % 2 == 1, "beta.test")
    return t.customer.select("c_custkey", I.location_match(website, F.when(k % 3 == 0, "(512) 555-0100").otherwise("12"), F.lit("acme.test/x"), F.lit("512.555.0100")).alias("belongs"))


@query("review_stats", r"""
select conv_id as site, count(*) as sample, max(turn) as sample_latest, min(turn) as sample_oldest, count(*) filter (len(regexp_extract_all(text, '\S+')) >= 20) as sample_detailed from conversations group by 1""")
def _(t):
    return I.review_stats(t.conversations.select(F.col("conv_id").alias("site"), F.col("turn").alias("published"), "text"), KEYS)


# ---- quotes and pages --------------------------------------------------------------------------------------------
@query("verify_quotes", r"""
with d as (select doc_id as k, trim(lower(regexp_replace(text, '\s+', ' ', 'g'))) as t, trim(lower(regexp_replace(case when doc_id % 3 = 0 then right(text, 50) when doc_id % 3 = 1 then left(text, 30) || 'zzz' else '' end, '\s+', ' ', 'g'))) as q from documents)
select k as claim_id, q <> '' and contains(t, q) as verified from d""")
def _(t):
    k = F.col("doc_id")
    quote = F.when(k % 3 == 0, F.concat(F.lit("  "), F.right("text", F.lit(50)))).when(k % 3 == 1, F.concat(F.left("text", F.lit(30)), F.lit("zzz"))).otherwise("")
    pages = t.documents.select(F.col("lang").alias("site"), k.alias("url"), F.col("text").alias("visible_text"))
    claims = t.documents.select(F.col("lang").alias("site"), k.alias("url"), k.alias("claim_id"), quote.alias("quote"))
    return E.verify_quotes(claims, pages, KEYS).select("claim_id", "verified")


@query("attribute_quotes", r"""
with d as (select doc_id as k, lang as site, source, trim(lower(regexp_replace(text, '\s+', ' ', 'g'))) as t from documents),
r as (select *, row_number() over (partition by site order by k) as place from d qualify place <= 8),
q as (select k, site, left(t, 25) as q from d where t <> ''),
m as (select q.k, min(place) as place from q join r on q.site = r.site and contains(r.t, q.q) group by 1)
select q.k as claim_id, 'https://s.test/' || coalesce(r.k, q.k) as url, m.place is not null as verified from q left join m using (k) left join r on r.site = q.site and r.place = m.place""")
def _(t):
    from ..functions.scalars import squash

    pages = t.documents.select(F.col("lang").alias("site"), F.col("doc_id").alias("page_no"), F.concat(F.lit("https://s.test/"), "doc_id").alias("url"), F.col("text").alias("visible_text"))
    read = R.first_n(pages, KEYS, [F.col("page_no")], 8, "place")
    claims = pages.withColumn("quote", F.left(squash(F.col("visible_text")), F.lit(25))).filter(F.col("quote") != "").select(
        "site", F.col("page_no").alias("claim_id"), "quote", F.concat("url", F.lit("/?x=1")).alias("url"))
    return E.attribute_quotes(claims, read, pages, KEYS).select("claim_id", "url", "verified")


@query("attribute_quotes_everywhere", r"""
with d as (select doc_id as k, lang as site, trim(lower(regexp_replace(text, '\s+', ' ', 'g'))) as t from documents),
q as (select k, site, substr(t, 1 + k % 40, 20 + k % 30) as q from d where t <> ''),
n as (select k, site, trim(q) as q from q where trim(q) <> ''),
m as (select q.k, min(d.k) as found from n q join d on q.site = d.site and contains(d.t, q.q) group by 1)
select n.k as claim_id, 'https://s.test/' || coalesce(m.found, n.k) as url, m.found is not null as verified from n left join m using (k)""")
def _(t):
    from ..functions.scalars import squash

    pages = t.documents.select(F.col("lang").alias("site"), F.col("doc_id").alias("place"), F.concat(F.lit("https://s.test/"), "doc_id").alias("url"), F.col("text").alias("visible_text"))
    part = F.substring(squash(F.col("visible_text")), (1 + F.col("place") % 40).cast("int"), (20 + F.col("place") % 30).cast("int"))
    claims = pages.withColumn("quote", part).filter(F.trim("quote") != "").select("site", F.col("place").alias("claim_id"), "quote", F.concat("url", F.lit("/?x=1")).alias("url"))
    return E.attribute_quotes_everywhere(claims, pages, KEYS).select("claim_id", "url", "verified")


@query("reading_pages", """
with p as (select doc_id as k, lang as site, ['blog', 'contact', 'about', 'homepage', 'case-study'][(doc_id % 5 + 1)::int] as label from documents where trim(text) <> '')
select site, k as page_no, label, row_number() over (partition by site order by list_position(['homepage', 'about', 'service', 'product', 'pricing', 'location', 'contact', 'case-study', 'blog'], label), k) as place from p qualify place <= 6""")
def _(t):
    label = F.element_at(F.array(*map(F.lit, ["blog", "contact", "about", "homepage", "case-study"])), (F.col("doc_id") % 5 + 1).cast("int"))
    pages = t.documents.select(F.col("lang").alias("site"), F.col("doc_id").alias("page_no"), label.alias("label"), F.col("text").alias("visible_text"))
    return E.reading_pages(pages, KEYS).select("site", "page_no", "label", "place")


@query("people_pages", """
with p as (select doc_id as k, lang as site, ['team/a', 'about-us', 'blog', '', 'our-doctors'][(doc_id % 5 + 1)::int] as path, doc_id % 7 = 0 as person from documents),
r as (select *, case when path in ('team/a', 'our-doctors') then 0 when person then 1 when path = 'about-us' then 2 when path = '' then 3 end as r from p)
select site, k as page_no, row_number() over (partition by site order by r, k) as place from r where r is not null qualify place <= 8""")
def _(t):
    path = F.element_at(F.array(*map(F.lit, ["team/a", "about-us", "blog", "", "our-doctors"])), (F.col("doc_id") % 5 + 1).cast("int"))
    url = F.concat(F.lit("https://s.test/"), path, F.when(path == "", "").otherwise(F.concat(F.lit("/x"), "doc_id")))
    pages = t.documents.select(F.col("lang").alias("site"), F.col("doc_id").alias("page_no"), F.when(path == "", F.concat(F.lit("https://s.test/?"), "doc_id")).otherwise(url).alias("url"),
                               F.when(path == "", "homepage").otherwise("other").alias("label"))
    places = pages.filter(F.col("page_no") % 7 == 0).select("site", F.col("url").alias("person"), "url")
    people = places.select("site", "person", F.lit(1).alias("pages"))
    return E.people_pages(pages, people, places, KEYS).select("site", "page_no", "place")


@query("crawl_text", """
with p as (select doc_id as k, lang as site, '## Doc ' || doc_id || chr(10) || chr(10) || left(text, 1500) as x, row_number() over (partition by lang order by doc_id) as n from documents)
select site, string_agg(x, chr(10) || chr(10) order by n) as text from p where n <= 12 group by 1""")
def _(t):
    pages = t.documents.select(F.col("lang").alias("site"), F.col("doc_id").alias("page_no"), F.concat(F.lit("Doc "), "doc_id").alias("title"), F.lit("").alias("url"),
                               F.lit(None).cast("string").alias("meta_description"), F.col("text").alias("visible_text"))
    return E.crawl_text(pages, KEYS)


@query("candidate_urls", """
with c as (select conv_id as q, role as url, min(turn) as pos from conversations where role <> 'system' group by 1, 2)
select q as question, url, row_number() over (partition by q order by pos) as place from c qualify place <= 3""")
def _(t):
    picked = t.conversations.select(F.lit("s").alias("site"), F.col("conv_id").alias("question"), F.col("turn").alias("pos"), F.col("role").alias("url"))
    known = picked.select("site", "url").filter(F.col("url") != "system").distinct()
    return E.candidate_urls(picked, known, KEYS).select("question", "url", "place")


@query("coverage_summary", """
select o_custkey as site, count(*) filter (o_orderstatus = 'F') as answered, count(*) filter (o_orderstatus = 'O') as partial, count(*) filter (o_orderstatus = 'P' and o_orderkey % 4 <> 0) as missing,
 count(*) filter (o_orderstatus = 'P' and o_orderkey % 4 = 0) as failed, count(*) as questions, case when count(*) filter (o_orderstatus = 'P' and o_orderkey % 4 = 0) > 0 then 'PARTIAL' else 'COMPLETE' end as status from orders group by 1""")
def _(t):
    bad = (F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 4 == 0)
    coverage = F.when(F.col("o_orderstatus") == "F", "answered").when(F.col("o_orderstatus") == "O", "partial").when(~bad, "missing")
    return E.coverage_summary(t.orders.select(F.col("o_custkey").alias("site"), coverage.alias("coverage"), F.when(bad, "timeout").alias("error")), KEYS)


@query("coverage_order", "select o_orderstatus as coverage, case o_orderstatus when 'F' then 2 when 'O' then 1 else 0 end as gap_rank, count(*) as questions from orders group by 1")
def _(t):
    word = F.when(F.col("o_orderstatus") == "F", "answered").when(F.col("o_orderstatus") == "O", "partial").otherwise("missing")
    return t.orders.groupBy(F.col("o_orderstatus").alias("coverage"), E.coverage_order(word).alias("gap_rank")).agg(F.count("*").alias("questions"))


# ---- people ------------------------------------------------------------------------------------------------------
WORDS = ["Dr. Jane", "Smith", "Lee", "Ana", "Smith DDS", "Roy"]


def _person_name():
    pick = lambda at: F.element_at(F.array(*map(F.lit, WORDS)), (at % 6 + 1).cast("int"))
    return F.concat_ws(" ", pick(F.col("c_custkey")), pick(F.floor(F.col("c_custkey") / 6)), F.when(F.col("c_custkey") % 5 == 0, pick(F.floor(F.col("c_custkey") / 36))))


PEOPLE_SQL = f"""
with n as (select c_custkey as k, c_nationkey as site, concat_ws(' ', {WORDS}[c_custkey % 6 + 1], {WORDS}[(c_custkey // 6) % 6 + 1], case when c_custkey % 5 = 0 then {WORDS}[(c_custkey // 36) % 6 + 1] end) as name from customer),
s as (select distinct site, list_sort(list_filter(list_distinct(regexp_extract_all(lower(name), '[a-z]+')), lambda w: w not in ('dr', 'dds'))) as tokens from n)"""


@query("same_person", PEOPLE_SQL + """
select a.site, array_to_string(a.tokens, ' ') as small, array_to_string(b.tokens, ' ') as large from s a join s b on a.site = b.site and len(a.tokens) >= 2 and len(a.tokens) <= len(b.tokens) and list_has_all(b.tokens, a.tokens)""")
def _(t):
    sets = t.customer.select(F.col("c_nationkey").alias("site"), E.name_tokens(_person_name()).alias("tokens")).distinct()
    return E.same_person(sets, KEYS).select("site", F.array_join("small", " ").alias("small"), F.array_join("large", " ").alias("large"))


@query("schema_people", P_SQL + """
select site, 'Jane Doe' as name, 1 + count(distinct k % 24) as same_as, count(*) as pages, 'sameAs,worksFor' as fields from p where k % 6 = 2 group by 1""")
def _(t):
    linked = F.concat(F.lit('"name":"Jane Doe","sameAs":["https://jane.example.org/","mailto:jane","https://l'), F.col("page_no") % 24, F.lit('.example.org/"]'))
    captured = D.captured(t).withColumn("html", F.replace("html", F.lit('"name":"Jane Doe"'), linked))
    found, _ = E.schema_people(D.records_of(captured, "lines"), KEYS)
    return found.select("site", "name", "same_as", "pages", F.array_join("fields", ",").alias("fields"))


@query("practitioner_summary", """
with p as (select c_nationkey as site, c_custkey as k, case when c_custkey % 4 <> 0 then c_custkey // 40 end as page from customer),
s as (select *, count(page) over (partition by site, page) as sharing from p)
select site, count(*) as practitioners, count(*) filter (k % 2 = 0 and page is not null and sharing = 1) as with_dedicated_page, count(*) filter (k % 3 = 0) as with_person_schema,
  count(*) filter (k % 6 = 0) as with_same_as, count(*) filter (k % 5 <> 0) as with_credentials from s group by 1""")
def _(t):
    k = F.col("c_custkey")
    people = t.customer.select(F.col("c_nationkey").alias("site"), F.when(k % 4 != 0, F.floor(k / 40)).alias("profile_url"), (k % 2 == 0).alias("dedicated_page"),
                               (k % 3 == 0).alias("person_schema"), (k % 6 == 0).alias("same_as"), (k % 5 != 0).alias("credentials"))
    return E.practitioner_summary(people, KEYS)


@query("practitioner_order", "select c_custkey, (c_custkey % 2 = 0)::int + (c_custkey % 3 = 0)::int + (c_custkey % 5 = 0)::int as passed from customer")
def _(t):
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", E.practitioner_order({"dedicated_page": k % 2 == 0, "person_schema": k % 3 == 0, "same_as": k % 5 == 0}).alias("passed"))


@query("ad_pages", "select p_type as site, p_brand as page_name, count(*) as ads from part group by 1, 2")
def _(t):
    return E.ad_pages(t.part.select(F.col("p_type").alias("site"), F.col("p_brand").alias("page_name")), KEYS)


@query("required_keys", """
select event_id, case when event_id % 3 = 2 then 'k,answer,note' when event_id % 3 = 1 then 'answer,note' else 'note' end as missing from events""")
def _(t):
    answer = F.when(F.col("event_id") % 3 == 0, F.concat(F.substring("props", 1, 2), F.lit('answer": "x", "'), F.substr("props", F.lit(3)))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise("not json")
    return t.events.select("event_id", F.array_join(E.required_keys(answer, ["k", "answer", "note"]), ",").alias("missing"))


# ---- run summaries: the captured pages of a site are its run ------------------------------------------------------
def _areas(t):
    """Three areas per page: problems by page number, one area unchecked on some pages."""
    k = F.col("page_id")
    checks = t.pages.select(F.col("url"), k.alias("site"))
    n = F.col("site")
    return B.area_rows(checks, KEYS, {"Content": (F.when(n % 19 == 0, "critical").otherwise("good"), F.when(n % 19 == 0, 1).otherwise(0)),
                                      "SEO": (F.when(n % 3 == 0, "warning").when(n % 5 == 0, "serious").otherwise("good"), (n % 3 == 0).cast("int") + (n % 5 == 0).cast("int") * 2),
                                      "Social": (F.when(n % 2 == 0, "good"), F.lit(0))})


@query("page_cards", """
select page_id as site, case when page_id % 19 = 0 then 1 else 0 end + case when page_id % 3 = 0 then 1 else 0 end + case when page_id % 5 = 0 then 2 else 0 end as issues,
 case when page_id % 19 = 0 then 'critical' when page_id % 3 <> 0 and page_id % 5 = 0 then 'serious' when page_id % 3 = 0 then 'warning' else 'good' end as level from pages""")
def _(t):
    return B.page_cards(_areas(t), KEYS).select("site", "issues", "level")


@query("card_order", """
select p_partkey, row_number() over (order by case when p_size % 5 = 0 then null else p_size end desc nulls last, lower(p_name || p_partkey)) as place from part""")
def _(t):
    cards = t.part.select("p_partkey", F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("ai_slop"), F.concat("p_name", "p_partkey").alias("path"))
    placed = R.positions(cards, [], B.card_order("ai_slop"), "place")
    return placed.select("p_partkey", "place")


@query("page_checks", P_SQL + """
select site, url, title, case when k % 2 = 1 and https then 1 else 0 end as hsts_missing, k % 5 in (1, 2) as tagged from p where k % 19 <> 0""")
def _(t):
    pages = D.records(t, "title", "script_sources", "images")
    security = C.security_row(pages, KEYS).select("site", "url", F.array_contains("missing_headers", "strict-transport-security").cast("int").alias("hsts_missing"))
    tools = D.with_tools(t).select("site", "url", F.exists("tools", lambda x: x["category"].isin(fixed.MEASURING)).alias("tagged"))
    folded = B.page_checks({"security": security, "measurement": tools}, pages.select("site", "url", "title"), KEYS)
    return folded.filter(F.col("hsts_missing").isNotNull())


METRIC_SQL = PROOF_SQL + """
, a as (select site, count(*) as pages, round_even(count(*) filter (k % 5 in (1, 2))::double / count(*) * 100, 0) as analytics_pct, round_even(count(*) filter (k % 6 in (1, 2, 3, 5))::double / count(*) * 100, 0) as jsonld_pct from p group by 1),
b as (select site, count(distinct k) filter (kind not in ('review_link', 'referral_ask')) as proof_pages from x group by 1),
m as (select site, 'pages' as key, pages::double as value from a union all select site, 'analytics_pct', analytics_pct from a union all select site, 'jsonld_pct', jsonld_pct from a
  union all select a.site, 'proof_pages', coalesce(proof_pages, 0) from a left join b using (site))"""


def _metrics(t):
    from ..operators import structured as SD

    pages = D.records(t, "lines")
    coverage = SD.schema_coverage(pages, KEYS).select("site", F.col("pages_checked").alias("pages"), B.percent(F.col("pages_with_json_ld"), F.col("pages_checked")).alias("jsonld_pct"))
    tags = C.share_tagged(C.measurement_flags(D.with_tools(t), KEYS)).select("site", "analytics_pct")
    proof = SO.proof_summary(D.with_signals(t), KEYS).select("site", F.col("pages_with_proof").alias("proof_pages"))
    return B.run_metrics([coverage, tags, proof], KEYS)


@query("run_metrics", METRIC_SQL + " select site, key, value from m")
def _(t):
    return _metrics(t)


@query("tile_levels", METRIC_SQL + """
 select site, key, value, case key when 'analytics_pct' then case when value > 0 then 'good' else 'serious' end when 'proof_pages' then case when value > 0 then 'good' else 'critical' end else 'neutral' end as level from m""")
def _(t):
    return B.tile_levels(_metrics(t))


def _facts(t):
    """One wide row per customer, standing for a run; NULL where a check did not run."""
    k = F.col("c_custkey")
    return t.customer.select(
        k.alias("site"), F.when(k % 11 != 0, k % 2 == 0).alias("has_measurement"), F.when(k % 11 != 0, k % 4 == 0).alias("has_consent_tool"), F.when(k % 11 != 0, k % 3 == 0).alias("ad_pixel"),
        F.when(k % 7 != 0, k % 3 == 0).alias("has_proof"), F.when(k % 7 != 0, k % 5 == 0).alias("has_ask"), (k % 9 != 0).alias("https"), F.when(k % 5 != 0, k % 4 != 0).alias("listing_found"),
        (k % 6).alias("reviews"), (k % 3).alias("listing_mismatches"), (k % 13 == 0).cast("int").alias("failed_files"), (k % 4).alias("page_errors"), (k % 3).alias("fails"), (k % 2).alias("warnings"),
        F.lit(0).alias("slop_high"), (k % 8 == 0).cast("int").alias("bias_high"), (k % 5).alias("headers_missing"), (k % 4).alias("questions_missing"), (k % 10).alias("a11y_findings"),
        (k % 6).alias("untagged"), (k % 12).alias("seo_failing"), (k % 2).alias("syntax_errors"), (k % 3).alias("aeo_issues"), F.lit(None).cast("int").alias("social_issues"), (k % 9).alias("font_families"),
        F.when(k % 4 == 0, "not_found").when(k % 4 == 1, "recommended").alias("visibility"), F.when(k % 4 == 1, 2).alias("ai_rank"), (k % 7 - 1).alias("ai_sentiment"),
        F.when(k % 6 == 0, "mismatch").otherwise("confirmed").alias("identity_verdict"))


@query("opportunity_facts", """
select c_custkey as site, unnest(['Analytics', 'Consent tool', 'Ad pixel', 'Reviews on site', 'Review or referral link', 'HTTPS', 'Google listing']) as fact,
 unnest([case when c_custkey % 11 <> 0 then c_custkey % 2 = 0 end, case when c_custkey % 11 <> 0 then c_custkey % 4 = 0 end, case when c_custkey % 11 <> 0 then c_custkey % 3 = 0 end, case when c_custkey % 7 <> 0 then c_custkey % 3 = 0 end,
  case when c_custkey % 7 <> 0 then c_custkey % 5 = 0 end, c_custkey % 9 <> 0, case when c_custkey % 5 <> 0 then c_custkey % 4 <> 0 end]) as state from customer""")
def _(t):
    return B.opportunity_facts(_facts(t), KEYS)


@query("attention", """
with c as (select c_custkey as k from customer),
r as (select k, unnest([{'l': 'critical', 'r': 'failed_integrity', 'n': (k % 13 = 0)::int}, {'l': 'serious', 'r': 'pages_failed', 'n': k % 4}, {'l': 'critical', 'r': 'fail_findings', 'n': k % 3}, {'l': 'warning', 'r': 'warning_findings', 'n': k % 2},
 {'l': 'warning', 'r': 'high_bias', 'n': (k % 8 = 0)::int}, {'l': 'critical', 'r': 'not_https', 'n': (k % 9 = 0)::int}, {'l': 'warning', 'r': 'headers_missing', 'n': k % 5}, {'l': 'warning', 'r': 'questions_missing', 'n': k % 4},
 {'l': 'serious', 'r': 'no_listing', 'n': (k % 5 <> 0 and k % 4 = 0)::int}, {'l': 'serious', 'r': 'listing_without_reviews', 'n': (k % 5 <> 0 and k % 4 <> 0 and k % 6 = 0)::int}, {'l': 'serious', 'r': 'listing_differs', 'n': k % 3},
 {'l': 'serious', 'r': 'no_proof_no_ask', 'n': (k % 7 <> 0 and k % 3 <> 0 and k % 5 <> 0)::int}, {'l': 'serious', 'r': 'no_proof', 'n': (k % 7 <> 0 and k % 3 <> 0 and k % 5 = 0)::int}, {'l': 'warning', 'r': 'no_ask', 'n': (k % 7 <> 0 and k % 3 = 0 and k % 5 <> 0)::int},
 {'l': 'warning', 'r': 'accessibility', 'n': k % 10}, {'l': 'serious', 'r': 'no_analytics', 'n': (k % 11 <> 0 and k % 2 = 1)::int}, {'l': 'warning', 'r': 'untagged_pages', 'n': case when k % 11 <> 0 and k % 2 = 0 then k % 6 else 0 end},
 {'l': 'warning', 'r': 'no_consent', 'n': (k % 11 <> 0 and k % 2 = 0 and k % 4 <> 0)::int}, {'l': 'warning', 'r': 'seo_pages', 'n': k % 12}, {'l': 'serious', 'r': 'json_ld_syntax', 'n': k % 2}, {'l': 'warning', 'r': 'structured_data', 'n': k % 3},
 {'l': 'warning', 'r': 'many_fonts', 'n': case when k % 9 > 4 then k % 9 else 0 end}, {'l': 'serious', 'r': 'unknown_to_ai', 'n': (k % 4 = 0)::int}, {'l': 'serious', 'r': 'negative_sentiment', 'n': (k % 7 = 0)::int}, {'l': 'serious', 'r': 'namesake', 'n': (k % 6 = 0)::int}]) as x from c)
select k as site, x.l as level, x.r as rule, x.n::bigint as n from r where x.n > 0""")
def _(t):
    return B.attention(_facts(t), KEYS).select("site", "level", "rule", "n")


@query("verdict_triplet", """
select c_custkey, case when c_custkey % 6 = 0 then 'critical' else 'good' end as identity, case c_nationkey % 4 when 0 then 'good' when 1 then 'warning' when 2 then 'critical' else 'neutral' end as icp,
 case c_custkey % 4 when 0 then 'critical' when 1 then 'good' else 'neutral' end as visibility from customer""")
def _(t):
    icp = F.element_at(F.array(F.lit("aligned"), F.lit("partial"), F.lit("misaligned"), F.lit("?")), (F.col("c_nationkey") % 4 + 1).cast("int"))
    k = F.col("c_custkey")
    found = B.verdict_triplet(F.when(k % 6 == 0, "mismatch").otherwise("confirmed"), icp, F.when(k % 4 == 0, "not_found").when(k % 4 == 1, "recommended"))
    return t.customer.select("c_custkey", found.alias("v")).select("c_custkey", "v.*")


@query("google_reviews_state", "select c_custkey, case when c_custkey % 5 = 0 then null else c_custkey % 4 = 0 or c_custkey % 6 = 0 end as bad from customer")
def _(t):
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", SO.google_reviews(k % 4 != 0, k % 6, F.when(k % 5 == 0, "UNKNOWN").otherwise("OBSERVED")).alias("bad"))


@query("site_check_verdicts", """
select c_custkey as site, unnest(['robots', 'sitemap', 'crawler_access', 'llms', 'redirects', 'feeds', 'fonts']) as check,
 unnest([case c_custkey % 4 when 0 then 'good' when 1 then 'good' when 2 then 'serious' else 'not collected' end, case when c_custkey % 2 = 0 then 'good' else 'warning' end, case when c_custkey % 3 = 0 then 'good' else 'warning' end,
 case when c_custkey % 5 = 0 then 'good' else 'neutral' end, case when c_custkey % 6 = 0 then 'warning' when c_custkey % 4 > 0 then 'good' else 'neutral' end, case when c_custkey % 7 > 0 then 'good' else 'neutral' end,
 case when c_custkey % 9 <= 4 then 'good' else 'warning' end]) as level from customer""")
def _(t):
    k = F.col("c_custkey")
    run = t.customer.select(k.alias("site"), F.when(k % 4 == 0, 200).when(k % 4 == 1, 404).when(k % 4 == 2, 503).alias("robots_status"), (k % 2 == 0).alias("sitemap_found"), (k % 3).alias("bots_blocked"),
                            F.when(k % 5 == 0, 200).otherwise(404).alias("llms_status"), (k % 6 == 0).cast("int").alias("long_redirects"), (k % 4).alias("redirects"), (k % 7).alias("feeds"), (k % 9).alias("font_families"))
    return B.site_check_verdicts(run, KEYS)


# ---- work lists --------------------------------------------------------------------------------------------------
@query("slop_worklist", LONG_SQL + """
, r as (select page_no as k, case page_no % 4 when 0 then 'HIGH' when 1 then 'LOW' when 2 then 'MEDIUM' end as rating from s)
select site, page_no as url, ai_slop as score, rating from s join r on k = page_no where rating in ('MEDIUM', 'HIGH') or (rating is null and ai_slop >= 30)""")
def _(t):
    scored = scored_pages(t).select("site", F.col("page_no").alias("url"), F.col("ai_slop").alias("score"))
    k = F.col("url") % 4
    rated = t.documents.select(F.col("lang").alias("site"), F.col("doc_id").alias("url")).withColumn("rating", F.when(k == 0, "HIGH").when(k == 1, "LOW").when(k == 2, "MEDIUM"))
    return B.slop_worklist(scored, rated.filter(F.col("rating").isNotNull()), KEYS, floor=30)


@query("persuasion_worklist", SIGNAL_SQL + """
, m as (select *, array_to_string(list_filter([case when loss_aversion = 0 then 'the cost of doing nothing' end, case when authority = 0 then 'proof or credentials' end], lambda x: x is not null), ',') as missing from s where marketing_bias is not null)
select site, page_no as url, case when label = 'service' and (marketing_bias < 15 or missing <> '') then 'flat' else 'pushy' end as kind, marketing_bias as score, case when label = 'service' and (marketing_bias < 15 or missing <> '') then missing else '' end as missing
from m where (label = 'service' and (marketing_bias < 15 or missing <> '')) or marketing_bias >= 30""")
def _(t):
    pages = scored_pages(t).withColumn("url", F.col("page_no"))
    return B.persuasion_worklist(pages, KEYS, pushy=30).withColumn("missing", F.array_join("missing", ","))


def _task_findings(t):
    slug = F.element_at(F.array(*map(F.lit, B.BUILDER_ORDER)), (F.col("l_partkey") % 11 + 1).cast("int"))
    return t.lineitem.select((F.col("l_suppkey") % 40).alias("site"), slug.alias("slug"), F.col("l_orderkey").alias("finding_id")).distinct()


TASK_SQL = f"""
with f as (select distinct l_suppkey % 40 as site, {B.BUILDER_ORDER}[(l_partkey % 11 + 1)::int] as slug, l_orderkey as finding_id from lineitem),
w as (select c_custkey % 40 as site, 'seo' as slug, count(*) as rows from customer where c_custkey % 3 = 0 group by 1 union all select c_custkey % 40, 'questions', count(*) from customer where c_custkey % 40 < 20 group by 1),
c as (select site, slug, count(*) as findings from f group by 1, 2),
t as (select coalesce(w.site, c.site) as site, coalesce(w.slug, c.slug) as slug, coalesce(rows, 0) as rows, coalesce(findings, 0) as findings from w full join c on w.site = c.site and w.slug = c.slug),
tasks as (select *, list_position({B.BUILDER_ORDER}, slug) - 1 as builder from t where rows > 0 or slug not in ({', '.join(f"'{s}'" for s in B.EVIDENCE_ONLY)}))"""


def _tasks(t):
    site = (F.col("c_custkey") % 40).alias("site")
    lists = {"seo": t.customer.filter(F.col("c_custkey") % 3 == 0).select(site), "questions": t.customer.filter(F.col("c_custkey") % 40 < 20).select(site)}
    return B.work_items(lists, _task_findings(t), KEYS)


@query("work_items", TASK_SQL + " select site, slug, rows, findings, builder from tasks")
def _(t):
    return _tasks(t)


@query("ordered_tasks", TASK_SQL + """
, best as (select f.site, slug, min(finding_id % 97) as cost_place from f where finding_id % 97 < 10 group by 1, 2) select site, slug, cost_place, builder from tasks left join best using (site, slug)""")
def _(t):
    found = _task_findings(t)
    ranked = found.filter(F.col("finding_id") % 97 < 10).select("site", "finding_id", (F.col("finding_id") % 97).alias("place")).distinct()
    return B.ordered_tasks(_tasks(t), found, ranked, KEYS).select("site", "slug", "cost_place", "builder")


@query("uncovered_findings", """
with r as (select l_suppkey % 40 as site, case when l_partkey % 5 = 0 then 'meta_ads' else 'copy' end as area, l_orderkey as finding_id, l_linenumber from lineitem),
f as (select distinct c_custkey % 40 as site, o_orderkey as finding_id from orders join customer on o_custkey = c_custkey)
select site, area, finding_id from r where area = 'copy' and not exists (select 1 from r x where x.site = r.site and x.finding_id = r.finding_id and x.area = 'meta_ads')
  and not exists (select 1 from f where f.site = r.site and f.finding_id = r.finding_id)""")
def _(t):
    resolved = t.lineitem.select((F.col("l_suppkey") % 40).alias("site"), F.when(F.col("l_partkey") % 5 == 0, "meta_ads").otherwise("copy").alias("area"), F.col("l_orderkey").alias("finding_id"))
    tasks = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select((F.col("c_custkey") % 40).alias("site"), F.col("o_orderkey").alias("finding_id")).distinct()
    return B.uncovered_findings(resolved, tasks, KEYS)


@query("flatten_one_level", "select p_partkey as id, p_name as \"about.name\", p_size as \"about.size\", '2 items' as tags from part")
def _(t):
    rows = t.part.select(F.col("p_partkey").alias("id"), F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size")).alias("about"), F.array("p_type", "p_brand").alias("tags"))
    return B.flatten_one_level(rows)

