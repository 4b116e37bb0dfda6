"""Post planning over ``part`` and ``orders``, listing proposals over ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendar as C
from .registry import query


def titles(t):
    """Parts as titles of a brand, in part order; the first parts exist already."""
    return t.part.select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("pos"), (F.col("p_partkey") < 100).alias("existing"),
                         F.concat_ws(" ", "p_name", "p_brand", F.lower("p_type")).alias("title"))


@query("near_duplicate_titles", r"""
with recursive w as (select p_brand as brand, p_partkey as pos, p_name || ' ' || p_brand || ' ' || lower(p_type) as title,
  list_sort(list_distinct(regexp_extract_all(regexp_replace(lower(p_name || ' ' || p_brand || ' ' || p_type), '[^a-z0-9 ]', ' ', 'g'), '[a-z0-9]+'))) as words from part),
f as (select *, row_number() over (partition by brand order by pos) as n from (select *, row_number() over (partition by brand, words order by pos) as copy from w) where copy = 1),
g as (select brand, n, pos, title, [words] as kept, true as ok from f where n = 1 union all
  select f.brand, f.n, f.pos, f.title, case when x.ok then list_append(g.kept, f.words) else g.kept end, x.ok from g join f on f.brand = g.brand and f.n = g.n + 1,
  lateral (select f.pos < 100 or len(list_filter(g.kept, lambda k: len(list_intersect(k, f.words))::double / len(list_distinct(list_concat(k, f.words))) >= 0.7)) = 0 as ok) x)
select brand, pos, title from g where ok and pos >= 100""")
def _(t):
    return C.near_duplicate_titles(titles(t), ["brand"])


@query("similar_titles", r"""
with w as (select p_brand as brand, list_sort(list_distinct(regexp_extract_all(regexp_replace(lower(p_name || ' ' || p_brand || ' ' || p_type), '[^a-z0-9 ]', ' ', 'g'), '[a-z0-9]+'))) as words,
  min(p_partkey) as id from part group by 1, 2)
select a.brand, a.id as early, b.id as late from w a join w b on a.brand = b.brand and a.id < b.id
where len(list_intersect(a.words, b.words))::double / len(list_distinct(list_concat(a.words, b.words))) >= 0.5""")
def _(t):
    sets = titles(t).groupBy("brand", C.title_words(F.col("title")).alias("words")).agg(F.min("pos").alias("set_id"))
    return C.similar_titles(sets, ["brand"], 0.5)


POSTS_SQL = """
with p as (select o_custkey as site, o_orderkey as id, o_orderpriority as keyword, o_orderdate as t0, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as age from orders),
used as (select site, lower(keyword) as k, min(age) as age from p where age <= 10 group by 1, 2),
s as (select c_custkey as site, c_custkey % 2 = 0 as repeat, c_custkey % 3 + 10 as every_days, ['2-high', '1-URGENT', '5-LOW', '3-MEDIUM', '4-NOT SPECIFIED'][1:(case when c_custkey % 5 = 0 then 5 else 3 end)] as words from customer),
o as (select site, repeat, every_days, generate_subscripts(words, 1) as pos, unnest(words) as keyword from s),
j as (select o.*, used.age from o left join used on o.site = used.site and lower(o.keyword) = used.k),
n as (select site, every_days, coalesce(arg_min(keyword, pos) filter (age is null), case when bool_or(repeat) then arg_max(keyword, age) end) as keyword from j group by 1, 2)
"""


def posts(t):
    return t.orders.select(F.col("o_custkey").alias("site"), F.col("o_orderkey").alias("post_id"), F.col("o_orderpriority").alias("keyword"),
                           F.col("o_orderdate").cast("timestamp").alias("created_at"))


def sites(t):
    listed = F.when(F.col("c_custkey") % 5 == 0, "2-high, 1-URGENT\n5-LOW,,3-MEDIUM\n 4-NOT SPECIFIED").otherwise("2-high,1-URGENT\n5-LOW")
    return t.customer.select(F.col("c_custkey").alias("site"), C.keyword_lines(listed).alias("keywords"), (F.col("c_custkey") % 2 == 0).alias("repeat"),
                             (F.col("c_custkey") % 3 + 10).alias("every_days"))


@query("next_keyword", POSTS_SQL + "select site, keyword from n")
def _(t):
    return C.next_keyword(sites(t), posts(t))


@query("schedule", """
with l as (select o_custkey as site, max(o_orderdate)::date as last_date from orders group by 1),
p as (select c_custkey as site, n from customer, (values (1), (2), (3), (4)) v(n))
select p.site, n, coalesce(greatest(last_date + 3, date '2001-06-02'), date '2001-06-02') + (3 * (n - 1))::int as publish_on from p left join l using (site)""")
def _(t):
    last = t.orders.groupBy(F.col("o_custkey").alias("site")).agg(F.to_date(F.max("o_orderdate")).alias("last_date"))
    planned = t.customer.select(F.col("c_custkey").alias("site"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("n")).join(last, "site", "left")
    return C.schedule(planned, F.to_date(F.lit("2001-06-01"))).select("site", "n", "publish_on")


@query("due_sites", POSTS_SQL + """
select n.site, n.keyword from n left join (select site, max(t0) as last from p group by 1) l using (site)
where n.keyword is not null and n.site % 4 <> 0 and (last is null or last + to_days(every_days::int) <= timestamp '2001-07-20')""")
def _(t):
    crawled = sites(t).filter(F.col("site") % 4 != 0)
    return C.due_sites(sites(t), posts(t), crawled, F.to_timestamp(F.lit("2001-07-20")))


@query("listing_proposals", """
with s as (select o_custkey as site, case when o_orderkey % 2 = 0 then 'field_edit' else 'review_reply' end as kind, o_orderpriority as target, max(o_orderkey) as k from orders where o_orderstatus <> 'P' group by 1, 2, 3),
n as (select o_custkey as site, case when o_orderkey % 2 = 0 then 'field_edit' else 'review_reply' end as kind, o_orderpriority as target, max(o_orderkey) as k from orders where o_orderstatus = 'P' group by 1, 2, 3),
j as (select coalesce(s.site, n.site) as site, coalesce(s.kind, n.kind) as kind, coalesce(s.target, n.target) as target, s.k as old, n.k as new,
  case when s.k is null then null when s.k % 3 = 0 then 'approved' when s.k % 3 = 1 then 'rejected' else 'pending' end as status from s full join n using (site, kind, target))
select site, kind, target, case when coalesce(status, 'pending') <> 'pending' or new is null or (old is not null and kind <> 'field_edit') then old else new end as after, coalesce(status, 'pending') as status
from j where not (new is null and coalesce(status, 'pending') = 'pending' and kind = 'field_edit')""")
def _(t):
    kind = F.when(F.col("o_orderkey") % 2 == 0, "field_edit").otherwise("review_reply")
    rows = t.orders.groupBy(F.col("o_custkey").alias("site"), kind.alias("kind"), F.col("o_orderpriority").alias("target"), (F.col("o_orderstatus") == "P").alias("new")).agg(
        F.max("o_orderkey").alias("after")).withColumn("before", -F.col("after"))
    state = F.when(F.col("after") % 3 == 0, "approved").when(F.col("after") % 3 == 1, "rejected").otherwise("pending")
    return C.new_proposals(rows.filter("new"), rows.filter(~F.col("new")).withColumn("status", state), ["site"]).select("site", "kind", "target", "after", "status")
