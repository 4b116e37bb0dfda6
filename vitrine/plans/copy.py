"""Copy analysis over ``documents``: language as site, document as page."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import copy as C, fixed_values as fixed, scalars as S
from ..operators import copy_scores as K, lines as L, pages as P
from ..session import cut
from ..sources.html import parse_html
from .registry import query
from .urls import HOST, VISIBLE_SQL, site_pages

CHROME = 0.02  # The commonest lines of these documents are on 2% of them.
OPENINGS = 0.05  # And the commonest line openings on 5%.
# The documents are invented words; a line of real copy is appended by document number, so that every signal occurs.
SAMPLES = [
    "",
    "We leverage cutting-edge synergy to unlock seamless growth. It's not about tools, it's about outcomes. The best part is simple.",
    "Our team is the #1 choice, always. Whether you're new or growing, look no further. Fast, simple, and reliable service for you.",
    "They don't have a lead problem. They have a follow-up problem. No new process, no dashboard to babysit. Just better results.",
    "We raised conversion from 0.97% to 2.73% for 40 clients in 2019. According to a study, 55% of teams wait 3 days — or more.",
    "Act now! Only 3 spots left. Don't miss out: your competitors are already winning, and you're losing money every day. Hurry.",
    "Certified experts with 20+ years of experience, trusted by 500 companies. We don't work with everyone; it is not a fit for some.",
    "lorem ipsum dolor sit amet. Your headline here — insert name here. 100% guaranteed results with 300 leads and 12k visits.",
]


def copy_pages(t):
    """Documents as pages of a site: ``site, page_no, label, lines, visible_text``."""
    sample = F.element_at(F.array(*map(F.lit, SAMPLES)), (F.col("doc_id") % 8 + 1).cast("int"))
    text = F.when(sample != "", F.concat("text", F.lit("\n"), sample, F.lit(" Page "), "doc_id", F.lit("."))).otherwise(F.col("text"))
    label = F.element_at(F.array(F.lit("article"), F.lit("service"), F.lit("other")), (F.col("doc_id") % 3 + 1).cast("int"))
    # The given table is one block of one file; dealt by document it is as many tasks as any other input.
    return t.documents.repartition("doc_id").select(F.col("lang").alias("site"), F.col("doc_id").alias("page_no"), label.alias("label"),
                                                    text.alias("visible_text"), F.split(text, "\n").alias("lines"))


def scored_pages(t):
    return K.score_pages(copy_pages(t), ["site"], chrome_share=CHROME, opening_share=OPENINGS)


def _sql_text(value):
    return "'" + value.replace("'", "''") + "'"


def _sql_phrases(phrases):
    """RE2 has no lookaround: separators are doubled in the text, so each match may consume one on either side."""
    def one(p):
        return "".join(r"\s+" if c == " " else c if c.isalnum() else (f"\\{c}" if c.isascii() else c) * 2 for c in p)
    return _sql_text(r"(?i)[^\p{L}\p{N}_](?:" + "|".join(map(one, phrases)) + r")[^\p{L}\p{N}_]")


def _sql_count(text, pattern):
    return f"len(regexp_extract_all({text}, {pattern}))"


def _sql_pattern(name):
    return _sql_text("(?i)" + fixed.PATTERNS[name])


NUMBER_SQL = r"""len(list_filter(regexp_extract_all(dbl, '(?i)[^\p{L}\p{N}_.]((?:\$\$|££|€€)?\d(?:\d|,,|\.\.)*(?:\s\s)?(?:%%|x[^\p{L}\p{N}_]|k[^\p{L}\p{N}_]|m[^\p{L}\p{N}_]|[a-z]{3,}))', 1),
  lambda n: not regexp_matches(n || '  ', '^(19|20)\d\d[^\p{L}\p{N}_]')))"""

TEXT_SQL = f"""
with d as (select lang as site, doc_id as page_no, ['article', 'service', 'other'][(doc_id % 3 + 1)::int] as label,
  text || case when doc_id % 8 = 0 then '' else chr(10) || [{', '.join(map(_sql_text, SAMPLES))}][(doc_id % 8 + 1)::int] || ' Page ' || doc_id || '.' end as visible_text from documents),
n as (select site, count(*) as pages from d group by 1),
l as (select site, page_no, generate_subscripts(a, 1) as i, unnest(a) as line from (select *, string_split(visible_text, chr(10)) as a from d)),
chrome as (select l.site, line, count(distinct page_no) as pages from l join n using (site) where trim(line) <> ''
  group by l.site, line, n.pages having count(distinct page_no) >= {CHROME} * n.pages and n.pages >= 3),
k as (select l.* from l left join chrome using (site, line) where chrome.line is null),
b as (select d.*, coalesce(x.body, '') as body, coalesce(x.kept, 0) as kept from d left join
  (select site, page_no, string_agg(line, chr(10) order by i) as body, count(*) as kept from k group by 1, 2) x using (site, page_no)),
o as (select *, array_to_string(regexp_extract_all(lower(line), '[a-z'']+')[1:3], ' ') as opening,
  len(regexp_extract_all(line, '\\S+')) as w from k),
common as (select o.site, opening, count(distinct page_no) as pages from o join n using (site) where w >= 2 and opening <> ''
  group by o.site, opening, n.pages having count(distinct page_no) >= greatest(3, {OPENINGS} * n.pages))
"""


@query("chrome_lines", TEXT_SQL + "select site, line, pages from chrome")
def _(t):
    return L.chrome_lines(copy_pages(t), ["site"], share=CHROME)


@query("skeleton_openings", TEXT_SQL + "select site, opening, pages from common")
def _(t):
    return L.skeleton_openings(copy_pages(t), ["site"], CHROME, OPENINGS)


@query("page_bodies", TEXT_SQL + """
select site, page_no, (len(string_split(visible_text, chr(10))) - kept)::bigint as chrome_lines_removed, length(body) as characters from b""")
def _(t):
    return L.page_bodies(copy_pages(t), ["site"], CHROME).select(
        "site", "page_no", "chrome_lines_removed", F.length("body").cast("bigint").alias("characters"))


@query("capped_chrome_lines", TEXT_SQL + """
select site, line, position from (select *, row_number() over (partition by site order by line) as position from chrome) where position <= 5""")
def _(t):
    return L.capped(L.chrome_lines(copy_pages(t), ["site"], share=CHROME), ["site"], "line", 5).select("site", "line", "position")


def _rated(hits, cap):
    return f"round_even(least({hits} / words * 1000.0 / {float(cap)}, 1.0) * 100, 0)::bigint"


SIGNAL_SQL = TEXT_SQL + rf""",
sent as (select site, page_no, len(regexp_extract_all(s, '\S+')) as n from (
  select site, page_no, unnest(string_split(regexp_replace(line, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) as s from k where len(regexp_extract_all(line, '\S+')) >= 6)
  where len(regexp_extract_all(s, '\S+')) >= 3),
rhythm as (select site, page_no, case when count(*) < 8 then 0 else round_even(greatest(0.0, least(1.0,
  (0.6 - sqrt((count(*) * sum(n * n) - sum(n) * sum(n))::double) / sum(n)) / 0.35)) * 100, 0) end::bigint as rhythm from sent group by 1, 2),
skel as (select o.site, o.page_no, count(*) as hits from o join common using (site, opening) where w >= 2 group by 1, 2),
claim as (select site, page_no, sum({_sql_count('s', _sql_pattern('stat'))}) as stats from (
  select site, page_no, unnest(string_split(regexp_replace(body, '[!?\n]|\.( )', chr(1) || '\1', 'g'), chr(1))) as s from b)
  where not regexp_matches(s, {_sql_pattern('sourced')}) and not regexp_matches(s, {_sql_pattern('measured')}) group by 1, 2),
first_line as (select site, page_no, s as first_sentence from (select site, page_no, s, row_number() over (partition by site, page_no order by i, j) as r from (
  select site, page_no, i, generate_subscripts(a, 1) as j, unnest(a) as s from (select site, page_no, i, string_split(regexp_replace(line, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) as a
  from k where len(regexp_extract_all(line, '\S+')) >= 6)) where len(regexp_extract_all(s, '\S+')) >= 3) where r = 1),
c as (select b.*, len(regexp_extract_all(body, '[A-Za-z][A-Za-z''’-]*')) as words, ' ' || regexp_replace(body, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g') || ' ' as dbl from b),
raw as (select c.*, {_sql_count('dbl', _sql_phrases(fixed.STOCK))} as stock, coalesce(rhythm, 0) as rhythm, coalesce(hits, 0) as skeleton,
  {_sql_count('body', _sql_pattern('contrast'))} + {_sql_count('body', _sql_pattern('split_contrast'))} as contrast,
  {_sql_count('dbl', _sql_phrases(fixed.OPENERS))} + {_sql_count('body', _sql_pattern('no_just'))} as openers,
  {_sql_count('body', "'—'")} as dashes, {_sql_count('body', _sql_pattern('triad'))} as triads_n, {NUMBER_SQL} as numbers,
  regexp_matches(visible_text, {_sql_pattern('template')}) as template,
  {_sql_count('dbl', _sql_phrases(fixed.PUFFERY))} + coalesce(stats, 0) as claims,
  {_sql_count('dbl', _sql_phrases(["we", "we're", "we’re", "we've", "we’ve", "we'll", "we’ll", "our", "ours", "us"]))} as we_n,
  {_sql_count('dbl', _sql_phrases(["you", "your", "yours"]))} as you_n, {_sql_count('dbl', _sql_phrases(fixed.BALANCE))} as balance,
  coalesce(regexp_matches(first_sentence, '(?i)^(we|our)\b'), false) as opens,
  {_sql_count('body', _sql_pattern('pressure'))} as pressure_n, {_sql_count('body', _sql_pattern('fomo'))} as fomo_n,
  {_sql_count('body', _sql_pattern('loss_aversion'))} as loss_n, {_sql_count('body', _sql_pattern('authority'))} as authority_n
  from c left join rhythm using (site, page_no) left join skel using (site, page_no) left join claim using (site, page_no)
  left join first_line using (site, page_no)),
sub as (select site, page_no, label, words, visible_text, {_rated('stock', 12)} as stock_phrases, rhythm::bigint as rhythm,
  round_even(least(skeleton / 4.0, 1.0) * 100, 0)::bigint as formula_skeleton, {_rated('contrast', 3)} as contrast_frames,
  {_rated('openers', 3)} as formula_openers, {_rated('dashes', 12)} as em_dashes, {_rated('triads_n', 6)} as triads,
  100 - {_rated('numbers', 25)} as vagueness, case when template then 100 else 0 end::bigint as template_artifacts,
  {_rated('claims', 10)} as unsupported_claims,
  least(100, round_even(greatest(0.0, least(1.0, (coalesce(we_n::double / nullif(we_n + you_n, 0), 0.5) - 0.4) / 0.4)) * least(1.0, (we_n + you_n) / 5.0) * 100, 0)
    + case when opens then 20 else 0 end)::bigint as self_focus,
  case when words < 300 then 0 else greatest(0, 100 - 50 * balance) end::bigint as one_sidedness,
  {_rated('pressure_n', 3)} as pressure, {_rated('fomo_n', 3)} as fomo, {_rated('loss_n', 4)} as loss_aversion, {_rated('authority_n', 5)} as authority
  from raw where words >= 80),
s as (select c.site, c.page_no, c.label, c.words::bigint as words, sub.* exclude (site, page_no, label, words, visible_text),
  case when stock_phrases is null then null else round_even(greatest(0.0, least(100.0, stock_phrases * 20.0 / 100 + rhythm * 10.0 / 100 + formula_skeleton * 15.0 / 100 + contrast_frames * 15.0 / 100
   + formula_openers * 10.0 / 100 + em_dashes * 5.0 / 100 + triads * 10.0 / 100 + vagueness * 15.0 / 100 + case when template_artifacts > 0 then 40.0 else 0.0 end)), 0)::bigint end as ai_slop,
  case when stock_phrases is null then null else round_even(greatest(0.0, least(100.0, unsupported_claims * 20.0 / 100 + self_focus * 15.0 / 100 + one_sidedness * 15.0 / 100 + pressure * 15.0 / 100
   + fomo * 10.0 / 100 + loss_aversion * 10.0 / 100 + authority * 15.0 / 100)), 0)::bigint end as marketing_bias
  from c left join sub using (site, page_no))
"""
SLOP = [*fixed.SLOP_WEIGHTS, "template_artifacts"]
BIAS = list(fixed.BIAS_WEIGHTS)


@query("slop_signals", SIGNAL_SQL + f"select site, page_no, words, {', '.join(SLOP)}, ai_slop from s")
def _(t):
    return scored_pages(t).select("site", "page_no", "words", *SLOP, "ai_slop")


@query("bias_signals", SIGNAL_SQL + f"select site, page_no, words, {', '.join(BIAS)}, marketing_bias from s")
def _(t):
    return scored_pages(t).select("site", "page_no", "words", *BIAS, "marketing_bias")


EVIDENCE = {"stock_phrases": "stock", "contrast_frames": "contrast", "formula_openers": "openers", "em_dashes": "dashes", "triads": "triads_n", "specificity": "numbers",
            "one_sidedness": "balance", "pressure": "pressure_n", "fomo": "fomo_n", "loss_aversion": "loss_n", "authority": "authority_n"}


@query("signal_counts", SIGNAL_SQL + f"""
, u as (select site, page_no, words, unnest([{', '.join(f"{{'signal': '{n}', 'count': {c}}}" for n, c in EVIDENCE.items())}]) as x from raw where words >= 80)
select site, page_no, x.signal as signal, x.count::bigint as count, round_even(x.count / words * 1000.0, 1) as per_1k from u""")
def _(t):
    return K.signal_counts(L.page_bodies(copy_pages(t), ["site"], CHROME), ["site", "page_no"])


@query("signal_examples", TEXT_SQL + r"""
select site, page_no, 'em_dashes' as signal, 0 as place, (case when pos > 40 then '…' else '' end)
  || trim(regexp_replace(substr(body, greatest(0, pos - 40) + 1, least(length(body), pos + 1 + 40) - greatest(0, pos - 40)), '\s+', ' ', 'g'))
  || (case when pos + 1 + 40 < length(body) then '…' else '' end) as example from (select *, instr(body, '—') - 1 as pos from b) where pos >= 0""")
def _(t):
    return K.signal_examples(L.page_bodies(copy_pages(t), ["site"], CHROME), ["site", "page_no"], ["em_dashes"], 1)


@query("rhythm_facts", SIGNAL_SQL + r"""
select site, page_no, count(*) as count, case when count(*) >= 8 then round_even(sqrt((count(*) * sum(n * n) - sum(n) * sum(n))::double) / sum(n), 2) end as cv,
  case when count(*) >= 8 then round_even(sum(n)::double / count(*), 1) end as mean_words from sent group by 1, 2""")
def _(t):
    rows = L.page_bodies(copy_pages(t), ["site"], CHROME).select("site", "page_no", C.rhythm_facts(F.col("body_lines")).alias("r"))
    return rows.select("site", "page_no", "r.*").filter(F.col("count") > 0)


@query("copy_levels", SIGNAL_SQL + """
select site, page_no, case when ai_slop is null then 'UNKNOWN' when ai_slop >= 60 then 'HIGH' when ai_slop >= 30 then 'MEDIUM' else 'LOW' end as slop_level,
 case when marketing_bias is null then 'UNKNOWN' when marketing_bias >= 60 then 'HIGH' when marketing_bias >= 30 then 'MEDIUM' else 'LOW' end as bias_level from s""")
def _(t):
    return scored_pages(t).select("site", "page_no", F.col("ai_slop_level").alias("slop_level"), F.col("marketing_bias_level").alias("bias_level"))


def _top_sql(names):
    return "[" + ", ".join(f"{{'n': '{n}', 'v': {n}, 'o': {i}}}" for i, n in enumerate(names)) + "]"


@query("top_signals", SIGNAL_SQL + f"""
, u as (select site, page_no, 'ai_slop' as score_name, unnest({_top_sql(SLOP)}) as x from s where ai_slop is not null
  union all select site, page_no, 'marketing_bias', unnest({_top_sql(BIAS)}) from s where ai_slop is not null),
r as (select site, page_no, score_name, x.n as n, row_number() over (partition by site, page_no, score_name order by x.v desc, x.o) as r from u where x.v > 0)
select site, page_no, score_name, string_agg(n, ',' order by r) as top from r where r <= 3 group by 1, 2, 3""")
def _(t):
    scored = scored_pages(t).filter(F.col("ai_slop").isNotNull())
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("score_name"), F.col(f"{n}_top").alias("top")) for n in K.SCORES])).alias("s")
    return scored.select("site", "page_no", each).select("site", "page_no", "s.score_name", "s.top").filter(F.col("top") != "")


LONG_SQL = SIGNAL_SQL + """, long as (select site, page_no, label, 'ai_slop' as score_name, ai_slop as score from s
  union all select site, page_no, label, 'marketing_bias', marketing_bias from s)"""


@query("copy_summary", LONG_SQL + """
select site, score_name, label, count(score) as pages, count(*) filter (score is null) as unscored, round_even(quantile_cont(score, 0.5), 0)::bigint as median,
  round_even(avg(score), 0)::bigint as mean, count(*) filter (score >= 60) as high, count(*) filter (score between 30 and 59) as medium,
  grouping(label)::int as all_classes from long group by grouping sets ((site, score_name), (site, score_name, label))""")
def _(t):
    return K.copy_summary(scored_pages(t), ["site"])


@query("top_pages", LONG_SQL + """
select site, score_name, page_no, score, position from (select *, row_number() over (partition by site, score_name order by score desc, page_no) as position
  from long where score is not null) where position <= 10""")
def _(t):
    return K.top_pages(scored_pages(t), ["site"], "page_no")


PAGE_COPY_SQL = VISIBLE_SQL.replace("\nl as (", "\nraw_lines as (") + rf""",
texts as (select page_id, string_agg(line, chr(10) order by n) as text from (select page_id, n, trim(regexp_replace(line, '\s+', ' ', 'g')) as line from raw_lines) where line <> '' group by 1),
d as (select {HOST} as site, p.page_id as page_no, '' as label, coalesce(text, '') as visible_text from pages p left join texts using (page_id)),
""" + LONG_SQL[LONG_SQL.index("n as (select site, count(*) as pages"):].replace(f"{CHROME} * n.pages", f"{fixed.CHROME_SHARE} * n.pages").replace(
    f"{OPENINGS} * n.pages", f"{fixed.SKELETON_SHARE} * n.pages")


@query("page_copy_top", PAGE_COPY_SQL + """
select site, score_name, page_no, score, position from (select *, row_number() over (partition by site, score_name order by score desc, page_no) as position
  from long where score is not null) where position <= 10""")
def _(t):
    """The whole way from HTML: parse, drop shared lines, score, rank per site."""
    # Parsing is the dear step and its result is read several times, so it is written once.
    pages = cut(P.page_record(parse_html(site_pages(t)), "label", "visible_text", "lines").select("site", "page_no", "label", "visible_text", "lines"))
    return K.top_pages(K.score_pages(pages, ["site"]), ["site"], "page_no")


@query("stock_snippets", TEXT_SQL + rf""", m as (select site, page_no, body, string_split_regex(regexp_replace(' ' || body || ' ', '(?i)([^\p{{L}}\p{{N}}_])(seamless|robust|leverage|synergy)([^\p{{L}}\p{{N}}_])', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g'), '[' || chr(1) || ']') as a from b)
select site, page_no, (len(a) - 1)::bigint as hits, {{e}} as first_snippet from m where len(a) > 1""".replace("{e}", r"""
  (case when length(a[1]) - 1 > 40 then '…' else '' end) || trim(regexp_replace(substr(body, greatest(0, length(a[1]) - 1 - 40) + 1,
   least(length(body), length(a[1]) - 1 + instr(a[2], chr(2)) - 1 + 40) - greatest(0, length(a[1]) - 1 - 40)), '\s+', ' ', 'g'))
  || (case when length(a[1]) - 1 + instr(a[2], chr(2)) - 1 + 40 < length(body) then '…' else '' end)"""))
def _(t):
    regex = C.phrase_pattern(["seamless", "robust", "leverage", "synergy"])
    bodies = L.page_bodies(copy_pages(t), ["site"], CHROME)
    found = bodies.filter(F.col("body").rlike(regex))
    return found.select("site", "page_no", C.count(F.col("body"), regex).cast("bigint").alias("hits"),
                        F.get(C.snippets(F.col("body"), regex, 1), 0).alias("first_snippet"))


@query("emails_in_text", r"""
select doc_id, len(list_distinct(regexp_extract_all(text, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}')))::bigint as emails from documents
where regexp_matches(text, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}')""")
def _(t):
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(fixed.EMAIL), 0))
    return t.documents.filter(F.col("text").rlike(fixed.EMAIL)).select("doc_id", F.size(found).cast("bigint").alias("emails"))


@query("text_normalisers", r"""
select doc_id, length(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) as squeezed, length(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) as squashed,
  case when length(regexp_replace(text, '[^0-9]', '', 'g')) >= 7 then right(regexp_replace(text, '[^0-9]', '', 'g'), 10) else '' end as phone,
  len(regexp_extract_all(text, '\S+')) as words,
  case when length(trim(regexp_replace(text, '\s+', ' ', 'g'))) <= 60 then trim(regexp_replace(text, '\s+', ' ', 'g'))
   else left(trim(regexp_replace(text, '\s+', ' ', 'g')), 59) || '…' end as clipped from documents""")
def _(t):
    text = F.col("text")
    return t.documents.select("doc_id", F.length(S.squeeze(text)).cast("bigint").alias("squeezed"), F.length(S.squash(text)).cast("bigint").alias("squashed"),
                              S.digits(text).alias("phone"), S.n_words(text).cast("bigint").alias("words"), S.clip(text, 60).alias("clipped"))


@query("rating_summary", """
with j as (select lang as site, case when doc_id % 10 = 9 then null else (doc_id * 7 % 41) / 10.0 end as rating, n_chars as tokens, doc_id from documents),
s as (select *, round_even(rating / 4 * 100, 0)::bigint as score from j)
select site, count(score) as judged, count(*) filter (doc_id % 10 = 9) as failed, round_even(quantile_cont(score, 0.5), 0)::bigint as median,
 count(*) filter (score >= 60) as high, count(*) filter (score between 30 and 59) as medium, sum(tokens)::bigint as tokens, 'OBSERVED' as status from s group by 1""")
def _(t):
    failed = F.col("doc_id") % 10 == 9
    judged = t.documents.select(F.col("lang").alias("site"), F.when(~failed, (F.col("doc_id") * 7 % 41) / 10).alias("rating"),
                                F.when(failed, "HTTP 500").alias("error"), F.col("n_chars").alias("tokens"))
    return K.rating_summary(judged, ["site"])
