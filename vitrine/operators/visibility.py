"""How often, how high and how warmly answers name a company, and what they cite.

``answers``: site, answer_id, prompt, error, companies ARRAY<STRUCT<name, website, city, position, sentiment>>,
sources ARRAY<STRUCT<url, title>>. ``profiles``: site, domain, names[], cities[]. One answer is one row, so ordering and
de-duplicating the companies it names needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.identity import company_key, is_target, rating
from ..functions.scalars import blank, ratio, rounded, strip, whole, whole_word
from ..functions.urls import clean_url, host
from ..session import cut
from .ranking import beside, positions


def scored(answers: DataFrame) -> Column:
    return F.coalesce(F.col("error"), F.lit("")).eqNullSafe("") & F.col("companies").isNotNull()


def answer_positions(answers: DataFrame, profiles: DataFrame, keys: list[str]) -> DataFrame:
    """One row per company and scored answer: its key, name, sentiment and position among the distinct companies."""
    joined = beside(answers.filter(scored(answers)), profiles.select(*keys, "domain", "names", "cities"), keys, "left")
    named = F.filter("companies", lambda c: ~blank(c["name"]))
    read = F.transform(named, lambda c, i: F.struct(
        F.coalesce(F.nanvl(c["position"].cast("double"), F.lit(None)), F.lit(float("inf"))).alias("place"), i.alias("at"),
        company_key(c["name"], c["website"]).alias("key"), strip(c["name"]).alias("name"), c["city"].alias("city"),
        rating(c["sentiment"]).alias("sentiment")))
    keyed = F.transform(read, lambda c: F.struct(
        c["place"], c["at"],
        F.when(is_target(c["key"], c["name"], F.col("domain"), F.col("names"), c["city"], F.col("cities")), F.col("domain")).otherwise(
            c["key"]).alias("company_key"), c["name"], c["sentiment"]))
    ordered = joined.select(*keys, "answer_id", "prompt", "domain", F.array_sort(keyed).alias("m")).withColumn(
        "k", F.transform("m", lambda c: c["company_key"]))
    firsts = F.filter("m", lambda c, i: F.array_position("k", c["company_key"]) == i + 1)
    return ordered.select(*keys, "answer_id", "prompt", "domain", F.posexplode(firsts).alias("i", "c")).select(
        *keys, "answer_id", "prompt", "c.company_key", "c.name", "c.sentiment", (F.col("i") + 1).cast("bigint").alias("position"),
        (F.col("c.company_key") == F.col("domain")).alias("is_target"))


def _seen_at(mentions: DataFrame) -> Column:
    """Orders mentions by answer, none first, and position. A whole number where answers have one, so that mentions are counted in
    hash tables; a least struct needs all of them sorted."""
    if mentions.schema["answer_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return F.struct("answer_id", "position")
    answer = F.coalesce(F.col("answer_id").cast("decimal(20,0)"), F.lit("-10000000000000000000").cast("decimal(20,0)"))
    return (answer * F.lit(10**10).cast("decimal(11,0)") + F.col("position").cast("decimal(10,0)")).cast("decimal(38,0)")


def leaderboard(mentions: DataFrame, keys: list[str]) -> DataFrame:
    """Companies by answers naming them; shown under their commonest spelling, the first seen on a tie."""
    spellings = mentions.groupBy(*keys, "company_key", "is_target", "name").agg(
        F.count("*").alias("n"), F.sum("position").alias("places"), F.min(_seen_at(mentions)).alias("first"))
    return spellings.groupBy(*keys, "company_key", "is_target").agg(
        F.sum("n").alias("mentions"), rounded(F.sum("places") / F.sum("n"), 2).alias("avg_position"),
        F.min_by("name", F.struct(-F.col("n"), F.col("first"))).alias("company"))


def leaderboard_rank(board: DataFrame, keys: list[str]) -> DataFrame:
    order = [F.desc("mentions"), F.asc("avg_position"), F.asc("company_key")]
    return positions(board, keys, order, "rank")


def target_rank(board: DataFrame, keys: list[str]) -> DataFrame:
    """The target's rank and the board's size: rows ahead of it are counted, nothing is sorted. The board is read twice, so it is
    written once."""
    board = cut(board)
    target = board.filter("is_target").select(*keys, F.struct(-F.col("mentions"), "avg_position", "company_key").alias("mine"))
    ahead = F.struct(-F.col("mentions"), "avg_position", "company_key") < F.col("mine")
    return beside(board, target, keys, "left").groupBy(*keys).agg(
        F.when(F.count("mine") > 0, F.count_if(ahead) + 1).alias("rank"), F.count("*").alias("companies"))


def scored_answers(answers: DataFrame, keys: list[str]) -> DataFrame:
    return answers.groupBy(*keys).agg(F.count("*").alias("answers_total"), F.count_if(scored(answers)).alias("answers_scored"))


def mention_rates(answers: DataFrame, mentions: DataFrame, keys: list[str]) -> DataFrame:
    """Share of scored answers naming the target, and the target's share of all mentions."""
    named = mentions.groupBy(*keys).agg(F.count("*").alias("mentions"), F.count_if("is_target").alias("target_mentions"))
    joined = scored_answers(answers, keys).join(named, keys, "left").na.fill(0, ["mentions", "target_mentions"])
    return joined.select(*keys, "answers_total", "answers_scored", "mentions", "target_mentions",
                         rounded(ratio(F.col("target_mentions"), F.col("answers_scored")), 3).alias("mention_rate"),
                         rounded(ratio(F.col("target_mentions"), F.col("mentions")), 3).alias("share_of_voice"))


def question_rate(answers: DataFrame, mentions: DataFrame, keys: list[str]) -> DataFrame:
    return mention_rates(answers, mentions, [*keys, "prompt"]).select(*keys, "prompt", "mention_rate")


def sentiment(mentions: DataFrame, branded: DataFrame, keys: list[str]) -> DataFrame:
    """-100..100 mean, lowest and highest per branch and overall, in one pass of grouping sets."""
    rows = mentions.filter(F.col("is_target") & F.col("sentiment").isNotNull()).select(*keys, F.lit("unbranded").alias("branch"), "sentiment")
    both = rows.unionByName(branded.select(*keys, F.lit("branded").alias("branch"), rating(F.col("sentiment")).alias("sentiment")))
    sets = both.filter(F.col("sentiment").isNotNull()).groupingSets([[*map(F.col, keys)], [*map(F.col, keys), F.col("branch")]], *keys, "branch")
    found = sets.agg(whole(F.avg("sentiment") * 100).alias("score"), F.count("*").alias("n"),
                     whole(F.min("sentiment") * 100).alias("low"), whole(F.max("sentiment") * 100).alias("high"))
    return found.withColumn("branch", F.coalesce("branch", F.lit("overall")))


def visibility(recognized: Column, rank: Column) -> Column:
    return F.when(rank.isNotNull() & (rank != 0), "recommended").when(recognized.eqNullSafe(False), "not_found").otherwise("not_recommended")


def _cited(answers: DataFrame, keys: list[str], address: str) -> DataFrame:
    """Sources of each answer, counted inside the answer's own row."""
    usable = F.filter("sources", lambda s: s["url"].rlike("^https?://") & host(s["url"]).isNotNull()) if address == "page" else \
        F.filter("sources", lambda s: host(s["url"]).isNotNull())
    spot = F.transform(usable, lambda s, i: F.struct(
        (clean_url(s["url"]) if address == "page" else host(s["url"])).alias("address"), i.alias("at"), s["title"].alias("title")))
    return answers.select(*keys, "answer_id", "prompt", F.explode(spot).alias("s")).groupBy(*keys, "answer_id", "prompt", "s.address").agg(
        F.count("*").alias("n"), F.min(F.struct("s.at", "s.title")).alias("first"))


def cited_domains(answers: DataFrame, profiles: DataFrame, keys: list[str]) -> DataFrame:
    totals = _cited(answers, keys, "domain").groupBy(*keys, F.col("address").alias("domain")).agg(
        F.sum("n").alias("citations"), F.countDistinct("answer_id").alias("answers"))
    return totals.join(profiles.select(*keys, F.col("domain").alias("_own")), keys, "left").withColumn(
        "is_target", F.col("domain") == F.col("_own")).drop("_own")


def cited_pages(answers: DataFrame, keys: list[str]) -> DataFrame:
    """Every cited page: citations, answers, and the prompts that led to it in first-seen order."""
    # An answer has one row per page and prompt here, so its rows are counted and not its distinct ids.
    per_prompt = _cited(answers, keys, "page").groupBy(*keys, "address", "prompt").agg(
        F.sum("n").alias("n"), F.count("answer_id").alias("answers"), F.min("answer_id").alias("seen_at"),
        F.min_by("first.title", F.struct("answer_id", "first")).alias("first_title"))
    pages = per_prompt.groupBy(*keys, F.col("address").alias("url")).agg(
        F.sum("n").alias("citations"), F.sum("answers").alias("answers"), F.min_by("first_title", "seen_at").alias("title"),
        F.array_sort(F.collect_list(F.struct("seen_at", "prompt"))).alias("seen"))
    return pages.select(*keys, "url", host(F.col("url")).alias("domain"), "title", "citations", "answers",
                        F.transform(F.filter("seen", lambda s: s["prompt"].isNotNull()), lambda s: s["prompt"]).alias("prompts"))


def distinct_prompts(prompts: DataFrame, keys: list[str]) -> DataFrame:
    """Each prompt once, at its first position."""
    return prompts.withColumn("prompt", strip(F.col("prompt"))).filter(F.col("prompt") != "").groupBy(*keys, "prompt").agg(F.min("pos").alias("pos"))


def banned_filter(prompts: DataFrame, profiles: DataFrame, keys: list[str]) -> DataFrame:
    """Prompts that do not name the company: its domain, the domain's label, or its name as whole words."""
    joined = prompts.join(profiles.select(*keys, "domain", "names"), keys, "left")
    low = F.lower("prompt")
    terms = F.concat(F.array("domain", F.split_part("domain", F.lit("."), F.lit(1))), F.coalesce("names", F.array().cast("array<string>")))
    named = F.exists(F.filter(terms, lambda term: term != ""), lambda term: whole_word(low, F.lower(term), "[a-z0-9]", ""))
    return joined.filter(~F.coalesce(named, F.lit(False))).drop("domain", "names")


def citations(answers: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct cited URLs of an answer's content blocks, in order: ``blocks ARRAY<STRUCT<annotations ARRAY<STRUCT<url, title>>>>``."""
    notes = F.filter(F.flatten(F.transform("blocks", lambda b: F.coalesce(b["annotations"], F.array().cast("array<struct<url:string,title:string>>")))),
                     lambda n: n["url"].isNotNull())
    listed = answers.select(*keys, "answer_id", notes.alias("n")).withColumn("u", F.transform("n", lambda n: n["url"]))
    firsts = F.filter("n", lambda n, i: F.array_position("u", n["url"]) == i + 1)
    return listed.select(*keys, "answer_id", firsts.alias("sources"))


def domain_mentioned(raw_answer: Column, domain: Column, name: Column) -> Column:
    low = F.lower(F.coalesce(raw_answer, F.lit("")))
    return low.contains(F.lower(domain)) | F.coalesce((name != "") & low.contains(F.lower(name)), F.lit(False))


def audience(user: Column, site: Column, model: Column) -> Column:
    """The value and where it came from: the user before the site before the model."""
    user, site = F.nullif(user, F.lit("")), F.nullif(site, F.lit(""))
    source = F.when(user.isNotNull(), "user").when(site.isNotNull(), "site").otherwise("model")
    return F.struct(F.coalesce(user, site, model).alias("value"), source.alias("source"))
