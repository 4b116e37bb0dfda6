"""Quotes checked against pages, buyer questions, and the people a site presents."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fixed
from ..functions.scalars import first_where, lookup, squash, strip
from ..functions.urls import page_key, path
from ..session import cut
from . import search
from .ranking import first_n
from .structured import OBJECTS, is_a, prop, text_of


# ---- quotes ------------------------------------------------------------------------------------------------------
def verify_quotes(claims: DataFrame, pages: DataFrame, keys: list[str], page: str = "url") -> DataFrame:
    """Adds ``verified``: the quote, white space and case aside, occurs on the page it names."""
    # Only pages that a claim names send their text.
    named = pages.join(claims.select(*keys, page).distinct(), [*keys, page], "left_semi")
    text = named.select(*keys, page, squash(F.col("visible_text")).alias("_text"))
    quote = squash(F.col("quote"))
    joined = claims.join(text, [*keys, page], "left")
    return joined.withColumn("verified", F.coalesce((quote != "") & F.contains("_text", quote), F.lit(False))).drop("_text")


def attribute_quotes(claims: DataFrame, read: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """The page a quote stands on: the first page read for the run that contains it, else the crawled page it names.

    ``read`` holds at most a handful of pages per run (``people_pages``), so a claim meets only those.
    """
    texts = read.select(*keys, F.col("place").alias("_place"), F.col("url").alias("_read_url"), squash(F.col("visible_text")).alias("_text"))
    stated = pages.select(*keys, page_key(F.col("url"), True).alias("_key"), F.col("url").alias("_known")).groupBy(*keys, "_key").agg(F.min("_known").alias("_known"))
    quote = squash(F.col("quote"))
    met = claims.join(texts, keys, "left").withColumn("_hit", (quote != "") & F.contains("_text", quote))
    ids = [*keys, "claim_id"]
    found = met.groupBy(*ids).agg(F.first("quote").alias("quote"), F.first("url").alias("url"),
                                  F.min_by("_read_url", F.when(F.col("_hit"), F.col("_place"))).alias("_found"), F.bool_or("_hit").alias("verified"))
    named = found.withColumn("_key", page_key(F.col("url"), True)).join(stated, [*keys, "_key"], "left")
    return named.select(*ids, F.coalesce(F.when(F.col("verified"), F.col("_found")), "_known", "url").alias("url"), F.coalesce("verified", F.lit(False)).alias("verified"))


def quoted_on(claims: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """The first page of a group that contains each quote: ``(keys, quote, place, url)``, the quote as ``squash`` gives it.

    ``claims``: keys, quote; ``pages``: keys, place, url, visible_text. Any number of pages: each is read once and only what
    quotes ask for leaves it, the quote itself with the page's place, so that nothing has to be searched for again. Quotes of any
    length are looked for in that one pass (``search``). Quotes and pages that are null or empty, and quotes that stand nowhere,
    give no row; quotes that come several times give one.
    """
    quotes = cut(claims.select(*keys, squash(F.col("quote")).alias("quote")).filter("quote <> ''").distinct())
    asked = cut(search.grams(quotes, pages, keys))
    # A page whose key or place is null meets no quote.
    held = reduce(and_, [F.col(c).isNotNull() for c in (*keys, "place", "visible_text")])
    texts = pages.filter(held).select(*keys, "place", "url", squash(F.col("visible_text")).alias("visible_text"))
    found = search.found_on(quotes, texts, keys, search.table(asked))
    return quotes.join(found, [*keys, "quote"]).groupBy(*keys, "quote").agg(F.min_by("url", "place").alias("url"), F.min("place").alias("place"))


def attribute_quotes_everywhere(claims: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """As ``attribute_quotes``, with every page of the run read instead of a handful. ``pages`` have a ``place``; ties go to the first."""
    claims = cut(claims.select(*keys, "claim_id", "quote", "url"))
    stated = pages.select(*keys, page_key(F.col("url"), True).alias("_key"), F.col("url").alias("_known")).groupBy(*keys, "_key").agg(F.min("_known").alias("_known"))
    where = quoted_on(claims, pages, keys).select(*keys, F.col("quote").alias("_quote"), F.col("url").alias("_found"))
    named = claims.withColumn("_quote", squash(F.col("quote"))).withColumn("_key", page_key(F.col("url"), True))
    met = named.join(where, [*keys, "_quote"], "left").join(stated, [*keys, "_key"], "left")
    return met.select(*keys, "claim_id", F.coalesce("_found", "_known", "url").alias("url"), F.col("_found").isNotNull().alias("verified"))


FEW_PAGES = 3  # A person on more pages is an author or the business itself.


# ---- pages worth reading -----------------------------------------------------------------------------------------
def reading_pages(pages: DataFrame, keys: list[str], limit: int | None = fixed.READ_PAGES) -> DataFrame:
    """The pages that say most about a business, by class and then page order."""
    rank = lookup(F.col("label"), {name: i for i, name in enumerate(fixed.READ_ORDER)}, len(fixed.READ_ORDER))
    return first_n(pages.filter(strip(F.col("visible_text")) != ""), keys, [rank, F.col("page_no")], limit, "place")


def people_rank(url: Column, has_person: Column, label: Column) -> Column:
    where = path(url)
    named = where.rlike(fixed.PEOPLE_PATH)
    return F.when(named & ~F.lower(where).contains("about"), 0).when(has_person, 1).when(named, 2).when(label == "homepage", 3)


def people_pages(pages: DataFrame, people: DataFrame, places: DataFrame, keys: list[str], limit: int | None = fixed.PEOPLE_PAGES) -> DataFrame:
    """Pages likely to present people: their URLs, then pages with Person data (of people on at most three pages).

    ``people`` and ``places`` are what ``schema_people`` gives. ``limit`` ``None`` keeps every such page.
    """
    few = places.join(people.filter(F.col("pages") <= FEW_PAGES).select(*keys, "person"), [*keys, "person"], "left_semi").select(*keys, "url").distinct().withColumn("_person", F.lit(True))
    ranked = pages.join(few, [*keys, "url"], "left").withColumn("_rank", people_rank(F.col("url"), F.coalesce("_person", F.lit(False)), F.col("label")))
    return first_n(ranked.filter(F.col("_rank").isNotNull()), keys, [F.col("_rank"), F.col("page_no")], limit, "place").drop("_person")


def crawl_text(pages: DataFrame, keys: list[str], limit: int = 12, characters: int = 1500) -> DataFrame:
    """The start of a run's first pages as one text; at most ``limit`` short pieces meet per run."""
    piece = F.concat(F.lit("## "), F.coalesce(F.nullif("title", F.lit("")), "url"), F.lit("\n"), F.coalesce("meta_description", F.lit("")), F.lit("\n"),
                     F.left("visible_text", F.lit(characters)))
    few = first_n(pages.withColumn("_piece", piece), keys, [F.col("page_no")], limit, "place")
    return few.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "_piece"))), lambda x: x["_piece"]), "\n\n").alias("text"))


# ---- buyer questions ---------------------------------------------------------------------------------------------
def candidate_urls(picked: DataFrame, pages: DataFrame, keys: list[str], limit: int = fixed.CANDIDATE_PAGES) -> DataFrame:
    """The first distinct crawled pages picked for a question. ``picked``: keys, question, pos, url."""
    known = picked.join(pages.select(*keys, "url"), [*keys, "url"], "left_semi").groupBy(*keys, "question", "url").agg(F.min("pos").alias("pos"))
    return first_n(known, [*keys, "question"], [F.col("pos")], limit, "place")


def coverage_summary(questions: DataFrame, keys: list[str]) -> DataFrame:
    counts = [F.count_if(F.col("coverage") == c).alias(c) for c in ("answered", "partial", "missing")]
    return questions.groupBy(*keys).agg(*counts, F.count_if(F.coalesce("error", F.lit("")) != "").alias("failed"), F.count("*").alias("questions")).withColumn(
        "status", F.when(F.col("failed") > 0, "PARTIAL").otherwise("COMPLETE"))


def coverage_order(coverage: Column) -> Column:
    """Gaps first: they are the work."""
    return lookup(coverage, {"missing": 0, "partial": 1, "answered": 2}, 3)


# ---- people ------------------------------------------------------------------------------------------------------
def name_tokens(name: Column) -> Column:
    """Words of a name without titles and designations."""
    found = F.regexp_extract_all(F.lower(name), F.lit("([a-z]+)"), 1)
    return F.array_sort(F.array_distinct(F.filter(found, lambda w: ~w.isin(fixed.NAME_TITLES))))


def same_person(names: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of name sets of a group where one of two or more words is contained in the other: ``(keys, small, large)``.

    The smaller set is looked up by its two rarest words; the larger offers every pair of its few words. Names sharing
    one common word therefore never meet. ``names``: keys, tokens (distinct sets).
    """
    rarity = names.select(*keys, F.explode("tokens").alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("_n"))
    ordered = names.select(*keys, "tokens", F.explode("tokens").alias("word")).join(rarity, [*keys, "word"]).groupBy(*keys, "tokens").agg(
        F.array_sort(F.collect_list(F.struct("_n", "word"))).alias("w"))
    rare = ordered.filter(F.size("tokens") >= 2).select(
        *keys, F.col("tokens").alias("small"), F.array_sort(F.transform(F.slice("w", 1, 2), lambda x: x["word"])).alias("pair"))
    pairs = F.flatten(F.transform("tokens", lambda a, i: F.transform(F.filter("tokens", lambda b: b > a), lambda b: F.array(a, b))))
    offered = names.filter(F.size("tokens") >= 2).select(*keys, F.col("tokens").alias("large"), F.explode(pairs).alias("pair"))
    met = rare.join(offered, [*keys, "pair"])
    return met.filter((F.size("small") <= F.size("large")) & (F.size(F.array_except("small", "large")) == 0)).select(*keys, "small", "large")


def schema_people(pages: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """People in a site's structured data, merged by name, and the pages that name them.

    The first result has a row per person: fields they have, distinct links to them, pages naming them; the second a row per
    person and page. Names are the nodes and containment the edges; labels spread along them until nothing changes.
    """
    person = F.filter(OBJECTS, lambda o: is_a(o, "Person") & F.coalesce(strip(text_of(prop(o, "name"))) != "", F.lit(False)))
    same_as = F.col("o.props")["sameAs"]
    links = F.filter(F.coalesce(F.from_json(same_as, "array<string>"), F.array(text_of(same_as))), lambda u: u.startswith("http"))
    rows = cut(pages.select(*keys, "page_no", "url", F.explode(person).alias("o")).select(
        *keys, "page_no", "url", strip(text_of(F.col("o.props")["name"])).alias("name"),
        F.array_compact(F.array(*[F.when(F.map_contains_key("o.props", f) & ~F.col("o.props")[f].isin("null", '""', "[]", "{}"), F.lit(f)) for f in fixed.PERSON_FIELDS])).alias("fields"),
        F.coalesce(links, F.array().cast("array<string>")).alias("links")))
    names = rows.groupBy(*keys, "name").agg(F.count("*").alias("n"))
    # A name of fewer than two words only equals itself.
    tokened = names.withColumn("tokens", name_tokens(F.col("name"))).withColumn(
        "node", F.when(F.size("tokens") >= 2, F.array_join("tokens", " ")).otherwise(F.concat(F.lit("="), "name")))
    sets = tokened.filter(F.size("tokens") >= 2).select(*keys, "tokens").distinct()
    found = same_person(sets, keys).select(*keys, F.array_join("small", " ").alias("a"), F.array_join("large", " ").alias("b")).filter(F.col("a") != F.col("b"))
    edges = cut(found.unionByName(found.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))))
    moved, changed = cut(tokened.select(*keys, "node", F.col("node").alias("person"), F.col("node").alias("_new")).distinct()), True
    while changed:
        labels = moved.select(*keys, "node", F.col("_new").alias("person"))
        heard = edges.join(labels.select(*keys, F.col("node").alias("a"), "person"), [*keys, "a"]).groupBy(*keys, F.col("b").alias("node")).agg(F.min("person").alias("_heard"))
        joined = labels.join(heard, [*keys, "node"], "left").withColumn("_new", F.least("person", F.coalesce("_heard", "person")))
        moved = cut(joined, replaces=moved)
        changed = not moved.filter(F.col("_new") != F.col("person")).isEmpty()
    merged = rows.join(tokened.select(*keys, "name", "node"), [*keys, "name"]).join(moved.select(*keys, "node", "person"), [*keys, "node"])
    fields = merged.select(*keys, "person", F.explode_outer("fields").alias("field")).groupBy(*keys, "person").agg(F.array_sort(F.collect_set("field")).alias("fields"))
    linked = merged.select(*keys, "person", F.explode("links").alias("link")).distinct().groupBy(*keys, "person").agg(F.count("*").alias("same_as"))
    places = merged.select(*keys, "person", "url").distinct()
    counted = places.groupBy(*keys, "person").agg(F.count("*").alias("pages"))
    named = merged.groupBy(*keys, "person").agg(F.min_by("name", F.struct("page_no", "name")).alias("name"))
    people = named.join(fields, [*keys, "person"]).join(counted, [*keys, "person"]).join(linked, [*keys, "person"], "left")
    return people.withColumn("same_as", F.coalesce("same_as", F.lit(0).cast("bigint"))), places


def practitioner_summary(people: DataFrame, keys: list[str]) -> DataFrame:
    """How many people have a page of their own, structured data, links and credentials. ``people``: keys, name,
    profile_url, dedicated_page, person_schema, same_as, credentials. A page several people share is nobody's own."""
    shared = people.filter(F.col("profile_url").isNotNull()).groupBy(*keys, "profile_url").agg(F.count("*").alias("_sharing"))
    own = F.col("dedicated_page") & F.col("profile_url").isNotNull() & (F.col("_sharing") == 1)
    joined = people.join(shared, [*keys, "profile_url"], "left")
    return joined.groupBy(*keys).agg(
        F.count("*").alias("practitioners"), F.count_if(own).alias("with_dedicated_page"), F.count_if("person_schema").alias("with_person_schema"),
        F.count_if("same_as").alias("with_same_as"), F.count_if("credentials").alias("with_credentials"))


def practitioner_order(checks: dict[str, Column]) -> Column:
    """Checks a profile passes; the thinnest comes first."""
    total = F.lit(0)
    for ok in checks.values():
        total = total + F.when(ok, 1).otherwise(0)
    return total


def ad_pages(ads: DataFrame, keys: list[str]) -> DataFrame:
    return ads.groupBy(*keys, "page_name").agg(F.count("*").alias("ads"))


def required_keys(answer: Column, required: list[str]) -> Column:
    """Required keys that a JSON answer lacks or leaves empty; all of them when it is not an object."""
    parsed = F.from_json(answer, "map<string,string>")
    lacking = [F.when(first_where([(F.coalesce(F.try_element_at(parsed, F.lit(k)), F.lit("")).isin("", "[]", "{}", "null"), "x")]).isNotNull(), F.lit(k)) for k in required]
    return F.array_compact(F.array(*lacking))
