"""Post planning: keywords, titles that repeat others, publish dates, due sites, and listing proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fixed
from ..session import cut
from .ranking import first_n


def keyword_lines(text: Column) -> Column:
    """One keyword per line or comma."""
    return F.filter(F.transform(F.split(F.replace(text, F.lit(","), F.lit("\n")), "\n"), lambda k: F.trim(k)), lambda k: k != "")


def next_keyword(sites: DataFrame, posts: DataFrame, window: int = fixed.REPEAT_WINDOW) -> DataFrame:
    """The first keyword not used by the site's latest posts; with repeats allowed, the one used longest ago.

    ``sites``: site, keywords[], repeat. ``posts``: site, post_id, keyword, created_at.
    """
    recent = first_n(posts, ["site"], [F.desc("created_at"), F.desc("post_id")], window, "age").groupBy(
        "site", F.lower("keyword").alias("_used")).agg(F.min("age").alias("_age"))
    options = sites.select("site", "repeat", F.posexplode("keywords").alias("pos", "keyword")).withColumn("_used", F.lower("keyword"))
    aged = options.join(recent, ["site", "_used"], "left")
    fresh = F.min_by(F.when(F.col("_age").isNull(), F.col("keyword")), F.when(F.col("_age").isNull(), F.col("pos")))
    oldest = F.max_by("keyword", F.struct("_age", -F.col("pos")))
    return aged.groupBy("site").agg(F.coalesce(fresh, F.when(F.bool_or("repeat"), oldest)).alias("keyword"))


def title_words(title: Column) -> Column:
    plain = F.regexp_replace(F.lower(title), "[^a-z0-9 ]", " ")
    return F.array_sort(F.array_distinct(F.filter(F.split(plain, " +"), lambda w: w != "")))


def similar_titles(titles: DataFrame, keys: list[str], threshold: float = fixed.SIMILAR_TITLES) -> DataFrame:
    """Pairs of distinct word sets of a group with Jaccard similarity at or above the threshold: ``(keys, early, late)``.

    Prefix filtering: with words ordered rarest first, two sets that similar must share one of their first
    ``n - ceil(t * n) + 1`` words, so only sets meeting on a rare word are compared, and none are missed.
    ``titles``: keys, set_id, words.
    """
    rarity = titles.select(*keys, F.explode("words").alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("n"))
    sized = titles.select(*keys, "set_id", F.size("words").alias("size"), F.explode("words").alias("word")).join(rarity, [*keys, "word"])
    ordered = sized.groupBy(*keys, "set_id", "size").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("w"))
    prefix = F.col("size") - F.ceil(F.col("size") * threshold - F.lit(1e-9)).cast("int") + 1
    heads = ordered.select(*keys, "set_id", "size", F.transform("w", lambda x: x["word"]).alias("words"),
                           F.explode(F.transform(F.slice("w", F.lit(1), prefix), lambda x: x["word"])).alias("word"))
    left = heads.select(*keys, "word", F.col("set_id").alias("early"), F.col("words").alias("_a"), F.col("size").alias("_na"))
    right = heads.select(*keys, "word", F.col("set_id").alias("late"), F.col("words").alias("_b"), F.col("size").alias("_nb"))
    close = (F.col("early") < F.col("late")) & (F.least("_na", "_nb") >= F.greatest("_na", "_nb") * threshold - 1e-9)
    shared = F.size(F.array_intersect("_a", "_b"))
    met = left.join(right, [*keys, "word"]).filter(close)
    return met.filter(shared >= (F.col("_na") + F.col("_nb") - shared) * threshold - 1e-9).select(*keys, "early", "late").distinct()


def near_duplicate_titles(titles: DataFrame, keys: list[str], threshold: float = fixed.SIMILAR_TITLES) -> DataFrame:
    """Titles kept in order: one is dropped when it repeats an earlier kept title. ``titles``: keys, pos, title, existing.

    Equal word sets meet in an aggregate first (the earliest stands for all), so copies never form pairs. Then each
    round accepts the sets all of whose earlier neighbours are settled, and rejects those next to an accepted one, until
    nothing is open: the same outcome as going through the list one by one.
    """
    order = F.struct(F.when(F.col("existing"), 0).otherwise(1), F.col("pos"))
    sets = titles.withColumn("words", title_words(F.col("title"))).groupBy(*keys, "words").agg(
        F.min_by(F.struct("pos", "title", "existing"), order).alias("t"))
    # Existing titles come before all new ones and are never dropped.
    first = sets.select(*keys, "words", "t.*").withColumn("set_id", F.when(F.col("existing"), F.col("pos") - F.lit(2**53)).otherwise(F.col("pos")))
    first = cut(first)
    edges = cut(similar_titles(first.select(*keys, "set_id", "words"), keys, threshold))
    node = [*keys, "set_id"]
    state, open_left = first.select(*node, F.when(F.col("existing"), True).alias("kept")), True
    while open_left:  # each round settles at least the earliest open title of a group
        settled = state.select(*keys, F.col("set_id").alias("early"), F.col("kept").alias("_early_kept"))
        seen = edges.join(settled, [*keys, "early"]).groupBy(*keys, F.col("late").alias("set_id")).agg(
            F.bool_or(F.coalesce("_early_kept", F.lit(False))).alias("_hit"), F.bool_or(F.col("_early_kept").isNull()).alias("_open"))
        joined = state.join(seen, node, "left")
        verdict = F.when(F.col("_hit"), False).when(~F.coalesce("_open", F.lit(False)), True)
        state = cut(joined.select(*node, F.coalesce("kept", verdict).alias("kept")))
        open_left = not state.filter(F.col("kept").isNull()).isEmpty()
    return first.join(state.filter("kept"), node).filter(~F.col("existing")).select(*keys, "pos", "title")


def schedule(planned: DataFrame, today: Column, spacing: int = fixed.SPACING_DAYS) -> DataFrame:
    """Publish dates ``spacing`` days apart, the first that far after the last one and never before tomorrow.

    ``planned``: site, n (1-based place in the plan), last_date.
    """
    tomorrow = F.date_add(today, 1)
    first = F.greatest(F.date_add("last_date", spacing), tomorrow)
    return planned.withColumn("publish_on", F.date_add(F.coalesce(first, tomorrow), (F.lit(spacing) * (F.col("n") - 1)).cast("int")))


def due_sites(sites: DataFrame, posts: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Sites with a schedule, a usable keyword and a crawl whose last post is older than their frequency."""
    last = posts.groupBy("site").agg(F.max("created_at").alias("last_post"))
    usable = next_keyword(sites, posts).filter(F.col("keyword").isNotNull())
    ready = sites.filter(F.col("every_days") > 0).join(runs.select("site"), "site", "left_semi").join(usable, "site").join(last, "site", "left")
    waited = F.col("last_post") + F.make_dt_interval(days=F.col("every_days").cast("int")) <= now
    return ready.filter(F.col("last_post").isNull() | waited).select("site", "keyword")


def new_proposals(mismatches: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Proposals after a sync: decided ones stay as they are, pending ones follow the listing, stale pending edits go.

    ``mismatches``: keys, kind, target, before, after. ``stored``: the same with status.
    """
    ids = [*keys, "kind", "target"]
    fresh = mismatches.select(*ids, F.struct("before", "after").alias("new"))
    old = stored.select(*ids, F.struct("before", "after").alias("old"), "status")
    merged = old.join(fresh, ids, "full")
    decided = F.col("status").isNotNull() & (F.col("status") != "pending")
    # A reply waits for its decision even when the review no longer shows up; a field edit that agrees again is moot.
    stale = F.col("new").isNull() & ~decided & (F.col("kind") == "field_edit")
    kept = F.when(decided | F.col("new").isNull() | (F.col("old").isNotNull() & (F.col("kind") != "field_edit")), F.col("old")).otherwise(F.col("new"))
    return merged.filter(~F.coalesce(stale, F.lit(False))).select(
        *ids, kept.alias("k"), F.coalesce("status", F.lit("pending")).alias("status")).select(*ids, "k.before", "k.after", "status")
