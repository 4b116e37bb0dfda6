"""Copy scores per page and their summaries per site."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import copy as C, fixed_values as fixed
from ..functions.scalars import whole
from .lines import bodies_and_openings

SCORES = ("ai_slop", "marketing_bias")


def signal_columns(brand: Column | None = None) -> dict[str, Column]:
    """Every subscore over ``body``, ``body_lines``, ``words``, ``common_openings``, ``_sentences`` and ``_asks``."""
    text, lines, words, sentences, bits = (F.col(c) for c in ("body", "body_lines", "words", "_sentences", "_asks"))

    def named(*names: str) -> Column:
        return reduce(lambda a, b: a + b, [C.hits(bits, n, C.count(text, C.pattern(n))) if n in C.ASKED else C.count(text, C.pattern(n)) for n in names])

    def phrases(name: str, listed: list[str]) -> Column:
        return C.hits(bits, name, C.count(text, C.phrase_pattern(listed)))

    def by_rate(hits: Column, weights: dict, name: str) -> Column:
        return C.rated(hits, words, weights[name][1])

    slop, bias = fixed.SLOP_WEIGHTS, fixed.BIAS_WEIGHTS
    return {
        "stock_phrases": by_rate(phrases("stock", fixed.STOCK), slop, "stock_phrases"),
        "rhythm": C.rhythm(sentences),
        "formula_skeleton": whole(F.least(C.skeleton_hits(lines, F.col("common_openings")) / 4, F.lit(1.0)) * 100),
        "contrast_frames": by_rate(named("contrast", "split_contrast"), slop, "contrast_frames"),
        "formula_openers": by_rate(phrases("openers", fixed.OPENERS) + named("no_just"), slop, "formula_openers"),
        "em_dashes": by_rate(C.count(text, "—"), slop, "em_dashes"),
        "triads": by_rate(named("triad"), slop, "triads"),
        "vagueness": F.lit(100).cast("bigint") - C.rated(named("number"), words, fixed.SPECIFICITY_RATE),
        "template_artifacts": F.when(C.asked(bits, "template") & F.col("visible_text").rlike(C.pattern("template")), 100).otherwise(0).cast("bigint"),
        "unsupported_claims": by_rate(C.unsupported_claims(text, brand, bits), bias, "unsupported_claims"),
        "self_focus": C.self_focus(text, named("we"), named("you"), F.try_element_at(sentences, F.lit(1)), brand),
        "one_sidedness": C.one_sidedness(phrases("balance", fixed.BALANCE), words),
        **{name: by_rate(named(name), bias, name) for name in ("pressure", "fomo", "loss_aversion", "authority")},
    }


def evidence_patterns() -> dict[str, list[str]]:
    """The patterns whose matches a signal counts; ``specificity`` is the counter-signal of ``vagueness``."""
    named = {name: [C.pattern(name)] for name in ("pressure", "fomo", "loss_aversion", "authority")}
    return {
        "stock_phrases": [C.phrase_pattern(fixed.STOCK)], "contrast_frames": [C.pattern("contrast"), C.pattern("split_contrast")],
        "formula_openers": [C.phrase_pattern(fixed.OPENERS), C.pattern("no_just")], "em_dashes": ["—"], "triads": [C.pattern("triad")],
        "specificity": [C.pattern("number")], "one_sidedness": [C.phrase_pattern(fixed.BALANCE)], **named}


def signal_counts(bodies: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, signal, count, per_1k)`` of every page with enough words; ``bodies`` as for ``score_bodies``."""
    counted = bodies.withColumn("words", C.english_words(F.col("body")).cast("bigint")).filter(F.col("words") >= fixed.MIN_WORDS)
    each = [F.struct(F.lit(n).alias("signal"), C.count(F.col("body"), *p).cast("bigint").alias("count")) for n, p in evidence_patterns().items()]
    rows = counted.select(*keys, "words", F.explode(F.array(*each)).alias("s")).select(*keys, "words", "s.*")
    return rows.select(*keys, "signal", "count", F.bround(C.rate(F.col("count"), F.col("words")), 1).alias("per_1k"))


def signal_examples(bodies: DataFrame, keys: list[str], signals: list[str] | None = None, limit: int = 5) -> DataFrame:
    """``(keys, signal, place, example)``: the text around the first matches of each signal, in page order."""
    patterns = {n: p for n, p in evidence_patterns().items() if signals is None or n in signals}
    found = [F.struct(F.lit(n).alias("signal"), C.snippets(F.col("body"), "|".join(f"(?:{p})" for p in ps), limit).alias("examples")) for n, ps in patterns.items()]
    rows = bodies.select(*keys, F.explode(F.array(*found)).alias("s"))
    return rows.select(*keys, "s.signal", F.posexplode("s.examples").alias("place", "example"))


def score_bodies(bodies: DataFrame, brand: Column | None = None) -> DataFrame:
    """Subscores and both scores per page; all NULL under 80 words."""
    counted = bodies.withColumn("words", C.english_words(F.col("body")).cast("bigint"))
    enough = F.col("words") >= fixed.MIN_WORDS
    signals = signal_columns(brand)
    # Sentences are cut once for the two signals that read them, and what no pattern can match in is searched for none.
    read = counted.withColumn("_asks", C.asks("body", "visible_text")).withColumn("_sentences", F.when(enough, C.sentences(F.col("body_lines"))))
    scored = read.select("*", *[F.when(enough, c).alias(name) for name, c in signals.items()]).drop("_asks", "_sentences")
    have = {name: F.col(name) for name in signals}
    slop = C.weighted(have, fixed.SLOP_WEIGHTS) + F.when(have["template_artifacts"] > 0, 40.0).otherwise(0.0)
    bias = C.weighted(have, fixed.BIAS_WEIGHTS)
    total = {"ai_slop": slop, "marketing_bias": bias}
    order = {"ai_slop": [*fixed.SLOP_WEIGHTS, "template_artifacts"], "marketing_bias": list(fixed.BIAS_WEIGHTS)}
    for name in SCORES:
        score = whole(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total[name])))
        scored = scored.withColumn(name, F.when(enough, score))
        scored = scored.withColumn(f"{name}_level", C.level(F.col(name)))
        scored = scored.withColumn(f"{name}_top", F.when(enough, F.array_join(
            C.top_signals({s: F.col(s) for s in order[name]}), ",")).otherwise(""))
    return scored


def score_pages(pages: DataFrame, keys: list[str], brand: Column | None = None, chrome_share: float = fixed.CHROME_SHARE,
                opening_share: float = fixed.SKELETON_SHARE) -> DataFrame:
    """From pages with ``lines`` to scored pages: shared lines out, template openings found, copy scored. Reads the texts twice."""
    return score_bodies(bodies_and_openings(pages, keys, chrome_share, opening_share), brand)


def long_scores(scored: DataFrame, keys: list[str], extra: list[str]) -> DataFrame:
    """One row per page and score."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("score_name"), F.col(n).alias("score")) for n in SCORES])).alias("s")
    return scored.select(*keys, *extra, each).select(*keys, *extra, "s.score_name", "s.score")


def copy_summary(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Per site and score, and per page class: pages scored, median, mean, how many high and medium. One pass.

    Scores are whole numbers, so the exact percentile keeps at most 101 counters per group.
    """
    rows = long_scores(scored, keys, ["label"])
    grouped = rows.groupingSets([[*map(F.col, keys), F.col("score_name")], [*map(F.col, keys), F.col("score_name"), F.col("label")]],
                                *keys, "score_name", "label")
    score = F.col("score")
    return grouped.agg(
        F.count("score").alias("pages"), F.count_if(score.isNull()).alias("unscored"),
        whole(F.percentile("score", 0.5)).alias("median"), whole(F.avg("score")).alias("mean"),
        F.count_if(score >= 60).alias("high"), F.count_if(score.between(30, 59)).alias("medium"),
        F.grouping("label").cast("int").alias("all_classes"))


def top_pages(scored: DataFrame, keys: list[str], order: str, limit: int = 10) -> DataFrame:
    """The highest scoring pages per site and score. The rank limit prunes on the map side."""
    rows = long_scores(scored, keys, [order]).filter(F.col("score").isNotNull())
    best = Window.partitionBy(*keys, "score_name").orderBy(F.desc("score"), F.col(order))
    return rows.withColumn("position", F.row_number().over(best)).filter(F.col("position") <= limit)


def rating_summary(judgements: DataFrame, keys: list[str]) -> DataFrame:
    """Summary of an external 0-4 copy rating, scaled to 0-100: pages judged and failed, median, high, medium, tokens."""
    score = whole(F.col("rating") / 4 * 100)
    return judgements.select(*keys, score.alias("score"), "error", "tokens").groupBy(*keys).agg(
        F.count("score").alias("judged"), F.count("error").alias("failed"),
        whole(F.percentile("score", 0.5)).alias("median"), F.count_if(F.col("score") >= 60).alias("high"),
        F.count_if(F.col("score").between(30, 59)).alias("medium"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.when((F.count("score") > 0) | (F.count("*") == 0), "OBSERVED").otherwise("UNKNOWN").alias("status"))
