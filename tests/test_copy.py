import pytest
from pyspark.sql import functions as F

from vitrine.functions import copy as C
from vitrine.operators import copy_scores as K, lines as L

FORMULA = """In today's fast-paced landscape, we leverage seamless, robust and innovative tools to unlock transformative growth.
It's not about software, it's about outcomes, and whether you're new or growing, look no further than our holistic platform.
We empower teams to streamline work, elevate results and harness synergy. Moreover, our bespoke approach is truly pivotal.
They don't have a lead problem. They have a follow-up problem. The best part is our comprehensive, dynamic and vibrant journey.
Delve into a tapestry of cutting-edge, state-of-the-art and next-level ideas that resonate, additionally, with every crucial realm."""
PLAIN = """Maria opened the shop in a former bakery on Fifth Street after she left her job at the city library.
She repaired 212 bikes last year and kept 40 customers from the first month, most of whom ride to work.
A basic tune takes 45 minutes and costs $85, which includes new cables if the old ones are worn through.
On Saturdays her brother runs the front desk while she trues wheels in the back room with the radio on.
Parts come from two suppliers in Ohio, and the shop keeps 30 spare tubes in each common size on the shelf."""


def pages(spark, texts, **extra):
    rows = [("s", i, "other", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "site string, page_no bigint, label string, visible_text string")
    return df.withColumn("lines", F.split("visible_text", "\n"))


def score(spark, text):
    return K.score_pages(pages(spark, [text]), ["site"]).first()


def test_formulaic_copy_scores_above_plain_copy(spark):
    formula, plain = score(spark, FORMULA), score(spark, PLAIN)
    assert formula.ai_slop > plain.ai_slop + 20 and formula.stock_phrases == 100 and formula.contrast_frames > 0
    assert plain.ai_slop_level == "LOW" and plain.vagueness < 100


def test_short_copy_is_unknown_with_null_scores(spark):
    row = score(spark, "Too little copy to judge.")
    assert row.ai_slop is None and row.ai_slop_level == "UNKNOWN" and row.marketing_bias_top == ""


@pytest.mark.parametrize("text, claims", [("We are the best shop.", 1), ("Best Leads is a shop.", 0), ("55% of buyers wait.", 1), ("According to a study 55% of buyers wait.", 0),
                                          ("Conversion went from 0.97% to 2.73%.", 0), ("The #1 choice, 100% safe", 3)])
def test_unsupported_claims(spark, text, claims):
    row = spark.createDataFrame([(text,)], "t string").select(C.unsupported_claims(F.col("t"), F.lit("Best Leads")).alias("n")).first()
    assert row.n == claims


def test_chrome_lines_and_bodies(spark):
    site = pages(spark, ["Home\nAbout\nfirst page", "Home\nAbout\nsecond page", "Home\nthird page", "Home\nHome\nfourth page"])
    assert {(r.line, r.pages) for r in L.chrome_lines(site, ["site"]).collect()} == {("Home", 4), ("About", 2)}
    assert {r.body for r in L.page_bodies(site, ["site"]).collect()} == {"first page", "second page", "third page", "fourth page"}
    assert L.chrome_lines(site.limit(2), ["site"]).isEmpty()


def test_snippets_have_exact_context(spark):
    text = "x" * 50 + " seamless " + "y" * 100 + " seamless end"
    row = spark.createDataFrame([(text,)], "t string").select(C.snippets(F.col("t"), C.phrase_pattern(["seamless"])).alias("s")).first()
    assert row.s == ["…" + "x" * 39 + " seamless " + "y" * 39 + "…", "…" + "y" * 39 + " seamless end"]


def test_summary_counts_by_class_and_overall(spark):
    scored = spark.createDataFrame([("s", "a", 10, 70), ("s", "a", 65, 30), ("s", "b", None, None)], "site string, label string, ai_slop bigint, marketing_bias bigint")
    rows = {(r.score_name, r.label): r for r in K.copy_summary(scored, ["site"]).collect()}
    total = rows["ai_slop", None]
    assert (total.pages, total.unscored, total.median, total.mean, total.high, total.medium) == (2, 1, 38, 38, 1, 0)
    assert rows["ai_slop", "b"].median is None
