import random

from pyspark.sql import functions as F

from vitrine.functions import copy as C, fixed_values as fixed, scalars as S
from vitrine.operators import copy_scores as K
from vitrine.plans.copy import SAMPLES

TEXTS = [*SAMPLES, "", "not just a shop but more. It's not talk, it's work.", "No plan, no fee. Just results.", "fast, cheap and good", "Book now before noon, 12 years of experience",
         "ſeamleſſ, act now! JOİN over 5 KB", "٣ clients, 3x. 4+ and ٣%", "we’re, us, éus, yours", "$5 million, €3k, 2019 was .5 percent",
         "lorem ipsum {{x}} [your name]", "We don’t. They do. Not for everyone, #1 and 100%!", "anı le, ıs, and we"]


def test_gates_lose_no_match(spark):
    rng = random.Random(3)
    words = " ".join(TEXTS + fixed.STOCK + fixed.OPENERS + fixed.PUFFERY + fixed.BALANCE).split()
    texts = TEXTS + fixed.STOCK + fixed.OPENERS + fixed.PUFFERY + fixed.BALANCE + [rng.choice([" ", "\n", " "]).join(rng.choices(words, k=30)) for _ in range(300)]
    phrases = {"stock": fixed.STOCK, "openers": fixed.OPENERS, "puffery": fixed.PUFFERY, "balance": fixed.BALANCE}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("bits", C.asks("t", "t"))
    for name in C.ASKED:
        regex = C.phrase_pattern(phrases[name]) if name in phrases else C.pattern(name)
        assert rows.filter(F.col("t").rlike(regex) & ~C.asked(F.col("bits"), name)).collect() == [], name
        assert rows.filter(F.col("t").rlike(regex)).count() and rows.filter(~C.asked(F.col("bits"), name)).count()
    for name in C.STARTS:
        assert rows.filter(C.count(F.col("t"), C.pattern(name)) != C.count(F.col("t"), C.FLAGS + fixed.PATTERNS[name])).collect() == [], name


def test_letters_that_fold_to_ascii_are_the_four_known(spark):
    chars = spark.range(0x80, 0x110000).filter("id < 55296 or id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    assert sorted(r.c for r in chars.filter(F.col("c").rlike("(?iU)^[a-z]$")).collect()) == ["İ", "ı", "ſ", "K"]


def test_words_of_a_line_are_counted_the_same_without_a_search(spark):
    lines = ["", " ", "a", "a b", " a b", "a b ", "a  b", "a\tb c", "é 中 x", "a\x0bb", "a b c", "a b c d e f", "x\n", "x \n", "a b\r"]
    rows = spark.createDataFrame([(x,) for x in lines], "x string").withColumn("n", F.regexp_count("x", F.lit(r"\S+")))
    assert rows.filter(S.line_words(F.col("x")) != F.col("n")).collect() == []
    for n in (2, 3, 6):
        assert rows.filter(S.has_words(F.col("x"), n) != (F.col("n") >= n)).collect() == []
    assert rows.filter(F.col("x").rlike(r"(?U)\S") != (S.strip(F.col("x")) != "")).collect() == []


def test_texts_without_a_pattern_are_not_searched_for_it(spark):
    rows = spark.createDataFrame([("s", 1, "a", "word " * 90)], "site string, page_no bigint, label string, visible_text string").withColumn("lines", F.split("visible_text", "\n"))
    scored = K.score_pages(rows, ["site"])
    assert "ArrowEvalPython" in scored._jdf.queryExecution().executedPlan().toString() and scored.first().ai_slop == 15
