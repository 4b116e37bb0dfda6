"""Trained operators: held-out accuracy, exact statistics, brute-force sums over small trees."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from vitrine.llm import html_text, quality, toxicity

DATA = "/root/testdata/sf0.01"


# ---- toxicity ----------------------------------------------------------------------------------------------------
def test_toxic_documents_of_the_held_out_fifth(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = toxicity.toxicity(docs, labels)
    assert found.count() == docs.count() and found.filter("score < 0 or score > 1 or (score >= 0.5) <> (predicted = 1)").isEmpty()
    held = found.join(labels, "doc_id").filter("held_out").groupBy("toxic", "predicted").count().collect()
    n = Counter({(r["toxic"], r["predicted"]): r["count"] for r in held})
    # A tenth of the labels are noise: the text they were given for has been replaced by junk.
    assert n[1, 1] / (n[1, 1] + n[1, 0]) > 0.85 and n[0, 1] / (n[0, 0] + n[0, 1]) < 0.02


def test_counterfactuals_keep_mentions_neutral():
    rows = [([0, 1], 1)] * 20 + [([1], 0)] * 4 + [([2], 0)] * 60
    plain, b0 = toxicity.fit(rows, [], 3)
    fair, b1 = toxicity.fit(rows, [([1], [])] * 5, 3, counterfactual=20.0)
    assert abs(fair[1]) < 0.3 * abs(plain[1]) and b1 + fair[0] > 0 > b1 + fair[1]
    assert toxicity.swaps("the muslim men spoke".split()) == [("men", "girls"), ("muslim", "christian")]


def test_odd_rows_are_scored(spark):
    rows = [(1, "you idiot", "a"), (2, None, "b"), (3, "", "c"), (None, "x", "d"), (1, "you idiot", "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    model = toxicity.Model(["^idiot$"], np.array([9.0]), -3.0)
    got = sorted(((r["doc_id"], r["predicted"]) for r in toxicity.score(docs, model).collect()), key=repr)
    assert got == sorted([(1, 1), (2, 0), (3, 0), (None, 0), (1, 1)], key=repr)
    assert toxicity.without_toxic(docs, model).columns == docs.columns and toxicity.without_toxic(docs, model).count() == 3
    none = docs.limit(0)
    empty = toxicity.train(none, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert toxicity.score(docs, empty).filter("predicted = 1").isEmpty() and toxicity.score(none, empty).count() == 0


# ---- quality -----------------------------------------------------------------------------------------------------
def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_statistics_and_verdicts(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "a", "é \x0b#x\n\nb b b b b\n#x\n#x"] + [rng.choice([" ", "\n"]).join(rng.choice(["a", "b", "ça", "#", "日", "x\ny"]) for _ in range(rng.randint(0, 90))) for _ in range(120)]
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(7, texts[7], 1), (None, "a b", 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_words int")
    found = quality.statistics(docs).drop("n_lines").collect()
    assert sorted(map(tuple, found), key=repr) == sorted(((k, *brute_statistics(t)) for k, t, _ in rows), key=repr)
    judged = quality.judged(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert judged.filter("kept = base_failed").isEmpty() and judged.count() == len(rows)
    assert quality.judged(docs.limit(0), spark.createDataFrame([(1, 0)], "doc_id bigint, quality int")).count() == 0


def test_bad_rows_are_found_and_good_ones_stay(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    n = {(r["quality"], r["kept"]): r["count"] for r in quality.judged(docs, labels).join(labels, "doc_id").filter("not base_failed").groupBy("quality", "kept").count().collect()}
    assert n.get((0, True), 0) <= 0.1 * n[0, False] and n.get((1, False), 0) <= 0.02 * n[1, True]


def test_isolation_and_thresholds():
    rows = np.concatenate([np.random.default_rng(1).normal(0, 1, (500, 2)), [[9.0, 9.0]]])
    scores = quality.Forest(rows).score(rows)
    assert scores.argmax() == 500 and 0 < scores.min() and scores.max() < 1
    assert quality.calibrated([(400, 90, 0), (700, 0, 9)]) == 0.5505 and quality.calibrated([(400, 9, 1)]) == math.inf


# ---- pages -------------------------------------------------------------------------------------------------------
def test_messages_give_the_sums_over_all_labellings():
    model = html_text.fit(html_text.labelled_pages(4), rounds=20)
    page = html_text.Page("<body><div class=content><h1>T</h1><p>Some text here. And more.</p></div><footer>&copy; x</footer></body>")
    likely, pairs = model.marginals(page)
    features, n = page.features(), len(page.tags)
    total, ones = 0.0, [0.0] * n
    for y in itertools.product((0, 1), repeat=n):
        z = sum(sum(model.unary[f] for f in features[i]) for i in range(n) if y[i])
        z += sum(model.pair[html_text.kinds_of(page)[i]][y[page.parents[i]]][y[i]] for i in range(1, n))
        total += math.exp(z)
        for i in range(n):
            ones[i] += math.exp(z) * y[i]
    assert all(abs(a - b / total) < 1e-9 for a, b in zip(likely, ones))
    assert all(abs(sum(p) - 1) < 1e-9 for p in pairs[1:])


def test_pages_of_layouts_that_training_did_not_see():
    model, wrong, blocks = html_text.trained(), 0, 0
    for source in html_text.labelled_pages(80, seed=1234):
        page = html_text.Page(source)
        likely, _ = model.marginals(page)
        for node, _ in page.blocks:
            blocks += 1
            wrong += (likely[node] > 0.5) != ("data-main" in page.attributes[node])
    assert wrong / blocks < 0.02


def test_text_of_given_pages_equals_the_article(spark):
    import html as references

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(pages.withColumn("text", F.lit("clash"))).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
        text = re.sub(r"<[^>]*>|<[^>]*\Z", " ", re.sub(r"</?b>", "", inner))
        text = " ".join(references.unescape(text).split())
        assert got[r["page_id"]] == (text, len(text))


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<nav><a href=x>Menu</a></nav>"), (None, "u", "<article><p>It&#39;s &amp; was  one.<p>Two <b>bo</b>ld.<br>Three."),
            (5, "u", "<article><p>" + "word " * 40_000 + ".</p></article>"), (5, "u", "<" * 3000), (6, "u", "<article><p>An article of some words.</p><script>var a='</p>';</script><!-- no --></article><p cut")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    by = {(r["page_id"], r["n_chars"]): r["text"] for r in got}
    assert len(got) == len(rows) and by[1, 0] == by[2, 0] == by[3, 0] == ""
    assert [t for (k, _), t in by.items() if k is None] == ["It's & was one. Two bold. Three."]
    assert by[6, 25] == "An article of some words." and any(k == 5 and n == 200_001 for k, n in by)
    assert html_text.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
