"""Language identification against plain context trees, and held-out accuracy."""

import math
import random
from collections import Counter

import numpy as np
from vitrine.llm import languages

SCHEMA = "doc_id bigint, text string, lang string, score string, gram int"


def brute_length(model_texts, text):
    """Code length in units of a text after the texts that a tree learned from, by counting in dictionaries."""
    k = languages.ORDER
    seen = Counter()
    for t in model_texts:
        raw = b" " * k + languages.spelled(t)
        for i in range(k, len(raw)):
            for n in range(k + 1):
                seen[raw[i - n:i], raw[i:i + 1]] += 1
    total, kinds = Counter(), Counter()
    for (c, _), n in seen.items():
        total[c] += n
        kinds[c] += 1
    out, raw = 0, b" " * k + languages.spelled(text)
    for i in range(k, len(raw)):
        for n in range(k, -1, -1):
            c, b = raw[i - n:i], raw[i:i + 1]
            if (c, b) in seen:
                out += round(languages.BIT * math.log2((total[c] + kinds[c]) / seen[c, b]))
                break
            if c in total:
                out += round(languages.BIT * math.log2((total[c] + kinds[c]) / kinds[c]))
        else:
            out += 8 * languages.BIT
    return out


def letters(rng, alphabet, n):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7))) for _ in range(n))


def test_code_lengths_are_those_of_plain_trees(spark, monkeypatch):
    monkeypatch.setattr(languages, "TABLE_BYTES", 4096)  # a table that holds few of the runs
    monkeypatch.setattr(languages, "RUNS", 64)  # texts over several stretches
    rng = random.Random(3)
    texts = {"a": [letters(rng, "abcdé", 40) for _ in range(6)], "b": [letters(rng, "bcdeß", 40) for _ in range(6)]}
    rows = [(i * 2 + j, t, lang, "x", 1) for j, (lang, ts) in enumerate(texts.items()) for i, t in enumerate(ts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = languages.train(docs)
    kept = {r["doc_id"] for r in docs.select("doc_id", languages.held_out(docs.doc_id).alias("h")).collect() if not r["h"]}
    learned = {lang: [t for k, t, x, *_ in rows if x == lang and k in kept] for lang in texts}
    given = ["", "abc", "Éd,  e!", "zz 日本", letters(rng, "abcdeé", 90), letters(rng, "cdeß", 90)]
    assert model.names == ["a", "b"]
    assert model.lengths(given).tolist() == [[brute_length(learned[x], t) for t in given] for x in ("a", "b")]


def test_odd_rows_and_defined_results(spark):
    base = [(i, t, lang, None, 0) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("le chat est sur le lit", "fr")] * 20)]
    odd = [(100, None, "en", "x", 1), (101, "", None, "x", 1), (102, "12 -- 3", "fr", "x", 1), (None, "the mat", None, "x", 1), (103, "the cat", None, "x", 1), (103, "the cat", None, "x", 1),
           (104, "le lit " * 40_000, None, "x", 1), (105, "²½", None, "x", 1)]
    docs = spark.createDataFrame(base + odd, SCHEMA)
    found = {}
    for r in languages.identified(docs).collect():
        found.setdefault(r["doc_id"], []).append(r["lang_pred"])
        assert 0 <= r["score"] <= 1 and r["held_out"] == (r["doc_id"] is not None and __import__("zlib").crc32(str(r["doc_id"]).encode()) % 4 == 2)
    assert [found[k] for k in (100, 101, 102, None, 103, 104, 105)] == [["und"], ["und"], ["und"], ["en"], ["en", "en"], ["fr"], ["und"]]
    assert languages.identified(docs.limit(0)).count() == 0
    unlabelled = docs.withColumn("lang", docs.lang.substr(1, 0)).withColumn("lang", docs.score)
    assert {r["lang_pred"] for r in languages.predict(docs, languages.train(unlabelled.filter("doc_id < 40"))).collect()} == {"und"}


def test_held_out_texts_never_teach(spark):
    rows = [(i, f"word{'abcdefgh'[i % 8]} text here", "xx" if __import__("zlib").crc32(str(i).encode()) % 4 == 2 else "yy", "s", 1) for i in range(60)]
    assert languages.train(spark.createDataFrame(rows, SCHEMA)).names == ["yy"]


def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = languages.identified(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    n, right = found.count(), found.filter("lang = lang_pred").count()
    assert n > 200 and right / n > 0.99


def test_sums_do_not_depend_on_slices():
    rng = np.random.default_rng(1)
    grams = languages.runs(rng.integers(97, 101, 500).astype(np.uint8))
    model = languages.Model(["a"], [np.unique(grams)], [np.unique(grams, return_counts=True)[1]])
    given = ["abcd " * 30, "dcba", ""]
    assert model.lengths(given)[0].tolist() == [int(model.lengths([t])[0, 0]) for t in given]
