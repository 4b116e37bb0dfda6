"""Benchmark windows and licence digests against brute force."""

import hashlib
import random
import re

from vitrine.llm import decontaminate, licenses
from vitrine.llm.fixed_values import LICENSE_TEXTS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n=10):
    windows = []
    for item, text in items:
        w = words(text)
        size = min(n, len(w))
        windows += [(item, tuple(w[i:i + size])) for i in range(len(w) - size + 1) if w]
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, window in windows:
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i:i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    found.add(item)
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "a", "The", "É", "é", "İx", "x1", "naïve", "2"] + ["".join(rng.choice("abcde") for _ in range(4)) for _ in range(25)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 3, 5, 9, 10, 11, 14, 25])))) for i in range(12)]
    items += [(90, None), (91, ""), (92, "!!"), (93, "zebra"), (94, items[0][1]), (None, items[3][1])]
    docs = []
    for d in range(80):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            text = rng.choice(items)[1] or ""
            text = rng.choice([text, text.upper(), text.replace(" ", "-- "), " ".join(text.split()[:9])])
            w.insert(rng.randint(0, len(w)), text)
        docs.append((d, rng.choice([" ", "\n", "_"]).join(w)))
    return docs + [(80, None), (81, ""), (None, docs[1][1]), docs[2], (2, docs[3][1]), (82, "A zebra, zebra.")], items


def test_windows_of_items(spark, monkeypatch):
    for seed, rows in ((1, 250_000), (2, 250_000), (2, 7)):
        monkeypatch.setattr(decontaminate, "BLOCK_ROWS", rows)
        docs, items = corpus(seed)
        d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id bigint, text string, token string, n int")
        b = spark.createDataFrame([(*r, "x") for r in items], "item_id bigint, text string, window string")
        expected = brute(docs, items)
        assert sorted(map(tuple, decontaminate.decontaminate(d, b).collect()), key=repr) == expected
        clean = decontaminate.without_contaminated(d, b).select("doc_id", "text").collect()
        assert sorted(map(tuple, clean), key=repr) == sorted((r for r in docs if not brute([r], items)[0][5]), key=repr)


def test_the_main_path_is_native(spark):
    docs, items = corpus(1)
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    plan = decontaminate.decontaminate(d, b)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    assert decontaminate.decontaminate(none, items).count() == 0
    assert tuple(decontaminate.decontaminate(some, items).first()) == (1, 3, 0, 0, hashlib.sha256(b"").hexdigest(), False)
    assert licenses.scan(none).count() == 0


def test_license_scan(spark):
    mit = LICENSE_TEXTS[0][1]
    varied = "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace('"', "“").replace("\n", "\n\n   ")
    rows = [(1, mit), (2, varied), (3, f"Some code here.\n\n{mit}\n\nMore.\nReleased under the MIT License!\nreleased  under the mit LICENCE"), (4, None), (5, ""), (6, "---"), (7, "A text.\nLicensed under CC BY-NC 4.0."),
            (7, "A text.\nLicensed under CC BY-NC 4.0."), (None, "All rights reserved."), (8, mit + " or else")]
    found = licenses.scan(spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, license string")).collect()
    assert sorted(map(tuple, found), key=repr) == sorted([
        (1, "MIT", 0, ""), (2, "MIT", 0, ""), (3, None, 3, "MIT"), (4, None, 0, ""), (5, None, 0, ""), (6, None, 0, ""), (7, None, 1, "CC-BY-NC-4.0"), (7, None, 1, "CC-BY-NC-4.0"),
        (None, "All-Rights-Reserved", 1, "All-Rights-Reserved"), (8, None, 0, "")], key=repr)
