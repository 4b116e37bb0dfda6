"""The near-dedup stage of the pipeline against brute-force Jaccard similarity."""

import random

import corpus_pipeline
import numpy as np
import pytest
from vitrine.llm import near_copies

from test_near_and_repeats import SCHEMA, corpus


def shingle_set(text, k=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute_similar(rows):
    sets, label = [shingle_set(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                label = [label[j] if x == label[i] else x for x in label]
    least = {}
    for (k, _), x in zip(rows, label):
        if k is not None:
            least[x] = min(k, least.get(x, k))
    return sorted(((k, least.get(x)) for (k, _), x in zip(rows, label)), key=repr)


@pytest.mark.parametrize("seed, tile", [(1, 1024), (2, 8)])
def test_classes_are_those_of_all_pairs(spark, monkeypatch, seed, tile):
    # One block of all and no radius: what is left are tiles, exact links and classes.
    monkeypatch.setattr(near_copies, "choices", lambda n, s: np.zeros((1, 0), int))
    monkeypatch.setattr(near_copies, "radius", lambda s: 128)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x", None) for r in rows], SCHEMA)
    found = near_copies.classes(df, tile=tile).collect()
    assert sorted(map(tuple, found), key=repr) == brute_similar(rows)
    assert near_copies.classes(df.limit(0)).count() == 0


def test_classes_of_given_documents_are_those_of_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_similar([tuple(r) for r in docs.select("doc_id", "text").collect()])
    found = sorted(map(tuple, near_copies.classes(docs).collect()), key=repr)
    copies = sum(k != c for k, c in want)
    # Links are exact, so nothing else may be joined; of the pairs at 0.8 a few of a hundred may be missed.
    assert copies > 50 and sum(k != c for k, c in found) >= 0.95 * copies and all(c == w or c == k for (k, c), (_, w) in zip(found, want))


@pytest.mark.parametrize("size", [10, 40, 300])
def test_pairs_at_the_similarity_are_within_the_radius_and_meet(size):
    rng = np.random.default_rng(size)
    other, n = round(size / 9), 400  # (size - other) / (size + other) is about 0.8
    sets = [(np.r_[x[:size]], np.r_[x[other:size + other]]) for x in rng.integers(0, 1 << 63, (n, size + other), dtype=np.uint64)]
    bits = near_copies.wide_fingerprints([s for pair in sets for s in pair])
    flat = np.unpackbits(bits.view(np.uint8).reshape(2 * n, -1), axis=1, bitorder="little")
    a, b = flat[::2], flat[1::2]
    met = np.zeros(n, bool)
    for places in near_copies.choices(200_000, 0.8):
        met |= (a[:, places] == b[:, places]).all(axis=1)
    assert (met & ((a != b).sum(axis=1) <= near_copies.radius(0.8))).mean() > 0.92


def test_a_large_group_makes_no_pairs_of_all(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    rows = [(d, " ".join(w if i != d % 200 else f"x{d}" for i, w in enumerate(base))) for d in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["component_id"] for r in near_copies.classes(docs, tile=64).collect()} == {0}


def test_fingerprints_and_shingles():
    sets = near_copies.shingle_sets(["a B c d e f", "A b C d E F", "a b", "", " \n", "a b c d e a b c d e a"])
    assert [len(s) for s in sets] == [2, 2, 1, 0, 0, 5] and (sets[0] == sets[1]).all()
    bits = near_copies.wide_fingerprints(sets)
    for s, f in zip(sets, bits):
        both = [near_copies.mixed(s * np.uint64(2 * j + 1) + np.uint64(j)) for j in range(2)]
        assert [2 * sum(int(x) >> i & 1 for x in b) > len(s) for b in both for i in range(64)] == [bool(int(f[i // 64]) >> i % 64 & 1) for i in range(128)]


def test_stage_drops_copies_with_a_word_changed(spark):
    rng, rows = random.Random(5), []
    for d in range(0, 60, 2):
        words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(150)]
        changed = words[:]
        changed[rng.randrange(150)] = "changed"
        rows += [(d, " ".join(words)), (d + 1, " ".join(changed))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r[0] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == list(range(0, 60, 2))
