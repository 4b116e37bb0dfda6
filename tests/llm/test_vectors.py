"""Hard negatives and centroid clustering against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from vitrine.llm import centroids, negatives, vectors

SCHEMA = "vec_id bigint, embedding array<double>, label bigint, id string, x int"


def steps(v, scale):
    return None if v is None or any(c is None or not math.isfinite(c) for c in v) else [math.floor(scale * c) for c in v]


def brute_negatives(rows, every, scale=256):
    least = {}
    for k, v, label, *_ in rows:
        q = steps(v, scale)
        if None not in (k, label, q):
            least[k] = min(least.get(k, (label, q)), (label, q))
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = []
    for a, (la, qa) in least.items():
        if a % every:
            continue
        order = sorted((-dot(qa, q), k, label) for k, (label, q) in least.items() if k != a)
        for s, p, _ in [x for x in order if x[2] == la][:5]:
            fits = [(k, -n) for n, k, label in order if label != la and 30 * -s <= 100 * -n <= 90 * -s][:10]
            out += [(a, p, i + 1, k, -s, n) for i, (k, n) in enumerate(fits)]
    return sorted(out)


def some_rows(seed, n, labels=3, size=6, grain=4):
    rng = random.Random(seed)
    return [(k, [rng.randint(-grain, grain) / 256 * rng.choice([1, 2, 8]) for _ in range(size)], rng.randrange(labels), "i", 0) for k in range(-20, n)]


@pytest.mark.parametrize("seed, sent", [(1, 16_384), (2, 7)])
def test_negatives_are_those_of_all_pairs(spark, monkeypatch, seed, sent):
    monkeypatch.setattr(vectors, "ROWS", 64)
    monkeypatch.setattr(negatives, "ANCHORS", 5)
    rows = some_rows(seed, 300)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = negatives.mine(df, F.col("vec_id") % 10 == 0, sent=sent).collect()
    assert len(found) > 200 and sorted(map(tuple, found)) == brute_negatives(rows, 10)


def test_negatives_of_odd_rows(spark):
    big = 2.0 ** 18
    rows = [(0, [1.0, 0.5], 1, "a", 1), (0, [1.0, 0.5], 1, "a", 1), (1, [1.0, 0.5], 1, "a", 1), (2, [0.5, 0.25], 2, "a", 1), (3, [0.5, 0.25], 2, "a", 1), (4, None, 2, "a", 1), (5, [0.5, None], 2, "a", 1),
            (6, [0.5, math.nan], 2, "a", 1), (7, [0.5, math.inf], 2, "a", 1), (8, [0.5, 0.2], None, "a", 1), (None, [0.5, 0.2], 2, "a", 1), (9, [0.5], 2, "a", 1), (10, [], 2, "a", 1), (11, [big, big], 1, "a", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = negatives.mine(df, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, found.collect())) == brute_negatives(rows, 10)
    assert negatives.mine(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0 and negatives.mine(df, F.lit(False)).columns == found.columns
    assert negatives.mine(df.filter("vec_id = 0"), F.col("vec_id") == 0).count() == 0


def test_keys_sort_as_anchor_descending_score_positives_id():
    rng = random.Random(1)
    many = [(rng.choice([-5, 0, 7]), rng.choice([-(1 << 40), -1, 0, 3, 1 << 40]), rng.randrange(2), rng.choice([-2, 0, 9])) for _ in range(200)]
    keys = [negatives.packed(np.array([a]), np.array([s]), k, np.array([i]))[0] for a, s, k, i in many]
    assert [negatives.unpacked_key(k) for k in sorted(keys)] == sorted(many, key=lambda r: (r[0], -r[1], r[2], r[3])) and [negatives.unpacked_key(k) for k in keys] == many


def brute_clusters(rows, size, scale, clusters, rounds, seed=1):
    kept = [(k, q) for k, v, *_ in rows if v is not None and len(v) == size and (q := steps(v, scale)) is not None]
    order = sorted((hashlib.sha256(f"{seed}:{k}".encode()).hexdigest(), q) for k, q in kept if k is not None)
    now = [q for _, q in order[:clusters]]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((away(q, c), i) for i, c in enumerate(now)) for _, q in kept]
    for _ in range(rounds):
        got = assign()
        for i in range(len(now)):
            own = [q for (_, q), (_, c) in zip(kept, got) if c == i]
            if own:
                now[i] = [sum(x) // len(own) for x in zip(*own)]
    got = assign()
    per = {i: sum(d for d, c in got if c == i) for i in range(len(now))}
    return sorted(((k, c, d, per[c], sum(per.values()), hashlib.sha256(",".join(map(str, now[c])).encode()).hexdigest()) for (k, _), (d, c) in zip(kept, got)), key=repr)


@pytest.mark.parametrize("seed, clusters, rounds", [(1, 5, 3), (2, 40, 2)])
def test_clusters_are_those_of_full_distances(spark, seed, clusters, rounds):
    rows = some_rows(seed, 200, size=7) + [(500, None, 1, "a", 1), (501, [1.0] * 6, 1, "a", 1), (502, [1.0] * 6 + [math.nan], 1, "a", 1), (503, [None] * 7, 1, "a", 1), (None, [0.1] * 7, None, "a", 1),
                                           (504, [0.03] * 7, None, "a", 1), (504, [0.03] * 7, None, "a", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = centroids.clustered(df, components=7, scale=64, clusters=clusters, rounds=rounds)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_clusters(rows, 7, 64, clusters, rounds)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame(some_rows(1, 3, size=4)[-3:], SCHEMA)
    assert centroids.clustered(df, components=4).filter("distance = 0").count() == 3
    assert centroids.clustered(df.limit(0), components=4).count() == 0 and centroids.clustered(df, components=5).count() == 0


def test_moved_products_equal_fresh_ones(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-9, 9, (300, 8))
    rows = spark.createDataFrame([(int(i), 0, r.astype(float).tolist()) for i, r in enumerate(x)], "id bigint, label bigint, x array<double>")
    old, new = rng.integers(-9, 9, (4, 8)), None
    new = old.copy()
    new[1, 3] += 2
    new[2] = -new[2]
    state = centroids._moved(centroids._moved(vectors.blocks(rows), np.zeros_like(old), old), old, new).collect()
    for r in state:
        ids, dots = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["dots"], np.int64).reshape(-1, 4)
        assert (dots == x[ids] @ new.T).all()
