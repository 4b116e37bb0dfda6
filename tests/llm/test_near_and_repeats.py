"""SimHash classes and repeated windows against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from vitrine.llm import repeats, simhash

SCHEMA = "doc_id bigint, text string, k string, source string"


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = words.encode().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(rows):
    marks = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, f"{m:016x}", least.get(find(i))) for i, ((k, _), m) in enumerate(zip(rows, marks))), key=repr)


def brute_dedup(rows, k=13):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - k + 1) if d is not None else ():
            key = tuple(w[i:i + k])
            first[key] = min(d, first.get(key, d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - k + 1) if d is not None else ():
            if first[tuple(w[i:i + k])] < d:
                gone.update(range(i, i + k))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "a"] * 3 + ["".join(rng.choice("abcdefé") for _ in range(rng.randint(2, 8))) for _ in range(60)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(13, 70))] for _ in range(6)]
    rows = []
    for d in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 5)
            at = rng.randint(0, len(words))
            words[at:at] = p[a:len(p) - rng.randint(0, 5)]
        if rows and rng.random() < 0.3:
            words = (rng.choice(rows)[1] or "").split()
            if words and rng.random() < 0.6:
                words[rng.randrange(len(words))] = "changed"
        rows.append((d, rng.choice([" ", "\n", "  "]).join(words)))
    rng.shuffle(rows)
    return rows + [(n, None), (n + 1, ""), (None, rows[0][1]), rows[3], (rows[4][0], rows[5][1]), (n + 2, "the of " * 400), (n + 3, "of the " * 300)]


@pytest.mark.parametrize("seed", [1, 2])
def test_simhash_classes(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x", None) for r in rows], SCHEMA)
    for tile in (8, 1024):
        found = simhash.near_duplicates(df, tile=tile).collect()
        assert sorted(map(tuple, found), key=repr) == brute_classes(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeated_windows(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x", None) for r in rows], SCHEMA)
    found = repeats.dedup(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, found), key=repr) == brute_dedup(rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repeats.dedup(none).count() == 0 and simhash.near_duplicates(none).count() == 0


def test_compaction_joins_neighbours_with_one_source():
    assert repeats.spans([(5, 2, 1), (0, 5, 1), (30, 1, 1), (31, 1, 2)], 13) == [(0, 19, 1), (30, 43, 1), (31, 44, 2)]


def test_fingerprints_that_differ_in_the_first_bit_are_linked(spark):
    base = [0x123456789ABCDEF0, 0x0F0F0F0F0F0F0F0F]
    fps = np.array([x ^ flip for x in base for flip in (0, 1 << 63, 1 << 63 | 1, 1 << 63 | 6, 15)], np.uint64).view(np.int64)
    a = fps.view(np.uint64)
    assert (simhash.near(fps, fps, 3) == [[bin(int(x) ^ int(y)).count("1") <= 3 for y in a] for x in a]).all()
    df = spark.createDataFrame([(int(x),) for x in fps], "fp bigint")
    found = {frozenset((r["a"], r["b"])) for r in simhash.links(df).collect()}
    joined = {k: k for k in fps.tolist()}
    for x, y in (tuple(f) for f in found if len(f) == 2):
        joined = {k: joined[x] if v == joined[y] else v for k, v in joined.items()}
    assert len(set(joined.values())) == 2
