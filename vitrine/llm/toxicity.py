"""A toxicity classifier regularised by counterfactuals (operator 8)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .fixed_values import IDENTITY_TERMS
from .frames import keyed, made, slices, stored, texts

#: Labelled rows a model is fitted on, per class: those with the least hash of their id. A bound, not a share.
SAMPLE_ROWS = {1: 4000, 0: 8000}
#: Features kept, and the toxic rows of the sample that must have one.
FEATURES, LEAST_ROWS = 3000, 4
#: Words of which a worker remembers the features (about 150 bytes each).
REMEMBERED = 100_000
PREFIXES = range(3, 9)
_LETTERS = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    """The whole words and their openings in a lower-cased stretch without white space."""
    out = []
    for w in _LETTERS.findall(word):
        out.append(f"^{w}$")
        out += [f"^{w[:n]}" for n in PREFIXES if len(w) > n]
    return out


def held_out(id_column: Column) -> Column:
    """A fifth of the ids, by checksum."""
    return F.crc32(id_column.cast("string")) % 5 == 0


def swaps(words: list[str], groups=IDENTITY_TERMS) -> list[tuple[str, str]]:
    """``(term, other term of its list)`` for every identity term among the words."""
    have = set(words)
    return [(t, group[(i + 1) % len(group)]) for group in groups for i, t in enumerate(group) if t in have]


class Model:
    """Weights of features that are present; ``score`` is a probability."""

    def __init__(self, features: list[str], weights: np.ndarray, bias: float):
        self.index = {f: i for i, f in enumerate(features)}
        self.weights, self.bias, self.memo = weights, bias, {}

    def present(self, text: str) -> set[int]:
        if len(self.memo) > REMEMBERED:
            self.memo.clear()
        memo, index, out = self.memo, self.index, set()
        for w in set(text.lower().split()):
            found = memo.get(w)
            if found is None:
                found = memo[w] = tuple(index[f] for f in word_features(w) if f in index)
            if found:
                out.update(found)
        return out

    def score(self, text: str) -> float:
        z = self.bias + float(self.weights[sorted(self.present(text))].sum())
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def fit(rows: list[tuple[list[int], int]], pairs: list[tuple[list[int], list[int]]], n: int, l2: float = 1e-4, counterfactual: float = 1.0,
        rounds: int = 600) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated descent: log loss, weight decay, and the squared change of the score over ``pairs``.

    Toxic rows weigh half as much together as the others, whatever their share of the sample.
    """
    if not rows:
        return np.zeros(n), -10.0

    def flat(lists):
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([i for x in lists for i in x], np.int64)

    (r, c), y = flat([x for x, _ in rows]), np.array([v for _, v in rows], float)
    (pr, pc), (qr, qc) = flat([a for a, _ in pairs]), flat([b for _, b in pairs])
    weight = np.where(y == 1, max(1, (y == 0).sum()) / (2 * max(1, (y == 1).sum())), 1.0)
    weight /= weight.sum()
    rate = min(max(float(weight @ y), 1e-3), 1 - 1e-3)
    w, b = np.zeros(n), math.log(rate / (1 - rate))
    fast_w, fast_b, t = w, b, 1.0
    widest = max(1, max(len(x) for x, _ in rows))
    change = max([1, *(len(set(a) ^ set(b)) for a, b in pairs)])
    step = 1 / (0.25 * (widest + 1) + l2 + 2 * counterfactual * change)
    for _ in range(rounds):
        z = fast_b + np.bincount(r, fast_w[c], len(y))
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * weight
        grad = np.bincount(c, error[r], n) + l2 * fast_w
        if pairs:
            moved = np.bincount(pr, fast_w[pc], len(pairs)) - np.bincount(qr, fast_w[qc], len(pairs))
            grad += 2 * counterfactual / len(pairs) * (np.bincount(pc, moved[pr], n) - np.bincount(qc, moved[qr], n))
        new_w, new_b = fast_w - step * grad, fast_b - step * error.sum()
        new_t = (1 + math.sqrt(1 + 4 * t * t)) / 2
        fast_w, fast_b = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return w, float(b)


def _sample(labels: DataFrame, id_column: str, label_column: str) -> DataFrame:
    rows = labels.select(F.col(id_column).cast("bigint").alias("k"), F.col(label_column).cast("int").alias("y")).dropna()
    rows = rows.filter(~held_out(F.col("k"))).groupBy("k").agg(F.max("y").alias("y"))
    each = [rows.filter(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(n) for y, n in SAMPLE_ROWS.items()]
    return each[0].union(each[1])


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Model:
    """A model from at most ``SAMPLE_ROWS`` labelled rows per class, none of them held out.

    Spark finds the sampled texts (the sample's size is bounded, so it is broadcast), counts their features per class and
    turns them into lists of feature numbers; only the chosen features and those lists come to the driver. Where a sampled
    text has an identity term, the same text with another term of its list is its counterfactual; every term's own features
    are compared with their absence as well, so that a mention alone moves no score. Without labels every score is low.
    """
    chosen = F.broadcast(_sample(labels, id_column, label_column))
    sample = stored(keyed(docs, id_column, text_column).filter("k is not null").join(chosen, "k").select("t", "y"), "sample")

    def count(batches):
        schema = pa.schema([("f", pa.string()), ("y", pa.int32()), ("n", pa.int64())])
        for part in slices(batches, limit=1 << 20):
            found: dict[tuple[str, int], int] = {}
            for t, y in zip(texts(part), part.column("y").to_pylist()):
                for f in {f for w in set(t.lower().split()) for f in word_features(w)}:
                    found[f, y] = found.get((f, y), 0) + 1
            yield made(schema, [f for f, _ in found], [y for _, y in found], list(found.values()))

    rows = sample.groupBy("y").count().collect()  # two rows
    total = {1: 0, 0: 0} | {r["y"]: r["count"] for r in rows}
    counted = sample.mapInArrow(count, "f string, y int, n bigint").groupBy("f").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (total[1] + 1) / ((F.col("b") + 0.5) / (total[0] + 1)))
    best = counted.filter(F.col("a") >= LEAST_ROWS).filter(odds > 1).orderBy((F.col("a") * odds).desc(), "f").limit(FEATURES)
    features = [r["f"] for r in best.select("f").collect()]
    blank = Model(features, np.zeros(len(features)), 0.0)

    def encode(batches):
        schema = pa.schema([("y", pa.int32()), ("x", pa.list_(pa.int32())), ("other", pa.list_(pa.list_(pa.int32())))])
        for part in slices(batches, limit=1 << 20):
            y, x, other = part.column("y").to_pylist(), [], []
            for t in texts(part):
                x.append(sorted(blank.present(t)))
                words = t.lower().split()
                other.append([sorted(blank.present(" ".join(new if w == old else w for w in words))) for old, new in swaps(words)])
            yield made(schema, y, x, other)

    encoded = sample.mapInArrow(encode, "y int, x array<int>, other array<array<int>>").collect()  # bounded by the sample
    encoded.sort(key=lambda r: (r["y"], r["x"]))
    pairs = [(r["x"], o) for r in encoded for o in r["other"]]
    pairs += [(sorted(blank.present(term)), []) for group in IDENTITY_TERMS for term in group if blank.present(term)]
    weights, bias = fit([(r["x"], r["y"]) for r in encoded], pairs, len(features))
    return Model(features, weights, bias)


_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row, from the whole text and nothing else.

    Null and empty texts get the score of a text without features; repeated rows are scored each; a null id is never held
    out; other columns are ignored. The model travels with the tasks; it has at most ``FEATURES`` features.
    """
    sent = docs.sparkSession.sparkContext.broadcast((list(model.index), model.weights, model.bias))

    def run(batches):
        local = Model(*sent.value)
        for part in slices(batches):
            yield made(_SCORED, part.column("k"), [local.score(t) for t in texts(part)])

    scored = keyed(docs, id_column, text_column).mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, text_column: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below ``limit``. Row-local."""
    sent = docs.sparkSession.sparkContext.broadcast((list(model.index), model.weights, model.bias))

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        local = Model(*sent.value)
        for batch in batches:
            yield pd.Series([local.score(t or "") for t in batch], dtype=float)

    return docs.filter(probability(F.col(text_column).cast("string")) < limit)


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> DataFrame:
    """Train on the labelled rows that are not held out and score every row: see ``train`` and ``score``."""
    return score(docs, train(docs, labels, id_column, text_column, label_column), id_column, text_column)
