"""Quality rules with an isolation forest on their statistics (operator 10)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .frames import keyed, made, slices, stored, texts
from .words import U, Words, mixed

#: Words below which, and percent of repeated words above which, a text fails the base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Labelled rows that the forest is grown on: those with the least hash of their id.
SAMPLE_ROWS = 8192
TREES, TREE_ROWS, SEED = 200, 256, 10
#: Steps of the score in which labelled rows are counted for the threshold.
STEPS = 1000

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_SPACES = " \t\n\v\f\r"

STATS = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint"
_STATS = pa.schema([(x.split()[0], pa.int64()) for x in STATS.split(", ")])


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(values, dtype=np.int64))
    return total[cuts[1:]] - total[cuts[:-1]]


def statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row the statistics the rules speak of; three-word windows are told apart by 64-bit hashes of their words."""
    def run(batches):
        for part in slices(batches, limit=1 << 20):
            all_texts = texts(part)
            w = Words(all_texts)
            visible = np.where((w.raw & 0xC0) != 0x80, 1, 0)
            visible[np.isin(w.raw, np.frombuffer(_SPACES.encode(), np.uint8))] = 0
            whole = np.flatnonzero(w.whole(3))
            key = mixed(w.windows(3)[whole] + mixed(w.doc[whole].astype(np.uint64) + U(1)))
            _, which, times = np.unique(key, return_inverse=True, return_counts=True)
            again = np.zeros(len(w), bool)
            for j in range(3):
                again[whole[times[which] > 1] + j] = True
            lines = [[x for x in t.split("\n") if x.strip(_SPACES)] for t in all_texts]
            yield made(_STATS, part.column("k"), w.count, _sums(visible, w.text_start), _sums(_SYMBOL[w.raw], w.text_start),
                       [len(x) - len(set(x)) for x in lines], _sums(again, w.first), [len(x) for x in lines])

    return keyed(docs, id_column, text_column).mapInArrow(run, STATS)


def base_failed():
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)


#: Groups of statistics, each with a forest of its own, in the order in which they judge.
GROUPS = ("symbols", "length", "repetition")


def features(cols: dict[str, np.ndarray], group: str) -> np.ndarray:
    """Shares that do not depend on a text's length: symbols, characters a word, doubled lines and repeated words."""
    words, lines, chars = (np.maximum(cols[n], 1) for n in ("n_words", "n_lines", "word_chars"))
    pick = {"symbols": (cols["n_symbols"] / words, cols["n_symbols"] / chars), "length": (cols["word_chars"] / words,),
            "repetition": (cols["n_dup_lines"] / lines, cols["n_repeat_words"] / words)}
    return np.column_stack(pick[group]).astype(float)


class Forest:
    """Random splits; ``score`` is 2 ** -(mean path length / the expected one), near 1 for rows that few splits isolate."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.size = min(tree_rows, len(rows))
        self.trees = []
        for _ in range(trees if len(rows) else 0):
            nodes: list[list[float]] = []
            self._grow(rows[rng.choice(len(rows), self.size, replace=False)], 0, max(1, math.ceil(math.log2(max(2, self.size)))), rng, nodes)
            self.trees.append(np.array(nodes))

    @staticmethod
    def expected(n) -> float:
        """Mean path length of an unsuccessful search among ``n`` rows."""
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, rows, depth, limit, rng, nodes) -> int:
        """A node is ``[feature or -1, split, left, right, path length]``."""
        at = len(nodes)
        nodes.append([-1, 0.0, at, at, depth + self.expected(len(rows))])
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (0, 0)
        open_ = np.flatnonzero(high > low) if len(rows) > 1 and depth < limit else []
        if len(open_):
            f = int(rng.choice(open_))
            split = float(rng.uniform(low[f], high[f]))
            left = rows[:, f] < split
            nodes[at][:4] = [f, split, self._grow(rows[left], depth + 1, limit, rng, nodes), self._grow(rows[~left], depth + 1, limit, rng, nodes)]
        return at

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.zeros(len(rows))
        total = np.zeros(len(rows))
        each = np.arange(len(rows))
        for nodes in self.trees:
            at = np.zeros(len(rows), np.int64)
            while True:
                f = nodes[at, 0].astype(np.int64)
                inner = f >= 0
                if not inner.any():
                    break
                left = rows[each, np.maximum(f, 0)] < nodes[at, 1]
                at = np.where(inner, np.where(left, nodes[at, 2], nodes[at, 3]).astype(np.int64), at)
            total += nodes[at, 4]
        return 2.0 ** (-total / len(self.trees) / max(self.expected(self.size), 1e-9))


def _columns(batch) -> dict[str, np.ndarray]:
    return {name: batch.column(name).to_numpy() for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")}


def calibrated(counts: list[tuple[int, int, int]]) -> float:
    """The score from which rows are dropped, from ``(step, good rows, bad rows)``: where most more bad than good rows go.

    Among equal thresholds the middle of the widest gap; where no threshold drops more bad than good rows, none is set.
    """
    by = {s: b - g for s, g, b in counts}
    gain, best, found = 0, 0, []
    for step in range(STEPS, -1, -1):  # rows of this step and above go
        gain += by.get(step, 0)
        if gain > best:
            best, found = gain, []
        if gain == best and best > 0:
            found.append(step)
    if not found:
        return math.inf
    found = np.array(found[::-1])
    widest = max(np.split(found, np.flatnonzero(np.diff(found) > 1) + 1), key=len)
    return float(widest[0] + widest[-1]) / 2 / STEPS


def judged(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> DataFrame:
    """Per row the statistics, ``base_failed``, an anomaly score for each group of statistics, and ``kept``.

    The forests grow on at most ``SAMPLE_ROWS`` labelled rows that pass the base rules, good and bad ones alike. All labelled
    rows, counted in Spark by steps of the score, set the thresholds, each forest's on what those before it leave. Null and
    empty texts have no words and fail; repeated rows are judged each; a null id has no label; conflicting labels of one id
    count as bad; without labels of both kinds only the base rules decide; no rows give no rows; other columns are ignored.
    """
    stats = stored(statistics(docs, id_column, text_column), "stats").withColumn("base_failed", base_failed())
    label = labels.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(label_column).cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.min("label").alias("label"))
    labelled = stored(stats.filter("not base_failed").join(label, "doc_id"), "labelled")
    sample = labelled.orderBy(F.xxhash64("doc_id"), "doc_id", "n_words", "word_chars").limit(SAMPLE_ROWS).toPandas()
    grown = {c: sample[c].to_numpy() for c in sample.columns}
    sent = docs.sparkSession.sparkContext.broadcast({g: Forest(features(grown, g)) for g in GROUPS})

    def score(batches):
        for batch in batches:
            if batch.num_rows:
                cols = _columns(batch)
                for g in GROUPS:
                    batch = batch.append_column(f"anomaly_{g}", pa.array(sent.value[g].score(features(cols, g))))
                yield batch

    def with_scores(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(score, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + "".join(f", anomaly_{g} double" for g in GROUPS))

    left, normal = with_scores(labelled), ~F.col("base_failed")
    for g in GROUPS:
        anomaly = F.col(f"anomaly_{g}")
        steps = left.groupBy(F.floor(anomaly * STEPS).cast("int").alias("step")).agg(
            F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") == 0).alias("bad")).collect()  # at most STEPS + 1 rows
        below = anomaly < F.lit(calibrated([tuple(r) for r in steps]))
        left, normal = left.filter(below), normal & below
    return with_scores(stats).withColumn("kept", normal)
