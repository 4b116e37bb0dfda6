"""Language identification by prediction by partial matching (operator 11).

One tree of byte contexts per language, up to ``ORDER`` bytes long. A byte that a context has seen costs what its count says;
one that it has not seen costs an escape and is looked for in the next shorter context, and below the empty one every byte
costs eight bits. Counts are frozen after training. Costs are whole numbers of 1/65536 bit, so the code length of a text is an
exact sum that does not depend on how the work was divided.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .frames import keyed, made, slices, stored, texts

#: Bytes of the longest context.
ORDER = 4
#: What a model learns from, per language: at most so many rows, those with the least hash, and of these so many characters.
SAMPLE_ROWS, SAMPLE_CHARS = 500, 1 << 19
#: Leading bits of the hash by which rows are counted.
STEP_BITS = 12
#: Bytes of a worker's table of common byte runs, and runs that are costed at a time.
TABLE_BYTES, RUNS = 16 << 20, 1 << 20
#: Units of a bit.
BIT = 1 << 16
UNDETERMINED = "und"
_U = np.uint64
_MIX = _U(0x9E3779B97F4A7C15)
#: ASCII that is no letter counts as a space.
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def held_out(id_column: Column) -> Column:
    """A quarter of the ids, by checksum; a null id is not held out."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 4 == 2, F.lit(False))


def spelled(text: str) -> bytes:
    """The bytes that are predicted: lower case, everything in ASCII that is no letter as one space, a space at the end."""
    return b" ".join([*text.lower().encode("utf-8", "replace").translate(_LETTERS).split(), b""])


def runs(raw: np.ndarray) -> np.ndarray:
    """The ``ORDER + 1`` bytes that end at each byte from place ``ORDER`` on, as one number."""
    n = max(0, len(raw) - ORDER)
    out = np.zeros(n, _U)
    for j in range(ORDER + 1):
        out = (out << _U(8)) | raw[j:j + n]
    return out


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts after each other, each behind ``ORDER`` spaces, and where the runs of each begin and end."""
    pad = b" " * ORDER
    size = np.array([len(p) for p in parts], np.int64)
    first = np.cumsum(np.r_[0, size[:-1] + ORDER]) if len(parts) else np.zeros(0, np.int64)
    return np.frombuffer(pad + pad.join(parts), np.uint8), first, first + size


def _found(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return table[at] == wanted, at


class Tree:
    """The context tree of one language: by order, the seen (context, byte) with their costs and the contexts with their escapes."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        """``grams`` are distinct runs, ``counts`` how often each was seen."""
        self.levels = []
        for order in range(ORDER + 1):
            seen, back = np.unique(grams & _U((1 << 8 * (order + 1)) - 1), return_inverse=True)
            n = np.bincount(back, counts, len(seen)).astype(np.int64)
            contexts, group = np.unique(seen >> _U(8), return_inverse=True)
            total = np.bincount(group, n, len(contexts)).astype(np.int64)
            kinds = np.bincount(group, minlength=len(contexts))
            # A byte has n of total + kinds, the escape has kinds of them.
            cost = np.rint(BIT * np.log2((total + kinds)[group] / n)).astype(np.int32)
            escape = np.rint(BIT * np.log2((total + kinds) / np.maximum(kinds, 1))).astype(np.int32)
            self.levels.append((seen, cost, contexts, escape))

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """The code length of the last byte of each run after the bytes before it, in units."""
        out = np.full(len(grams), 8 * BIT, np.int64)
        total, left = np.zeros(len(grams), np.int64), np.arange(len(grams))
        for order in range(ORDER, -1, -1):
            seen, cost, contexts, escape = self.levels[order]
            g = grams[left] & _U((1 << 8 * (order + 1)) - 1)
            hit, at = _found(seen, g)
            if len(seen):
                out[left[hit]] = cost[at[hit]]
            left, g = left[~hit], g[~hit]
            known, at = _found(contexts, g >> _U(8))
            total[left[known]] += escape[at[known]] if len(contexts) else 0
        return out + total


class Model:
    """Trees of all languages, and a table of the costs of common runs that is filled once and keeps its size."""

    def __init__(self, names: list[str], grams: list[np.ndarray], counts: list[np.ndarray]):
        self.names, self.trees = names, [Tree(g, c) for g, c in zip(grams, counts)]
        self.bits = max(8, min(18, int(math.log2(TABLE_BYTES / (8 + 4 * max(1, len(names)))))))
        self.keys = np.full(1 << self.bits, np.iinfo(_U).max, _U)
        every = np.unique(np.concatenate([*grams, np.zeros(0, _U)]))
        weight = np.zeros(len(every), np.int64)
        for g, c in zip(grams, counts):
            weight[np.searchsorted(every, g)] += c
        every = every[np.argsort(weight, kind="stable")]
        self.keys[self._slot(every)] = every  # of several runs of one slot the commonest stays
        self.table = np.stack([t.costs(self.keys) for t in self.trees]).astype(np.int32) if names else np.zeros((0, len(self.keys)), np.int32)

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * _MIX) >> _U(64 - self.bits)).astype(np.int64)

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """Languages by runs."""
        slot = self._slot(grams)
        out = self.table[:, slot].astype(np.int64)
        miss = np.flatnonzero(self.keys[slot] != grams)
        if len(miss):
            rare, back = np.unique(grams[miss], return_inverse=True)
            for i, tree in enumerate(self.trees):
                out[i, miss] = tree.costs(rare)[back]
        return out

    def lengths(self, given: list[str]) -> np.ndarray:
        """Exact code lengths in units: languages by texts."""
        raw, start, end = _joined([spelled(t) for t in given])
        out = np.zeros((len(self.names), len(given)), np.int64)
        for at in range(0, max(0, len(raw) - ORDER), RUNS):
            grams = runs(raw[at:at + RUNS + ORDER])
            total = np.zeros((len(self.names), len(grams) + 1), np.int64)
            np.cumsum(self.costs(grams), axis=1, out=total[:, 1:])
            i, j = np.searchsorted(end, at, side="right"), np.searchsorted(start, at + len(grams))
            out[:, i:j] += total[:, np.clip(end[i:j] - at, 0, len(grams))] - total[:, np.clip(start[i:j] - at, 0, len(grams))]
        return out

    def predict(self, given: list[str], worded: list[bool]) -> tuple[list[str], list[float]]:
        """The language of the shortest code, the least name of equal ones, and its share of ``2 ** -length`` over all."""
        if not self.names:
            return [UNDETERMINED] * len(given), [0.0] * len(given)
        bits = self.lengths(given)
        best = bits.argmin(axis=0)
        share = 1 / np.exp2(-np.minimum((bits - bits.min(axis=0)) / BIT, 1000)).sum(axis=0)
        return [self.names[b] if w else UNDETERMINED for b, w in zip(best, worded)], [float(s) if w else 0.0 for s, w in zip(share, worded)]


def _sample(docs: DataFrame, id_column: str, text_column: str, lang_column: str) -> DataFrame:
    """``(lang, t)``: at most ``SAMPLE_ROWS`` distinct rows per language with the least hash, and ``SAMPLE_CHARS`` characters.

    Rows are counted by steps of their hash first, so that only about ``SAMPLE_ROWS`` narrow rows of a language of any size are
    ranked. There is a row per language in what is broadcast.
    """
    rows = docs.select(F.col(id_column).cast("bigint").alias("k"), F.col(text_column).cast("string").alias("t"), F.col(lang_column).cast("string").alias("lang"))
    rows = rows.filter("lang is not null and t is not null").filter(~held_out(F.col("k"))).withColumn("h", F.xxhash64("t"))
    # Steps of the hash, those of texts longer than the whole allowance last: such a text is learned from only where a language has no others.
    o = F.xxhash64("k", "h")
    step = F.shiftrightunsigned(o, 64 - STEP_BITS) + F.when(F.char_length("t") > SAMPLE_CHARS, 1 << STEP_BITS).otherwise(0)
    narrow = rows.select("lang", "k", "h", o.alias("o"), step.alias("step"), F.char_length("t").alias("size"))
    steps = Window.partitionBy("lang").orderBy("step")
    counts = narrow.groupBy("lang", "step").count().withColumn("before", F.sum("count").over(steps) - F.col("count"))
    ends = counts.filter(F.col("before") < SAMPLE_ROWS).groupBy("lang").agg(F.max("step").alias("end"))
    by = Window.partitionBy("lang").orderBy("step", "o", "h", "k")
    least = narrow.join(F.broadcast(ends), "lang").filter("step <= end").withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= SAMPLE_ROWS)
    before = F.coalesce(F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    least = least.withColumn("before", before).filter((F.col("before") + F.col("size") <= SAMPLE_CHARS) | (F.col("rank") == 1))
    chosen = stored(least.select("lang", F.col("k").alias("ck"), F.col("h").alias("ch")).distinct(), "lang-rows")
    found = rows.join(F.broadcast(chosen.withColumnRenamed("lang", "cl")), F.expr("lang = cl and h = ch and k <=> ck"))
    return found.dropDuplicates(["lang", "k", "h"]).select("lang", "t")


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Model:
    """A model of every non-null ``lang`` of rows that are not held out, from their texts.

    A language's statistics come from at most ``SAMPLE_ROWS`` rows and ``SAMPLE_CHARS`` characters. Spark counts the runs of
    bytes per language; their number is bounded by the sample, and only the counts come to the driver. Without rows the model
    knows no language. Equal ids on several rows are several rows; a repeated row counts once.
    """
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(batches):
        for part in slices(batches, limit=1 << 20):
            langs = np.array(part.column("lang").to_pylist(), object)
            given = texts(part)
            for lang in sorted(set(langs)):
                raw, start, end = _joined([spelled(given[i]) for i in np.flatnonzero(langs == lang)])
                inside = np.zeros(len(raw) + 1, np.int64)
                np.add.at(inside, start, 1)
                np.add.at(inside, end, -1)
                grams = runs(raw)
                grams, n = np.unique(grams[np.cumsum(inside)[:len(grams)] > 0], return_counts=True)
                yield made(schema, [lang] * len(grams), pa.array(grams.view(np.int64)), n)

    # One task per language: its sample is bounded, and each of its runs is counted in one place.
    sample = _sample(docs, id_column, text_column, lang_column).repartition("lang")
    counted = sample.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs, grams, n = counted.column("lang").combine_chunks(), counted.column("gram").to_numpy().view(_U), counted.column("n").to_numpy()
    names = sorted(pc.unique(langs).to_pylist())
    each = [np.flatnonzero(pc.equal(langs, name).to_numpy(zero_copy_only=False)) for name in names]
    each = [i[np.argsort(grams[i])] for i in each]
    return Model(names, [grams[i] for i in each], [n[i] for i in each])


_PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
_LETTER = r"\p{L}"


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row, from the whole text and nothing else.

    ``lang_pred`` is the language whose tree gives the shortest code, ``score`` its share of the probability. Null texts and
    texts without a letter are ``und`` with score 0, and so is everything where nothing was learned. Repeated rows come back
    each; a null id stays null and is not held out; no rows give no rows; other columns are ignored. Row-local: long texts are
    costed ``RUNS`` bytes at a time.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        local = sent.value
        for part in slices(batches):
            worded = pc.fill_null(pc.match_substring_regex(part.column("t"), _LETTER), False).to_pylist()
            yield made(_PREDICTED, part.column("k"), *local.predict(texts(part), worded))

    found = keyed(docs, id_column, text_column).mapInArrow(run, "doc_id bigint, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """Train on the rows that are not held out and predict every row: see ``train`` and ``predict``."""
    return predict(docs, train(docs, id_column, text_column, lang_column), id_column, text_column)
