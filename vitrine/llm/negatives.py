"""Hard-negative mining by a secondary-sort shuffle (operator 12).

A pair of an anchor and another row is one key: the anchor, the score from the highest down, positives before negatives, the
other row's id. Keys are dealt by anchor and sorted within partitions; one pass over each partition opens a window at every
positive and gives out the negatives that fall into open windows, so no anchor's rows are ever held together.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .frames import made, shared_folder, stored
from .vectors import blocks, products, unpacked, whole

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: A negative's score is at least and at most so many hundredths of the positive's.
LOW, HIGH = 30, 90
EVERY = 100
#: Anchors compared at a time, and anchors sent to the tasks at a time.
ANCHORS, SENT = 256, 16_384

_SIGN = 1 << 63
_KEY = struct.Struct(">QQBQ")
_KEYS = pa.schema([("key", pa.binary())])
_BYTES = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
POSITIVE, NEGATIVE = 0, 1


def packed(anchor: np.ndarray, score: np.ndarray, kind: int, other: np.ndarray) -> list[bytes]:
    """Keys whose order as bytes is (anchor, descending score, positives first, id)."""
    out = np.empty(len(anchor), _BYTES)
    out["anchor"], out["id"] = anchor.view(np.uint64) ^ np.uint64(_SIGN), other.view(np.uint64) ^ np.uint64(_SIGN)
    out["score"], out["kind"] = ~(score.view(np.uint64) ^ np.uint64(_SIGN)), kind
    raw, n = out.tobytes(), _BYTES.itemsize
    return [raw[i:i + n] for i in range(0, len(raw), n)]


def unpacked_key(key: bytes) -> tuple[int, int, int, int]:
    """``(anchor, score, kind, id)``."""
    anchor, score, kind, other = _KEY.unpack(key)
    return anchor - _SIGN, (score ^ ((1 << 64) - 1)) - _SIGN, kind, other - _SIGN


def windows(keys: Iterator[bytes], positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> Iterator[tuple]:
    """``(anchor, positive, rank, negative, positive score, negative score)`` from sorted keys, in one pass.

    At any time only the open windows of one anchor are held, at most ``positives`` of them.
    """
    now, open_, seen = None, [], 0
    for key in keys:
        anchor, score, kind, other = unpacked_key(key)
        if anchor != now:
            now, open_, seen = anchor, [], 0
        if kind == POSITIVE:
            if seen < positives:
                seen += 1
                open_.append([other, score, 0])
            continue
        ended = False
        for w in open_:
            if w[2] < negatives and low * w[1] <= 100 * score <= high * w[1]:
                w[2] += 1
                yield now, w[0], w[2], other, w[1], score
            ended |= w[2] == negatives or 100 * score < low * w[1]
        if ended:
            open_ = [w for w in open_ if w[2] < negatives and 100 * score >= low * w[1]]


def _best(score: np.ndarray, good: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``n`` best of each row's ``good`` columns by (descending score, id); columns are in id order."""
    if not good.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = np.iinfo(np.int64).min
    masked = np.where(good, score, least)
    if masked.shape[1] > n:
        # Everything above the n-th score is in; of those equal to it the first ids are.
        edge = -np.partition(-masked, n - 1, axis=1)[:, n - 1:n]
        room = n - (masked > edge).sum(axis=1, keepdims=True)
        tied = (masked == edge) & good
        good = ((masked > edge) & good) | (tied & (np.cumsum(tied, axis=1) <= room))
    return np.nonzero(good)


class _Kept:
    """The best of each of ``n`` lists over many blocks: what a task knows so far, never more than ``most`` a list."""

    def __init__(self, n: int, most: int):
        self.most, self.n = most, n
        self.list, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, lists: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        a, s, i = np.r_[self.list, lists], np.r_[self.score, score], np.r_[self.id, ids]
        order = np.lexsort((i, -s, a))
        a, s, i = a[order], s[order], i[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        keep = place < self.most
        self.list, self.score, self.id = a[keep], s[keep], i[keep]


def _write_keys(path: str, vectors: DataFrame, anchors: list[dict], kind: int, most: int, low: int, high: int) -> None:
    """Add to the folder the keys of pairs of ``anchors`` (sent to the tasks) and all rows, without those that a task knows to lose.

    For positives each task keeps an anchor's best ``most`` rows of its label; for negatives the best ``most`` of every
    window. What is left out is behind ``most`` better rows of the same list, so the result is that of all pairs.
    """
    spark = vectors.sparkSession
    sent = spark.sparkContext.broadcast(anchors)

    def run(batches):
        parts = sent.value
        ends = [[np.array(x, np.int64) for x in zip(*p["windows"])] if kind == NEGATIVE else [] for p in parts]
        kept = [[_Kept(len(p["ids"]) // 8, most) for _ in range(len(e) if kind == NEGATIVE else 1)] for p, e in zip(parts, ends)]
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels, x = unpacked(row)
                order = np.argsort(ids, kind="stable")
                ids, labels, x = ids[order], labels[order], x[order]
                for p, e, k in zip(parts, ends, kept):
                    own, own_labels, own_x = unpacked(p)
                    score, same = products(own_x, x), own_labels[:, None] == labels[None, :]
                    if kind == POSITIVE:
                        i, j = _best(score, same & (own[:, None] != ids[None, :]), ids, most)
                        k[0].add(i, score[i, j], ids[j])
                        continue
                    for scores, one in zip(e, k):
                        inside = (100 * score >= low * scores[:, None]) & (100 * score <= high * scores[:, None]) & ~same
                        i, j = _best(score, inside, ids, most)
                        one.add(i, score[i, j], ids[j])
        for p, k in zip(parts, kept):
            own = np.frombuffer(p["ids"], np.int64)
            found = np.unique(np.concatenate([np.stack([own[one.list], one.score, one.id], axis=1) for one in k]), axis=0)
            yield made(_KEYS, pa.array(packed(*(np.ascontiguousarray(found[:, c]) for c in (0, 1)), kind, np.ascontiguousarray(found[:, 2])), pa.binary()))

    vectors.mapInArrow(run, "key binary").write.mode("append").parquet(path)
    sent.destroy()


def _sorted(keys: DataFrame):
    """The secondary sort: an RDD of keys dealt by anchor, in order within each partition."""
    n = max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = keys.rdd.map(lambda r: (bytes(r[0]), None))
    return pairs.repartitionAndSortWithinPartitions(n, lambda key: zlib.crc32(key[:8])).map(lambda kv: kv[0])


def _groups(rows: DataFrame, size: int) -> Iterator[list[dict]]:
    """Blocks of anchors, cut to ``ANCHORS`` rows, in lists of about ``size`` anchors; one list is on the driver at a time."""
    group, n = [], 0
    for r in rows.toLocalIterator():
        ids, labels, x = unpacked(r.asDict())
        for i in range(0, len(ids), ANCHORS):
            part = slice(i, i + ANCHORS)
            group.append({"size": r["size"], "ids": ids[part].tobytes(), "labels": labels[part].tobytes(), "x": x[part].tobytes()})
            n += len(ids[part])
            if n >= size:
                yield group
                group, n = [], 0
    if group:
        yield group


MINED = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def mine(vectors: DataFrame, anchor: Column, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", scale: int = SCALE,
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, sent: int = SENT) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of the rows where ``anchor`` is true.

    A score is the inner product of ``floor(scale * x)`` of both vectors. An anchor's positives are its first ``positives``
    other rows of the same label, higher scores first and ties by id; each positive has the first ``negatives`` rows of other
    labels with a score from ``low`` to ``high`` hundredths of its own. Rows with a null id, label, vector or component, or one that is not
    finite (or beyond 2 ** 27 in whole numbers), take no part. Of rows with one id, that with the least label and vector
    counts, so repeated rows count once. Vectors of unlike length are compared as if the shorter one ended in zeros. An
    anchor without positives or negatives, and an empty table, give no rows; other columns are ignored.

    All rows are compared with the anchors in groups of ``sent`` anchors. A task holds, per anchor of the group, the best
    ``positives`` rows and the best ``negatives`` of each window, so what it sends does not grow with the rows it reads.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(label_column).cast("bigint").alias("label"), whole(F.col(vector_column), scale).alias("x"),
                          F.coalesce(anchor, F.lit(False)).alias("chosen")).dropna()
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "x", "chosen")).alias("r")).select("id", "r.*")
    rows = stored(rows, "whole-vectors")
    packed_rows = stored(blocks(rows), "vector-blocks")
    chosen = stored(blocks(rows.filter("chosen")), "anchors")

    near, far = shared_folder(spark, "positive-keys"), shared_folder(spark, "negative-keys")
    none = True
    for group in _groups(chosen, sent):
        _write_keys(near, packed_rows, group, POSITIVE, positives, low, high)
        none = False
    if none:
        return spark.createDataFrame([], MINED)
    best = stored(_sorted(spark.read.schema("key binary").parquet(near)).mapPartitions(lambda it: _first(it, positives)).toDF("anchor bigint, score bigint, id bigint"), "positives")
    for group in _groups(chosen, sent):
        _write_keys(far, packed_rows, _with_windows(group, best), NEGATIVE, negatives, low, high)
    opened = best.mapInArrow(_positive_keys, "key binary").union(spark.read.schema("key binary").parquet(far))
    return _sorted(opened).mapPartitions(lambda it: windows(it, positives, negatives, low, high)).toDF(MINED)


def _first(keys: Iterator[bytes], positives: int) -> Iterator[tuple]:
    """The first ``positives`` keys of every anchor."""
    now, seen = None, 0
    for key in keys:
        anchor, score, _, other = unpacked_key(key)
        seen = seen + 1 if anchor == now else 1
        now = anchor
        if seen <= positives:
            yield anchor, score, other


def _positive_keys(batches):
    for batch in batches:
        yield made(_KEYS, pa.array(packed(*[batch.column(c).to_numpy() for c in ("anchor", "score")], POSITIVE, batch.column("id").to_numpy()), pa.binary()))


def _with_windows(group: list[dict], best: DataFrame) -> list[dict]:
    """The group with the scores of every anchor's positives, as many as any has; -1 (an empty window) where there are fewer."""
    spark, ids = best.sparkSession, np.concatenate([np.frombuffer(p["ids"], np.int64) for p in group])
    wanted = F.broadcast(spark.createDataFrame(pa.table({"anchor": ids})))  # at most ``sent`` ids and their few scores
    scores: dict[int, list[int]] = {}
    for a, s in best.join(wanted, "anchor").select("anchor", "score").collect():
        scores.setdefault(a, []).append(s)
    widest = max(map(len, scores.values()), default=1)
    of = lambda k: (scores.get(k, []) + [-1] * widest)[:widest]
    return [p | {"windows": [of(k) for k in np.frombuffer(p["ids"], np.int64).tolist()]} for p in group]


ORACLE = f"""
with kept as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor({SCALE} * x::double)) as q
  from embeddings
  where label is not null and embedding is not null and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
pairs as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_dot_product(a.q, b.q)::bigint as score
  from kept a join kept b on a.vec_id % {EVERY} = 0 and a.vec_id <> b.vec_id),
positives as (
  select anchor_id, other_id as positive_id, score as positive_score from pairs where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= {POSITIVES})
select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by n.score desc, n.other_id))::int as rank,
       n.other_id as negative_id, positive_score, n.score as negative_score
from positives p join pairs n using (anchor_id)
where not n.same and {LOW} * positive_score <= 100 * n.score and 100 * n.score <= {HIGH} * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by n.score desc, n.other_id) <= {NEGATIVES}
"""
