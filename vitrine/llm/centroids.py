"""Centroid clustering with an incremental distance matrix (operator 13).

Every vector keeps its exact inner products with all centroids. When centroids move, only the components that changed are
multiplied: the products move by the change, and the nearest centroid is read off again. All numbers are whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .frames import made
from .vectors import blocks, whole

COMPONENTS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1

#: A block of vectors with their products, clusters and distances, and what the block adds to each cluster.
STATE = "size int, ids binary, x binary, dots binary, cluster binary, distance binary, sums array<struct<c:int,n:bigint,inertia:bigint,sum:array<bigint>>>"
_STATE = pa.schema([("size", pa.int32()), ("ids", pa.binary()), ("x", pa.binary()), ("dots", pa.binary()), ("cluster", pa.binary()), ("distance", pa.binary()),
                    ("sums", pa.list_(pa.struct([("c", pa.int32()), ("n", pa.int64()), ("inertia", pa.int64()), ("sum", pa.list_(pa.int64()))])))])


def _moved(rows: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """The state after the centroids went from ``old`` to ``new``: products moved by the nonzero changes, nearest centroids anew.

    The centroids are a few thousand numbers and travel with the tasks. A row without products has those with zeros.
    """
    change, square = new - old, (new * new).sum(axis=1)
    columns = [(c, np.flatnonzero(d)) for c, d in enumerate(change) if d.any()]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                size = row["size"]
                x = np.frombuffer(row["x"], np.int64).reshape(-1, size)
                n = len(x)
                dots = np.frombuffer(row["dots"], np.int64).reshape(n, len(new)).copy() if row.get("dots") is not None else np.zeros((n, len(new)), np.int64)
                for c, at in columns:
                    dots[:, c] += x[:, at] @ change[c, at]
                away = (x * x).sum(axis=1)[:, None] - 2 * dots + square[None, :]
                cluster = away.argmin(axis=1)  # the first of equal ones
                near = away[np.arange(n), cluster]
                sums = [{"c": int(c), "n": int(of.sum()), "inertia": int(near[of].sum()), "sum": x[of].sum(axis=0).tolist()} for c in np.unique(cluster) for of in [cluster == c]]
                yield made(_STATE, [size], [row["ids"]], [row["x"]], [dots.tobytes()], [cluster.astype(np.int32).tobytes()], [near.tobytes()], [sums])

    return rows.mapInArrow(run, STATE)


def _totals(state: DataFrame, size: int) -> dict[int, tuple]:
    """Per non-empty cluster its rows, inertia and component sums: one row a cluster comes to the driver."""
    each = state.select(F.explode("sums").alias("s")).select("s.*")
    sums = [F.sum(F.col("sum")[j]).alias(f"s{j}") for j in range(size)]
    found = each.groupBy("c").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), *sums).collect()
    return {r["c"]: (r["n"], r["inertia"], np.array([r[f"s{j}"] for j in range(size)], np.int64)) for r in found}


def _first(rows: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the least hash of ``seed:id``, in the order of the hashes; ties by the vector."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    found = rows.select(rank.alias("rank"), "x").orderBy("rank", "x").limit(clusters).collect()
    return np.array([r["x"] for r in found]).astype(np.int64)


CLUSTERED = "vec_id bigint, cluster int, distance bigint"


def clustered(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE,
              clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every kept row.

    Kept are vectors of exactly ``components`` components, none null or not finite (or beyond 2 ** 27 in whole numbers), as
    ``floor(scale * x)``. A null id is no start and stays null. Repeated rows each count and come back each. With fewer rows
    than ``clusters`` there are as many centroids as rows; an empty table gives no rows; other columns are ignored.

    Each round is one pass over the written state, which replaces the round before; a cluster's sums are made in the tasks and
    added up by Spark, so no cluster is gathered anywhere.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("label"), F.when(F.size(vector_column) == components, whole(F.col(vector_column), scale)).alias("x"))
    rows = rows.filter("x is not null")
    now = _first(rows.filter("id is not null"), clusters, seed)
    if not len(now):
        return spark.createDataFrame([], CLUSTERED + ", cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    state = cut(_moved(blocks(rows), np.zeros_like(now), now))
    for _ in range(rounds):
        new = now.copy()
        for c, (n, _, total) in _totals(state, components).items():
            new[c] = total // n  # rounds down, below zero as well
        state = cut(_moved(state, now, new), replaces=state)
        now = new
    inertia = {c: r[1] for c, r in _totals(state, components).items()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now.tolist()]
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def out(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, cluster, distance = (None if row[c] is None else pa.array(np.frombuffer(row[c], t)) for c, t in (("ids", np.int64), ("cluster", np.int32), ("distance", np.int64)))
                yield made(schema, pa.nulls(len(cluster), pa.int64()) if ids is None else ids, cluster, distance)

    found = state.select("ids", "cluster", "distance").mapInArrow(out, CLUSTERED)
    per_cluster = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    return found.select("vec_id", "cluster", "distance", per_cluster([inertia.get(c, 0) for c in range(len(now))]).cast("bigint").alias("cluster_inertia"),
                        F.lit(sum(inertia.values())).cast("bigint").alias("inertia"), per_cluster(digests).alias("centroid_sha256"))


def oracle(rounds: int = ROUNDS) -> str:
    """The same rows in DuckDB SQL."""
    away = "list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint"
    parts = [f"""kept as (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as q
  from embeddings where len(embedding) = {COMPONENTS} and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
c0 as (
  select row_number() over (order by h, q) - 1 as c, q
  from (select sha256('{SEED}:' || vec_id) as h, q from kept where vec_id is not null order by h, q limit {CLUSTERS}))"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} as (
  select row, any_value(vec_id) as vec_id, any_value(q) as q, min(d) as d, arg_min(c, (d, c)) as c
  from (select v.row, v.vec_id, v.q, c.c, {away} as d from kept v cross join c{i} c) group by row)""")
        if i < rounds:
            parts.append(f"""m{i} as (
  select c, list((s - ((s % n) + n) % n) // n order by j) as q
  from (select c, j, sum(q[j])::bigint as s, count(*) as n from a{i}, range(1, {COMPONENTS + 1}) t(j) group by c, j) group by c),
c{i + 1} as (select c.c, coalesce(m.q, c.q) as q from c{i} c left join m{i} m using (c))""")
    return "with " + ",\n".join(parts) + f"""
select vec_id, a.c::int as cluster, d as distance, (sum(d) over (partition by a.c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,
       sha256(array_to_string(c.q, ',')) as centroid_sha256
from a{rounds} a join c{rounds} c on a.c = c.c
"""
