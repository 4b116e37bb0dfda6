"""Exact positions inside groups of any size, and joins of their rows to what is known of the group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut


#: Up to here the rows of ``groups`` in ``beside`` are few enough to go to every task.
FEW_GROUPS = 10_000
#: Beyond, the rows of a group are dealt over so many parts, each with its copy of the group's row.
PARTS = 32


def beside(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows.join(groups, keys, how)`` where ``groups`` has about one narrow row per group and a group any number of rows.

    ``groups`` is written first and counted. Few go to every task, so that ``rows`` stay where they are; many are repeated for
    each part of a group, and ``rows`` meet them by key and part, which the content of a row decides. Either way no group
    lands in one task, here or in an aggregate or window over the same keys that follows.
    """
    groups = groups if hasattr(groups, "_cut_path") else cut(groups)
    if groups.count() <= FEW_GROUPS:
        return rows.join(F.broadcast(groups), keys, how)
    plain = [f.name for f in rows.schema.fields if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]
    placed = rows.withColumn("_part", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.lit(PARTS)).cast("int"))
    each = groups.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return placed.join(each, [*keys, "_part"], how).drop("_part")


def positions(rows: DataFrame, keys: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """``row_number`` per group without ever holding a group in one task.

    Rows are range-partitioned by key and order, numbered inside their partition, and shifted by the number of rows of
    the same group in earlier partitions. The numbered rows are written first and counted from there, so a lost executor
    cannot move a row between the numbering and the counting. ``order`` must be total.
    """
    by_key = [F.col(k) for k in keys]
    placed = rows.repartitionByRange(*by_key, *order).withColumn("_part", F.spark_partition_id())
    local = cut(placed.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))))
    sizes = local.groupBy(*keys, "_part").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.withColumn("_shift", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    return local.join(shift, [*keys, "_part"]).withColumn(name, F.col("_local") + F.col("_shift")).drop("_part", "_local", "_shift")


#: Up to here Spark keeps the first rows of a group on the map side (spark.sql.optimizer.windowGroupLimitThreshold).
MAP_SIDE_RANKS = 1000


def first_n(rows: DataFrame, keys: list[str], order: list[Column], n: int | None, name: str = "position") -> DataFrame:
    """The first ``n`` rows of each group, all of them for ``None``.

    Up to ``MAP_SIDE_RANKS`` rows every map task passes on at most ``n`` rows per group; beyond, rows are numbered by range
    partitions, so no group is sorted in one task either way.
    """
    if n is None or n > MAP_SIDE_RANKS:
        placed = positions(rows, keys, order, name)
        return placed if n is None else placed.filter(F.col(name) <= n)
    ranked = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(name) <= n)


def previous(rows: DataFrame, keys: list[str], time: str, value: Column, name: str, bucket: str = "month") -> DataFrame:
    """The newest earlier non-NULL ``value`` of the same group, for groups of any size.

    Inside a time bucket it is a window; across buckets only one row per bucket travels (its last known value), so a hot
    group is spread over as many tasks as it has buckets.
    """
    filled = rows.withColumn("_value", value).withColumn("_bucket", F.date_trunc(bucket, time))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    held = filled.filter(F.col("_value").isNotNull())
    ends = held.groupBy(*keys, "_bucket").agg(F.max_by("_value", time).alias("_end"))
    all_buckets = filled.select(*keys, "_bucket").distinct().join(ends, [*keys, "_bucket"], "left")
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = all_buckets.withColumn("_carried", F.last("_end", ignorenulls=True).over(earlier)).drop("_end")
    local = filled.withColumn("_local", F.last("_value", ignorenulls=True).over(inside))
    return local.join(carried, [*keys, "_bucket"]).withColumn(name, F.coalesce("_local", "_carried")).drop("_value", "_bucket", "_local", "_carried")
