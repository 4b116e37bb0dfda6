"""Connected components by alternating stars, one written round after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` of every node in ``edges``: ``root`` is the least node that can be reached.

    Each round joins rows to the least neighbour of their node, which is a partial aggregate, so a node with very many
    neighbours is no group of one task. A round is written to the shared folder before the next and the one before it deleted; rounds end when nothing
    changes and grow with the logarithm of the longest path. Loops count as a node alone; no edges give no rows.
    """
    now = cut(edges.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).dropna().filter("a <> b").distinct())
    mark = None
    while True:
        now = cut(_small_star(_large_star(now)), replaces=now)
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sums) == mark:
            break
        mark = tuple(sums)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
