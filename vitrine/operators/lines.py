"""Lines shared by the pages of a site, and page bodies without them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fixed
from ..functions.copy import opening, openings
from ..functions.scalars import has_words
from ..session import cut
from .ranking import beside


def _nonblank(lines: Column) -> Column:
    """Lines with anything but white space, found at their first other character."""
    return F.filter(lines, lambda x: x.rlike(r"(?U)\S"))


def line_marks(pages: DataFrame, keys: list[str], with_openings: bool = False) -> DataFrame:
    """One narrow row per page, written once: 8-byte hashes of its distinct lines, and if asked for of its lines' openings with their lines.

    The texts are read for this once; everything that pages of a site share is counted from these rows.
    """
    pairs = F.transform(F.filter("lines", lambda x: has_words(x, 2)), lambda x: F.struct(F.xxhash64(x).alias("line"), opening(x).alias("opening")))
    hashed = F.transform(F.filter(pairs, lambda p: p["opening"] != ""), lambda p: F.struct(p["line"].alias("line"), F.xxhash64(p["opening"]).alias("opening")))
    lines = F.array_distinct(F.transform(_nonblank(F.col("lines")), lambda x: F.xxhash64(x))).alias("_lines")
    return cut(pages.select(*keys, lines, *([F.array_distinct(hashed).alias("_pairs")] if with_openings else [])))


def _frequent(marks: DataFrame, keys: list[str], hashes: Column, floor: Callable[[Column], Column], at_least: int, name: str) -> DataFrame:
    """``(keys, name)``: per group the hashes on at least ``floor(pages of the group)`` pages.

    Counts are partial aggregates of narrow rows; no group is gathered but its passing hashes, at most (hashes a page) / share.
    """
    totals = marks.groupBy(*keys).agg(F.count("*").alias("_total"))
    counted = marks.select(*keys, F.explode(hashes).alias("_hash")).groupBy(*keys, "_hash").agg(F.count("*").alias("_n")).filter(F.col("_n") >= at_least)
    return beside(counted, totals, keys).filter(F.col("_n") >= floor(F.col("_total"))).groupBy(*keys).agg(F.collect_set("_hash").alias(name))


def _chrome_floor(share: float, min_pages: int) -> Callable[[Column], Column]:
    return lambda total: F.when(total >= min_pages, total * F.lit(share))


def _none() -> Column:
    return F.array().cast("array<bigint>")


def _with(rows: DataFrame, keys: list[str], per_group: DataFrame, *names: str) -> DataFrame:
    """Rows with the arrays of their group, empty where it has none; the pages of a group stay spread out."""
    joined = beside(rows, per_group, keys, "left")
    return joined.withColumns({n: F.coalesce(n, _none()) for n in names})


def _shared_lines(marks: DataFrame, keys: list[str], share: float, min_pages: int) -> DataFrame:
    return _frequent(marks, keys, F.col("_lines"), _chrome_floor(share, min_pages), 1, "_chrome")


def _shared_openings(marks: DataFrame, keys: list[str], chrome: DataFrame, share: float, min_pages: int) -> DataFrame:
    """Openings of the lines that are left after the shared lines are gone."""
    left = _with(marks, keys, chrome, "_chrome")
    own = F.array_distinct(F.transform(F.filter("_pairs", lambda p: ~F.array_contains("_chrome", p["line"])), lambda p: p["opening"]))
    floor = lambda total: F.greatest(F.lit(float(min_pages)), total * F.lit(share))
    return _frequent(left, keys, own, floor, min_pages, "_openings")


def _text_counts(pages: DataFrame, keys: list[str], items: Column, name: str) -> DataFrame:
    return pages.select(*keys, F.explode(items).alias(name)).groupBy(*keys, name).agg(F.count("*").alias("pages"))


def chrome_lines(pages: DataFrame, keys: list[str], share: float = fixed.CHROME_SHARE,
                 min_pages: int = fixed.CHROME_MIN_PAGES) -> DataFrame:
    """Lines on at least ``share`` of a site's pages: navigation, footer, banners. None under ``min_pages`` pages.

    Hashes decide which lines travel as text; their texts are then counted, so a hash collision changes no count.
    """
    marks = line_marks(pages, keys)
    joined = _with(pages, keys, _shared_lines(marks, keys, share, min_pages).join(marks.groupBy(*keys).agg(F.count("*").alias("_total")), keys), "_chrome")
    passing = F.filter(F.array_distinct(_nonblank(F.col("lines"))), lambda x: F.array_contains("_chrome", F.xxhash64(x)))
    counted = joined.select(*keys, "_total", F.explode(passing).alias("line")).groupBy(*keys, "line").agg(F.count("*").alias("pages"), F.first("_total").alias("_total"))
    return counted.filter(F.col("pages") >= _chrome_floor(share, min_pages)(F.col("_total"))).drop("_total")


def _bodies(joined: DataFrame) -> DataFrame:
    kept = joined.withColumn("body_lines", F.filter("lines", lambda x: ~F.array_contains("_chrome", F.xxhash64(x)))).drop("_chrome")
    return kept.withColumn("body", F.array_join("body_lines", "\n")).withColumn(
        "chrome_lines_removed", (F.size("lines") - F.size("body_lines")).cast("bigint"))


def page_bodies(pages: DataFrame, keys: list[str], share: float = fixed.CHROME_SHARE,
                min_pages: int = fixed.CHROME_MIN_PAGES) -> DataFrame:
    """Adds ``body_lines``, ``body`` and ``chrome_lines_removed`` to pages that have a ``lines`` array. Reads the texts twice."""
    return _bodies(_with(pages, keys, _shared_lines(line_marks(pages, keys), keys, share, min_pages), "_chrome"))


def bodies_and_openings(pages: DataFrame, keys: list[str], chrome_share: float = fixed.CHROME_SHARE, opening_share: float = fixed.SKELETON_SHARE,
                        min_pages: int = fixed.CHROME_MIN_PAGES) -> DataFrame:
    """``page_bodies`` and ``common_openings``, the hashes of the site's template openings, from two reads of the texts and one join."""
    marks = line_marks(pages, keys, with_openings=True)
    chrome = cut(_shared_lines(marks, keys, chrome_share, min_pages))
    openings = _shared_openings(marks, keys, chrome, opening_share, min_pages)
    shared = chrome.join(openings, keys, "full_outer")
    return _bodies(_with(pages, keys, shared, "_chrome", "_openings")).withColumnRenamed("_openings", "common_openings")


def skeleton_openings(pages: DataFrame, keys: list[str], chrome_share: float = fixed.CHROME_SHARE, share: float = fixed.SKELETON_SHARE,
                      min_pages: int = fixed.CHROME_MIN_PAGES) -> DataFrame:
    """Three-word line openings used on a fifth of the pages or more, shared lines left out."""
    joined = bodies_and_openings(pages, keys, chrome_share, share, min_pages)
    return _text_counts(joined, keys, F.filter(openings(F.col("body_lines")), lambda o: F.array_contains("common_openings", F.xxhash64(o))), "opening")


def capped(items: DataFrame, keys: list[str], item: str, limit: int) -> DataFrame:
    """The first ``limit`` items of each group in order; the rank limit is applied before the shuffle."""
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy(item)
    return items.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)
