"""Benchmark decontamination as a prefix-filtered set join (operator 3); DataFrame expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .frames import stored

WINDOW, SHINGLE = 10, 3
#: Rows of benchmark shingles or windows that are broadcast at a time; a larger benchmark is joined in so many blocks.
BLOCK_ROWS = 250_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of digits, letters and everything beyond ASCII, as written."""
    return F.array_remove(F.split(text, _BETWEEN), "")


def _exact(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _shingle(size: Column | int, *w: Column) -> Column:
    """A hash of the first ``size`` words. Words are lower-cased in full here, which finds more; the exact check follows."""
    return F.xxhash64(*[F.when(F.lit(i) < size, F.lower(x)) for i, x in enumerate(w)])


def item_windows(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """``(item_id, n, window)`` of every item: all its runs of ``window`` words, or all its words where it has fewer."""
    items = benchmark.select(F.col(id_column).alias("item_id"), words(_exact(F.col(text_column).cast("string"))).alias("w")).filter(F.size("w") > 0)
    n = F.least(F.lit(window), F.size("w"))
    placed = items.select("item_id", "w", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("p"))
    return placed.select("item_id", "n", F.array_join(F.slice("w", F.col("p"), F.col("n")), " ").alias("window"))


def _places(given: DataFrame, sizes: list[int]) -> DataFrame:
    """``(k, h, w, i, token)``: every shingle of ``sizes`` words at every place of every document."""
    at = given.select("k", "h", words(F.col("t")).alias("w")).select("k", "h", "w", F.posexplode("w").alias("i", "w0"))
    following = [F.col("w0"), *[F.get("w", F.col("i") + j) for j in range(1, SHINGLE)]]
    # A shingle that would leave the document lacks words and so can't equal one of the benchmark; the bounds drop it later.
    each = [_shingle(s, *following) for s in sizes]
    if len(each) == 1:
        return at.select("k", "h", "w", "i", each[0].alias("token"))
    return at.select("k", "h", "w", "i", F.explode(F.array(*each)).alias("token"))


def _in_blocks(rows: DataFrame, key: str, join) -> DataFrame:
    """``join(block)`` for each broadcast block of stored ``rows``, united; a block has a bounded number of rows."""
    n = -(-rows.count() // BLOCK_ROWS) or 1
    blocks = [rows] if n == 1 else [rows.filter(F.pmod(F.xxhash64(F.lit("block"), key), F.lit(n)) == i) for i in range(n)]
    return reduce(DataFrame.unionByName, [join(F.broadcast(b)) for b in blocks])


def occurrences(given: DataFrame, windows: DataFrame) -> DataFrame:
    """``(k, h, start, n, wid)``: every place of every window ``(wid, n, window)`` in the documents ``(k, h, t)``.

    A window is the set of its shingles, each with its place. To hold all of them a document must hold any one, so the
    prefix that must be joined is one shingle: the rarest over all documents. Windows whose rarest shingle occurs nowhere
    are gone before the join. Where the shingle is found, the window has to fit in the document at that offset, and then its
    words have to be equal.
    """
    w = F.split("window", " ")
    s = F.least(F.lit(SHINGLE), F.col("n"))
    parts = windows.select("wid", "n", "window", w.alias("w"), s.alias("s")).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("s"))).alias("o"))
    shingles = stored(parts.select("wid", "n", "window", "o", "s", _shingle(F.col("s"), *[F.get("w", F.col("o") + j) for j in range(SHINGLE)]).alias("token")), "shingles")
    sizes = [r["s"] for r in shingles.select("s").distinct().orderBy("s").collect()]  # at most SHINGLE rows
    if not sizes:
        return given.select("k", "h", F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("wid")).limit(0)
    places = _places(given, sizes)
    tokens = stored(shingles.select("token").distinct(), "tokens")
    frequency = _in_blocks(tokens, "token", lambda b: places.select("token").join(b, "token").groupBy("token").agg(F.count("*").alias("freq")))
    rare = Window.partitionBy("wid").orderBy("freq", "token", "o")
    found = shingles.join(frequency, "token", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    prefix = found.withColumn("rank", F.row_number().over(rare)).filter("rank = 1 and freq > 0")
    prefix = stored(prefix.select("wid", "n", "window", "o", "token"), "prefix")

    def join(block: DataFrame) -> DataFrame:
        start = F.col("i") - F.col("o")
        near = places.join(block, "token").filter((start >= 0) & (start + F.col("n") <= F.size("w")))
        return near.filter(_exact(F.array_join(F.slice("w", start + 1, F.col("n")), " ")) == F.col("window")).select("k", "h", start.alias("start"), "n", "wid")

    return _in_blocks(prefix, "wid", join)


def _given(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(k, h, t)``: id, text hash and text."""
    text = F.col(text_column).cast("string")
    return docs.select(F.col(id_column).cast("bigint").alias("k"), F.xxhash64(text).alias("h"), text.alias("t"))


def _numbered(of_item: DataFrame) -> DataFrame:
    """``(wid, n, window)``: distinct windows, numbered once and for all by being stored."""
    return stored(of_item.select("n", "window").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
                  item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` of every row of ``docs``.

    Null and empty texts have no words and no hits; items without words never occur; equal windows of several items count for
    each; repeated rows are judged each, a null id like any other; an item with a null id counts as none in ``n_items`` but
    its words are hit; an empty benchmark hits nothing; other columns are ignored.
    """
    given = _given(docs, id_column, text_column)
    of_item = item_windows(benchmark, item_column, item_text, window)
    numbered = _numbered(of_item)
    holders = stored(of_item.join(numbered, ["n", "window"]).select("wid", F.col("item_id").cast("string").alias("item")).dropna().distinct(), "holders")
    # Repeated rows find the same places; a row's id and text stand for all of them.
    hits = stored(occurrences(given, numbered).distinct(), "hits")
    by_start = Window.partitionBy("k", "h").orderBy("start")
    longest = hits.groupBy("k", "h", "start").agg(F.max("n").alias("n"))
    reach = F.coalesce(F.max(F.col("start") + F.col("n")).over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = longest.select("k", "h", F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest("start", reach)).alias("new"))
    n_hit = covered.groupBy("k", "h").agg(F.sum("new").alias("n_hit"))
    items = hits.select("k", "h", "wid").distinct().join(holders, "wid").groupBy("k", "h").agg(F.sort_array(F.collect_set("item")).alias("items"))
    # Present on both sides, so that ids that are null find their hits.
    key = [F.coalesce(F.col("k").cast("string"), F.lit("null")).alias("key"), "h"]
    per_text = n_hit.select(*key, "n_hit").join(items.select(*key, "items"), ["key", "h"], "left")
    counted = given.select("k", *key, F.coalesce(F.size(words(F.col("t"))), F.lit(0)).cast("bigint").alias("n_words")).withColumn("n_words", F.greatest("n_words", F.lit(0)))
    joined = counted.join(per_text, ["key", "h"], "left")
    return joined.select(
        F.col("k").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.greatest(F.coalesce(F.size("items"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
                         item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window of an item occurs."""
    hits = occurrences(_given(docs, id_column, text_column), _numbered(item_windows(benchmark, item_column, item_text, window)))
    bad = stored(hits.select(F.coalesce(F.col("k").cast("string"), F.lit("null")).alias("_key"), F.col("h").alias("_hash")).distinct(), "contaminated")
    id_text = F.coalesce(F.col(id_column).cast("bigint").cast("string"), F.lit("null"))
    return docs.join(bad, (id_text == F.col("_key")) & (F.xxhash64(F.col(text_column).cast("string")) == F.col("_hash")), "left_anti")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bp AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS t FROM bp),
lens AS (SELECT DISTINCT n FROM bw),
dp AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n),
dw AS (SELECT rid, n, p, array_to_string(w[p:p + n - 1], ' ') AS t FROM dp),
h AS (SELECT rid, n, p, item_id FROM dw JOIN bw USING (n, t)),
cov AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM h) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT rid, item_id::VARCHAR AS i FROM h) GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN it USING (rid)
"""
