"""Captured responses, prospects, prompts and bundles: how they are read, written and checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.scalars import strip
from ..operators.ranking import beside, positions

RESPONSES = T.StructType([
    T.StructField("site", T.StringType()), T.StructField("run_id", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("final_url", T.StringType()), T.StructField("status", T.IntegerType()),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())), T.StructField("body", T.StringType()),
    T.StructField("redirects", T.ArrayType(T.StructType([T.StructField("from", T.StringType()), T.StructField("to", T.StringType()), T.StructField("status", T.IntegerType())]))),
    T.StructField("error", T.StringType()), T.StructField("retrieved_at", T.TimestampType()), T.StructField("truncated", T.BooleanType())])


def read_responses(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Captured responses with a declared schema: no inference pass, and only the columns asked for are read."""
    return spark.read.schema(RESPONSES).format(form).load(path)


def response_metadata(responses: DataFrame) -> DataFrame:
    return responses.drop("body")


def read_prospects(spark: SparkSession, path: str, domain_column: str = "domain") -> DataFrame:
    """Prospect rows of a CSV with their row number in the file; a byte order mark is tolerated."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    rows = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])
    if domain_column not in rows.columns:
        raise ValueError(f"CSV has no column {domain_column!r}")
    # The id grows along the file; it is only an order, never a key.
    return prospects(positions(rows.withColumn("_at", F.monotonically_increasing_id()), [], [F.col("_at")], "row_no").drop("_at"), domain_column)


def prospects(rows: DataFrame, domain_column: str = "domain") -> DataFrame:
    """Marks rows without a domain as errors; the others go on."""
    domain = strip(F.coalesce(domain_column, F.lit("")))
    return rows.withColumn("domain", F.nullif(domain, F.lit(""))).withColumn("status", F.when(domain == "", "ERROR").otherwise("PENDING"))


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    rows = prompt_lines(spark.read.text(path))
    if rows.isEmpty():
        raise ValueError("no prompts in the file")
    return rows


def prompt_lines(rows: DataFrame) -> DataFrame:
    """One question per line; blank lines and ``#`` comments are dropped."""
    text = strip(F.col("value"))
    return rows.withColumn("value", text).filter((F.col("value") != "") & ~F.col("value").startswith("#"))


def read_bundle_json(spark: SparkSession, expected: DataFrame, folder: str, schema: T.StructType) -> DataFrame:
    """JSON files of a folder joined to the ones expected: ``state`` is ok, unreadable or not collected, never an error.

    ``expected``: file name.
    """
    tolerant = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    read = spark.read.schema(tolerant).option("multiLine", True).option("mode", "PERMISSIVE").json(folder)
    data = read.select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), F.struct(*[f.name for f in schema.fields]).alias("data"), "_corrupt_record")
    state = F.when(F.col("data").isNull(), "not collected").when(F.col("_corrupt_record").isNotNull(), "unreadable").otherwise("ok")
    return expected.join(data, "file", "left").select("file", state.alias("state"), F.when(state == "ok", F.col("data")).alias("data"))


def by_run(rows: DataFrame, keys: list[str], rows_per_file: int = 1_000_000):
    """A Parquet writer with one folder per run: rows of a run meet first, in pieces that Spark evens out, and files stay small
    enough to be hashed whole."""
    return rows.hint("rebalance", *keys).write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file).partitionBy(*keys)


def write_bundle(tables: dict[str, DataFrame], folder: str, keys: tuple[str, ...] = ("site", "run_id")) -> DataFrame:
    """Each table as Parquet partitioned by its keys; refuses a folder that has data. Returns the manifest rows."""
    spark = next(iter(tables.values())).sparkSession
    for name, rows in tables.items():
        by_run(rows, list(keys)).parquet(f"{folder}/{name}")
    manifest = artifacts(stored_files(spark, [f"{folder}/{name}" for name in tables]), folder)
    manifest.write.mode("errorifexists").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def stored_files(spark: SparkSession, folders: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folders).select("path", "length", "content")


def artifacts(files: DataFrame, folder: str) -> DataFrame:
    """Manifest rows: path inside the bundle, bytes and SHA-256."""
    inside = F.regexp_extract("path", rf"\Q{folder.rstrip('/')}\E/(.*)$", 1)
    return files.select(inside.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Problems of a bundle: files that are missing (or lead out of it) and files that changed. ``files``: path, content."""
    now = files.select("path", F.sha2("content", 256).alias("_now"))
    escapes = F.col("path").rlike(r"(^|/)\.\.(/|$)") | F.col("path").startswith("/")
    problem = F.when(escapes | F.col("_now").isNull(), "missing").when(F.col("_now") != F.col("sha256"), "modified")
    return manifest.join(now, "path", "left").withColumn("problem", problem).filter(F.col("problem").isNotNull()).select("path", "problem")


def content_names(pages: DataFrame, keys: list[str]) -> DataFrame:
    """File name of each page's text: its class, and for a repeated class the class with the page's number."""
    firsts = pages.groupBy(*keys, "label").agg(F.min("page_no").alias("_first"))
    named = pages.join(firsts, [*keys, "label"])
    return named.withColumn("file", F.when(F.col("page_no") == F.col("_first"), F.col("label")).otherwise(F.concat_ws("-", "label", F.format_string("%04d", "page_no")))).drop("_first")


def write_content(pages: DataFrame, folder: str, keys: list[str]) -> None:
    """Readable text per page as Parquet: a folder per run, the file name a page would have as the column ``file``."""
    text = F.concat(F.lit("# "), F.coalesce(F.nullif("title", F.lit("")), "url"), F.lit("\n\nSource: "), "url", F.lit("\n\n"), "visible_text", F.lit("\n"))
    by_run(content_names(pages, keys).select(*keys, "file", text.alias("value")), keys).parquet(folder)


def redirect_report(responses: DataFrame, keys: list[str]) -> DataFrame:
    hops = F.size("redirects")
    return responses.filter(hops > 0).select(*keys, "url", "final_url", hops.cast("bigint").alias("hops"), "error", ((hops > 1) | F.col("error").isNotNull()).alias("long"))


def header_report(responses: DataFrame, keys: list[str]) -> DataFrame:
    return responses.select(*keys, "url", "status", "headers")


def llms_txt_report(sites: DataFrame, responses: DataFrame, keys: list[str]) -> DataFrame:
    """``/llms.txt`` of every site: UNKNOWN unless robots allows it. ``sites``: keys, origin, allowed."""
    body = responses.select(F.col("url").alias("_url"), F.col("status").alias("_status"), F.col("body").alias("_body"))
    joined = sites.withColumn("_url", F.concat("origin", F.lit("/llms.txt"))).join(body, "_url", "left")
    ok = F.col("allowed").eqNullSafe(True) & F.col("_status").isNotNull()
    return joined.select(*keys, F.when(ok, F.col("_status").cast("string")).otherwise("UNKNOWN").alias("status"), F.when(ok & (F.col("_status") == 200), F.col("_body")).alias("text"))


def skip_reasons(skipped: DataFrame, keys: list[str]) -> DataFrame:
    return skipped.groupBy(*keys, "reason").agg(F.count("*").alias("urls"))


# ---- digest ------------------------------------------------------------------------------------------------------
def trimmed(text: Column, limit: Column) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.left(text, limit), F.lit("\n[trimmed: "), F.length(text) - limit, F.lit(" more characters]")))


def corpus_digest(reports: DataFrame, pages: DataFrame, keys: list[str], budget: int = 600_000, report_max: int = 40_000, head_max: int = 4_000) -> DataFrame:
    """A run's evidence as ordered parts within a budget of characters: at most 40% reports, 20% page heads, page text the
    rest, where short pages leave their slack to longer ones. The allowances are sums per run joined back to the parts;
    no run's text is ever gathered. ``reports``: keys, pos, text. ``pages``: keys, page_no, head, body.
    """
    shares = reports.groupBy(*keys).agg(F.count("*").alias("_files"))
    told = beside(reports, shares, keys).withColumn("text", trimmed(F.col("text"), F.least(F.lit(report_max), F.floor(F.lit(budget * 0.4) / (F.col("_files") + 1)).cast("int"))))
    counts = pages.groupBy(*keys).agg(F.count("*").alias("_pages"))
    headed = beside(pages, counts, keys).withColumn("head", trimmed(F.col("head"), F.least(F.lit(head_max), F.floor(F.lit(budget * 0.2) / F.col("_pages")).cast("int"))))
    spent = told.groupBy(*keys).agg(F.sum(F.length("text")).alias("_told"))
    used = headed.groupBy(*keys).agg(F.sum(F.length("head")).alias("_heads"), F.first("_pages").alias("_pages")).join(spent, keys, "left")
    left = F.lit(budget) - F.coalesce("_told", F.lit(0)) - F.col("_heads")
    even = used.select(*keys, left.alias("_left"), F.greatest(F.lit(200), F.floor(left / F.col("_pages"))).cast("bigint").alias("_even"))
    sized = beside(headed, even, keys)
    fits = F.length("body") <= F.col("_even")
    slack = sized.groupBy(*keys).agg(F.first("_left").alias("_left"), F.first("_even").alias("_even"), F.sum(F.when(fits, F.length("body")).otherwise(0)).alias("_short"), F.count_if(~fits).alias("_long"))
    each = slack.select(*keys, F.greatest("_even", F.coalesce(F.floor(F.try_divide(F.col("_left") - F.col("_short"), F.col("_long"))), "_even")).cast("int").alias("_each"))
    bodies = beside(headed, each, keys).select(*keys, F.lit("page").alias("part"), F.col("page_no").alias("pos"), F.concat("head", F.lit("\n"), trimmed(F.col("body"), F.col("_each"))).alias("text"))
    return told.select(*keys, F.lit("report").alias("part"), "pos", "text").unionByName(bodies)


