"""The registered queries of the pipeline operators and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import centroids, decontaminate, html_text, languages, licenses, negatives, pieces, quality, repeats, simhash, token_counts, token_store, toxicity
from .frames import documents

RUN: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    """The public vocabulary files are installed with the Python of every worker."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(documents(spark, folder, "pages"))


def op2_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.dedup(documents(spark, folder), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.decontaminate(documents(spark, folder), documents(spark, folder, "benchmark"))


def op4_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trip(documents(spark, folder), tokenizer_path("piece_bpe_32k.model"))


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, folder))


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, folder), tokenizer_path("byte_bpe_50k.json"))


def op7_token_store(spark: SparkSession, folder: str) -> DataFrame:
    return token_store.packed_digests(documents(spark, folder), tokenizer_path("word_bpe_49k.json"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, folder), documents(spark, folder, "labels"))


def op9_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(documents(spark, folder))


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(documents(spark, folder), documents(spark, folder, "labels")).drop("n_lines")


def op11_languages(spark: SparkSession, folder: str) -> DataFrame:
    return languages.identified(documents(spark, folder))


def op12_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = documents(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", label), F.col("vec_id") % negatives.EVERY == 0)


def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.clustered(documents(spark, folder, "embeddings"))


for _query in (op1_html_text, op2_repeats, op3_decontaminate, op4_sentencepiece, op5_simhash, op6_token_counts, op7_token_store, op8_toxicity, op9_licenses, op10_quality,
               op11_languages, op12_negatives, op13_centroids):
    RUN[_query.__name__] = _query

SQL["op1_html_text"] = html_text.ORACLE
SQL["op2_repeats"] = repeats.ORACLE
SQL["op3_decontaminate"] = decontaminate.ORACLE
SQL["op9_licenses"] = licenses.oracle()
SQL["op12_negatives"] = negatives.ORACLE
SQL["op13_centroids"] = centroids.oracle()
