"""From raw documents to token ids: each stage works on all that the one before it kept.

A stage is ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns the rows it keeps with the columns of
``documents``, the last one the ids. Between stages the rows are written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vitrine.llm import decontaminate, near_copies, pieces, repeats, simhash, toxicity
from vitrine.llm.frames import documents, stored
from vitrine.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled rows that are not held out, does not call toxic."""
    return toxicity.without_toxic(docs, toxicity.train(docs, documents(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or more): that with the least id."""
    return simhash.least_of_class(docs, near_copies.classes(docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the words of passages that stand in an earlier one; lengths are those of the texts left."""
    return repeats.without_repeats(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.without_contaminated(docs, documents(spark, sf_dir, "benchmark"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document left, decoded again as a check."""
    return pieces.round_trip(docs, tokenizer_path("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("sentencepiece", to_pieces),
]

#: The classifier and the fingerprints have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{i}")
    return docs
