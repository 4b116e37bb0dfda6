"""Shared helpers: safe column selection, text slices of Arrow batches, the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import checkpoint_dir

#: Bytes of text that a Python worker holds as words at a time; a longer single text is a slice of its own.
SLICE_BYTES = 4 << 20


def keyed(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Only ``(k, t)``: the id and the text. Other columns, whatever their names, are never read."""
    return df.select(F.col(id_column).cast("bigint").alias("k"), F.col(text_column).cast("string").alias("t"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "t", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice holds about ``limit`` bytes of ``column``: memory stays bounded for long texts."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < n:
            base = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, base + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def texts(batch: pa.RecordBatch, column: str = "t") -> list[str]:
    """The texts of a slice; null is empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def made(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below the checkpoint folder that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/vitrine-{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: lineage ends there, and the size is known to the planner."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, folder: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")
