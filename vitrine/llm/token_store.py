"""Token ids in fixed-width bit packing (operator 7)."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .frames import keyed, made, shared_folder, slices, texts
from .memo import bare_words, library

#: Ids after which a block is closed; a document is never divided between blocks.
BLOCK_IDS = 1 << 18


def width(vocab_size: int) -> int:
    """The bits that hold every id below ``vocab_size``."""
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after another, ``bits`` each, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, first: int, n: int) -> np.ndarray:
    """Ids ``first`` to ``first + n`` of a block, without reading the others."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", n, first * bits // 8).astype("<u4")
    at = (first + np.arange(n, dtype=np.int64)) * bits
    raw = np.frombuffer(payload + bytes(8), np.uint8)
    value = np.zeros(n, np.uint64)
    for i in range((bits + 14) // 8):  # a value of up to 32 bits touches at most this many bytes
        value |= raw[(at >> 3) + i].astype(np.uint64) << np.uint64(8 * i)
    return ((value >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype("<u4")


BLOCKS = "part int, block int, bits int, first bigint, n_ids bigint, doc_ids array<bigint>, doc_starts array<bigint>, payload binary"
_BLOCKS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("bits", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()),
                     ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())), ("payload", pa.binary())])


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text",
              block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of every document, in ascending id order, as a folder of packed blocks.

    A row of the folder is a block: ``part`` and ``block`` give its place, ``first`` the ids of the part before it,
    ``doc_ids`` and ``doc_starts`` the documents and where each starts in the block, ``payload`` the ids of ``bits`` bits
    each, the least that holds the vocabulary. Documents are dealt to tasks by ranges of the id, so a part is as large as its
    share of the input. Null and empty texts are the end id alone; null document ids come first; rows with the same id follow
    each other in the order of their texts; other columns are ignored.
    """
    def run(batches):
        words, bits = bare_words(tokenizer), width(library(tokenizer).vocab_size)
        part = TaskContext.get().partitionId()
        end, block, first = np.array([end_id], "<u4").tobytes(), 0, 0
        held, keys, starts, size = [], [], [], 0

        def close():
            ids = np.frombuffer(b"".join(held), "<u4")
            return made(_BLOCKS, [part], [block], [bits], [first], [size], [keys], [starts], [pack(ids, bits)])

        for piece in slices(batches):
            for key, ids in zip(piece.column("k").to_pylist(), words.encode(texts(piece))):
                held += [ids, end]
                keys.append(key)
                starts.append(size)
                size += len(ids) // 4 + 1
                if size >= block_ids:
                    yield close()
                    block, first = block + 1, first + size
                    held, keys, starts, size = [], [], [], 0
        if keys:
            yield close()

    tie = F.xxhash64("t")
    ordered = keyed(docs, id_column, text_column).repartitionByRange(F.col("k"), tie).sortWithinPartitions("k", tie, "t")
    ordered.mapInArrow(run, BLOCKS).write.option("compression", "zstd").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a folder, each with ``start``: the ids of all documents before it."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("_n"))  # one row per written part
    before = sizes.select(F.col("part").alias("_part"), F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return blocks.join(before, F.col("part") == F.col("_part")).withColumn("start", F.col("_before") + F.col("first")).drop("_part", "_before")


DIGESTS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def per_document(blocks: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` from the packed blocks that ``read_ids`` gives."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"], row["bits"], 0, row["n_ids"])
                starts = [*row["doc_starts"], row["n_ids"]]
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, starts[1:])]
                yield made(_DIGESTS, row["doc_ids"], [row["start"] + a for a in starts[:-1]], [b - a for a, b in zip(starts, starts[1:])], crc)

    return blocks.select("bits", "n_ids", "doc_ids", "doc_starts", "payload", "start").mapInArrow(run, DIGESTS)


def documents_at(blocks: DataFrame, doc_ids: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Random access: ``(doc_id, ids)`` of the wanted documents, unpacked without the rest of their blocks."""
    spots = blocks.select("bits", "n_ids", "doc_starts", "payload", F.posexplode("doc_ids").alias("i", "k"))
    wanted = doc_ids.select(F.col(id_column).cast("bigint").alias("k")).distinct()
    ends = F.coalesce(F.get("doc_starts", F.col("i") + 1), F.col("n_ids"))
    narrow = spots.join(wanted, "k", "left_semi").select("k", "bits", F.get("doc_starts", "i").alias("a"), ends.alias("b"), "payload")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"], row["bits"], row["a"], row["b"] - row["a"])
                yield pa.RecordBatch.from_arrays([pa.array([row["k"]], pa.int64()), pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return narrow.mapInArrow(run, "doc_id bigint, ids array<int>")


def packed_digests(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write, read back and digest: see ``write_ids`` and ``per_document``."""
    spark, path = docs.sparkSession, shared_folder(docs.sparkSession, "ids")
    write_ids(docs, path, tokenizer, **options)
    return per_document(read_ids(spark, path))
