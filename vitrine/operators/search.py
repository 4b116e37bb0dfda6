"""Exact search for any number of short texts in the texts of any number of pages: one Arrow pass over the pages.

A text of ``n`` bytes is covered by its first and its last window of the greatest power of two that is not above ``n``, so a few
hashes for each byte of a page, each made of two of half the width, compare it with texts of every length. What the texts ask
for stands in one table of bits; what passes it by chance goes out like the rest and meets no text there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

U = np.uint64
#: Bytes hashed at a time, places and lengths compared at a time, bytes cut out at a time.
PIECE, PAIRS, CUT_OUT = 1 << 18, 1 << 18, 1 << 22
#: Bits of the table for each gram, and the least and the most of it as powers of two (64 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 13, 29
#: A gram has a bit for each; the first is the gram itself.
PROBES = (U(1), U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93))
_ONE, _TWO = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * _ONE
    x = (x ^ (x >> U(27))) * _TWO
    return x ^ (x >> U(31))


_BYTES = _mixed(np.arange(1, 257, dtype=U) * PROBES[1])


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts after one another and where each begins, with the end of the last."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def _windows(data: np.ndarray, levels: set[int], reach: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """``(start, stop, level, hashes)``: of the windows of ``2**level`` bytes from ``start`` on, and as far behind ``stop`` as ``reach``."""
    step = max(PIECE, 2 * reach)
    for start in range(0, len(data), step):
        hashes = _BYTES[data[start : start + step + reach]]
        for level in range(max(levels, default=-1) + 1):
            half = 1 << level >> 1
            if half >= len(hashes):
                break
            if half:
                wider = hashes[:-half] * _ONE
                wider += hashes[half:]
                wider ^= wider >> U(29)
                hashes = wider
            if level in levels:
                yield start, start + step, level, hashes


def _level(size: np.ndarray) -> np.ndarray:
    return np.frexp(size.astype(np.float64))[1] - 1


def _whole(head: np.ndarray, tail: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    x = (head ^ group) * _TWO
    x += tail
    x ^= x >> U(29)
    x *= _ONE
    x += size.astype(U)
    return x ^ (x >> U(32))


def _group(keys: list[str], of: DataFrame, other: DataFrame) -> Column:
    """What tells the groups apart in a gram; nothing where the keys of the two sides are of other types, which hash otherwise."""
    same = all(of.schema[k].dataType == other.schema[k].dataType for k in keys)
    return F.xxhash64(*keys) if same else F.lit(0).cast("bigint")


def _asked_by(data: np.ndarray, ends: np.ndarray, group: np.ndarray) -> Iterator[np.ndarray]:
    """The grams of whole texts."""
    begins, size = ends[:-1], np.diff(ends)
    level = _level(size)
    for start, stop, here, hashes in _windows(data, set(level.tolist()), int(size.max(initial=0))):
        rows = np.flatnonzero((level == here) & (begins >= start) & (begins < stop))
        at, n = begins[rows] - start, size[rows]
        head = hashes[at]
        yield np.concatenate([head, _whole(head, hashes[at + n - (1 << here)], n, group[rows])])


def grams(quotes: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """``(gram)``: what the quotes ask for, each its first window and its whole, as hashes. ``quotes``: keys, quote (not empty)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in _asked_by(*_bytes(batch.column("quote")), batch.column("_group").to_numpy(zero_copy_only=False).view(U)):
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["gram"])

    return quotes.select("quote", _group(keys, quotes, pages).alias("_group")).mapInArrow(run, "gram bigint").distinct()


def _slots(gram: np.ndarray, power: int) -> np.ndarray:
    return np.concatenate([gram * k for k in PROBES]) >> U(64 - power)


def table(asked: DataFrame) -> np.ndarray:
    """Bytes of the table of bits in which the grams ``asked`` are set, of bounded size. ``asked`` is read twice."""
    power = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * asked.count() - 1).bit_length()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram = batch.column("gram").to_numpy(zero_copy_only=False).view(U)
            slots = _slots(gram, power)
            yield pa.RecordBatch.from_arrays([pa.array((slots >> U(6)).view(np.int64)), pa.array((U(1) << (slots & U(63))).view(np.int64))], names=["w", "b"])

    words = asked.select("gram").mapInArrow(run, "w bigint, b bigint").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(1 << power >> 6, "<u8")
    bits[words["w"].to_numpy()] = words["b"].to_numpy().view(U)
    return bits.view(np.uint8)


def _asked(bits: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Places of the grams of ``found`` whose bits are all set."""
    shift = U(64 - (len(bits) * 8).bit_length() + 1)
    slot, at = found >> shift, None
    for k in PROBES:
        slot = slot if at is None else found[at] * k >> shift
        held = bits[(slot >> U(3)).view(np.int64)] >> (slot.astype(np.uint8) & np.uint8(7)) & np.uint8(1)
        at = np.flatnonzero(held) if at is None else at[held.view(bool)]
    return at


def _occurrences(data: np.ndarray, ends: np.ndarray, group: np.ndarray, sizes: dict[int, np.ndarray], bits: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """``(row, begin, size)`` of whatever passes the table of bits in the texts."""
    reach = max((int(n.max()) for n in sizes.values()), default=0)
    for start, stop, level, hashes in _windows(data, set(sizes), reach):
        begin = _asked(bits, hashes[: stop - start])
        row = np.searchsorted(ends, begin + start, "right") - 1
        room, most = ends[row + 1] - start - begin, max(1, PAIRS // len(sizes[level]))
        for i in range(0, len(begin), most):
            place, kind = np.nonzero(room[i : i + most, None] >= sizes[level])
            n, at, where = sizes[level][kind], begin[i + place], row[i + place]
            passed = _asked(bits, _whole(hashes[at], hashes[at + n - (1 << level)], n, group[where]))
            if len(passed):
                yield where[passed], start + at[passed], n[passed]


def _cut_out(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(size)])
    held = data[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])]
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(held)])


def _earliest(rows: np.ndarray, quotes: pa.Array, group: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """For each group and quote the row that comes first."""
    code = quotes.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    order = np.lexsort((rank[rows], group[rows], code))
    code, of = code[order], group[rows][order]
    first = np.ones(len(order), bool)
    first[1:] = (code[1:] != code[:-1]) | (of[1:] != of[:-1])
    kept = order[first]
    return rows[kept], quotes.take(pa.array(kept))


def _codes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """A number for each group of the batch."""
    code = np.zeros(batch.num_rows, np.int64)
    for k in keys:
        held = batch.column(k).dictionary_encode()
        code = np.unique(code * len(held.dictionary) + held.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    return code


def found_on(quotes: DataFrame, pages: DataFrame, keys: list[str], bits: np.ndarray) -> DataFrame:
    """``(keys, place, url, quote)``: each quote on the first of those pages that are read together and hold it.

    ``pages``: keys, place, url, visible_text, none null but the url. ``bits`` is the ``table`` of the quotes' grams; rows of texts
    that only share a gram's bits are among the result, so it is joined to the quotes.
    """
    lengths = np.array([r[0] for r in quotes.select(F.octet_length("quote").alias("n")).distinct().collect()], np.int64)
    sizes = {int(level): np.sort(lengths[_level(lengths) == level]) for level in np.unique(_level(lengths))}
    sent = pages.sparkSession.sparkContext.broadcast(bits)
    read = pages.select(*keys, "place", "url", "visible_text", _group(keys, quotes, pages).alias("_group"))
    schema = T.StructType([*(read.schema[c] for c in (*keys, "place", "url")), T.StructField("quote", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = _bytes(batch.column("visible_text"))
            code, rank = _codes(batch, keys), np.empty(batch.num_rows, np.int64)
            rank[pc.sort_indices(batch.column("place")).to_numpy()] = np.arange(batch.num_rows)
            kept = []
            for row, begin, size in _occurrences(data, ends, batch.column("_group").to_numpy(zero_copy_only=False).view(U), sizes, sent.value):
                block = np.cumsum(size) // CUT_OUT
                for i in np.unique(block):
                    one = block == i
                    kept.append(_earliest(row[one], _cut_out(data, begin[one], size[one]), code, rank))
            if kept:
                rows, texts = _earliest(np.concatenate([r for r, _ in kept]), pa.concat_arrays([q for _, q in kept]), code, rank)
                at = pa.array(rows)
                columns = [batch.column(c).take(at).cast(arrow.field(c).type) for c in schema.names[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, texts.cast(pa.binary()).view(pa.string()).cast(arrow.field("quote").type)], schema=arrow)

    return read.mapInArrow(run, schema)
