"""Near copies by wide fingerprints, compared in tiles, and exact Jaccard similarity (near-dedup stage of the pipeline).

Operator 5 at five words and a similarity of 0.8: fingerprints of 128 bits are put into blocks by several choices of their bits,
blocks are cut into tiles ordered by population count, tiles are compared with exclusive-or and bit counts, and tile pairs
whose counts differ beyond the radius are skipped. That joins documents in candidate classes. Each class is cut into tiles
again, which now hold the sets of shingles, and inside and between these the links are those at an exact similarity of 0.8.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .components import components
from .frames import keyed, made, slices, stored, texts
from .simhash import labels
from .words import Words, mixed

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
BITS = 128
#: Rows of a tile: a pair of tiles is a matrix of at most ``TILE ** 2`` comparisons.
TILE = 1024
#: Fingerprints that a block is meant to hold where all differ, and the share of pairs at the similarity that some block brings together.
BLOCK, MEET = 256, 0.99
#: Bits of the map of documents to be compared; a bit that is set by chance costs a row, not a result.
MAP_BITS = 1 << 24
#: Bytes of text that are shingled at a time, and of the sets that a tile holds.
SLICE, TILE_BYTES = 1 << 20, 1 << 20
_U = np.uint64


def differing(similarity: float) -> float:
    """The share of bits in which fingerprints of two equally large sets differ on average."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def radius(similarity: float, bits: int = BITS) -> int:
    """Three deviations above the bits that differ on average at ``similarity``: sets of a few shingles differ in more than large ones."""
    p = differing(similarity)
    return min(bits, round(bits * p + 3 * math.sqrt(bits * p * (1 - p))))


def choices(nodes: int, similarity: float) -> np.ndarray:
    """Rows of bit places, one row a table: as many bits as leave ``BLOCK`` fingerprints in a block, as many tables as let a share
    ``MEET`` of the pairs at ``similarity`` agree in one of them."""
    wide = min(32, max(8, math.ceil(math.log2(max(2, nodes) / BLOCK))))
    agree = (1 - differing(similarity)) ** wide
    tables = max(1, math.ceil(math.log(1 - MEET) / math.log(1 - min(agree, 0.99))))
    rng, out = np.random.default_rng(SEED), []
    while len(out) < tables:  # stretches of one order share no bit, so one differing bit spoils one of them only
        order = rng.permutation(BITS)
        out += [np.sort(order[i:i + wide]) for i in range(0, BITS - wide + 1, wide)]
    return np.stack(out[:tables])


def shingle_sets(given: list[str], k: int = SHINGLE) -> list[np.ndarray]:
    """Per text the distinct 64-bit hashes of the runs of ``k`` words, ascending; of the whole text if it has fewer words; none
    without words."""
    w = Words(given, lower=True)
    runs = w.windows(k)
    out = []
    for first, n in zip(w.first.tolist(), w.count.tolist()):
        if n >= k:
            out.append(np.unique(runs[first:first + n - k + 1]))
        else:
            h = np.zeros(min(n, 1), _U)
            for x in w.hashes[first:first + n]:
                h = h * _U(0xD6E8FEB86659FD93) + x
            out.append(mixed(h + _U(n)))
    return out


def set_key(s: np.ndarray) -> int:
    import xxhash

    return int(np.array([xxhash.xxh3_64_intdigest(s.tobytes(), SEED)], _U).view(np.int64)[0])


_BIT_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def wide_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """``BITS`` bits of every set as pairs of 64-bit numbers: a bit is 1 where more than half of the members' hashes have it."""
    out = np.zeros((len(sets), BITS // 64), _U)
    for i in range(0, len(sets), 64):
        some = sets[i:i + 64]
        size = np.array([len(s) for s in some])
        members = np.concatenate([*some, np.zeros(0, _U)])
        both = np.stack([mixed(members * _U(2 * j + 1) + _U(j)) for j in range(BITS // 64)], axis=1)
        raw = both.view(np.uint8).reshape(len(members), BITS // 8)
        place = (np.repeat(np.arange(len(some)), size)[:, None] * (BITS // 8) + np.arange(BITS // 8)[None, :]) * 256 + raw
        counts = np.bincount(place.ravel(), minlength=len(some) * BITS // 8 * 256).reshape(-1, 256)
        ones = (counts @ _BIT_OF).reshape(len(some), BITS)
        out[i:i + 64] = np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view("<u8")
    return out


def _marks(docs: DataFrame, k: int) -> DataFrame:
    schema = pa.schema([("k", pa.int64()), ("fp", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for part in slices(batches, limit=SLICE):
            sets = shingle_sets(texts(part), k)
            bits = wide_fingerprints(sets).view(np.int64)
            yield made(schema, part.column("k"), [set_key(s) for s in sets], *[pa.array(np.ascontiguousarray(bits[:, j])) for j in range(2)])

    return docs.mapInArrow(run, "k bigint, fp bigint, a bigint, b bigint")


_PLACED = ["key", "ones", "fp", "a", "b"]


def _placed(nodes: DataFrame, tables: np.ndarray) -> DataFrame:
    """Every node once per table: ``(key, ones, fp, a, b)``."""
    schema = pa.schema([(c, pa.int64()) for c in _PLACED])
    weights = 1 << np.arange(tables.shape[1], dtype=np.int64)

    def run(batches):
        for batch in batches:
            fp, a, b = (batch.column(c).to_numpy() for c in ("fp", "a", "b"))
            both = np.stack([a, b], axis=1)
            bits = np.unpackbits(both.view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little")
            ones = bits.sum(axis=1, dtype=np.int64)
            for t, places in enumerate(tables):
                key = bits[:, places].astype(np.int64) @ weights + (t << tables.shape[1])
                yield made(schema, *map(pa.array, (key, ones, fp, a, b)))

    return nodes.select("fp", "a", "b").mapInArrow(run, ", ".join(f"{c} bigint" for c in _PLACED))


_TILES = "tile bigint, low_key bigint, low_ones bigint, high_key bigint, high_ones bigint, head binary, tail binary, rows binary"
_TILE = pa.schema([(c, pa.int64()) for c in ("tile", "low_key", "low_ones", "high_key", "high_ones")] + [(c, pa.binary()) for c in ("head", "tail", "rows")])


def _tiles(placed: DataFrame, tile: int) -> DataFrame:
    ordered = placed.repartitionByRange("key", "ones", "fp").sortWithinPartitions("key", "ones", "fp")

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        rest = np.zeros((0, len(_PLACED)), np.int64)
        for batch in [*batches, None]:
            if batch is not None:
                rest = np.concatenate([rest, np.stack([batch.column(c).to_numpy() for c in _PLACED], axis=1)])
            while len(rest) >= tile or (batch is None and len(rest)):
                part, rest = rest[:tile], rest[tile:]
                number += 1
                head, tail = part[part[:, 0] == part[0, 0]], part[part[:, 0] == part[-1, 0]]
                yield made(_TILE, [number], [part[0, 0]], [part[0, 1]], [part[-1, 0]], [part[-1, 1]], [head.tobytes()], [tail.tobytes()], [part.tobytes()])

    return stored(ordered.mapInArrow(run, _TILES), "near-tiles")


def _near(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """The matrix of pairs of rows ``(.., a, b)`` within ``most`` differing bits."""
    # Of a signed number the bits of its absolute value are counted.
    a, b = x[:, -2:].view(_U), y[:, -2:].view(_U)
    away = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
    away += np.bitwise_count(a[:, None, 1] ^ b[None, :, 1])
    return away <= most


def _rows(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64).reshape(-1, len(_PLACED))


def _blocks(raw: bytes) -> list[np.ndarray]:
    """The blocks of a tile that hold more than one row."""
    rows = _rows(raw)
    return [g for g in np.split(rows, np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1) if len(g) > 1]


def _met(tiles: DataFrame, most: int) -> DataFrame:
    """Pairs of tiles that share a block and whose population counts allow ``most`` differing bits."""
    left = tiles.select(F.col("tile").alias("t1"), F.col("high_key").alias("key"), "high_ones", "tail")
    right = tiles.select(F.col("tile").alias("t2"), F.col("low_key").alias("key"), "low_ones", "head")
    return left.join(right, "key").filter(f"t1 < t2 and low_ones - high_ones <= {most}")


_LINK = pa.schema([("x", pa.int64()), ("y", pa.int64())])


def _forest(fps: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """As many of the links ``i - j`` as join the same rows: each row with the first of its group."""
    root = labels(len(fps), i, j)
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return made(_LINK, pa.array(fps[moved]), pa.array(fps[root[moved]]))


def _candidates(tiles: DataFrame, most: int) -> DataFrame:
    """Links ``(x, y)`` that join everything within ``most`` differing bits in some block; inside a tile and between two only those
    that a group needs, so a group of n gives about n links a table."""
    def inside(batches):
        for batch in batches:
            for raw in batch.column("rows").to_pylist():
                for g in _blocks(raw):
                    yield _forest(g[:, 2], *np.nonzero(np.triu(_near(g, g, most), 1)))

    def between(batches):
        for batch in batches:
            for x, y in zip(*(map(_rows, batch.column(c).to_pylist()) for c in ("tail", "head"))):
                i, j = np.nonzero(_near(x, y, most))
                yield _forest(np.r_[x[:, 2], y[:, 2]], i, j + len(x))

    columns = "x bigint, y bigint"
    return tiles.select("rows").mapInArrow(inside, columns).union(_met(tiles, most).select("tail", "head").mapInArrow(between, columns)).distinct()


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``(fp, s)`` of the wanted nodes ``(fp, least)``.

    Only documents that stand for a wanted node are shingled again; a map of bits, whose size does not depend on the data,
    tells the tasks which.
    """
    place = F.pmod(F.xxhash64("least"), F.lit(MAP_BITS))
    words = wanted.select(place.alias("p")).groupBy(F.expr("shiftright(p, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("b")).toArrow()
    bits = np.zeros(MAP_BITS // 64, np.int64)
    bits[words.column("w").to_numpy()] = words.column("b").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    schema = pa.schema([("fp", pa.int64()), ("s", pa.binary())])

    def run(batches):
        for part in slices(batches, limit=SLICE):
            at = part.column("p").to_numpy()
            part = part.filter(pa.array((shared.value[at >> 6] >> (at & 63)) & 1 == 1))
            found = shingle_sets(texts(part), k) if part.num_rows else []
            if found:
                yield made(schema, [set_key(s) for s in found], [s.tobytes() for s in found])

    marked = docs.select("t", F.pmod(F.xxhash64("k"), F.lit(MAP_BITS)).alias("p"))
    return marked.mapInArrow(run, "fp bigint, s binary").join(wanted.select("fp"), "fp", "left_semi").groupBy("fp").agg(F.first("s").alias("s"))


_SET_TILE = "class bigint, tile bigint, low int, high int, marks binary, sizes binary, sets binary"


def _set_tiles(members: DataFrame, tile: int, most_bytes: int) -> DataFrame:
    """Rows ``(class, ones, fp, a, b, s)`` as tiles of one class each, in the order of population counts."""
    ordered = members.repartitionByRange("class", "ones", "fp").sortWithinPartitions("class", "ones", "fp")

    def run(rows):
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for r in itertools.chain(rows, [None]):
            if held and (r is None or r["class"] != held[0]["class"] or len(held) >= tile or size + len(r["s"]) > most_bytes):
                number += 1
                marks = np.array([(h["fp"], h["a"], h["b"]) for h in held], np.int64)
                yield held[0]["class"], number, held[0]["ones"], held[-1]["ones"], marks.tobytes(), np.array([len(h["s"]) // 8 for h in held]).tobytes(), b"".join(bytes(h["s"]) for h in held)
                held, size = [], 0
            if r is not None:
                held.append(r)
                size += len(r["s"])

    return stored(ordered.rdd.mapPartitions(run).toDF(_SET_TILE), "set-tiles")


def _similar(x: tuple, y: tuple | None, most: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of one or two tiles ``(marks, sizes, sets)`` and the links between them that are at ``similarity``."""
    marks, size, members = (np.concatenate(c) for c in zip(*(
        (np.frombuffer(m, np.int64).reshape(-1, 3), np.frombuffer(n, np.int64), np.frombuffer(s, _U)) for m, n, s in ([x] if y is None else [x, y]))))
    n = len(marks) if y is None else len(x[1]) // 8
    start = np.cumsum(np.r_[0, size])
    left, right = marks[:n], marks if y is None else marks[n:]
    near = _near(left, right, most)
    near &= np.minimum(size[:n, None], size[None, -len(right):]) >= similarity * np.maximum(size[:n, None], size[None, -len(right):]) - 1e-9
    if y is None:
        near = np.triu(near, 1)
    words, number = np.unique(members, return_inverse=True)
    shift, have, found = 0 if y is None else n, np.zeros(len(words), bool), []
    for i in np.flatnonzero(near.any(axis=1)):
        own = number[start[i]:start[i + 1]]
        j = np.flatnonzero(near[i]) + shift
        have[own] = True
        # The members that i has, summed over each other set; sets are never empty here.
        total = np.cumsum(np.r_[0, have[number[start[shift]:]]])
        both = total[start[j + 1] - start[shift]] - total[start[j] - start[shift]]
        have[own] = False
        j = j[both / (size[i] + size[j] - both) >= similarity]
        found.append((np.full(len(j), i), j))
    i, j = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    return marks[:, 0], i, j


def _exact(tiles: DataFrame, most: int, similarity: float) -> DataFrame:
    """Links ``(x, y)`` that join every two sets of a class at ``similarity``; pairs of tiles are rows, pairs of sets are not."""
    one = ("marks", "sizes", "sets")

    def linked(rows):
        for r in rows:
            x, y = tuple(bytes(r[c]) for c in one), tuple(bytes(r[c + "_2"]) for c in one) if "marks_2" in r else None
            fps, i, j = _similar(x, y, most, similarity)
            links = _forest(fps, i, j)
            yield from zip(links.column("x").to_pylist(), links.column("y").to_pylist())

    other = tiles.select("class", F.col("tile").alias("tile_2"), F.col("low").alias("low_2"), *[F.col(c).alias(c + "_2") for c in one])
    met = tiles.join(other, "class").filter(f"tile < tile_2 and low_2 - high <= {most}").drop("class")
    # Rows, not Arrow batches: a row may hold two tiles of a megabyte.
    found = tiles.select(*one).rdd.mapPartitions(linked).union(met.rdd.mapPartitions(linked))
    return stored(found.toDF("x bigint, y bigint"), "linked")


def classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """``(doc_id, component_id)`` of every row: the least doc_id that links of ``similarity`` or more reach, the row's own included.

    Every link is exact; a pair at the similarity is missed where its fingerprints differ beyond the radius or agree in no
    table (a few of a hundred at the similarity itself, hardly any at 0.9). Documents with one set of shingles are one node,
    so repeated rows and exact copies of any number are one row before anything is compared; texts without words (null, empty)
    are one node as well. A null id stays null and is no component's least. Tables without rows give none; other columns
    are ignored.

    A class of candidates is compared tile by tile, as operator 5 compares its blocks, so a large class costs the square of its
    size in comparisons of bits, spread over its pairs of tiles, but sends no pairs of documents.
    """
    docs = keyed(docs, id_column, text_column)
    marks = stored(_marks(docs, shingle), "marks")
    nodes = stored(marks.groupBy("fp").agg(F.min("k").alias("least"), F.first("a").alias("a"), F.first("b").alias("b")), "nodes")
    most = radius(similarity)
    near = components(_candidates(_tiles(_placed(nodes, choices(nodes.count(), similarity)), tile), most), "x", "y")
    wanted = stored(near.select(F.col("node").alias("fp"), F.col("root").alias("class")).join(nodes, "fp"), "compared")
    members = wanted.join(_sets(docs, wanted, shingle), "fp").select("class", (F.bit_count("a") + F.bit_count("b")).alias("ones"), "fp", "a", "b", "s")
    root = components(_exact(_set_tiles(members, tile, TILE_BYTES), most, similarity), "x", "y")
    of_root = root.join(nodes.select("fp", "least"), root.node == F.col("fp")).groupBy("root").agg(F.min("least").alias("component_id"))
    linked = root.join(of_root, "root").select(F.col("node").alias("fp"), "component_id")
    known = nodes.select("fp", "least").join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return marks.select("k", "fp").join(known, "fp").select(F.col("k").alias("doc_id"), "component_id")
