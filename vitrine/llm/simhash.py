"""SimHash near-duplicates by tiled exact comparison (operator 5)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .components import components
from .frames import keyed, made, slices, stored, texts

SHINGLE, RADIUS, BITS, SEED = 3, 3, 64, 42
#: Fingerprints in a tile: a tile pair is a matrix of at most ``TILE ** 2`` comparisons.
TILE = 1024


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """A bit is 1 where more than half of the shingles' XXH64 have it; 0 without words."""
    import xxhash

    norm = b" ".join(text.encode().lower().split())
    if not norm:
        return 0
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(norm)]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(norm[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:])] or [digest(norm, SEED)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` of every row; ``fp`` holds the 64 bits as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for part in slices(batches):
            yield made(schema, part.column("k"), pa.array(np.array([fingerprint(t, shingle) for t in texts(part)], np.uint64).view(np.int64)))

    return keyed(docs, id_column, text_column).mapInArrow(run, "doc_id bigint, fp bigint")


def near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """The matrix of pairs at ``radius`` or fewer differing bits."""
    # Of a signed number the bits of its absolute value are counted.
    return np.bitwise_count(a.view(np.uint64)[:, None] ^ b.view(np.uint64)[None, :]) <= radius


def labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each node's component under the links ``i - j``."""
    now = np.arange(n)
    while True:
        new = now.copy()
        np.minimum.at(new, i, now[j])
        np.minimum.at(new, j, now[i])
        new = new[new]
        if (new == now).all():
            return now
        now = new


def _own_labels(fps: np.ndarray, radius: int) -> np.ndarray:
    i, j = np.nonzero(np.triu(near(fps, fps, radius), 1))
    return labels(len(fps), i, j)


_TILES = "tile bigint, low_key bigint, low_ones int, high_key bigint, high_ones int, head binary, tail binary, fps binary"
_LINKS = "a bigint, b bigint"


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links ``(a, b)`` that join everything within ``radius`` bits, from distinct fingerprints ``fp``.

    Two fingerprints at ``radius`` differing bits agree in at least one of ``radius + 1`` stretches of bits, so each goes to
    one block per stretch and value. Ordered by block and population count they are cut into tiles; a tile is compared with
    itself and with later tiles of its last block whose population counts are within the radius. Small blocks share a tile, a
    block of any size is many tiles, and tile pairs are rows that Spark deals out. Inside a tile, and between two, only
    links that a component needs are emitted, so a group of n near copies gives about n links and not n * n.
    """
    cuts = [BITS * i // (radius + 1) for i in range(radius + 2)]
    stretch = F.array(*[F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:])])
    placed = fps.select("fp", F.bit_count("fp").alias("ones"), F.posexplode(stretch).alias("i", "value"))
    placed = placed.select((F.col("i").cast("bigint") * F.lit(1 << 48) + F.col("value")).alias("key"), "ones", "fp")
    ordered = placed.repartitionByRange("key", "ones", "fp").sortWithinPartitions("key", "ones", "fp")
    schema = pa.schema([("tile", pa.int64()), ("low_key", pa.int64()), ("low_ones", pa.int32()), ("high_key", pa.int64()), ("high_ones", pa.int32()),
                        ("head", pa.binary()), ("tail", pa.binary()), ("fps", pa.binary())])

    def cut_tiles(batches):
        at = TaskContext.get().partitionId() << 32
        rest = None

        def row(key, ones, fp):
            nonlocal at
            at += 1
            head, tail = fp[key == key[0]], fp[key == key[-1]]
            return made(schema, [at], [key[0]], [ones[0]], [key[-1]], [ones[-1]], [head.tobytes()], [tail.tobytes()], [fp.tobytes()])

        for batch in batches:
            new = [batch.column(c).to_numpy() for c in ("key", "ones", "fp")]
            rest = new if rest is None else [np.concatenate(x) for x in zip(rest, new)]
            while len(rest[0]) >= tile:
                yield row(*[x[:tile] for x in rest])
                rest = [x[tile:] for x in rest]
        if rest is not None and len(rest[0]):
            yield row(*rest)

    tiles = stored(ordered.mapInArrow(cut_tiles, _TILES), "tiles")
    schema_links = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def inside(batches):
        for batch in batches:
            for raw in batch.column("fps").to_pylist():
                f = np.frombuffer(raw, np.int64)
                root = _own_labels(f, radius)
                i = np.flatnonzero(root != np.arange(len(f)))
                yield made(schema_links, pa.array(f[i]), pa.array(f[root[i]]))

    def between(batches):
        for batch in batches:
            for x, y in zip(batch.column("tail").to_pylist(), batch.column("head").to_pylist()):
                a, b = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                i, j = np.nonzero(near(a, b, radius))
                if len(i):  # one link for two groups that touch; their own links come from ``inside``
                    pairs = np.unique(np.stack([_own_labels(a, radius)[i], _own_labels(b, radius)[j]]), axis=1)
                    yield made(schema_links, pa.array(a[pairs[0]]), pa.array(b[pairs[1]]))

    left = tiles.select(F.col("tile").alias("t1"), F.col("high_key").alias("key"), "high_ones", "tail")
    right = tiles.select(F.col("tile").alias("t2"), F.col("low_key").alias("key"), "low_ones", "head")
    pairs = left.join(right, "key").filter(f"t1 < t2 and low_ones - high_ones <= {radius}").select("tail", "head")
    return tiles.select("fps").mapInArrow(inside, _LINKS).union(pairs.mapInArrow(between, _LINKS))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE, radius: int = RADIUS,
                    tile: int = TILE) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row: the least doc_id that links reach, the row's own included.

    Equal fingerprints are one node, so a group of copies of any size is one aggregate row before anything is compared.
    Null and empty texts have fingerprint zero and are linked like any other; repeated rows come back each; a null id stays
    null and is no component's least; no rows give no rows; other columns are ignored.
    """
    found = stored(fingerprints(docs, id_column, text_column, shingle), "fingerprints")
    nodes = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    root = components(links(nodes.select("fp"), radius, tile))
    of_root = root.join(nodes, root.node == nodes.fp).groupBy("root").agg(F.min("least").alias("component_id"))
    linked = root.join(of_root, "root").select(F.col("node").alias("fp"), "component_id")
    classes = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return found.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: of each class the document with the least id.

    Of repeated rows with that id one stays; rows without an id all stay, because nothing tells them apart.
    """
    return least_of_class(docs, near_duplicates(docs, id_column, text_column, **options), id_column, text_column)


def least_of_class(docs: DataFrame, classes: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when of each class ``(doc_id, component_id)`` the document with the least id stays."""
    least = classes.filter("doc_id = component_id").select(F.col("doc_id").alias("_least")).distinct()
    kept = docs.join(least, F.col(id_column).cast("bigint") == F.col("_least"))
    once = Window.partitionBy("_least").orderBy(F.xxhash64(F.col(text_column)), F.col(text_column))
    kept = kept.withColumn("_row", F.row_number().over(once)).filter("_row = 1").drop("_row", "_least")
    return kept.unionByName(docs.filter(F.col(id_column).isNull()))
