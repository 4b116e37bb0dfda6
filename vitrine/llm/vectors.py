"""Vectors as exact whole numbers, many in one matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .frames import made

#: Rows of a block.
ROWS = 4096
#: A vector with a larger whole-number component takes no part: its products might not fit 64 bits.
LARGEST = 1 << 27

BLOCK = "size int, ids binary, labels binary, x binary"
_BLOCK = pa.schema([("size", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("x", pa.binary())])


def whole(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of every component as doubles; null where any component is null, not finite or beyond ``LARGEST``."""
    steps = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(LARGEST / scale), F.lit(False)))
    return F.when(fine, steps)


def blocks(rows: DataFrame) -> DataFrame:
    """Rows ``(id bigint, label bigint, x array<double>)`` packed as matrices of ``size`` columns.

    A block holds up to ``ROWS`` neighbouring rows with vectors of one length. Labels and vectors are not null; rows without
    an id are blocks of their own, whose ``ids`` are null.
    """
    def run(batches):
        for batch in batches:
            lists = batch.column("x")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            ids, labels = pc.fill_null(batch.column("id"), 0).to_numpy(), batch.column("label").to_numpy()
            known = batch.column("id").is_valid().to_numpy(zero_copy_only=False)
            for size, named in sorted({*zip(sizes.tolist(), known.tolist())}):
                of = np.flatnonzero((sizes == size) & (known == named))
                flat = lists.take(pa.array(of)).flatten().to_numpy().astype(np.int64).reshape(len(of), size)
                for i in range(0, len(of), ROWS):
                    part = of[i:i + ROWS]
                    yield made(_BLOCK, [size], [ids[part].tobytes() if named else None], [labels[part].tobytes()], [flat[i:i + ROWS].tobytes()])

    return rows.select("id", "label", "x").mapInArrow(run, BLOCK)


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and the matrix of a block."""
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["labels"], np.int64), np.frombuffer(row["x"], np.int64).reshape(len(ids), row["size"])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows; a component that one side lacks is 0."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * d
    if most < 1 << 53:  # floating-point products and sums of whole numbers below 2 ** 53 are exact
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T
