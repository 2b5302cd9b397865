"""Vectors of a table as whole numbers: which rows take part, and their matrices in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, col: str) -> tuple[DataFrame, int]:
    """The rows whose vector has no null, no infinite and no undefined component, and the length of the vectors.

    Vectors of another length than most have (the greater length of equally frequent ones) and empty ones take no
    part; a table without vectors has length 0 and no rows. The column becomes an array of doubles.
    """
    v = F.col(f"`{col}`").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = df.withColumn(col, F.when(F.coalesce(finite, F.lit(False)) & (F.size(v) > 0), v)).where(F.col(f"`{col}`").isNotNull())
    size = F.size(F.col(f"`{col}`"))
    most = rows.groupBy(size.alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    width = most["width"] if most else 0
    return rows.where(size == width), width


def floors(vectors: pa.Array, width: int, scale: int, limit: int) -> np.ndarray:
    """floor(scale * x) of usable vectors [n, width], held within ``limit`` to both sides."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), width)
    return np.clip(np.floor(flat * float(scale)), -limit, limit).astype(np.int64)


def pack(rows: np.ndarray) -> pa.Array:
    """Each row of whole numbers as bytes: two a number where all of a row's fit, else four."""
    if len(rows) == 0 or rows.shape[1] == 0:
        return pa.array([b""] * len(rows), pa.binary())
    narrow = np.abs(rows).max(axis=1) < 1 << 15
    if narrow.all():
        data, step = rows.astype("<i2").tobytes(), 2 * rows.shape[1]
        ends = np.arange(len(rows) + 1, dtype=np.int32) * step
        return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])
    return pa.array([r.astype("<i2" if small else "<i4").tobytes() for r, small in zip(rows, narrow)], pa.binary())


def unpack(packed: pa.Array, width: int) -> np.ndarray:
    """The whole numbers that ``pack`` made bytes of."""
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1] if len(packed) else np.zeros(1, np.int32)
    body = packed.buffers()[2] if len(packed) else None
    if body is None or width == 0:
        return np.zeros((len(packed), width), np.int64)
    if (np.diff(offsets) == 2 * width).all():
        return np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]].view("<i2").reshape(-1, width).astype(np.int64)
    out = np.empty((len(packed), width), np.int64)
    for i, b in enumerate(packed.to_pylist()):
        out[i] = np.frombuffer(b, "<i2" if len(b) == 2 * width else "<i4")
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` with those of ``b``, by the narrowest arithmetic that is exact."""
    # no partial sum exceeds the product of the two lengths
    bound = float(np.sqrt((a.astype(float) ** 2).sum(axis=1).max(initial=0)) * np.sqrt((b.astype(float) ** 2).sum(axis=1).max(initial=0))) * 1.01
    if bound < 1 << 24:
        return (a.astype(np.float32) @ b.T.astype(np.float32)).astype(np.int64)
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T
