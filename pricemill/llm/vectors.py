"""Vector columns in tasks: which rows are usable, integer components, exact squared distances."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Integer components beyond this size count as this size: squares of 64 of them still fit in 64 bits.
LARGEST = 1 << 27


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def finite(vector: Column) -> Column:
    """Whether the vector and all its components are there and finite; never null."""
    wide = lambda x: x.cast("double")
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(wide(x)) | (F.abs(wide(x)) == float("inf")))
    return F.coalesce(~odd, F.lit(False))


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """The rows of a list column, all of ``length`` components, as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)


def integers(x: np.ndarray) -> np.ndarray:
    """floor(256 * x), exact."""
    return np.clip(np.floor(256.0 * x), -LARGEST, LARGEST).astype(np.int32)


def packed(rows: np.ndarray) -> pa.Array:
    """Every row of a C-ordered matrix as one binary value."""
    n, width = len(rows), rows.dtype.itemsize * int(np.prod(rows.shape[1:]))
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width or 1, dtype=np.int32)[:n + 1] if width
                                                                    else np.zeros(n + 1, np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def unpacked(column: pa.Array, kind) -> np.ndarray:
    """Equally long binary values as the rows of a matrix."""
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]].view(kind).reshape(len(column), -1)


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the integer rows of ``x`` to those of ``c``."""
    if not x.size or not c.size:
        return np.zeros((len(x), len(c)), np.int64)
    if max(np.abs(x).max(), np.abs(c).max()) <= 1 << 21 and x.shape[1] <= 256:  # all sums stay below 2 ** 53
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    wide = x.astype(np.int64)
    return np.stack([((wide - row) ** 2).sum(1) for row in c.astype(np.int64)], 1)


def summed_by(group: np.ndarray, x: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the integer rows of ``x`` and their number, by group."""
    order = np.argsort(group, kind="stable")
    count = np.bincount(group, minlength=groups)
    total = np.zeros((groups, x.shape[1]), np.int64)
    held = np.flatnonzero(count)
    if len(held):
        total[held] = np.add.reduceat(x[order].astype(np.int64), (np.cumsum(count) - count)[held], axis=0)
    return total, count
