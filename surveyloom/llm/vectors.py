"""Vectors of a table as packed blocks: rows that hold many vectors in one binary value."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is not null and holds finite components only, as doubles."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.withColumn(vector_col, v).where(F.col(vector_col).isNotNull() & ~F.coalesce(bad, F.lit(False)))


def matrix(column: pa.Array, dims: int, dtype=np.float64) -> np.ndarray:
    """Rows of a list column as a matrix; shorter ones end in zeros."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    if (size == dims).all():
        return flat.reshape(len(size), dims)
    out = np.zeros((len(size), dims), dtype)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def rotation(df: DataFrame, vector_col: str, dims: int) -> np.ndarray:
    """Orthonormal directions of all vectors (columns), the one of largest spread about 0 first.

    Each task sums the products of its vectors' components; only these sums,
    dims x dims per task, are added up for the singular vectors.
    """

    def gram(batches):
        total = np.zeros((dims, dims))
        for b in batches:
            x = matrix(b.column(0), dims)
            total += x.T @ x
        yield pa.record_batch([pa.array(np.arange(dims * dims)), pa.array(total.ravel())], names=["i", "g"])

    sums = df.select(vector_col).mapInArrow(gram, "i long, g double").groupBy("i").agg(F.sum("g").alias("g"))
    g = np.zeros(dims * dims)
    for r in sums.collect():
        g[r["i"]] = r["g"]
    values, vectors = np.linalg.eigh(np.nan_to_num(g.reshape(dims, dims)))
    return vectors[:, np.argsort(-values, kind="stable")]


def pack_rows(ids: np.ndarray, rows: np.ndarray) -> tuple[bytes, bytes]:
    return ids.astype("<i8").tobytes(), np.ascontiguousarray(rows).tobytes()
