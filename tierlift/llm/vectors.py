"""Vector columns: which rows count, and matrices from Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """Not null, not empty, and without null, NaN or infinite components."""
    limit = F.lit(float("inf"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == limit))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    """Rows of a list column; shorter ones are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy()
    width = int(sizes.max()) if len(sizes) else 0
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out
