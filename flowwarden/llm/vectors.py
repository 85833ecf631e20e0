"""What the operators on embedding vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITE = float("inf")


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    entries = vector.cast("array<double>")
    return vector.isNotNull() & F.forall(entries, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(INFINITE)))


def floors(vector: Column, scale: int) -> Column:
    """``floor(scale * v)`` of each entry, as long; beyond a long's range the end of the range stands."""
    return F.transform(vector.cast("array<double>"), lambda v: F.floor(F.lit(float(scale)) * v))


def matrix(lists: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column as one array of int64; shorter rows are filled with zeros."""
    array = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], array.type)
    ends = array.offsets.to_numpy()
    length = np.diff(ends)
    values = array.flatten().to_numpy(zero_copy_only=False)
    width = int(length.max()) if len(length) else 0
    if (length == width).all():
        return values.reshape(len(length), width)
    out = np.zeros((len(length), width), dtype=np.int64)
    out[np.arange(width)[None, :] < length[:, None]] = values
    return out
