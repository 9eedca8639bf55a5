"""Embedding columns as integers: which rows take part, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(vector: str | Column) -> Column:
    """True for a vector that is there and holds neither nulls nor NaN or infinite components."""
    v = F.col(vector) if isinstance(vector, str) else vector
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(v.isNotNull() & fine, F.lit(False))


def integers(vector: str | Column, scale: int) -> Column:
    """floor(scale * x) of every component x as double; products beyond a long are its ends."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def numbered(df: DataFrame) -> DataFrame:
    """A row number beside each row, unique but not dense; store the result before it is used twice."""
    return df.withColumn("rid", F.monotonically_increasing_id())


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """(rows, dims) of a list column; a shorter list is filled with zeros."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(c, pa.ChunkedArray):  # no chunk at all
        return np.zeros((0, dims), dtype=np.int64)
    flat, lengths = c.flatten().to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(c).to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        return flat.reshape(len(c), dims)
    out = np.zeros((len(c), dims), dtype=np.int64)
    out[np.arange(dims) < lengths[:, None]] = flat
    return out
