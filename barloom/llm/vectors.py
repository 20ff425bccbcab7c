"""Vector tables as dense blocks: what both vector searches share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """Not null, not empty, every component there and finite."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & fine, F.lit(False))


def dense(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """Rows of a list column; shorter vectors are filled up with zeros, which no inner product sees."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    wide = int(size.max()) if len(size) else 0
    if (size == wide).all():
        return flat.reshape(len(size), wide)
    out = np.zeros((len(size), wide), dtype)
    out[np.arange(wide)[None, :] < size[:, None]] = flat
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, wide - x.shape[1]))) if x.shape[1] < wide else x for x in (a, b))


def dealt(df: DataFrame, name: str, parts: int, *others: tuple[str, int]) -> DataFrame:
    """Rows with a block number `name` by a hash of the row, one copy for each combination of the other block numbers."""
    out = df.withColumn(name, F.pmod(F.xxhash64(*df.columns), F.lit(parts)).cast("int"))
    for other, n in others:
        out = out.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out
