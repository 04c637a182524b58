"""Vectors as array columns and as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vec: Column) -> Column:
    """Whether a vector isn't null and holds neither nulls nor NaN nor infinities; an empty one is finite."""
    return F.coalesce(F.forall(vec.cast("array<double>"), lambda c: F.coalesce((~F.isnan(c)) & (F.abs(c) < float("inf")), F.lit(False))), F.lit(False))


def dimension(rows: DataFrame, vec_col: str) -> int:
    """The length of the longest vector; 0 without rows."""
    return rows.agg(F.max(F.size(vec_col))).first()[0] or 0


def padded(vec: Column, dim: int, fill: Column) -> Column:
    """``vec`` with ``fill`` behind a shorter one."""
    return F.when(F.size(vec) == dim, vec).otherwise(F.concat(vec, F.array_repeat(fill, F.lit(dim) - F.size(vec))))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of a list column without nulls, all of length ``dim``."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)
