"""Vector expressions and the Arrow helpers of the numpy kernels."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

DISTANCE_DIGITS = 12  # distances are compared at this precision, so equal vectors tie exactly and the id decides


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, in double precision, for joins that are already one row per pair."""
    return F.round(F.lit(1.0) - dot(a, b) / (norm(a) * norm(b)), DISTANCE_DIGITS)


def vector_error(v: Column, dims: int) -> Column:
    """Why a vector is not usable, or null: wrong length, not finite, all zero."""
    finite = F.forall(v, lambda x: ~(F.isnan(x) | x.isNull() | (F.abs(x) == float("inf"))))
    return (F.when(v.isNull() | (F.size(v) != dims), "DIMENSION_MISMATCH")
            .when(~finite, "NON_FINITE_EMBEDDING")
            .when(F.forall(v, lambda x: x == 0), "NON_FINITE_EMBEDDING"))


def normalized(v: Column) -> Column:
    """Unit-length float32 vector."""
    return F.transform(v, lambda x: (x.cast("double") / norm(v)).cast("float"))


@F.pandas_udf(T.StringType())
def encode_vector(values: pd.Series) -> pd.Series:
    """Base64 of the little-endian float32 bytes."""
    return values.map(lambda v: base64.b64encode(np.asarray(v, dtype="<f4").tobytes()).decode("ascii"),
                      na_action="ignore")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vector(values: pd.Series) -> pd.Series:
    """The inverse of :func:`encode_vector`."""
    return values.map(lambda s: np.frombuffer(base64.b64decode(s), dtype="<f4"), na_action="ignore")


def unit_rows(grid: np.ndarray) -> np.ndarray:
    """Rows of length one; a row of zeros stays."""
    lengths = np.linalg.norm(grid, axis=1, keepdims=True)
    return grid / np.where(lengths == 0, 1.0, lengths)


def matrix(column: pa.Array | pa.ChunkedArray, unit: bool = True) -> np.ndarray:
    """Arrow list<float> column to a float64 matrix, of unit rows unless told otherwise (no Python object per row); all rows
    must be as long."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0)
    rows = len(column)
    sizes = np.diff(column.offsets.to_numpy()) if rows and hasattr(column, "offsets") else np.zeros(0, int)
    if column.null_count or (len(sizes) and sizes.min() != sizes.max()):
        raise ValueError(f"DIMENSION_MISMATCH: vectors of {sizes.min()} to {sizes.max()} values, {column.null_count} missing")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    grid = flat.reshape(rows, -1) if rows else flat.reshape(0, 0)
    return unit_rows(grid) if unit and rows else grid
