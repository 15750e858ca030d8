"""Vector columns (``array<float|double>``).

Wide-vector arithmetic goes through Arrow batches and one NumPy call per batch:
higher-order SQL functions are interpreted element by element and cost far more
from a few dozen dimensions on. Reshaping (slice, concat) stays a SQL expression.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_matrix(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """List array -> (matrix of the valid rows, validity mask); rows of unequal length are refused."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    valid = arr.is_valid().to_numpy(zero_copy_only=False)
    rows = arr if arr.null_count == 0 else arr.drop_null()
    sizes = pc.list_value_length(rows).to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError(f"vectors of unequal length: {sizes.min()} to {sizes.max()}")
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(rows), -1 if len(flat) else 0) if len(rows) else flat.reshape(0, 0), valid


def to_segments(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """List array -> (values end to end, length of each valid row, validity mask); lengths may differ."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    valid = arr.is_valid().to_numpy(zero_copy_only=False)
    rows = arr if arr.null_count == 0 else arr.drop_null()
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat, pc.list_value_length(rows).to_numpy(zero_copy_only=False).astype(np.int64), valid


def segment_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each row's values; 0 for an empty row."""
    out = np.zeros(len(sizes))
    some = sizes > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some])
    return out


def from_matrix(matrix: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Inverse of :func:`to_matrix`; invalid rows become NULL."""
    lengths = np.where(valid, matrix.shape[1] if matrix.size else 0, 0)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    mask = None if valid.all() else pa.array(~valid)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.reshape(-1)), mask=mask)


def scatter(values: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Per-row scalars of the valid rows -> array with NULL for the rest."""
    full = np.zeros(len(valid), dtype=values.dtype)
    full[valid] = values
    return pa.array(full, mask=~valid)


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero."""
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm == 0.0, 1.0, norm)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def l2_normalize(v: pa.Array) -> pa.Array:
    """Each row scaled to length one, whatever its dimension; zero rows stay zero."""
    flat, sizes, valid = to_segments(v)
    norm = np.sqrt(segment_sums(flat * flat, sizes))
    full = np.zeros(len(valid), np.int64)
    full[valid] = sizes
    offsets = np.concatenate([[0], np.cumsum(full)]).astype(np.int32)
    scaled = flat / np.repeat(np.where(norm == 0.0, 1.0, norm), sizes)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(scaled), mask=None if valid.all() else pa.array(~valid))


@F.arrow_udf(T.DoubleType())
def vector_norm(v: pa.Array) -> pa.Array:
    flat, sizes, valid = to_segments(v)
    return scatter(np.sqrt(segment_sums(flat * flat, sizes)), valid)


def _pairwise(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    both = pc.and_(a.is_valid(), b.is_valid()) if a.null_count or b.null_count else None
    if both is not None:
        valid = both.to_numpy(zero_copy_only=False)
        a, b = a.filter(both), b.filter(both)
    else:
        valid = np.ones(len(a), dtype=bool)
    return to_matrix(a)[0], to_matrix(b)[0], valid


@F.arrow_udf(T.DoubleType())
def cosine(a: pa.Array, b: pa.Array) -> pa.Array:
    """Cosine of two vector columns; 0 where either vector is zero."""
    x, y, valid = _pairwise(a, b)
    return scatter((unit_rows(x) * unit_rows(y)).sum(axis=1), valid)


@F.arrow_udf(T.DoubleType())
def euclidean(a: pa.Array, b: pa.Array) -> pa.Array:
    x, y, valid = _pairwise(a, b)
    return scatter(np.sqrt(((x - y) ** 2).sum(axis=1)), valid)


def softmax(logits: str | Column) -> Column:
    """Max-shifted softmax of a short array column, which is computed once for a row."""
    arr = F.col(logits) if isinstance(logits, str) else logits
    exps = _bound(arr, lambda a: _bound(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x - top))))
    return _bound(exps, lambda e: _bound(F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x), lambda total: F.transform(e, lambda x: x / total)))


def _bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with the value computed once: an expression inside a lambda would be computed for every element."""
    return F.transform(F.array(value), fn)[0]


def argmax(arr: str | Column) -> Column:
    """Index of the largest element; the first one on ties."""
    arr = F.col(arr) if isinstance(arr, str) else arr
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def last_block(arr: str | Column, width: int) -> Column:
    """The last ``width`` elements, e.g. one layer of a multi-layer vector."""
    return F.slice(arr, F.lit(-width), F.lit(width))


def append_position(arr: str | Column, row: Column, col: Column, grid: int, weight: float) -> Column:
    """Vector with its weighted grid position appended, normalised again."""
    arr = F.col(arr) if isinstance(arr, str) else arr
    where = F.array((row / F.lit(float(grid))) * weight, (col / F.lit(float(grid))) * weight)
    return l2_normalize(F.concat(arr.cast("array<double>"), where))
