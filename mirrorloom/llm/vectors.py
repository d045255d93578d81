"""What the operators on vectors share: tables of whole-number vectors, Arrow to matrices, exact squared distances."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize


def is_sound(vector: str) -> Column:
    """Whether an array column of numbers is there and holds neither null nor NaN nor an infinity."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN counts as larger than any number
    return F.coalesce(F.col(vector).isNotNull() & finite, F.lit(False))


def whole_vectors(vectors: DataFrame, columns: dict[str, str], vec_col: str, scale: int, dim: int | None = None) -> DataFrame:
    """A written table: ``columns`` (new name: column) and v, the vectors' components as floor(scale * x).

    Only sound vectors are in it, and with ``dim`` only those of that many components. Repeated rows stay.
    """
    doubles = vectors.select(*[F.col(c).alias(to) for to, c in columns.items()], F.col(vec_col).cast("array<double>").alias("x"))
    kept = doubles.filter(is_sound("x") if dim is None else (F.size("x") == dim) & is_sound("x"))
    return materialize(kept.select(*columns, F.transform("x", lambda x: F.floor(scale * x)).alias("v")), "vectors")


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column, all of one length and without nulls, as a matrix of 64-bit numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), -1)


def check_size(x: np.ndarray, c: np.ndarray, room: int = 1) -> int:
    """A bound of ``room`` times the squared distances between rows of x and c; raises where 64 bits can't hold it."""
    most = max((max(int(m.max()), -int(m.min())) for m in (x, c) if m.size), default=0)
    bound = 4 * x.shape[1] * most * most * room
    if bound >= 2**63:
        raise ValueError(f"components up to {most} are too large: their squared distances don't fit 64 bits")
    return bound


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared Euclidean distances of all rows of x to all rows of c. In floating point only where that is exact."""
    if check_size(x, c) < 2**53:
        x, c = x.astype(np.float64), c.astype(np.float64)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
