"""Exact arithmetic on vectors that were scaled and floored to integers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """Whether an array is there and holds neither nulls nor non-finite numbers."""
    column = F.col(f"`{vector}`")
    return column.isNotNull() & F.forall(column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))


def as_numbers(vectors: DataFrame, vector_col: str) -> Column:
    """Floats stay floats, as they take half the room; all other numbers become doubles."""
    column = F.col(f"`{vector_col}`")
    floats = vectors.select(column).schema[0].dataType.simpleString() == "array<float>"
    return column if floats else column.cast("array<double>")


def floored(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): int64 where all products fit one with room to spare, else Python's integers. The scale is a power of two,
    so a product is exact but for an overflow."""
    x = x.astype(np.float64)
    if not x.size or np.abs(x).max() < 2.0**52 / scale:
        return np.floor(scale * x).astype(np.int64)
    exact = np.empty(x.shape, object)
    exact.ravel()[:] = [int(v) * scale if abs(v) >= 2.0**52 else int(np.floor(v * scale)) for v in x.ravel().tolist()]
    return exact


def largest(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


def fitting(most: int, *arrays: np.ndarray) -> list[np.ndarray]:
    """The integer arrays in the fastest kind in which sums up to ``most`` are exact: doubles, 64-bit integers or Python's."""
    if most < 2**53:
        return [a.astype(np.float64) for a in arrays]
    return [a.astype(np.int64 if most < 2**63 else object) for a in arrays]


def as_long(value: int) -> int | None:
    """None where a number doesn't fit a long."""
    return int(value) if -(2**63) <= value < 2**63 else None
