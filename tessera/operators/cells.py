"""Cells of unit vectors around pivots, and products of two sides in blocks of bounded size.

Angles between unit vectors are a metric. If y lies in the cell of its nearest pivot c, at
most R from it, then a vector x of another cell, r from its own pivot, can be within an angle t
of y only if angle(x, c) <= R + t, and only if angle(x, c) <= r + 2 t, as y is no nearer to x's pivot
than to c. Both tests keep every pair that counts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Added to every bound of an angle, for the rounding of products and arc cosines.
SLACK = 1e-6


def unit(vectors) -> np.ndarray:
    """Rows of length one, as doubles; a zero vector stays zero."""
    m = np.stack([np.asarray(v, float) for v in vectors]) if len(vectors) else np.zeros((0, 0))
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def block_counts(rows: DataFrame, keys: list[str], name: str, size: int) -> DataFrame:
    """(keys, name): how many blocks of about ``size`` rows each key's rows are cut into."""
    return rows.groupBy(*keys).agg(F.greatest(F.ceil(F.count("*") / size), F.lit(1)).cast("int").alias(name))


def block_of(count: Column, *row: Column) -> Column:
    """The block of a row, by a hash of what names it."""
    return F.pmod(F.xxhash64(*row), count).cast("int")


def every(count: Column) -> Column:
    """One row for each number below ``count``; none if it is 0 or null."""
    return F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")))
