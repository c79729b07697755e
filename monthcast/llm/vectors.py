"""Vectors in array columns: which of them count, and batches of them as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers; empty vectors are not."""
    inf = F.lit(float("inf"))
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return F.coalesce((F.size(vector) > 0) & whole, F.lit(False))


def dimension(vectors: DataFrame, column: str) -> int:
    """The most frequent length, of equally frequent ones the largest; 0 without rows. One row a length reaches the driver's sort."""
    sizes = vectors.groupBy(F.size(column).alias("d")).count()
    first = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return first.d if first else 0


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of ``dims`` components each as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(len(column), dims)
