"""Vectors as whole numbers, so that sums, means and distances are exact whatever the order of work."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components may be at most so large after scaling: squared distances of 64 of them fit in a long.
LARGEST = 1 << 27


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers, none null, NaN or infinite."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & F.forall(vector, number), F.lit(False))


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as an array of integers. A component beyond LARGEST is an
    error: the distances that follow from it could not be told in a long."""
    floors = F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)))
    fits = F.forall(floors, lambda q: q.between(-LARGEST, LARGEST))
    return F.when(fits, floors.cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}")).cast("array<int>"))


def floor_means(sums: np.ndarray, counts: np.ndarray, before: np.ndarray) -> np.ndarray:
    """floor(sum / count) by component; rows without a count stay as they were."""
    return np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], before)


def squared_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared Euclidean distance of each row of `x` from each center; both of 64-bit integers."""
    out = np.empty((len(x), len(centers)), np.int64)
    for i, center in enumerate(centers):
        apart = x - center
        out[:, i] = np.einsum("ij,ij->i", apart, apart)
    return out


def digest(numbers: np.ndarray) -> str:
    """Lower-case hex SHA-256 of the numbers in order, in decimal, comma-joined."""
    return hashlib.sha256(",".join(map(str, numbers.ravel().tolist())).encode()).hexdigest()
