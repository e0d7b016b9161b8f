"""Small-sample statistics as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of a share, clamped to [0, 1]; (0, 1) where n is 0."""
    m = F.nullif(n, F.lit(0)).cast("double")
    p = k / m
    d = 1.0 + z * z / m
    centre = (p + z * z / (2.0 * m)) / d
    half = z * F.sqrt(p * (1.0 - p) / m + z * z / (4.0 * m * m)) / d
    low = F.coalesce(F.greatest(F.lit(0.0), centre - half), F.lit(0.0))
    high = F.coalesce(F.least(F.lit(1.0), centre + half), F.lit(1.0))
    return low, high


def dirichlet(n: Column, total: Column, kinds: Column, alpha: float = 0.5) -> Column:
    """Share smoothed by a symmetric prior over `kinds` outcomes."""
    return (n + alpha) / (total + alpha * kinds)

