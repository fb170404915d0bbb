"""Closed-form intervals for proportions."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def z_of(level: float) -> float:
    """Two-sided normal quantile of a confidence level."""
    return NormalDist().inv_cdf(0.5 + level / 2.0)


def wilson(x: Column, n: Column, z: float) -> tuple[Column, Column]:
    """Wilson score interval of ``x / n``; NULL without observations."""
    p = x / n
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    low = F.when(x <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half))
    high = F.when(x >= n, 1.0).otherwise(F.least(F.lit(1.0), centre + half))
    return F.when(n > 0, low), F.when(n > 0, high)


def newcombe(x1: Column, n1: Column, x2: Column, n2: Column, z: float) -> tuple[Column, Column]:
    """Newcombe's hybrid score interval of the difference of two proportions."""
    p1, p2 = x1 / n1, x2 / n2
    l1, u1 = wilson(x1, n1, z)
    l2, u2 = wilson(x2, n2, z)
    d = p1 - p2
    low = F.greatest(F.lit(-1.0), d - F.sqrt((p1 - l1) * (p1 - l1) + (u2 - p2) * (u2 - p2)))
    high = F.least(F.lit(1.0), d + F.sqrt((u1 - p1) * (u1 - p1) + (p2 - l2) * (p2 - l2)))
    both = (n1 > 0) & (n2 > 0)
    return F.when(both, low), F.when(both, high)
