"""Uncertainty of one row from its class probabilities (``ARRAY<DOUBLE>``) or its margin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def top_two_gap(prob: Column) -> Column:
    """Highest minus second highest probability."""
    ranked = F.sort_array(prob, asc=False)
    return F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1))


def entropy(prob: Column) -> Column:
    """Entropy in bits; a class of probability zero adds nothing."""
    term = lambda p: F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0))
    return F.aggregate(prob, F.lit(0.0), lambda acc, p: acc - term(p))


def least_confidence(prob: Column) -> Column:
    return F.lit(1.0) - F.array_max(prob)


def bias_boundary(positive_share: Column) -> Column:
    """Mean of one half and the negative share of the labeled rows."""
    return (F.lit(0.5) + (F.lit(1.0) - positive_share)) / 2


def dynamic_bias_boundary(positive_share: Column, labeled_ratio: Column) -> Column:
    """As above, weighed by how much of the initial pool is labeled."""
    return (1 - labeled_ratio) * (1 - positive_share) + labeled_ratio * 0.5


def biased_confidence(q: Column, boundary: Column) -> Column:
    """Piecewise linear score that peaks at ``boundary``; NULL where the boundary is zero."""
    return F.when(q < boundary, F.try_divide(q, boundary)).otherwise(
        F.try_divide(1 - q, boundary)
    )
