"""Arithmetic and distances over ``ARRAY<DOUBLE>`` columns.

Every distance is a plain Column expression over two array columns. A quotient with a zero
denominator gives NULL (``try_divide``); callers decide whether that is an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Distance = Callable[[Column, Column], Column]


def total(values: Column) -> Column:
    """Sum of an array of doubles."""
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def mean(values: Column) -> Column:
    return F.try_divide(total(values), F.size(values))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda p, q: p * q))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda v: v * v)))


def centred(a: Column) -> Column:
    mid = mean(a)
    return F.transform(a, lambda v: v - mid)


def sqeuclidean(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(sqeuclidean(a, b))


def cityblock(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda p, q: F.abs(p - q)))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda p, q: F.abs(p - q)))


def minkowski(a: Column, b: Column, p: float = 2.0) -> Column:
    powers = F.zip_with(a, b, lambda u, v: F.pow(F.abs(u - v), F.lit(float(p))))
    return F.pow(total(powers), F.lit(1.0 / float(p)))


def canberra(a: Column, b: Column) -> Column:
    term = F.zip_with(
        a,
        b,
        lambda p, q: F.coalesce(F.try_divide(F.abs(p - q), F.abs(p) + F.abs(q)), F.lit(0.0)),
    )
    return total(term)


def braycurtis(a: Column, b: Column) -> Column:
    return F.try_divide(cityblock(a, b), total(F.zip_with(a, b, lambda p, q: F.abs(p + q))))


def cosine(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def correlation(a: Column, b: Column) -> Column:
    return cosine(centred(a), centred(b))


def hamming(a: Column, b: Column) -> Column:
    return mean(F.zip_with(a, b, lambda p, q: (p != q).cast("double")))


def jaccard(a: Column, b: Column) -> Column:
    differ = total(F.zip_with(a, b, lambda p, q: (p != q).cast("double")))
    present = total(F.zip_with(a, b, lambda p, q: ((p != 0) | (q != 0)).cast("double")))
    return F.coalesce(F.try_divide(differ, present), F.lit(0.0))


def jensenshannon(a: Column, b: Column) -> Column:
    """Square root of the Jensen-Shannon divergence of the two vectors scaled to sum 1."""
    sum_a, sum_b = total(a), total(b)
    pairs = F.zip_with(
        a,
        b,
        lambda p, q: F.struct(
            F.try_divide(p, sum_a).alias("p"), F.try_divide(q, sum_b).alias("q")
        ),
    )

    def part(share: Column, other: Column) -> Column:
        half = (share + other) / 2
        return F.when(share > 0, share * F.ln(share / half)).otherwise(
            F.when(share == 0, F.lit(0.0))
        )

    terms = F.transform(pairs, lambda s: part(s["p"], s["q"]) + part(s["q"], s["p"]))
    return F.sqrt(F.greatest(total(terms), F.lit(0.0)) / 2)


def truth_counts(a: Column, b: Column) -> tuple[Column, Column, Column, Column]:
    """How many positions are (both set, only a, only b, neither); non-zero means set."""

    def count(test: Callable[[Column, Column], Column]) -> Column:
        return total(F.zip_with(a, b, lambda p, q: test(p != 0, q != 0).cast("double")))

    return (
        count(lambda p, q: p & q),
        count(lambda p, q: p & ~q),
        count(lambda p, q: ~p & q),
        count(lambda p, q: ~p & ~q),
    )


def dice(a: Column, b: Column) -> Column:
    tt, tf, ft, _ = truth_counts(a, b)
    return F.try_divide(tf + ft, 2 * tt + tf + ft)


def rogerstanimoto(a: Column, b: Column) -> Column:
    tt, tf, ft, ff = truth_counts(a, b)
    return F.try_divide(2 * (tf + ft), tt + ff + 2 * (tf + ft))


def russellrao(a: Column, b: Column) -> Column:
    tt, _, _, _ = truth_counts(a, b)
    return F.try_divide(F.size(a) - tt, F.size(a))


def sokalsneath(a: Column, b: Column) -> Column:
    tt, tf, ft, _ = truth_counts(a, b)
    return F.try_divide(2 * (tf + ft), tt + 2 * (tf + ft))


def yule(a: Column, b: Column) -> Column:
    tt, tf, ft, ff = truth_counts(a, b)
    mixed = tf * ft
    return F.when(mixed == 0, F.lit(0.0)).otherwise(F.try_divide(2 * mixed, tt * ff + mixed))


def kulczynski1(a: Column, b: Column) -> Column:
    tt, tf, ft, _ = truth_counts(a, b)
    return F.try_divide(tt, tf + ft)


def kulsinski(a: Column, b: Column) -> Column:
    tt, tf, ft, _ = truth_counts(a, b)
    return F.try_divide(tf + ft - tt + F.size(a), tf + ft + F.size(a))


# Metrics that need nothing but the two vectors. `seuclidean` and `mahalanobis` become
# `euclidean` once the vectors are rescaled, see operators/spaces.py.
DISTANCES: dict[str, Distance] = {
    "euclidean": euclidean,
    "sqeuclidean": sqeuclidean,
    "cityblock": cityblock,
    "chebyshev": chebyshev,
    "minkowski": minkowski,
    "canberra": canberra,
    "braycurtis": braycurtis,
    "cosine": cosine,
    "correlation": correlation,
    "hamming": hamming,
    "matching": hamming,
    "jaccard": jaccard,
    "jensenshannon": jensenshannon,
    "dice": dice,
    "rogerstanimoto": rogerstanimoto,
    "sokalmichener": rogerstanimoto,
    "russellrao": russellrao,
    "sokalsneath": sokalsneath,
    "yule": yule,
    "kulczynski1": kulczynski1,
    "kulsinski": kulsinski,
}


def distance(metric: str, a: Column, b: Column) -> Column:
    if metric not in DISTANCES:
        raise ValueError(f"unknown distance metric {metric!r}")
    return DISTANCES[metric](a, b)


def guarded(d: Column, what: str) -> Column:
    """``d``, or a failing job when it is NULL or NaN."""
    return F.when(
        d.isNull() | F.isnan(d), F.raise_error(F.lit(f"undefined distance in {what}"))
    ).otherwise(d)


def similarity(d: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + d)
