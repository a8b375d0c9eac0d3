"""Additive per-class moments and the diagonal linear discriminant built on them.

``(count, sum x, sum x*x)`` per class can be added up over batches, streams and rounds. The
discriminant needs nothing else: w = (mean1 - mean0) / pooled variance per dimension,
b = ln(n1/n0) - w.(mean1 + mean0)/2, margin = w.x + b, p = 1/(1 + exp(-margin)).

The sums are aggregated by Spark; what reaches the driver are two rows of d numbers per model,
as with the coefficients of any Spark ML model.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from labelpool.functions.vectors import dot


def class_moments(df: DataFrame, by: Sequence[str] = (), x: str = "x", y: str = "y") -> DataFrame:
    """``(*by, y, n, s1, s2)`` with array sums; one pass, partial sums before the shuffle."""
    squares = F.transform(F.col(x), lambda v: v * v)
    parts = df.select(
        *by, F.col(y).alias("y"), array_to_vector(x).alias("v1"), array_to_vector(squares).alias("v2")
    )
    return parts.groupBy(*by, "y").agg(
        F.count("*").alias("n"),
        vector_to_array(Summarizer.sum(F.col("v1"))).alias("s1"),
        vector_to_array(Summarizer.sum(F.col("v2"))).alias("s2"),
    )


@dataclass
class Sums:
    """Moments of one model: per class, the rows, the sum and the sum of squares."""

    n: list[int]
    s1: list[np.ndarray | float]
    s2: list[np.ndarray | float]

    @staticmethod
    def of(rows: Iterable[Row]) -> "Sums":
        out = Sums([0, 0], [0.0, 0.0], [0.0, 0.0])
        for r in rows:
            if r["y"] not in (0, 1):
                raise ValueError(f"the model knows the classes 0 and 1, not {r['y']!r}")
            out.n[r["y"]] += r["n"]
            out.s1[r["y"]] = out.s1[r["y"]] + np.array(r["s1"])
            out.s2[r["y"]] = out.s2[r["y"]] + np.array(r["s2"])
        return out

    def __add__(self, other: "Sums") -> "Sums":
        return Sums(
            [a + b for a, b in zip(self.n, other.n)],
            [a + b for a, b in zip(self.s1, other.s1)],
            [a + b for a, b in zip(self.s2, other.s2)],
        )

    def weights(self) -> tuple[list[float] | None, float | None]:
        """``(w, b)``, or ``(None, None)`` without rows of both classes."""
        n0, n1 = self.n
        if not n0 or not n1:
            return None, None
        mean0, mean1 = self.s1[0] / n0, self.s1[1] / n1
        within = self.s2[0] - self.s1[0] * mean0 + (self.s2[1] - self.s1[1] * mean1)
        variance = within / max(n0 + n1 - 2, 1)
        usable = variance > 1e-300 if n0 + n1 > 2 else np.zeros_like(variance, dtype=bool)
        w = np.divide(mean1 - mean0, variance, out=np.zeros_like(variance), where=usable)
        return w.tolist(), float(math.log(n1 / n0) - w @ (mean1 + mean0) / 2)


def margin_and_prob(df: DataFrame, w: Column, b: Column, x: str = "x") -> DataFrame:
    """Add ``margin`` and ``prob`` = [p(y=0), p(y=1)]."""
    margin = dot(F.col(x), w) + b
    p1 = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin")))
    return df.withColumn("margin", margin).withColumn("prob", F.array(1 - p1, p1))


def array_literal(values: Sequence[float]) -> Column:
    """A constant array, built in one step instead of one expression per element."""
    return F.expr(f"array({', '.join(repr(float(v)) + 'D' for v in values)})")


class DiscriminantModel:
    """A fitted discriminant."""

    def __init__(self, sums: Sums, x: str = "x"):
        self.sums, self.x = sums, x
        self.w, self.b = sums.weights()

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``margin`` and ``prob``; both NULL if the training rows had one class only."""
        if self.w is None:
            return df.withColumns(
                {
                    "margin": F.lit(None).cast("double"),
                    "prob": F.lit(None).cast("array<double>"),
                }
            )
        return margin_and_prob(df, array_literal(self.w), F.lit(self.b), self.x)

    def partial_fit(self, df: DataFrame) -> "DiscriminantModel":
        """The model of the rows seen so far and ``df`` together."""
        return DiscriminantModel(self.sums + Sums.of(class_moments(df, x=self.x).collect()), self.x)


class Discriminant:
    """Estimator of the closed-form model, with the fit / transform shape of Spark ML."""

    def __init__(self, x: str = "x", y: str = "y"):
        self.x, self.y = x, y

    def fit(self, df: DataFrame) -> DiscriminantModel:
        return DiscriminantModel(Sums.of(class_moments(df, x=self.x, y=self.y).collect()), self.x)
