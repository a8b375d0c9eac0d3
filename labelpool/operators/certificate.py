"""How far a linear hinge model is from the best one, proven by one aggregate over the rows.

The objective is mean hinge loss + alpha / 2 |w|^2, the intercept free of penalty. Any row weights
a in [0, 1] whose class totals agree give the lower bound

    mean(a) - alpha / 2 |v|^2   with   v = sum(a * s * x) / (alpha * n),   s = 2y - 1,

on every model's objective. Row weights are read off the margins: rows inside the margin weigh 1,
rows outside 0, and those within a width of it something between. All widths are tried in one pass,
class totals are evened out by scaling the heavier class, and the best bound counts. The row
weights do not depend on alpha, so one pass certifies a model for any number of penalties.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelpool.functions.vectors import dot
from labelpool.operators.models import ScoringModel
from labelpool.operators.moments import array_literal

#: Widths around the margin over which row weights fall from 1 to 0; 0 is a step.
WIDTHS = (0.0, 0.03, 0.1, 0.3, 1.0, 3.0)


@dataclass
class Certificate:
    """``dual <= best objective <= objective``; ``subgradient`` is the length of one subgradient."""

    alpha: float
    objective: float
    dual: float
    subgradient: float

    @property
    def gap(self) -> float:
        return self.objective - self.dual


def hinge_weights(model: ScoringModel) -> tuple[list[float], float]:
    """``(w, b)`` of a fitted hinge model."""
    return model.model.coefficients.toArray().tolist(), float(model.model.intercept)


def row_weight(margin: Column, width: float) -> Column:
    """The weight of a row with signed ``margin``, between 0 and 1."""
    if width == 0:
        return F.when(margin < 1, 1.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + (1 - margin) / width))


def _times(a: Column):
    return lambda v: v * a


def hinge_certificates(
    rows: DataFrame, w: Sequence[float], b: float, alphas: Sequence[float],
    widths: Sequence[float] = WIDTHS,
) -> list[Certificate]:
    """A certificate of the model ``(w, b)`` on ``rows (x, y)`` for every penalty of ``alphas``.

    Rows without ``x`` or ``y`` are left out; without any row the list is empty. With one class
    only the row weights are all 0 and the bound is 0, which a model of large intercept reaches.
    """
    if not all(a > 0 for a in alphas):
        raise ValueError("a bound needs penalties above 0")
    signed = rows.where("x IS NOT NULL AND y IS NOT NULL").select(
        "y",
        "x",
        ((2 * F.col("y") - 1) * (dot(F.col("x"), array_literal(w)) + F.lit(float(b)))).alias("m"),
    )
    sums = [F.count(F.lit(1)).alias("n"), F.sum(F.greatest(F.lit(0.0), 1 - F.col("m"))).alias("loss")]
    for i, width in enumerate(widths):
        a = row_weight(F.col("m"), width)
        sums += [
            F.sum(a).alias(f"a{i}"),
            vector_to_array(Summarizer.sum(array_to_vector(F.transform("x", _times(a))))).alias(f"x{i}"),
        ]
    classes = {r["y"]: r for r in signed.groupBy("y").agg(*sums).collect()}
    if not classes:
        return []
    if not set(classes) <= {0, 1}:
        raise ValueError(f"the model knows the classes 0 and 1, not {sorted(classes)}")
    return _bounds(classes, np.array(w, dtype=float), alphas, widths)


def _bounds(classes: dict, w: np.ndarray, alphas, widths) -> list[Certificate]:
    n = sum(r["n"] for r in classes.values())
    loss = sum(r["loss"] for r in classes.values()) / n

    def total(y: int, i: int) -> tuple[float, np.ndarray]:
        if y not in classes:
            return 0.0, np.zeros(len(w))
        return classes[y][f"a{i}"], np.array(classes[y][f"x{i}"])

    directions = []
    for i in range(len(widths)):
        (a0, x0), (a1, x1) = total(0, i), total(1, i)
        even = min(a0, a1)
        if even > 0:
            directions.append((2 * even / n, (x1 * even / a1 - x0 * even / a0) / n))
    steps = [total(y, list(widths).index(0.0)) for y in (0, 1)] if 0.0 in widths else None
    out = []
    for alpha in alphas:
        dual = 0.0
        for mean, v in directions:
            # Row weights may also be scaled down together; the best scale is known.
            curve = float(v @ v) / alpha
            scale = 1.0 if curve <= mean else mean / curve
            dual = max(dual, scale * mean - scale * scale * curve / 2)
        subgradient = float("nan")
        if steps is not None:
            (a0, x0), (a1, x1) = steps
            subgradient = float(np.linalg.norm(np.r_[alpha * w - (x1 - x0) / n, (a0 - a1) / n]))
        out.append(Certificate(alpha, loss + alpha / 2 * float(w @ w), dual, subgradient))
    return out
