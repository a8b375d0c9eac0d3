"""Logistic models of few features by Newton steps, many models in one pass a step.

A step is one aggregate over the rows: loss, gradient and Hessian of every model are sums over its
rows, so partial sums leave the tasks and d * d numbers a model reach the driver, which solves for
the step. The steps are the same on every engine, so the result can be checked to the last digits.
Platt scaling is the case of one feature, the margin.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelpool.functions.vectors import dot
from labelpool.operators.moments import Discriminant, array_literal
from labelpool.session import materialise

STEPS, TOLERANCE = 50, 1e-10


@dataclass
class Fitted:
    """Weights ``w``, intercept ``b``, mean penalised ``loss``, Newton ``steps`` taken."""

    w: list[float]
    b: float
    loss: float
    steps: int


def newton_fits(
    rows: DataFrame, alphas: dict[object, float], model: str | None = None, steps: int = STEPS,
    tolerance: float = TOLERANCE,
) -> dict[object, Fitted]:
    """One logistic model for each key of ``alphas``: mean log loss plus alpha / 2 |w|^2, the
    intercept free of penalty.

    ``rows`` is ``(x, y)`` and the column ``model`` that says to which model a row belongs; without
    ``model`` every row belongs to every model. All start at zero. A step that would raise the loss
    is halved until it does not; a model rests when no part of a step is above ``tolerance``.
    A model whose rows have one class only, or none, is left out.
    """
    rows = rows.where("y IS NOT NULL AND x IS NOT NULL")
    sizes = _sizes(rows, alphas, model)
    todo = {m: alphas[m] for m, (n0, n1, _) in sizes.items() if n0 and n1}
    now = {m: np.zeros(sizes[m][2] + 1) for m in todo}
    ask = dict(now)
    best: dict[object, tuple[float, np.ndarray, np.ndarray]] = {}
    taken, done = dict.fromkeys(todo, 0), {}
    for _ in range(4 * steps):
        if not ask:
            break
        for m, (loss, g, h) in _sums(rows, ask, todo, model).items():
            if m in best and not loss <= best[m][0] + 1e-12:
                # Half of the last step.
                ask[m] = (ask[m] + now[m]) / 2
                if np.abs(ask[m] - now[m]).max() <= tolerance:
                    done[m] = best[m][0]
                continue
            now[m], best[m] = ask[m], (loss, g, h)
            step = np.linalg.lstsq(h, g, rcond=None)[0]
            if np.abs(step).max() <= tolerance or taken[m] == steps:
                done[m] = loss
                continue
            taken[m] += 1
            ask[m] = now[m] - step
        ask = {m: w for m, w in ask.items() if m not in done}
    return {
        m: Fitted(now[m][:-1].tolist(), float(now[m][-1]), float(best[m][0]), taken[m]) for m in todo
    }


def _sizes(rows: DataFrame, alphas: dict, model: str | None) -> dict[object, tuple[int, int, int]]:
    made = rows.groupBy(F.lit(0).alias("m") if model is None else F.col(model).alias("m")).agg(
        F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1), F.max(F.size("x"))
    )
    found = {r[0]: (r[1], r[2], r[3]) for r in made.collect()}
    if model is None:
        return {m: found[0] for m in alphas} if found else {}
    return {m: found[m] for m in alphas if m in found}


def _sums(rows: DataFrame, at: dict, alphas: dict, model: str | None) -> dict:
    """Loss, gradient and Hessian of each model at its weights, by one aggregate."""
    names = list(at)
    if model is None:
        keyed = rows.withColumn("_m", F.explode(F.array(*[F.lit(i) for i in range(len(names))])))
    else:
        index = F.lit(None).cast("int")
        for i, m in enumerate(names):
            index = F.when(F.col(model) == F.lit(m), i).otherwise(index)
        keyed = rows.withColumn("_m", index).where("_m IS NOT NULL")
    weights = F.get(F.array(*[array_literal(at[m]) for m in names]), F.col("_m"))
    x = F.concat(F.col("x").cast("array<double>"), F.array(F.lit(1.0)))
    keyed = keyed.select("_m", "y", x.alias("x"), weights.alias("w"))
    keyed = keyed.withColumn("z", dot(F.col("x"), F.col("w")))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("z")))
    loss = F.log1p(F.exp(-F.abs("z"))) + F.greatest("z", F.lit(0.0)) - F.col("y") * F.col("z")
    gradient = F.transform("x", lambda v: v * (p - F.col("y")))
    curvature = p * (1 - p)
    hessian = F.flatten(F.transform("x", lambda u: F.transform(F.col("x"), lambda v: u * v * curvature)))
    packed = F.concat(F.array(F.lit(1.0), loss), gradient, hessian)
    sums = keyed.select("_m", array_to_vector(packed).alias("v")).groupBy("_m").agg(
        vector_to_array(Summarizer.sum(F.col("v"))).alias("s")
    )
    out = {}
    for row in sums.collect():
        m, s = names[row["_m"]], np.array(row["s"])
        w, d = at[m], len(at[m])
        penalty = np.r_[np.full(d - 1, alphas[m]), 0.0]
        loss, s = s[1] / s[0] + (penalty * w * w).sum() / 2, s / s[0]
        out[m] = (loss, s[2 : 2 + d] + penalty * w, s[2 + d :].reshape(d, d) + np.diag(penalty))
    return out


def add_probability(df: DataFrame, w: list[float], b: float, x: Column) -> DataFrame:
    """Add ``prob`` = [p(y=0), p(y=1)] for the margin w.x + b."""
    p1 = F.lit(1.0) / (F.lit(1.0) + F.exp(-(dot(x, array_literal(w)) + F.lit(b))))
    return df.withColumn("_p", p1).withColumn("prob", F.array(1 - F.col("_p"), F.col("_p"))).drop("_p")


class NewtonModel:
    def __init__(self, fitted: Fitted | None):
        self.fitted = fitted

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``margin`` and ``prob``, NULL if the training rows had one class only."""
        if self.fitted is None:
            return df.withColumns(
                {"margin": F.lit(None).cast("double"), "prob": F.lit(None).cast("array<double>")}
            )
        x = F.col("x").cast("array<double>")
        margin = dot(x, array_literal(self.fitted.w)) + F.lit(self.fitted.b)
        return add_probability(df.withColumn("margin", margin), self.fitted.w, self.fitted.b, x)


class NewtonLogistic:
    """Logistic regression over ``(x, y)`` with the fit / transform shape of the other models."""

    def __init__(self, alpha: float = 1e-4, steps: int = STEPS):
        self.alpha, self.steps = alpha, steps

    def fit(self, df: DataFrame) -> NewtonModel:
        return NewtonModel(newton_fits(df, {0: self.alpha}, steps=self.steps).get(0))


class PlattModel:
    def __init__(self, base, fitted: Fitted | None):
        self.base, self.fitted = base, fitted

    def transform(self, df: DataFrame) -> DataFrame:
        """``margin`` of the base model; ``prob`` is the calibrated probability."""
        out = self.base.transform(df)
        out = out.drop("prob") if "prob" in out.columns else out
        if self.fitted is None:
            return out.withColumn("prob", F.lit(None).cast("array<double>"))
        return add_probability(out, self.fitted.w, self.fitted.b, F.array("margin"))


class PlattNewton:
    """Any model with margins, and a logistic regression of the label on the margins of the same
    training rows. ``c`` weighs the summed loss, hence 1 / (c * n) on the mean."""

    def __init__(self, base=None, c: float = 1.0, steps: int = STEPS):
        self.base, self.c, self.steps = base or Discriminant(), c, steps

    def fit(self, df: DataFrame) -> PlattModel:
        base = self.base.fit(df)
        rows = materialise(margin_rows(base, df), "margins")
        alpha = 1.0 / (self.c * max(rows.count(), 1))
        return PlattModel(base, newton_fits(rows, {0: alpha}, steps=self.steps).get(0))


def margin_rows(model, df: DataFrame) -> DataFrame:
    """``(x, y)`` with the margin as the only feature."""
    return model.transform(df).where("y IS NOT NULL AND margin IS NOT NULL").select(
        F.array("margin").alias("x"), "y"
    )


def platt_grid(model, df: DataFrame, values: tuple[float, ...], steps: int = STEPS) -> dict[float, Fitted]:
    """The calibrations of one fitted model for several C, all by the same passes."""
    rows = materialise(margin_rows(model, df), "margins")
    n = max(rows.count(), 1)
    return newton_fits(rows, {c: 1.0 / (c * n) for c in values}, steps=steps)
