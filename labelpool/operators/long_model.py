"""The closed-form discriminant on long features ``(id, feature, value)``, for all folds at once.

The model of ``operators/moments`` needs nothing but sums per class and feature, which
``select.training_sums`` gives for the training side of every fold. So models over millions of
features are fitted and applied without a vector, a pass for each fold, or a weight on the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelpool.operators.evaluate import auc
from labelpool.operators.select import class_sums
from labelpool.plans.lookup import split_lookup
from labelpool.session import materialise

# Equal margins must be equal whatever the order of summation was.
MARGIN_DIGITS = 9


def fold_weights(sums: DataFrame) -> DataFrame:
    """``(fold, feature, rows, n0, n1, w, mid)`` from training sums; features may be left out of
    ``sums`` by a selection. A feature without variance has weight 0."""
    n0, n1, s0, s1 = (F.col(c) for c in ("n0", "n1", "s0", "s1"))
    mean0, mean1 = F.try_divide(s0, n0), F.try_divide(s1, n1)
    within = F.col("ss") - s0 * mean0 - s1 * mean1
    variance = F.try_divide(within, F.greatest(n0 + n1 - 2, F.lit(1.0)))
    weight = F.when((variance > 1e-300) & (n0 + n1 > 2), (mean1 - mean0) / variance).otherwise(0.0)
    return sums.select(
        "fold", "feature", "rows", "n0", "n1", weight.alias("w"), ((mean0 + mean1) / 2).alias("mid")
    )


def fold_margins(features: DataFrame, labels: DataFrame, weights: DataFrame) -> DataFrame:
    """``(fold, id, y, margin)``: every labeled row under the model that its fold was held out of.

    A row without a kept feature has the intercept as margin. A fold without any kept feature, or
    whose training side has one class only, has no margin.
    """
    weights = materialise(weights, "fold-weights")
    bias = weights.groupBy("fold").agg(
        (F.ln(F.try_divide(F.first("n1"), F.first("n0"))) - F.sum(F.col("w") * F.col("mid"))).alias("b")
    )
    by_feature = weights.groupBy("feature").agg(
        F.map_from_entries(F.collect_list(F.struct("fold", "w"))).alias("_w"), F.max("rows").alias("_rows")
    )
    by_feature = materialise(by_feature, "weights")
    home = labels.where("y IS NOT NULL").select("id", "y", F.col("fold").cast("int").alias("fold"))
    rows = features.select("id", "feature", "value").join(home.select("id", "fold"), "id")
    found = split_lookup(materialise(rows, "labeled-rows"), by_feature, "feature", F.col("_rows"), "id")
    dots = found.groupBy("id").agg(
        F.sum(F.col("value") * F.coalesce(F.element_at("_w", F.col("fold")), F.lit(0.0))).alias("dot")
    )
    margin = F.round(F.coalesce("dot", F.lit(0.0)) + F.col("b"), MARGIN_DIGITS)
    return (
        home.join(dots, "id", "left").join(bias, "fold", "left").select("fold", "id", "y", margin.alias("margin"))
    )


def fold_model_auc(features: DataFrame, labels: DataFrame, sums: DataFrame) -> DataFrame:
    """``(fold, features, auc)``: cross-validation of the discriminant over the features in ``sums``."""
    weights = materialise(fold_weights(sums), "fold-weights")
    sizes = weights.groupBy("fold").agg(F.count(F.lit(1)).alias("features"))
    scored = fold_margins(features, labels, weights)
    return auc(scored, "margin", by=["fold"]).select("fold", "auc").join(sizes, "fold").select(
        "fold", "features", "auc"
    )


class LongDiscriminantModel:
    """A fitted discriminant whose weights are a table."""

    def __init__(self, features: DataFrame, weights: DataFrame, bias: float | None):
        self.features, self.weights, self.bias = features, weights, bias

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``margin`` and ``prob`` to ``(id, ...)``; both NULL if the training rows had one
        class only. A row without features has the intercept as margin."""
        if self.bias is None:
            return df.withColumns(
                {"margin": F.lit(None).cast("double"), "prob": F.lit(None).cast("array<double>")}
            )
        found = split_lookup(self.features, self.weights, "feature", F.col("rows"), "id")
        dots = found.groupBy("id").agg(F.sum(F.col("value") * F.col("w")).alias("_dot"))
        scored = df.join(dots, "id", "left").withColumn("margin", F.coalesce("_dot", F.lit(0.0)) + F.lit(self.bias))
        p1 = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin")))
        return scored.withColumn("prob", F.array(1 - p1, p1)).drop("_dot")


class LongDiscriminant:
    """``moments.Discriminant`` for rows whose features are a written long table: no row is ever as
    wide as there are features, and no weight reaches the driver."""

    def __init__(self, features: DataFrame):
        self.features = features

    def fit(self, labeled: DataFrame) -> LongDiscriminantModel:
        """``labeled`` is ``(id, y)``."""
        n = {r["y"]: r["count"] for r in labeled.groupBy("y").count().collect()}
        for y in n:
            if y not in (0, 1):
                raise ValueError(f"the model knows the classes 0 and 1, not {y!r}")
        sums = class_sums(self.features, labeled).withColumn("fold", F.lit(0))
        weights = materialise(fold_weights(sums).select("feature", "rows", "w", "mid"), "weights")
        if len(n) < 2:
            return LongDiscriminantModel(self.features, weights, None)
        shift = weights.agg(F.sum(F.col("w") * F.col("mid"))).first()[0] or 0.0
        return LongDiscriminantModel(self.features, weights, math.log(n[1] / n[0]) - shift)
