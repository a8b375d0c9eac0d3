"""Linear classifiers from Spark ML with one common output: ``margin`` and ``prob``."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelpool.operators.evaluate import auc
from labelpool.operators.splits import test_rows, training_rows
from labelpool.session import materialise

# The grids searched.
C_GRID = (0.75, 0.77, 0.8, 0.85, 0.87)
ALPHA_GRID = (0.0001, 0.001, 0.01, 0.1, 1.0, 10.0)


def with_vector(df: DataFrame, x: str = "x") -> DataFrame:
    """Add ``features`` as an ML vector from an array column."""
    return df.withColumn("features", array_to_vector(x))


def hinge(alpha: float = 1e-4, max_iter: int = 100, tol: float = 1e-3) -> LinearSVC:
    """Mean hinge loss + alpha/2 |w|^2."""
    return LinearSVC(
        featuresCol="features", labelCol="y", regParam=alpha, standardization=False,
        maxIter=max_iter, tol=tol,
    )


def log_loss(alpha: float = 1e-4, max_iter: int = 100, tol: float = 1e-3) -> LogisticRegression:
    return LogisticRegression(
        featuresCol="features", labelCol="y", regParam=alpha, elasticNetParam=0.0,
        standardization=False, maxIter=max_iter, tol=tol,
    )


def linear_svc(c: float, n: int, max_iter: int = 100, tol: float = 1e-3) -> LinearSVC:
    """Penalty ``c`` on the summed loss of ``n`` rows."""
    return hinge(1.0 / (c * n), max_iter, tol)


class ScoringModel:
    """A fitted classifier whose ``transform`` adds ``margin`` and, if it has them, ``prob``."""

    def __init__(self, model: Model, calibration: Model | None = None, x: str | None = "x"):
        self.model, self.calibration, self.x = model, calibration, x

    def transform(self, df: DataFrame) -> DataFrame:
        keep = df.columns
        out = self.model.transform(with_vector(df, self.x) if self.x else df)
        margin = F.get(vector_to_array("rawPrediction"), F.lit(1)).alias("margin")
        if self.calibration is None:
            extra = [vector_to_array("probability").alias("prob")] if "probability" in out.columns else []
            return out.select(*keep, margin, *extra)
        kept = _margin_vector(out.withColumn("margin", margin)).drop(
            "rawPrediction", "prediction"
        )
        scored = self.calibration.transform(kept)
        return scored.select(*keep, "margin", vector_to_array("probability").alias("prob"))


def _margin_vector(df: DataFrame) -> DataFrame:
    slicer = VectorSlicer(inputCol="rawPrediction", outputCol="margin_vector", indices=[1])
    return slicer.transform(df)


class LinearModel:
    """Fit / transform wrapper of a Spark ML estimator over ``(x, y)`` or ``(features, y)``."""

    def __init__(self, estimator: Estimator, x: str | None = "x"):
        self.estimator, self.x = estimator, x

    def fit(self, df: DataFrame) -> ScoringModel:
        rows = with_vector(df, self.x) if self.x else df
        return ScoringModel(self.estimator.fit(rows), None, self.x)


class PlattScaled:
    """Hinge classifier whose margins on the same training rows train a logistic regression.

    The logistic penalty weighs the summed loss with C = 1, hence 1/n on the mean loss.
    """

    def __init__(self, estimator: Estimator | None = None, x: str | None = "x", c: float = 1.0):
        self.estimator, self.x, self.c = estimator or hinge(), x, c

    def fit(self, df: DataFrame) -> ScoringModel:
        rows = with_vector(df, self.x) if self.x else df
        model = self.estimator.fit(rows)
        n = df.count()
        calibration = LogisticRegression(
            featuresCol="margin_vector", labelCol="y", regParam=1.0 / (self.c * max(n, 1)),
            elasticNetParam=0.0, standardization=False,
        ).fit(_margin_vector(model.transform(rows)).drop("rawPrediction", "prediction"))
        return ScoringModel(model, calibration, self.x)


def _evaluator() -> BinaryClassificationEvaluator:
    return BinaryClassificationEvaluator(
        rawPredictionCol="rawPrediction", labelCol="y", metricName="areaUnderROC", numBins=0
    )


def cross_validate(
    estimator: Estimator, rows: DataFrame, k: int, parallelism: int = 4
) -> tuple[float, float]:
    """Mean AUC over the folds in column ``fold`` and twice its population deviation."""
    model = _search(estimator, ParamGridBuilder().build(), rows, k, parallelism)
    return float(model.avgMetrics[0]), float(2 * model.stdMetrics[0])


def cross_validate_model(make, rows: DataFrame, folds: Sequence[int], parallelism: int = 4) -> DataFrame:
    """``(fold, auc, log_loss)`` of any model with fit / transform over ``(x, y, fold)``, Platt
    scaling included; ``make()`` gives a new model for each fold. Several folds run at a time."""
    rows = materialise(rows, "cv")
    floor = 1e-15

    def one(fold: int) -> DataFrame:
        model = make().fit(training_rows(rows, fold))
        scored = model.transform(test_rows(rows, fold)).withColumn("fold", F.lit(fold))
        scored = scored.select("fold", "y", F.get("prob", F.lit(1)).alias("p"))
        p = F.greatest(F.least("p", F.lit(1 - floor)), F.lit(floor))
        loss = scored.groupBy("fold").agg(
            F.avg(-F.when(F.col("y") == 1, F.log(p)).otherwise(F.log(1 - p))).alias("log_loss")
        )
        return auc(scored, "p", by=["fold"]).select("fold", "auc").join(loss, "fold")

    with ThreadPoolExecutor(parallelism) as pool:
        parts = list(pool.map(one, folds))
    return reduce(DataFrame.unionByName, parts)


def grid_search(
    estimator: Estimator, param: str, values: Sequence[float], rows: DataFrame, k: int = 5,
    parallelism: int = 5,
) -> tuple[Model, list[tuple[float, float]]]:
    """Best model by AUC and the mean AUC of every value."""
    grid = ParamGridBuilder().addGrid(estimator.getParam(param), list(values)).build()
    model = _search(estimator, grid, rows, k, parallelism)
    return model.bestModel, [(v, float(m)) for v, m in zip(values, model.avgMetrics, strict=True)]


def _search(estimator, grid, rows, k, parallelism) -> CrossValidatorModel:
    """Every fit reads its rows many times: they are written once, with their folds."""
    rows = materialise(rows.select("features", "y", F.col("fold").cast("int").alias("fold")), "cv")
    return CrossValidator(
        estimator=estimator, estimatorParamMaps=grid, evaluator=_evaluator(), numFolds=k,
        foldCol="fold", parallelism=parallelism,
    ).fit(rows)
