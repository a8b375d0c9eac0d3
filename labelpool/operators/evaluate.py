"""Model quality: exact AUC, calibration, learning curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def auc(df: DataFrame, score: str = "score", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve per group: ``(*by, n_pos, n_neg, auc)``.

    Equal scores are merged first, so a score shared by a third of the rows is one row. The merged
    rows are range-partitioned by score; each range counts its own ordered pairs, and the ranges
    are then put together from one row each. NULL when a class is missing.
    """
    by = list(by)
    per_score = (
        df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
        .groupBy(*by, F.col(score).alias("s"))
        .agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    )
    ranged = per_score.repartitionByRange(*by, "s").withColumn("part", F.spark_partition_id())
    below = (
        Window.partitionBy("part", *by)
        .orderBy("s")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    beaten = F.coalesce(F.sum("neg").over(below), F.lit(0)) + F.col("neg") / 2
    per_range = (
        ranged.withColumn("pairs", F.col("pos") * beaten)
        .groupBy("part", *by)
        .agg(
            F.min("s").alias("s"),
            F.sum("pairs").alias("pairs"),
            F.sum("pos").alias("pos"),
            F.sum("neg").alias("neg"),
        )
    )
    earlier = (
        Window.partitionBy(*by).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        per_range.withColumn(
            "pairs",
            F.col("pairs")
            + F.col("pos") * F.coalesce(F.sum("neg").over(earlier), F.lit(0)).cast("double"),
        )
        .groupBy(*by)
        .agg(
            F.sum("pos").alias("n_pos"),
            F.sum("neg").alias("n_neg"),
            F.sum("pairs").alias("pairs"),
        )
        .select(
            *by,
            F.coalesce("n_pos", F.lit(0)).alias("n_pos"),
            F.coalesce("n_neg", F.lit(0)).alias("n_neg"),
            F.try_divide(
                F.col("pairs"), F.col("n_pos").cast("double") * F.col("n_neg")
            ).alias("auc"),
        )
    )


def accuracy(df: DataFrame, predicted: Column, y: str = "y") -> DataFrame:
    return df.agg(F.avg((predicted == F.col(y)).cast("double")).alias("accuracy"))


def min_max(df: DataFrame, score: str = "score") -> DataFrame:
    """Scale ``score`` to [0, 1].

    Flat scores stay as they are below 1 and become 1/score otherwise.
    """
    ends = df.agg(
        F.struct(F.min(score).alias("lo"), F.max(score).alias("hi")).alias("e")
    )
    s, lo, hi = F.col(score), F.col("_e.lo"), F.col("_e.hi")
    return (
        df.withColumn("_e", ends.scalar())
        .withColumn(
            score,
            F.when(hi > lo, F.try_divide(s - lo, hi - lo))
            .when(lo < 1, s)
            .otherwise(F.try_divide(F.lit(1.0), lo)),
        )
        .drop("_e")
    )


def reliability_curve(
    df: DataFrame,
    score: str = "score",
    y: str = "y",
    bins: int = 10,
    normalise: bool = False,
) -> DataFrame:
    """``(bin, lo, hi, n, mean_score, positive_rate)`` over bins ``(lo, hi]``, empty ones included.

    One pass with a few sums per bin. A score of exactly 0 lies in no bin.
    """
    if normalise:
        ends = df.agg(F.struct(F.min(score).alias("lo"), F.max(score).alias("hi")).alias("e"))
        df = df.withColumn("_e", ends.scalar()).withColumn(
            score, F.try_divide(F.col(score) - F.col("_e.lo"), F.col("_e.hi") - F.col("_e.lo"))
        )
    edges = [i / bins for i in range(bins + 1)]
    s = F.col(score)
    sums = []
    for i in range(bins):
        inside = (s > edges[i]) & (s <= edges[i + 1])
        sums.append(
            F.struct(
                F.lit(i + 1).alias("bin"),
                F.lit(edges[i]).alias("lo"),
                F.lit(edges[i + 1]).alias("hi"),
                F.count_if(inside).alias("n"),
                F.avg(F.when(inside, s)).alias("mean_score"),
                F.avg(F.when(inside, F.col(y)).cast("double")).alias("positive_rate"),
            )
        )
    return df.agg(F.array(*sums).alias("b")).select(F.inline("b"))


def calibration_comparison(
    df: DataFrame, methods: dict[str, tuple[str, bool]], y: str = "y", bins: int = 10
) -> DataFrame:
    """Reliability curves of several score columns; the flag says whether to min-max scale it."""
    curves = [
        reliability_curve(df, column, y, bins, normalise).withColumn("method", F.lit(name))
        for name, (column, normalise) in methods.items()
    ]
    out = curves[0]
    for curve in curves[1:]:
        out = out.unionByName(curve)
    return out


def mean_curve(curves: DataFrame, by: Sequence[str] = ("strategy",), over: str = "fold") -> DataFrame:
    """Mean AUC per draw over folds or runs, cut to the shortest of them."""
    by = list(by)
    runs = curves.groupBy(*by).agg(F.count_distinct(over).alias("_runs"))
    per_draw = curves.groupBy(*by, "draw").agg(
        F.avg("auc").alias("auc"), F.count_distinct(over).alias("_seen")
    )
    if by:
        joined = per_draw.join(runs, by)
    else:
        joined = per_draw.withColumn("_runs", runs.scalar())
    return joined.where(F.col("_seen") == F.col("_runs")).select(*by, "draw", "auc")


def first_reach(curve: DataFrame, target: float = 0.8, by: Sequence[str] = ("strategy",)) -> DataFrame:
    """First draw whose mean AUC reaches the target; NULL means never."""
    return curve.groupBy(*by).agg(
        F.min(F.when(F.col("auc") >= target, F.col("draw"))).alias("first_draw")
    )


def normalised_alc(curve: DataFrame, by: Sequence[str] = ("strategy",)) -> DataFrame:
    """Area under the learning curve (trapezoids of width 1), 0 at AUC 0.5 and 1 at AUC 1."""
    order = Window.partitionBy(*by).orderBy("draw")
    return (
        curve.withColumn("_prev", F.lag("auc").over(order))
        .groupBy(*by)
        .agg(
            F.sum((F.col("auc") + F.col("_prev")) / 2).alias("_area"),
            F.count("_prev").alias("_steps"),
        )
        .select(
            *by,
            F.try_divide(
                F.col("_area") - F.col("_steps") * 0.5, F.col("_steps") * 0.5
            ).alias("alc"),
        )
    )


def fold_summary(fold_auc: DataFrame) -> DataFrame:
    """Mean over folds and twice the population standard deviation."""
    return fold_auc.agg(
        F.avg("auc").alias("auc"), (2 * F.stddev_pop("auc")).alias("spread")
    )
