"""Exact nearest neighbours and pool pruning by shared neighbours."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelpool.operators.spaces import space
from labelpool.plans.blocks import all_pairs
from labelpool.plans.lookup import skew_lookup
from labelpool.plans.pivots import BLOCK_BYTES, BUNCH, METRICS, nearest
from labelpool.session import materialise

ONE_TILE = BLOCK_BYTES * BUNCH


def _nearest_kernel(k: int):
    """The k nearest columns of each row, leaving out the row itself; ties by smaller id."""

    def kernel(d: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> dict[str, np.ndarray]:
        order = np.argsort(cols, kind="stable")
        cols, d = cols[order], np.round(d[:, order], 12)
        itself = rows[:, None] == cols[None, :]
        if np.isnan(np.where(itself, 0.0, d)).any():
            raise ValueError("undefined distance between two rows")
        # The row itself comes after every other row, also after infinitely far ones.
        d = np.where(itself, np.nan, d)
        take = min(k, d.shape[1])
        if take < d.shape[1]:
            # Everything up to the k-th smallest distance, then cut in (distance, id) order.
            limit = np.partition(d, take - 1, axis=1)[:, take - 1 : take]
            near = np.where((d <= limit) | np.isnan(limit), d, np.nan)
        else:
            near = d
        best = np.argsort(near, axis=1, kind="stable")[:, :take]
        dist = np.take_along_axis(near, best, axis=1)
        ok = ~np.isnan(dist)
        owner = np.broadcast_to(rows[:, None], dist.shape)
        return {"id": owner[ok], "nbr": cols[best][ok], "d": dist[ok]}

    return kernel


def knn_join(
    pool: DataFrame, k: int, metric: str = "euclidean", scale_rows: DataFrame | None = None
) -> DataFrame:
    """``(id, rank, nbr, d)``: the exact k nearest other rows of each row of ``(id, x)``.

    Under a metric that obeys the triangle inequality, a pool of more than one tile is searched
    with bounds (``plans/pivots``), which leaves out what cannot be near. Otherwise every block pair
    keeps k candidates per row, so the last shuffle carries k rows per row and block, already cut
    by the partial rank limit.
    """
    if k < 1:
        raise ValueError("k must be positive")
    frame = space(metric, scale_rows if scale_rows is not None else pool)
    rows = frame.apply(pool.select("id", "x"))
    if frame.metric in METRICS and not _one_tile(pool):
        rows = materialise(rows, "space")
        return nearest(rows, rows, frame.metric, k)
    pairs = all_pairs(rows, frame.metric, _nearest_kernel(k), ["id", "nbr", "d"])
    order = Window.partitionBy("id").orderBy("d", "nbr")
    return (
        pairs.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("id", "rank", "nbr", "d")
    )


def _one_tile(pool: DataFrame) -> bool:
    """Whether all rows fit into one tile, where there is nothing to leave out."""
    row = pool.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    return row[0] * (row[1] or 0) * 8 <= ONE_TILE


def local_density_scores(neighbours: DataFrame, hot_weight: int = 100_000) -> DataFrame:
    """``(id, lds)``: mean number of neighbours a row shares with each of its neighbours.

    A row that is near to very many others is looked up that often; such hubs are joined by
    broadcast, see ``skew_lookup``.
    """
    neighbours = materialise(neighbours.select("id", "nbr"), "neighbours")  # read three times
    lists = neighbours.groupBy("id").agg(F.sort_array(F.collect_list("nbr")).alias("nn"))
    popular = neighbours.groupBy(F.col("nbr").alias("id")).agg(F.count("*").alias("cited"))
    dim = lists.join(popular, "id").select(
        F.col("id").alias("nbr"), F.col("nn").alias("nbr_nn"), "cited"
    )
    asked = lists.select("id", "nn", F.explode("nn").alias("nbr"))
    both = skew_lookup(asked, dim, "nbr", F.col("cited"), "id", hot_weight)
    return both.groupBy("id").agg(
        F.try_divide(
            F.sum(F.size(F.array_intersect("nn", "nbr_nn"))).cast("double"), F.count("*")
        ).alias("lds")
    )


def lds_prune(
    pool: DataFrame,
    k: int = 30,
    threshold: float | str = "auto",
    metric: str = "mahalanobis",
) -> DataFrame:
    """The rows of ``pool`` whose local density score reaches the threshold (auto: k/2)."""
    limit = k / 2 if threshold == "auto" else float(threshold)
    scores = local_density_scores(knn_join(pool, k, metric))
    return pool.join(scores.where(F.col("lds") >= limit).select("id"), "id", "left_semi")
