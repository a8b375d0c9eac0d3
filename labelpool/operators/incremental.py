"""Pair statistics kept up to date after a batch, instead of recomputed over all pairs.

Exact: a batch of B rows costs |U| * B distances. Sums drift by rounding, so they are recomputed
from time to time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelpool.operators.spaces import Space
from labelpool.operators.strategies import (
    TIE_DIGITS,
    Density,
    MinMax,
    PoolState,
    QueryStrategy,
    _similarity_kernel,
    min_distances,
)
from labelpool.plans.blocks import cross_pairs
from labelpool.plans.kernels import block_distances
from labelpool.session import materialise

# Rows with the largest distances that the driver looks at together: a bound, not a sample.
CANDIDATES = 1024


def update_min_distances(
    frame: Space, nearest: DataFrame, unlabeled: DataFrame, batch: DataFrame
) -> DataFrame:
    """``(id, d)`` to the nearest labeled row once ``batch`` is labeled too.

    ``unlabeled`` no longer holds the batch.
    """
    new = min_distances(frame, unlabeled, batch).withColumnRenamed("d", "_new")
    return nearest.join(new, "id").select("id", F.least("d", "_new").alias("d"))


def update_similarity_sums(
    frame: Space, sums: DataFrame, unlabeled: DataFrame, batch: DataFrame
) -> DataFrame:
    """``(id, s, n)`` over the remaining pool once ``batch`` has left it."""
    gone = cross_pairs(
        frame.apply(unlabeled.select("id", "x")),
        frame.apply(batch.select("id", "x")),
        frame.metric,
        _similarity_kernel,
        ["id", "s", "n"],
    ).groupBy("id").agg(F.sum("s").alias("_s"), F.sum("n").alias("_n"))
    return sums.join(gone, "id").select(
        "id", (F.col("s") - F.col("_s")).alias("s"), (F.col("n") - F.col("_n")).alias("n")
    )


class PairScores:
    """The pair statistics of one run, a written table for each version.

    Version 0 compares all pairs. A later version changes the one before it by the batch that was
    labeled in between; every ``refresh``-th is computed anew, and ``drift`` then says by how much
    the kept one was off. Which rows are picked never depends on ``refresh`` beyond rounding.

    Kept are the parts of a strategy that compare pairs in a space that stays the same. A scaled
    space that is fitted to U and L again in every round changes all distances, so it is left alone.
    """

    def __init__(self, strategy: QueryStrategy, refresh: int = 50):
        if refresh < 1:
            raise ValueError("refresh must be positive")
        self.parts = [p for p in _leaves(strategy) if _lasting(p)]
        self.refresh, self.version = refresh, 0
        self.tables: dict[int, DataFrame] = {}
        #: (version, largest difference of a statistic) at every refresh.
        self.drift: list[tuple[int, float]] = []

    def advance(self, unlabeled: DataFrame, labeled: DataFrame, batch: DataFrame | None) -> dict[int, DataFrame]:
        """Statistics for this U and L; ``batch`` holds the rows labeled since the last call."""
        state = PoolState(unlabeled, labeled)
        anew = not self.version % self.refresh or batch is None
        for part in self.parts:
            before = self.tables.get(id(part))
            if before is None:
                made = part.statistics(state)
            else:
                update = update_similarity_sums if isinstance(part, Density) else update_min_distances
                made = update(part.frame(state), before, unlabeled, batch)
            if anew and before is not None:
                fresh = materialise(part.statistics(state), "pair-scores")
                value = "s" if isinstance(part, Density) else "d"
                off = made.select("id", F.col(value).alias("_kept")).join(fresh, "id").agg(
                    F.max(F.abs(F.col("_kept") - F.col(value)))
                )
                self.drift.append((self.version, off.first()[0] or 0.0))
                self.tables[id(part)] = fresh
            else:
                self.tables[id(part)] = materialise(made, "pair-scores")
        self.version += 1
        return self.tables


def _leaves(strategy: QueryStrategy) -> list[QueryStrategy]:
    parts = [getattr(strategy, n, None) for n in ("first", "second")]
    return [leaf for p in parts if p is not None for leaf in _leaves(p)] or [strategy]


def _lasting(part: QueryStrategy) -> bool:
    return isinstance(part, (MinMax, Density)) and part.metric != "seuclidean"


def farthest_first(
    frame: Space, unlabeled: DataFrame, nearest: DataFrame, k: int, candidates: int = CANDIDATES
) -> DataFrame:
    """``(id, score)`` of k rows picked one after the other, each farthest from L and from those
    before it; the score is that distance. Equal distances go to the smaller id.

    ``nearest`` is ``(id, d)`` to L. Distances only shrink, so a row outside the ``candidates``
    farthest ones cannot be next while one of these is still as far as they were. As many rows as
    this allows are picked on the driver from the candidates; then the table is changed by all of
    them in one pass, and so on. So a pass serves many picks, and what is collected is bounded.
    """
    spark = unlabeled.sparkSession
    pool = unlabeled.select("id", "x")
    key = F.round("d", TIE_DIGITS)
    picked: list[tuple[int, float]] = []
    while len(picked) < k:
        top = nearest.orderBy(key.desc(), "id").limit(candidates).collect()
        if not top:
            break
        rows = frame.apply(pool.where(F.col("id").isin([r["id"] for r in top]))).collect()
        vectors = {r["id"]: r["x"] for r in rows}
        ids = np.array([r["id"] for r in top])
        d = np.array([r["d"] for r in top])
        x = np.array([vectors[i] for i in ids.tolist()])
        # What every row outside the candidates comes after.
        worst = (-round(d[-1], TIE_DIGITS), ids[-1]) if len(ids) == candidates else None
        new: list[int] = []
        alive = np.ones(len(ids), bool)
        while len(picked) < k and alive.any():
            best = min(np.flatnonzero(alive), key=lambda i: (-round(d[i], TIE_DIGITS), ids[i]))
            if worst is not None and (-round(d[best], TIE_DIGITS), ids[best]) > worst:
                break
            picked.append((int(ids[best]), float(d[best])))
            new.append(best)
            alive[best] = False
            d = np.minimum(d, block_distances(frame.metric, x[best : best + 1], x)[0])
        if len(picked) < k:
            gone = pool.where(F.col("id").isin([int(ids[i]) for i in new]))
            pool = pool.join(gone.select("id"), "id", "left_anti")
            nearest = materialise(update_min_distances(frame, nearest, pool, gone), "pair-scores")
    return spark.createDataFrame(picked, "id long, score double")
