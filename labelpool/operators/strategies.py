"""Query strategies: score every unlabeled row, then pick the next ones to label.

A strategy turns a ``PoolState`` into ``(id, score)``. Which end of the scores is picked is part of
the strategy (``pick_largest``). Own strategies subclass ``QueryStrategy``.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelpool.functions import scores as S
from labelpool.functions.hashing import hash_order
from labelpool.functions.vectors import distance, guarded, similarity
from labelpool.operators.evaluate import min_max
from labelpool.operators.neighbours import lds_prune
from labelpool.operators.spaces import Space, centre, space
from labelpool.plans.blocks import all_pairs, cross_pairs
from labelpool.plans.cuts import first_rows
from labelpool.session import materialise

# Scores are rounded before ordering, so that rows equal up to floating-point noise tie and the
# smaller id wins on every engine.
TIE_DIGITS = 9


@dataclass
class PoolState:
    """What a strategy sees.

    ``unlabeled``: ``(id, x)`` plus ``margin`` and ``prob`` where the strategy needs a model;
    ``labeled``: ``(id, x, y)``; ``initial_size``: rows of U before the first draw (counted from
    ``unlabeled`` if not given); ``previous``: last round's ``(id, score)`` for model change.
    """

    unlabeled: DataFrame
    labeled: DataFrame
    initial_size: int | None = None
    previous: DataFrame | None = None
    statistics: dict[int, DataFrame] | None = None


class QueryStrategy:
    name = ""
    pick_largest = True
    needs_model = False
    pairwise = False  # scores cost far more than reading the pool

    def prune(self, state: PoolState) -> DataFrame:
        """The unlabeled rows the strategy keeps; called once, before the first draw."""
        return state.unlabeled

    def score(self, state: PoolState) -> DataFrame:
        raise NotImplementedError

    def query(self, state: PoolState, k: int = 1) -> DataFrame:
        return select_batch(self.score(state), k, self.pick_largest)


def select_batch(scores: DataFrame, k: int, largest: bool = True) -> DataFrame:
    """The k best rows, smaller id first among equals; undefined scores come last."""
    key = F.round("score", TIE_DIGITS)
    order = key.desc_nulls_last() if largest else key.asc_nulls_last()
    return first_rows(scores, [order, "id"], k)


class Random(QueryStrategy):
    """Hash order: repeatable, uniform, independent of partitioning."""

    name = "random"

    def __init__(self, seed: int = 0):
        self.seed = seed

    def score(self, state: PoolState) -> DataFrame:
        """The pool size for every row, as a plain marker; ``query`` does the drawing."""
        size = state.unlabeled.agg(F.count("*").cast("double").alias("n"))
        return state.unlabeled.select("id", size.scalar().alias("score"))

    def query(self, state: PoolState, k: int = 1) -> DataFrame:
        return first_rows(self.score(state), [hash_order("id", self.seed), "id"], k)


class SimpleMargin(QueryStrategy):
    name = "simple_margin"
    pick_largest = False
    needs_model = True

    def score(self, state: PoolState) -> DataFrame:
        return state.unlabeled.select("id", F.abs("margin").alias("score"))


class Margin(QueryStrategy):
    name = "margin"
    pick_largest = False
    needs_model = True

    def score(self, state: PoolState) -> DataFrame:
        return state.unlabeled.select("id", S.top_two_gap(F.col("prob")).alias("score"))


class UncertaintyStrategy(QueryStrategy):
    """Scores from probabilities, optionally minus 1/|L| of the last round's stored score."""

    needs_model = True

    def __init__(self, model_change: bool = False):
        self.model_change = model_change

    def raw_score(self, state: PoolState) -> Column:
        raise NotImplementedError

    def score(self, state: PoolState) -> DataFrame:
        now = state.unlabeled.select("id", self.raw_score(state).alias("score"))
        if not self.model_change or state.previous is None:
            return now
        before = state.previous.select("id", F.col("score").alias("_previous"))
        labeled = state.labeled.agg(F.count("*").alias("n")).scalar()
        return now.join(before, "id", "left").select(
            "id",
            (
                F.col("score")
                - F.coalesce("_previous", F.lit(0.0)) * F.try_divide(F.lit(1.0), labeled)
            ).alias("score"),
        )


class Entropy(UncertaintyStrategy):
    name = "entropy"

    def raw_score(self, state: PoolState) -> Column:
        return S.entropy(F.col("prob"))


class LeastConfidence(UncertaintyStrategy):
    name = "least_confidence"

    def raw_score(self, state: PoolState) -> Column:
        return S.least_confidence(F.col("prob"))


def _positive_share(state: PoolState) -> Column:
    return state.labeled.agg(F.avg(F.col("y").cast("double")).alias("share")).scalar()


class LeastConfidenceBias(UncertaintyStrategy):
    name = "lcb"

    def raw_score(self, state: PoolState) -> Column:
        boundary = S.bias_boundary(_positive_share(state))
        return S.biased_confidence(F.array_max("prob"), boundary)


class LeastConfidenceDynamicBias(UncertaintyStrategy):
    name = "lcb2"

    def raw_score(self, state: PoolState) -> Column:
        labeled = state.labeled.agg(F.count("*").cast("double").alias("n")).scalar()
        boundary = S.dynamic_bias_boundary(
            _positive_share(state), F.try_divide(labeled, _initial_size(state))
        )
        return S.biased_confidence(F.get(F.col("prob"), F.lit(1)), boundary)


def _initial_size(state: PoolState) -> Column:
    if state.initial_size is not None:
        return F.lit(float(state.initial_size))
    return state.unlabeled.agg(F.count("*").cast("double").alias("n")).scalar()


class _SpatialStrategy(QueryStrategy):
    """Keeps the space it scaled in: U and L together are the same rows in every round.

    Only ``seuclidean`` takes its variances from the two sides that are compared, anew each time.
    """

    def __init__(self, metric: str = "euclidean"):
        self.metric = metric
        self._space: Space | None = None

    def sides(self, state: PoolState) -> DataFrame:
        """The vectors of both sides of the distances, one side after the other."""
        return state.unlabeled.select("x").unionByName(state.labeled.select("x"))

    def frame(self, state: PoolState) -> Space:
        if self.metric == "seuclidean":
            return space(self.metric, self.sides(state))
        if self._space is None:
            rows = state.unlabeled.select("id", "x").unionByName(state.labeled.select("id", "x"))
            self._space = space(self.metric, rows)
        return self._space


class DistanceToCenter(_SpatialStrategy):
    """Picks the row farthest from the mean labeled vector (lowest similarity)."""

    name = "d2c"
    pick_largest = False

    def sides(self, state: PoolState) -> DataFrame:
        middle = centre(state.labeled.select("id", "x")).select(F.col("c").alias("x"))
        return state.unlabeled.select("x").unionByName(middle)

    def score(self, state: PoolState) -> DataFrame:
        frame = self.frame(state)
        middle = centre(frame.apply(state.labeled.select("id", "x")))
        rows = frame.apply(state.unlabeled.select("id", "x")).withColumn("_c", middle.scalar())
        d = guarded(distance(frame.metric, F.col("_c"), F.col("x")), self.name)
        return rows.select("id", similarity(d).alias("score"))


def _min_kernel(d: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> dict[str, np.ndarray]:
    if np.isnan(d).any():
        raise ValueError("undefined distance between two rows")
    return {"id": rows, "d": d.min(axis=1)}


def _similarity_kernel(d: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> dict[str, np.ndarray]:
    own = rows[:, None] == cols[None, :]
    if np.isnan(np.where(own, 0.0, d)).any():
        raise ValueError("undefined distance between two rows")
    sims = np.where(own, 0.0, 1.0 / (1.0 + d))
    return {"id": rows, "s": sims.sum(axis=1), "n": (~own).sum(axis=1)}


def min_distances(frame: Space, rows: DataFrame, to: DataFrame) -> DataFrame:
    """``(id, d)``: distance of each row to the nearest row of ``to``."""
    parts = cross_pairs(
        frame.apply(rows.select("id", "x")),
        frame.apply(to.select("id", "x")),
        frame.metric,
        _min_kernel,
        ["id", "d"],
    )
    return parts.groupBy("id").agg(F.min("d").alias("d"))


class MinMax(_SpatialStrategy):
    """Picks the row whose nearest labeled row is farthest away."""

    name = "minmax"
    pairwise = True

    def __init__(
        self,
        metric: str = "euclidean",
        lds: bool = False,
        lds_k: int = 30,
        lds_threshold: float | str = "auto",
        lds_metric: str = "mahalanobis",
    ):
        super().__init__(metric)
        self.lds, self.lds_k, self.lds_threshold = lds, lds_k, lds_threshold
        self.lds_metric = lds_metric

    def prune(self, state: PoolState) -> DataFrame:
        if not self.lds:
            return state.unlabeled
        return lds_prune(state.unlabeled, self.lds_k, self.lds_threshold, self.lds_metric)

    def statistics(self, state: PoolState) -> DataFrame:
        return min_distances(self.frame(state), state.unlabeled, state.labeled)

    def score(self, state: PoolState) -> DataFrame:
        return _kept(self, state).select("id", F.col("d").alias("score"))


class KCenter(MinMax):
    """Farthest-first batches: each row is the one farthest from L and from the rows picked before
    it, so a batch holds no two near copies while other rows are farther away.

    An extension beside the strategies known by name."""

    name = "kcenter"

    def query(self, state: PoolState, k: int = 1) -> DataFrame:
        from labelpool.operators.incremental import farthest_first

        return farthest_first(self.frame(state), state.unlabeled, _kept(self, state), k)


class Density(_SpatialStrategy):
    """Mean similarity to all other unlabeled rows; picks the most isolated row."""

    name = "density"
    pick_largest = False
    pairwise = True

    def sides(self, state: PoolState) -> DataFrame:
        return state.unlabeled.select("x").unionByName(state.unlabeled.select("x"))

    def statistics(self, state: PoolState) -> DataFrame:
        return similarity_sums(self.frame(state), state.unlabeled)

    def score(self, state: PoolState) -> DataFrame:
        return _kept(self, state).select("id", F.try_divide("s", "n").alias("score"))


def _kept(strategy: QueryStrategy, state: PoolState) -> DataFrame:
    """The pair statistics of a strategy: those kept up over rounds, or made anew."""
    kept = (state.statistics or {}).get(id(strategy))
    return strategy.statistics(state) if kept is None else kept


def similarity_sums(frame: Space, rows: DataFrame) -> DataFrame:
    """``(id, s, n)``: sum of similarities to the other rows and how many there are."""
    parts = all_pairs(
        frame.apply(rows.select("id", "x")), frame.metric, _similarity_kernel, ["id", "s", "n"]
    )
    return parts.groupBy("id").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


class Combined(QueryStrategy):
    """norm(score1) * norm(score2) ** beta, largest first.

    ``beta="dynamic"`` is 2|U|/|L|. ``orient=True`` first turns scores whose strategy picks the
    smallest, which the plain rule does not do.
    """

    name = "combined"

    def __init__(
        self,
        first: QueryStrategy,
        second: QueryStrategy,
        beta: float | str = 1.0,
        alpha: float | str = "auto",
        orient: bool = False,
    ):
        for part in (first, second):
            if part is None:
                raise ValueError("combined needs two strategies")
            if isinstance(part, Random):
                raise ValueError("random has no row scores and cannot be combined")
            if getattr(part, "model_change", False):
                raise ValueError("model change has no effect inside combined")
        self.first, self.second, self.orient = first, second, orient
        self.beta = beta if beta == "dynamic" else float(beta)
        self.alpha = alpha if alpha == "auto" else float(alpha)
        if self.alpha != "auto":
            warnings.warn("alpha is accepted but not used", RuntimeWarning, stacklevel=2)
        self.needs_model = first.needs_model or second.needs_model

    def prune(self, state: PoolState) -> DataFrame:
        for part in (self.first, self.second):
            state = PoolState(part.prune(state), state.labeled, state.initial_size)
        return state.unlabeled

    def exponent(self, state: PoolState) -> Column:
        if self.beta != "dynamic":
            return F.lit(self.beta)
        u = state.unlabeled.agg(F.count("*").cast("double").alias("n")).scalar()
        n_l = state.labeled.agg(F.count("*").cast("double").alias("n")).scalar()
        return 2 * F.try_divide(u, n_l)

    def _part(self, strategy: QueryStrategy, state: PoolState, out: str) -> DataFrame:
        scores = strategy.score(state)
        if strategy.pairwise:  # read twice below: once for the ends, once for the rows
            scores = materialise(scores, "scores")
        if self.orient and not strategy.pick_largest:
            scores = scores.withColumn("score", -F.col("score"))
        return min_max(scores).select("id", F.col("score").alias(out))

    def score(self, state: PoolState) -> DataFrame:
        both = self._part(self.first, state, "_a").join(
            self._part(self.second, state, "_b"), "id"
        )
        return both.select(
            "id", (F.col("_a") * F.pow(F.col("_b"), self.exponent(state))).alias("score")
        )


STRATEGIES: dict[str, Callable[..., QueryStrategy]] = {
    s.name: s
    for s in (
        Random,
        SimpleMargin,
        Margin,
        Entropy,
        LeastConfidence,
        LeastConfidenceBias,
        LeastConfidenceDynamicBias,
        DistanceToCenter,
        MinMax,
        Density,
        Combined,
    )
}


def get_strategy(name: str, **params) -> QueryStrategy:
    """A strategy by name; the parts of ``combined`` may be given by name too."""
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; known: {', '.join(STRATEGIES)}")
    if name == "combined":
        for part in ("first", "second"):
            if isinstance(params.get(part), str):
                params[part] = get_strategy(params[part])
    return STRATEGIES[name](**params)
