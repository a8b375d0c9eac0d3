"""Acquisition rounds on rows whose labels are known: fit, measure, pick, move.

Only the acquired ids grow from round to round. Each round writes its batch as one partition of a
table in the shared folder, and U and L are derived from the unchanged base rows by a join with
that table; so plans stay the same size however many rounds are run, nothing is collected, and a
lost executor costs one round at most.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelpool.functions.hashing import hash_order
from labelpool.functions.scores import entropy, least_confidence, top_two_gap
from labelpool.operators.evaluate import auc
from labelpool.operators.incremental import PairScores
from labelpool.operators.moments import Discriminant, Sums, class_moments, margin_and_prob
from labelpool.operators.pool import with_draw
from labelpool.operators.splits import split_u_l, test_rows, training_rows, unlabeled_size
from labelpool.operators.strategies import TIE_DIGITS, PoolState, QueryStrategy, select_batch
from labelpool.plans.cuts import first_of_groups, hash_cuts
from labelpool.session import materialise, new_table_dir

CURVE = "draw int, labeled long, auc double"
CHOICES = "draw int, id long, y int"

# Up to so many rows a fold and task, a ranking keeps only the best; beyond, Spark's own limit of
# a rank would send whole folds to one task.
WINDOW_ROWS = 1000


@dataclass
class Run:
    """``curve``: (draw, labeled, auc), AUC before the draw; ``choices``: (draw, id, y) in order."""

    curve: DataFrame
    choices: DataFrame


class ActiveLearner:
    """The acquisition loop for any strategy and any model with ``fit`` / ``transform``."""

    def __init__(
        self,
        strategy: QueryStrategy,
        model=None,
        u_share: float = 0.9,
        seed: int = 0,
        batch_size: int = 1,
        refresh: int = 50,
    ):
        if not 0 < u_share < 1:
            raise ValueError("u_share must lie between 0 and 1")
        if batch_size < 1:
            raise ValueError("batch_size must be positive")
        self.strategy, self.model = strategy, model or Discriminant()
        self.u_share, self.seed, self.batch_size = u_share, seed, batch_size
        #: Pair statistics are computed anew after so many batches, and kept up in between.
        self.refresh = refresh

    def run(self, train: DataFrame, test: DataFrame, ndraws: int | None = None) -> Run:
        """``train`` and ``test`` are ``(id, x, y)``; ``ndraws`` counts rows, default all of U."""
        spark = train.sparkSession
        base = split_u_l(train.select("id", "x", "y"), self.u_share, self.seed)
        pool0 = base.where(F.col("role") == "U").drop("role")
        labeled0 = base.where(F.col("role") == "L").drop("role")
        n_l = labeled0.count()
        pruned = self.strategy.prune(PoolState(pool0, labeled0))
        if pruned is not pool0:
            pool0 = materialise(pruned, "pruned-pool")
        n_u = pool0.count()
        total = n_u if ndraws is None else min(ndraws, n_u)

        picked_dir = new_table_dir(spark, "acquired")
        points: list[tuple[int, int, float | None]] = []
        previous = None
        keeper = PairScores(self.strategy, self.refresh)
        for start in range(0, total, self.batch_size):
            size = min(self.batch_size, total - start)
            if start:
                picked = spark.read.schema(CHOICES).parquet(picked_dir)
                unlabeled = pool0.join(picked.select("id"), "id", "left_anti")
                labeled = labeled0.unionByName(
                    pool0.join(picked.select("id"), "id", "left_semi").select("id", "x", "y")
                )
                last = picked.where(F.col("draw") >= start - self.batch_size)
                batch = pool0.join(last.select("id"), "id", "left_semi").select("id", "x")
            else:
                unlabeled, labeled, batch = pool0, labeled0, None
            kept = keeper.advance(unlabeled, labeled, batch) if keeper.parts else None
            fitted = self.model.fit(labeled)
            points.append((start, n_l + start, self._auc(fitted, test)))
            if self.strategy.needs_model:
                unlabeled = fitted.transform(unlabeled)
            state = PoolState(unlabeled, labeled, n_u, previous, kept)
            if getattr(self.strategy, "model_change", False):
                previous = materialise(self.strategy.score(state), "scores")
                batch = select_batch(previous, size, self.strategy.pick_largest)
            else:
                batch = self.strategy.query(state, size)
            (
                with_draw(self.strategy, batch)
                .join(pool0.select("id", "y"), "id")
                .select((F.col("draw") + start).cast("int").alias("draw"), "id", "y")
                .write.mode("append")
                .parquet(picked_dir)
            )
        choices = (
            spark.read.schema(CHOICES).parquet(picked_dir).orderBy("draw")
            if points
            else spark.createDataFrame([], CHOICES)
        )
        return Run(spark.createDataFrame(points, CURVE), choices)

    def _auc(self, fitted, test: DataFrame) -> float | None:
        scored = fitted.transform(test.select("id", "x", "y"))
        score = F.get("prob", F.lit(1)) if "prob" in scored.columns else F.col("margin")
        row = auc(scored.select(score.alias("score"), "y")).first()
        return row["auc"] if row else None


def experiment(
    rows: DataFrame,
    learners: dict[str, ActiveLearner],
    folds: Sequence[int],
    ndraws: int | None = None,
    parallelism: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """Every learner on every fold of ``(id, x, y, fold)``, several folds at a time.

    Returns ``(strategy, fold, draw, auc)`` and ``(strategy, fold, draw, id, y)``.
    """
    def one(task: tuple[str, int]) -> tuple[DataFrame, DataFrame]:
        name, fold = task
        model = learners[name]
        learner = ActiveLearner(
            _fresh(model.strategy), model.model, model.u_share, fold, model.batch_size, model.refresh
        )
        run = learner.run(training_rows(rows, fold), test_rows(rows, fold), ndraws)
        tags = [F.lit(name).alias("strategy"), F.lit(fold).alias("fold")]
        return run.curve.select(*tags, "draw", "auc"), run.choices.select(*tags, "draw", "id", "y")

    tasks = [(name, fold) for name in learners for fold in folds]
    with ThreadPoolExecutor(parallelism) as pool:
        results = list(pool.map(one, tasks))
    curves, choices = results[0]
    for curve, choice in results[1:]:
        curves, choices = curves.unionByName(curve), choices.unionByName(choice)
    return curves, choices


def _fresh(strategy: QueryStrategy) -> QueryStrategy:
    """A copy without the space another run has fitted."""
    import copy

    clone = copy.deepcopy(strategy)
    if hasattr(clone, "_space"):
        clone._space = None
    return clone


def _point_score(name: str) -> tuple[Column | None, bool]:
    """Score and whether the largest is picked, for strategies that look at one row at a time."""
    prob = F.col("prob")
    table = {
        "simple_margin": (F.abs("margin"), False),
        "margin": (top_two_gap(prob), False),
        "entropy": (entropy(prob), True),
        "least_confidence": (least_confidence(prob), True),
        "random": (None, True),
    }
    if name not in table:
        raise ValueError(f"{name!r} is not a row-wise strategy; use ActiveLearner")
    return table[name]


def fold_rounds(
    rows: DataFrame,
    strategy: str,
    folds: int,
    rounds: int,
    batch_size: int,
    u_share: float = 0.9,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """All folds of a row-wise strategy with the closed-form model, one job per round.

    ``rows`` is ``(id, x, y, fold)``. The class sums of L are kept per fold and only the batch is
    added to them, so a round reads the pool once, to score it; each task then keeps only its best
    ``batch_size`` rows per fold. At the end one job scores the test folds for all draws.
    Returns curves ``(fold, draw, labeled, auc)`` and choices ``(fold, draw, id, y)``; ``draw``
    counts rounds here.
    """
    spark = rows.sparkSession
    value, largest = _point_score(strategy)
    # Written once, so that no round computes folds or rereads the source again.
    own = materialise(
        rows.select("id", "x", "y", F.col("fold").cast("int").alias("home")), "folded"
    )
    train = own.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where(
        "fold <> home"
    )
    key = hash_order("id", F.concat_ws("-", F.lit(str(seed)), F.col("fold").cast("string")))
    cuts = hash_cuts(train, key, lambda n: [unlabeled_size(n, u_share)], by=F.col("fold"))
    last_u = F.element_at(
        F.create_map(*[F.lit(v) for f, (_, (cut,)) in sorted(cuts.items()) for v in (f, cut)]),
        F.col("fold"),
    )
    split = train.withColumn("in_u", key <= last_u)
    pool = split.where("in_u").select("fold", "id", "x", "y")

    picked_dir = new_table_dir(spark, "picked")
    schema = "fold int, round int, draw int, id long, y int, x array<double>"
    sums = _sums_by_fold(split.where(~F.col("in_u")), folds)
    history: list[tuple[int, int, int, list[float] | None, float | None]] = []
    for r in range(rounds):
        for f in range(folds):
            history.append((f, r, sum(sums[f].n), *sums[f].weights()))
        left = pool
        if r:
            picked = spark.read.schema(schema).parquet(picked_dir)
            left = pool.join(picked.select("fold", "id"), ["fold", "id"], "left_anti")
        if value is None:
            order = [hash_order("id", seed), F.col("id")]
        else:
            left = _score_folds(left, history[-folds:], ["fold"])
            key = F.round(value, TIE_DIGITS)
            order = [key.desc_nulls_last() if largest else key.asc_nulls_last(), F.col("id")]
        if batch_size > WINDOW_ROWS and value is not None:
            # NULL scores come last, the largest first.
            sign = F.coalesce(-key if largest else key, F.lit(math.inf))
            chosen = _large_batch(left, sign, batch_size)
        else:
            rank = F.row_number().over(Window.partitionBy("fold").orderBy(*order))
            chosen = left.withColumn("draw", rank - 1).where(F.col("draw") < batch_size)
        (
            chosen.select(
                "fold", F.lit(r).alias("round"), F.col("draw").cast("int").alias("draw"), "id", "y", "x"
            )
            .write.partitionBy("round")
            .mode("append")
            .parquet(picked_dir)
        )
        if r + 1 < rounds:
            drawn = spark.read.schema(schema).parquet(picked_dir).where(F.col("round") == r)
            new = _sums_by_fold(drawn, folds)
            sums = {f: sums[f] + new[f] for f in range(folds)}

    # The test folds once, against the models of all rounds.
    tests = own.withColumnRenamed("home", "fold")
    scored = _score_folds(tests, history, ["fold", "draw"])
    curves = auc(
        scored.select("fold", "draw", "labeled", F.get("prob", F.lit(1)).alias("score"), "y"),
        by=["fold", "draw", "labeled"],
    ).select("fold", "draw", "labeled", "auc")
    picked = spark.read.schema(schema).parquet(picked_dir)
    in_run = (F.col("round") * batch_size + F.col("draw")).alias("draw")
    return curves, picked.select("fold", in_run, "id", "y")


def _large_batch(left: DataFrame, key: Column, size: int) -> DataFrame:
    """The batch of every fold with ``draw``, cut without ordering a fold in one task: only folds,
    ids and keys are written and counted, then the rows that were drawn are looked up."""
    keys = materialise(left.select("fold", "id", key.alias("_key")), "round-keys")
    drawn = first_of_groups(keys, "fold", "_key", "id", size).select("fold", "id", "draw")
    return left.join(drawn, ["fold", "id"])


def _sums_by_fold(rows: DataFrame, folds: int) -> dict[int, Sums]:
    found: dict[int, list] = {f: [] for f in range(folds)}
    for row in class_moments(rows, ["fold"]).collect():
        found[row["fold"]].append(row)
    return {f: Sums.of(r) for f, r in found.items()}


def _score_folds(rows: DataFrame, models: list[tuple], on: list[str]) -> DataFrame:
    """Join each row to the model(s) of its fold. Spark knows the size of their table and
    broadcasts it while it is small."""
    table = rows.sparkSession.createDataFrame(
        models, "fold int, draw int, labeled long, w array<double>, b double"
    )
    if "draw" not in on:
        table = table.drop("draw", "labeled")
    joined = rows.join(table, "fold")
    return margin_and_prob(joined, F.col("w"), F.col("b")).drop("w", "b")
