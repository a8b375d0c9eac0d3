"""The pool as tables: moving rows from unlabeled to labeled, taking rows, one-shot selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelpool.operators.strategies import PoolState, QueryStrategy
from labelpool.plans.cuts import numbered


def take_rows(df: DataFrame, ids: Sequence[int] | int, id_col: str = "id") -> DataFrame:
    """The rows with the given id or ids."""
    wanted = [ids] if isinstance(ids, int) else list(ids)
    return df.where(F.col(id_col).isin(wanted))


def move_to_labeled(
    unlabeled: DataFrame, labeled: DataFrame, chosen: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """U without the chosen ids, L with them."""
    moved = unlabeled.join(chosen.select("id"), "id", "left_semi")
    columns = labeled.columns
    return (
        unlabeled.join(chosen.select("id"), "id", "left_anti"),
        labeled.unionByName(moved.select(*columns)),
    )


def next_batch(
    unlabeled: DataFrame,
    labeled: DataFrame,
    strategy: QueryStrategy,
    k: int,
    model=None,
    previous: DataFrame | None = None,
) -> DataFrame:
    """``(id, score, draw)``: the next ``k`` rows to label, best first.

    ``model`` has ``fit`` and gives ``margin`` / ``prob``; it is trained on L when the strategy
    needs one.
    """
    if strategy.needs_model:
        if model is None:
            raise ValueError(f"{strategy.name} needs a model")
        unlabeled = model.fit(labeled).transform(unlabeled)
    state = PoolState(unlabeled, labeled, previous=previous)
    return with_draw(strategy, strategy.query(state, k))


def with_draw(strategy: QueryStrategy, batch: DataFrame) -> DataFrame:
    """Number the rows of one batch in picking order, from 0, however large the batch is."""
    from labelpool.functions.hashing import hash_order
    from labelpool.operators.strategies import TIE_DIGITS, Random

    if isinstance(strategy, Random):
        order = [hash_order("id", strategy.seed), F.col("id")]
    else:
        key = F.round("score", TIE_DIGITS)
        order = [
            key.desc_nulls_last() if strategy.pick_largest else key.asc_nulls_last(),
            F.col("id"),
        ]
    return numbered(batch, order, "draw").withColumn("draw", F.col("draw").cast("int"))
