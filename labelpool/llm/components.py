"""Connected components of a graph too large for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelpool.llm.spread import join_by_part
from labelpool.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """``(id, root)`` for every node of ``edges (a, b)``; the root is the smallest id reachable.

    Alternates two steps until nothing changes: every node links its larger neighbours to its
    smallest one, then its smaller ones. Both only shorten paths, so a chain of n nodes takes about
    log n rounds, and edges never outnumber the first ones. The edges of a node
    with very many neighbours are dealt out over tasks. Each
    round's edges are written, so a lost executor costs one round.
    """
    now = materialise(_tidy(edges.select("a", "b")), "edges")
    while True:
        mark = _mark(now)
        if mark[0] == 0:
            break
        # The larger neighbours: each end knows its neighbours, the minimum goes to all of them.
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = _tidy(
            join_by_part(both.where("b > a"), least, ["a"], "b").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        # The smaller neighbours: in (a, b) with a > b, all b and a meet at the least b.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = _tidy(
            joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
                least.select("a", F.col("m").alias("b"))
            )
        )
        now = materialise(small, "edges")
        if _mark(now) == mark:
            break
    return (
        now.select(F.col("a").alias("id"), F.col("b").alias("root"))
        .union(now.select(F.col("b").alias("id"), F.col("b").alias("root")))
        .distinct()
    )


def _tidy(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger id to the smaller."""
    return (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    ).first()
    return tuple(row)
