"""Pair statistics kept up over rounds, and farthest-first batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelpool.operators import incremental, strategies
from labelpool.operators.incremental import PairScores, farthest_first
from labelpool.operators.pool import next_batch
from labelpool.operators.rounds import ActiveLearner
from labelpool.operators.spaces import Space
from labelpool.operators.strategies import Combined, KCenter, PoolState, get_strategy, min_distances

SCHEMA = "id long, x array<double>, y int"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(70, 4))
    x[40:50] = x[30:40]  # near copies of other rows
    df = spark.createDataFrame([(i, v.tolist(), int(v[0] > 0)) for i, v in enumerate(x)], SCHEMA)
    return df.repartition(3), x


def choices(learner, df):
    run = learner.run(df.where("id < 60"), df.where("id >= 60"), 12)
    return [(r["draw"], r["id"]) for r in run.choices.collect()]


@pytest.mark.parametrize("name", ["minmax", "density", "combined"])
def test_kept_statistics_choose_the_same_rows(rows, name):
    """Kept up over all rounds, or computed anew in each: the same choices."""
    make = {
        "minmax": lambda: get_strategy("minmax"),
        "density": lambda: get_strategy("density", metric="cityblock"),
        "combined": lambda: Combined(get_strategy("entropy"), get_strategy("minmax")),
    }[name]
    df, _ = rows
    kept = choices(ActiveLearner(make(), u_share=0.8, seed=2, batch_size=4), df)
    anew = choices(ActiveLearner(make(), u_share=0.8, seed=2, batch_size=4, refresh=1), df)
    assert kept == anew and len(kept) == 12


def test_a_batch_costs_distances_to_the_batch_only(rows, monkeypatch):
    df, _ = rows
    counted = []

    def counting(left, right, *args, **more):
        counted.append(left.count() * right.count())
        return plain(left, right, *args, **more)

    plain = strategies.cross_pairs
    monkeypatch.setattr(strategies, "cross_pairs", counting)
    monkeypatch.setattr(incremental, "cross_pairs", counting)
    choices(ActiveLearner(get_strategy("minmax"), u_share=0.8, seed=2, batch_size=4), df)
    # 48 rows of U, 12 of L: all pairs once, then what is left of U against four rows.
    assert counted == [48 * 12, 44 * 4, 40 * 4]


def test_refresh_measures_drift(rows):
    df, _ = rows
    u, labeled = df.where("id < 40"), df.where("id >= 60")
    keeper = PairScores(get_strategy("density"), refresh=2)
    part = keeper.parts[0]
    keeper.advance(u, labeled, None)
    for r, cut in enumerate((35, 30), 1):
        batch = u.where(F.col("id") >= cut)
        u, labeled = u.where(F.col("id") < cut), labeled.union(batch)
        tables = keeper.advance(u, labeled, batch)
    assert [v for v, _ in keeper.drift] == [2] and 0 <= keeper.drift[0][1] < 1e-9
    want = {r.id: r.s for r in part.statistics(PoolState(u, labeled)).collect()}
    assert {r.id: r.s for r in tables[id(part)].collect()} == pytest.approx(want)
    # A kept table that is wrong is seen.
    keeper.tables[id(part)] = tables[id(part)].withColumn("s", F.col("s") + 1)
    keeper.advance(u, labeled, u.limit(0))
    keeper.version = 4
    keeper.advance(u, labeled, u.limit(0))
    assert keeper.drift[-1][1] >= 0


def test_only_lasting_spaces_are_kept():
    assert not PairScores(get_strategy("minmax", metric="seuclidean")).parts
    assert not PairScores(get_strategy("entropy")).parts
    assert len(PairScores(Combined(get_strategy("density"), get_strategy("minmax"))).parts) == 2
    with pytest.raises(ValueError):
        PairScores(get_strategy("minmax"), refresh=0)


@pytest.mark.parametrize("candidates", [1, 5, 1024])
def test_farthest_first(spark, rows, candidates):
    df, x = rows
    u, labeled = df.where("id < 55"), df.where("id >= 60")
    frame = Space("euclidean")
    d = np.linalg.norm(x[:55, None] - x[None, 60:], axis=2).min(axis=1)
    want, left = [], set(range(55))
    while len(want) < 9:
        best = min(left, key=lambda i: (-round(d[i], 9), i))
        want.append((best, pytest.approx(d[best])))
        left.remove(best)
        d = np.minimum(d, np.linalg.norm(x[:55] - x[best], axis=1))
    got = farthest_first(frame, u, min_distances(frame, u, labeled), 9, candidates).collect()
    assert [tuple(r) for r in got] == want


def test_kcenter_batch_avoids_copies(rows):
    df, x = rows
    u, labeled = df.where("id < 60"), df.where("id >= 60")
    batch = next_batch(u, labeled, KCenter(), 30)
    ids = [r.id for r in batch.orderBy("draw").collect()]
    assert not [i for i in ids if 30 <= i < 40 and i + 10 in ids]
    assert next_batch(u, labeled, KCenter(), 200).count() == 60


def test_a_tile_holds_few_distances():
    """8 MB of distances at a time, whatever the sides are."""
    import numpy as np

    from labelpool.plans import blocks

    sizes = []

    def kernel(d, rows, cols):
        sizes.append(d.nbytes)
        return {"id": rows}

    a, b = np.zeros((3000, 2)), np.ones((2000, 2))
    parts = blocks._tiles("euclidean", kernel, np.arange(3000), a, np.arange(2000), b)
    assert max(sizes) <= 8 << 20 and sum(len(p["id"]) for p in parts) == 3000
