"""The strategy fixture: five unlabeled rows, three labeled ones, fixed model output."""

import pytest
from pyspark.errors import PySparkException

from labelpool.operators.neighbours import knn_join, lds_prune, local_density_scores
from labelpool.operators.strategies import (
    STRATEGIES,
    Combined,
    Density,
    DistanceToCenter,
    Entropy,
    MinMax,
    PoolState,
    Random,
    get_strategy,
    select_batch,
)

U = [
    (0, [1.0, 2.0, 3.0], 0, [0.1, 0.9], 0.3),
    (1, [4.0, 5.0, 6.0], 1, [0.3, 0.7], -0.3),
    (2, [7.0, 8.0, 9.0], 0, [0.5, 0.5], 0.5),
    (3, [10.0, 11.0, 12.0], 1, [0.7, 0.3], -0.5),
    (4, [13.0, 14.0, 15.0], 0, [0.9, 0.1], 0.9),
]
L = [(100, [9.0, 8.0, 7.0], 1), (101, [6.0, 5.0, 4.0], 0), (102, [3.0, 2.0, 1.0], 1)]
U_SCHEMA = "id long, x array<double>, y int, prob array<double>, margin double"
L_SCHEMA = "id long, x array<double>, y int"


@pytest.fixture(scope="module")
def state(spark):
    return PoolState(spark.createDataFrame(U, U_SCHEMA), spark.createDataFrame(L, L_SCHEMA))


def vector(df):
    return [r["score"] for r in df.orderBy("id").collect()]


def picked(df):
    return [r["id"] for r in df.collect()]


CASES = [
    ("simple_margin", {}, [0.3, 0.3, 0.5, 0.5, 0.9], 0),
    ("margin", {}, [0.8, 0.4, 0.0, 0.4, 0.8], 2),
    ("entropy", {}, [0.468996, 0.881291, 1.0, 0.881291, 0.468996], 2),
    ("least_confidence", {}, [0.1, 0.3, 0.5, 0.3, 0.1], 2),
    ("lcb", {}, [0.24, 0.72, 1.2, 0.72, 0.24], 2),
    ("lcb2", {}, [0.230769, 0.692308, 1.153846, 0.692308, 0.230769], 2),
    ("d2c", {}, [0.144591, 0.261204, 0.144591, 0.084959, 0.059372], 4),
    ("density", {}, [0.088839, 0.117711, 0.124585, 0.117711, 0.088839], 0),
    ("minmax", {}, [2.828427, 2.828427, 2.828427, 5.91608, 10.77033], 4),
    (
        "minmax",
        {"metric": "mahalanobis"},
        [2.077659, 1.932184, 1.932184, 1.932184, 2.077659],
        0,
    ),
    ("combined", {"first": "entropy", "second": "minmax"}, [0, 0, 0, 0.301866, 0], 3),
    (
        "combined",
        {"first": "entropy", "second": "minmax", "beta": "dynamic"},
        [0, 0, 0, 0.033301, 0],
        3,
    ),
]


@pytest.mark.parametrize("name,params,expected,pick", CASES)
def test_scores_and_pick(state, name, params, expected, pick):
    strategy = get_strategy(name, **params)
    assert vector(strategy.score(state)) == pytest.approx(expected, abs=1e-6)
    assert picked(strategy.query(state)) == [pick]


def test_registry_has_the_eleven_names():
    assert sorted(STRATEGIES) == sorted(
        "random simple_margin margin entropy least_confidence lcb lcb2 d2c minmax density combined".split()
    )
    with pytest.raises(ValueError):
        get_strategy("nope")


def test_random_is_repeatable_and_uniform_order(state):
    a = picked(Random(3).query(state, 5))
    assert a == picked(Random(3).query(state, 5)) and sorted(a) == [0, 1, 2, 3, 4]
    assert vector(Random().score(state)) == [5.0] * 5


def test_choice_ignores_partitioning(spark, state):
    shuffled = PoolState(state.unlabeled.repartition(4), state.labeled.repartition(3))
    for name in ("entropy", "density", "minmax", "d2c"):
        assert picked(get_strategy(name).query(shuffled)) == picked(
            get_strategy(name).query(state)
        )


def test_model_change_uses_the_stored_adjusted_score(spark, state):
    strategy = Entropy(model_change=True)
    first = strategy.score(state)
    assert picked(select_batch(first, 1)) == [2]
    labeled = state.labeled.unionByName(state.unlabeled.where("id = 2").select("id", "x", "y"))
    second = PoolState(state.unlabeled.where("id <> 2"), labeled, previous=first)
    assert vector(strategy.score(second)) == pytest.approx(
        [0.351747, 0.660968, 0.660968, 0.351747], abs=1e-6
    )
    assert picked(strategy.query(second)) == [1]


def test_undefined_cosine_raises(spark, state):
    zero = spark.createDataFrame(
        [(i, [0.0, 0.0, 0.0] if i == 3 else x, y, p, m) for i, x, y, p, m in U], U_SCHEMA
    )
    bad = PoolState(zero, state.labeled)
    for strategy in (Density("cosine"), MinMax("cosine"), DistanceToCenter("cosine")):
        with pytest.raises(PySparkException):
            strategy.score(bad).collect()


def test_singular_covariance(spark):
    u = spark.createDataFrame([(i, [5.0] * 5) for i in range(5)], "id long, x array<double>")
    labeled = spark.createDataFrame(
        [(100 + i, [3.0] * 5, 1) for i in range(3)], L_SCHEMA
    )
    assert picked(MinMax("mahalanobis").query(PoolState(u, labeled))) == [0]


def test_combined_rejects_what_cannot_work():
    with pytest.raises(ValueError):
        Combined(Random(), Entropy())
    with pytest.raises(ValueError):
        Combined(Entropy(model_change=True), MinMax())
    with pytest.raises(ValueError):
        Combined(Entropy(), None)
    with pytest.warns(RuntimeWarning):
        Combined(Entropy(), MinMax(), alpha=0.5)


def test_combined_beta_zero_is_the_first_score(state):
    got = vector(Combined(Entropy(), MinMax(), beta=0).score(state))
    low, high = 0.468996, 1.0
    raw = [0.468996, 0.881291, 1.0, 0.881291, 0.468996]
    assert got == pytest.approx([(r - low) / (high - low) for r in raw], abs=1e-5)


def test_combined_orient_turns_smallest_first_parts(state):
    assert picked(Combined(Entropy(), Density(), orient=False).query(state)) == [2]
    scores = vector(Combined(get_strategy("margin"), Density(), orient=True).score(state))
    assert scores[2] == pytest.approx(0.0)


def test_lds_golden(spark):
    points = [(0.0, 0.0), (1.0, 0.0), (0.0, 1.1), (10.0, 10.0), (10.0, 11.3), (30.0, 0.0)]
    pool = spark.createDataFrame(
        [(i, list(p)) for i, p in enumerate(points)], "id long, x array<double>"
    )
    near = knn_join(pool, 2)
    lists = {}
    for r in near.orderBy("id", "rank").collect():
        lists.setdefault(r["id"], []).append(r["nbr"])
    assert lists == {0: [1, 2], 1: [0, 2], 2: [0, 1], 3: [4, 2], 4: [3, 2], 5: [3, 4]}
    for hot in (0, 100_000):  # every key by broadcast, or none
        lds = {r["id"]: r["lds"] for r in local_density_scores(near, hot).collect()}
        assert lds == {0: 1.0, 1: 1.0, 2: 1.0, 3: 0.5, 4: 0.5, 5: 1.0}
    kept = lds_prune(pool, 2, 1, "euclidean")
    assert sorted(r["id"] for r in kept.collect()) == [0, 1, 2, 5]


def test_lds_shrinks_the_pool(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    pts = np.vstack(
        [
            rng.normal(0, 0.1, (20, 2)),
            rng.normal(8, 0.1, (20, 2)),
            rng.uniform(-40, 40, (5, 2)),
        ]
    )
    pool = spark.createDataFrame(
        [(i, [float(v) for v in p]) for i, p in enumerate(pts)], "id long, x array<double>"
    )
    kept = lds_prune(pool, k=8, threshold=4).count()
    assert 0 < kept < 45
