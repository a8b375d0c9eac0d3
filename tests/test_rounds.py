"""The loop fixture and properties of acquisition rounds."""

import pytest
from pyspark.sql import functions as F

from labelpool.operators import models
from labelpool.operators.incremental import update_min_distances, update_similarity_sums
from labelpool.operators.moments import Discriminant
from labelpool.operators.pool import next_batch
from labelpool.operators.rounds import ActiveLearner, experiment, fold_rounds
from labelpool.operators.spaces import Space
from labelpool.operators.splits import stratified_folds
from labelpool.operators.strategies import get_strategy, min_distances, similarity_sums

SCHEMA = "id long, x array<double>, y int"
TRAIN = [[0.5, 1.5], [0.5, 3.0], [2.0, 3.0], [2.0, 1.5], [3.0, 1.0], [3.0, 3.0]]


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(
        [(i, x, y) for i, (x, y) in enumerate(zip(TRAIN, [0, 0, 0, 1, 1, 1]))], SCHEMA
    ).repartition(1)


@pytest.fixture(scope="module")
def test(spark):
    return spark.createDataFrame([(10, [1.0, 2.0], 0), (11, [2.0, 1.0], 1)], SCHEMA).repartition(1)


STRATEGIES = {
    "random": {},
    "simple_margin": {},
    "margin": {},
    "entropy": {"model_change": True},
    "least_confidence": {},
    "lcb": {},
    "lcb2": {},
    "d2c": {},
    "minmax": {},
    "density": {},
    "combined": {"first": "entropy", "second": "minmax"},
}


@pytest.mark.parametrize("name", STRATEGIES)
def test_curve_has_one_point_per_draw(train, test, name):
    run = ActiveLearner(get_strategy(name, **STRATEGIES[name]), u_share=0.4, seed=1).run(train, test)
    curve = run.curve.orderBy("draw").collect()
    assert [(r["draw"], r["labeled"]) for r in curve] == [(0, 3), (1, 4), (2, 5)]
    choices = run.choices.collect()
    assert [r["draw"] for r in choices] == [0, 1, 2] and len({r["id"] for r in choices}) == 3


def test_draws_can_be_limited_and_batched(train, test):
    learner = ActiveLearner(get_strategy("entropy"), u_share=0.4, seed=1)
    assert learner.run(train, test, 2).curve.count() == 2
    batched = ActiveLearner(get_strategy("d2c"), u_share=0.4, seed=1, batch_size=3)
    run = batched.run(train, test)
    assert run.curve.count() == 1 and run.choices.count() == 3


def test_labeled_set_of_one_class_is_reported_not_a_crash(train, test):
    for seed in range(40):
        run = ActiveLearner(get_strategy("entropy"), u_share=0.5, seed=seed)
        from labelpool.operators.splits import split_u_l

        split = split_u_l(train, 0.5, seed).where("role = 'L'")
        if split.select("y").distinct().count() == 1:
            first = run.run(train, test, 1).curve.first()
            assert first["auc"] is None
            return
    pytest.fail("no seed gave one class")


def test_bad_settings(train, test):
    with pytest.raises(ValueError):
        ActiveLearner(get_strategy("random"), u_share=1.2)
    with pytest.raises(ValueError):
        ActiveLearner(get_strategy("random"), batch_size=0)
    with pytest.raises(ValueError):
        next_batch(train, train, get_strategy("entropy"), 1)


@pytest.fixture(scope="module")
def pool(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=4) + (i % 2)).tolist(), i % 2) for i in range(240)]
    return stratified_folds(spark.createDataFrame(rows, SCHEMA).repartition(2), 3, 1).cache()


def test_fold_rounds_equal_the_general_loop(pool):
    """One fold of the joint run picks what the loop over single folds picks."""
    curves, choices = fold_rounds(pool, "least_confidence", 3, 3, 4)
    assert curves.count() == 9 and choices.count() == 36
    assert choices.groupBy("fold").agg(F.count_distinct("id").alias("n")).where("n <> 12").count() == 0
    fold_of = {r["id"]: r["fold"] for r in pool.collect()}
    assert all(fold_of[r["id"]] != r["fold"] for r in choices.collect())
    labeled = {(r["fold"], r["draw"]): r["labeled"] for r in curves.collect()}
    assert all(labeled[f, d] == labeled[f, 0] + 4 * d for f in range(3) for d in range(3))
    with pytest.raises(ValueError):
        fold_rounds(pool, "density", 3, 1, 1)


def test_experiment_runs_every_strategy_on_every_fold(pool):
    learners = {
        "random": ActiveLearner(get_strategy("random"), batch_size=5),
        "minmax": ActiveLearner(get_strategy("minmax", metric="mahalanobis"), batch_size=5),
    }
    curves, choices = experiment(pool, learners, [0, 1], ndraws=10)
    assert curves.count() == 8 and choices.count() == 40


def test_batch_of_one_repeated_equals_the_incremental_statistics(pool):
    """Distances and similarity sums updated by a batch equal those computed anew."""
    frame = Space("euclidean")
    u, labeled = pool.where("id >= 40"), pool.where("id < 40")
    batch = u.where("id % 10 = 3")
    rest = u.where("id % 10 <> 3")
    both = labeled.unionByName(batch)
    got = update_min_distances(frame, min_distances(frame, u, labeled), rest, batch)
    want = min_distances(frame, rest, both).withColumnRenamed("d", "w")
    assert got.join(want, "id").where("abs(d - w) > 1e-12").count() == 0 and got.count() == rest.count()
    sums = update_similarity_sums(frame, similarity_sums(frame, u), rest, batch)
    anew = similarity_sums(frame, rest).withColumnsRenamed({"s": "s2", "n": "n2"})
    joined = sums.join(anew, "id")
    assert joined.count() == rest.count()
    assert joined.where("abs(s - s2) > 1e-9 OR n <> n2").count() == 0


def test_partial_fit_equals_fit(pool):
    halves = Discriminant().fit(pool.where("id < 100")).partial_fit(pool.where("id >= 100"))
    whole = Discriminant().fit(pool)
    assert halves.b == pytest.approx(whole.b) and halves.w == pytest.approx(whole.w)


def test_spark_ml_models_give_margin_and_probability(pool):
    train, test = pool.where("fold > 0"), pool.where("fold = 0")
    for model in (
        models.LinearModel(models.log_loss(max_iter=20)),
        models.PlattScaled(models.hinge(max_iter=20)),
        models.PlattScaled(models.linear_svc(1.0, 160, max_iter=20)),
    ):
        out = model.fit(train).transform(test).collect()
        assert all(abs(sum(r["prob"]) - 1) < 1e-9 for r in out)
        right = sum((r["prob"][1] > 0.5) == (r["y"] == 1) for r in out)
        assert right / len(out) > 0.75
        ordered = sorted(out, key=lambda r: r["margin"])
        assert [r["prob"][1] for r in ordered] == sorted(r["prob"][1] for r in out)
    bare = models.LinearModel(models.hinge(max_iter=20)).fit(train).transform(test)
    assert "prob" not in bare.columns and bare.where("margin IS NULL").count() == 0


def test_cross_validation_and_grid(pool):
    rows = models.with_vector(pool)
    mean, spread = models.cross_validate(models.hinge(max_iter=5), rows, 3)
    assert 0.8 < mean <= 1 and 0 <= spread < 0.3
    best, table = models.grid_search(models.hinge(max_iter=5), "regParam", [1e-4, 10.0], rows, 3)
    assert [v for v, _ in table] == [1e-4, 10.0] and best is not None
