"""Newton steps against plain numpy and against Spark's own optimiser."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelpool.operators import models
from labelpool.operators.moments import Discriminant
from labelpool.operators.newton import (
    NewtonLogistic, PlattNewton, margin_rows, newton_fits, platt_grid,
)

SCHEMA = "x array<double>, y int, m string"


def loss_of(w, b, x, y, alpha):
    z = x @ w + b
    return np.mean(np.logaddexp(0, z) - y * z) + alpha / 2 * (w @ w)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3)) * [1, 5, 0.1]
    y = (x[:, 0] + 0.2 * x[:, 1] + rng.logistic(size=300) > 0.3).astype(int)
    rows = [(v.tolist(), int(t), "ab"[i % 2]) for i, (v, t) in enumerate(zip(x, y))]
    rows += [(None, 1, "a"), ([1.0, 1.0, 1.0], None, "a")]
    return spark.createDataFrame(rows, SCHEMA).repartition(4), x, y


@pytest.mark.parametrize("alpha", [1e-4, 0.1, 10.0])
def test_gradient_is_zero_at_the_end(data, alpha):
    df, x, y = data
    fit = newton_fits(df, {0: alpha})[0]
    w, b = np.array(fit.w), fit.b
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(np.r_[x.T @ (p - y) / len(y) + alpha * w, (p - y).mean()]).max() < 1e-10
    assert fit.loss == pytest.approx(loss_of(w, b, x, y, alpha), rel=1e-12)
    for d in np.random.default_rng(1).normal(size=(20, 4)) * 0.05:
        assert loss_of(w + d[:3], b + d[3], x, y, alpha) > fit.loss


def test_agrees_with_the_batch_optimiser(data):
    df, x, y = data
    df = df.where("x IS NOT NULL AND y IS NOT NULL")
    ours = NewtonLogistic(0.01).fit(df).transform(df)
    theirs = models.LinearModel(models.log_loss(0.01, 200, 1e-10)).fit(df).transform(df)
    a, b = ([r.margin for r in d.orderBy("x").collect()] for d in (ours, theirs))
    assert a == pytest.approx(b, abs=1e-4)
    assert all(abs(sum(r.prob) - 1) < 1e-12 for r in ours.collect())


def test_many_models_in_one_pass(data):
    df, x, y = data
    both = newton_fits(df, {"a": 0.01, "b": 0.5, "c": 1.0}, model="m")
    assert set(both) == {"a", "b"}
    for m, alpha in (("a", 0.01), ("b", 0.5)):
        one = newton_fits(df.where(F.col("m") == m), {0: alpha})[0]
        assert both[m].w == pytest.approx(one.w) and both[m].b == pytest.approx(one.b)


def test_steps_that_go_too_far_are_halved(spark):
    """A separable set with an outlier, on which full steps from zero run away."""
    x = [[-200.0], [-1.0], [-0.9], [0.9], [1.0], [1e4]]
    rows = [(v, int(v[0] > 0), "a") for v in x] + [([30.0], 0, "a"), ([-30.0], 1, "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    fit = newton_fits(df, {0: 1e-6})[0]
    xs, ys = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    p = 1 / (1 + np.exp(-(xs @ np.array(fit.w) + fit.b)))
    assert np.abs(xs.T @ (p - ys) / len(ys) + 1e-6 * np.array(fit.w)).max() < 1e-5
    assert math.isfinite(fit.loss) and fit.loss <= math.log(2)


def test_one_class_and_no_rows(spark, data):
    df, *_ = data
    for rows in (df.where("y = 1"), df.limit(0)):
        assert newton_fits(rows, {0: 1.0}) == {}
        out = NewtonLogistic().fit(rows).transform(df)
        assert out.where("prob IS NOT NULL OR margin IS NOT NULL").count() == 0
    assert PlattNewton().fit(df.where("y = 1 AND x IS NOT NULL")).transform(df).where("prob IS NOT NULL").count() == 0


def test_platt_of_any_margin(data):
    """On a hinge model's margins it is what the library's own calibration gives."""
    df, x, y = data
    df = df.where("x IS NOT NULL AND y IS NOT NULL")
    hinge = models.LinearModel(models.hinge(0.01))
    ours = PlattNewton(hinge).fit(df).transform(df)
    theirs = models.PlattScaled(models.hinge(0.01)).fit(df).transform(df)
    a, b = ([r.prob[1] for r in d.orderBy("x").collect()] for d in (ours, theirs))
    assert a == pytest.approx(b, abs=1e-3)
    out = models.cross_validate_model(lambda: PlattNewton(models.LinearModel(models.hinge(0.01))),
                                      df.withColumn("fold", (F.xxhash64("x") % 2 == 0).cast("int")), [0, 1])
    assert [0.6 < r.auc < 1 and 0 < r.log_loss < 0.7 for r in out.collect()] == [True, True]


def test_grid_of_c(data):
    df, *_ = data
    df = df.where("x IS NOT NULL AND y IS NOT NULL")
    model = Discriminant().fit(df)
    grid = platt_grid(model, df, (0.1, 10.0))
    rows = margin_rows(model, df)
    for c, fit in grid.items():
        alone = newton_fits(rows, {0: 1 / (c * 300)})[0]
        assert (fit.w, fit.b) == (pytest.approx(alone.w), pytest.approx(alone.b))
    assert abs(grid[0.1].w[0]) < abs(grid[10.0].w[0])
