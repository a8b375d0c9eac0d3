"""Certificates of hinge models against plain numpy and against what must hold for every model."""

import numpy as np
import pytest

from labelpool.operators import models
from labelpool.operators.certificate import WIDTHS, hinge_certificates, hinge_weights

SCHEMA = "x array<double>, y int"


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 3)) * [1, 3, 0.5]
    y = (x[:, 0] + 0.4 * x[:, 1] + rng.normal(size=400) > 0.7).astype(int)
    rows = [(v.tolist(), int(t)) for v, t in zip(x, y)] + [(None, 1), ([1.0, 2.0, 3.0], None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4), x, y


def objective(x, y, w, b, alpha):
    return np.maximum(0, 1 - (2 * y - 1) * (x @ w + b)).mean() + alpha / 2 * (w @ w)


def brute(x, y, w, b, alpha):
    """The bound and the subgradient, row by row."""
    s, n = 2 * y - 1, len(y)
    m = s * (x @ w + b)
    best = 0.0
    for width in WIDTHS:
        a = (m < 1).astype(float) if width == 0 else np.clip(0.5 + (1 - m) / width, 0, 1)
        totals = [a[y == c].sum() for c in (0, 1)]
        if min(totals) == 0:
            continue
        a = a * np.where(y == 1, min(totals) / totals[1], min(totals) / totals[0])
        assert abs((a * s).sum()) < 1e-9 and a.min() >= 0 and a.max() <= 1 + 1e-12
        v = (a * s) @ x / (alpha * n)
        t = min(1.0, a.mean() / (alpha * (v @ v)))
        best = max(best, t * a.mean() - alpha / 2 * t * t * (v @ v))
    inside = (m < 1) * s
    return best, np.linalg.norm(np.r_[alpha * w - inside @ x / n, -inside.sum() / n])


@pytest.mark.parametrize("alpha", [1e-3, 0.1, 10.0])
def test_certificate_is_the_brute_force_one(data, alpha):
    df, x, y = data
    w, b = np.array([0.8, 0.3, -0.1]), -0.4
    (got,) = hinge_certificates(df, w, b, [alpha])
    dual, sub = brute(x, y, w, b, alpha)
    assert got.objective == pytest.approx(objective(x, y, w, b, alpha), rel=1e-12)
    assert got.dual == pytest.approx(dual, rel=1e-9) and got.subgradient == pytest.approx(sub, rel=1e-9)
    assert got.gap == got.objective - got.dual


def test_bound_holds_for_every_model_and_is_tight_at_the_best(data):
    df, x, y = data
    alpha = 0.1
    fitted = models.LinearModel(models.hinge(alpha, 500, 1e-8)).fit(df.where("x IS NOT NULL AND y IS NOT NULL"))
    w, b = hinge_weights(fitted)
    (best,) = hinge_certificates(df, w, b, [alpha])
    assert best.objective == pytest.approx(objective(x, y, np.array(w), b, alpha), rel=1e-12)
    assert 0 <= best.gap < 0.02 * best.objective
    rng = np.random.default_rng(3)
    for _ in range(5):
        other = np.array(w) + rng.normal(size=3) * 0.3
        (c,) = hinge_certificates(df, other, b + rng.normal() * 0.2, [alpha])
        # No model beats any bound, and a model far away shows a larger gap.
        assert c.dual <= best.objective + 1e-12 and c.objective >= best.dual and c.gap > best.gap


def test_one_pass_serves_all_penalties(data):
    df, _, _ = data
    w, b = [0.8, 0.3, -0.1], -0.4
    together = hinge_certificates(df, w, b, models.ALPHA_GRID)
    assert together == [hinge_certificates(df, w, b, [a])[0] for a in models.ALPHA_GRID]


def test_edges(spark, data):
    df, x, y = data
    empty = spark.createDataFrame([], SCHEMA)
    assert hinge_certificates(empty, [1.0, 0.0, 0.0], 0.0, [0.1]) == []
    (one,) = hinge_certificates(df.where("y = 1"), [0.0, 0.0, 0.0], 1.0, [0.1])
    assert one.objective == 0 and one.dual == 0 and one.subgradient == 0
    # Margins of exactly 1 lie on the kink: they cost nothing.
    tie = spark.createDataFrame([([1.0], 1), ([-1.0], 0), ([1.0], 1)], SCHEMA)
    (kink,) = hinge_certificates(tie, [1.0], 0.0, [0.1])
    assert kink.objective == pytest.approx(0.05) and kink.dual <= 0.05 + 1e-12
    with pytest.raises(ValueError):
        hinge_certificates(df, [0.0, 0.0, 0.0], 0.0, [0.0])
    with pytest.raises(ValueError):
        hinge_certificates(spark.createDataFrame([([1.0], 2)], SCHEMA), [0.0], 0.0, [0.1])
