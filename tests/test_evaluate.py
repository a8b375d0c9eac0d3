import numpy as np
import pytest
from pyspark.sql import functions as F

from labelpool.operators.evaluate import (
    auc,
    first_reach,
    mean_curve,
    min_max,
    normalised_alc,
    reliability_curve,
)


def scored(spark, rows):
    return spark.createDataFrame([(float(s), int(y)) for s, y in rows], "score double, y int")


def brute(scores, labels):
    pos, neg = scores[labels == 1], scores[labels == 0]
    return ((pos[:, None] > neg[None]).mean() + 0.5 * (pos[:, None] == neg[None]).mean())


def test_auc_golden(spark):
    df = scored(spark, zip([0.1, 0.4, 0.4, 0.35, 0.8], [0, 0, 1, 1, 1]))
    assert auc(df).first()["auc"] == pytest.approx(0.75)


def test_auc_missing_class_is_null(spark):
    row = auc(scored(spark, [(0.1, 1), (0.2, 1)])).first()
    assert row["auc"] is None and row["n_neg"] == 0


def test_auc_over_many_ranges_with_hot_ties(spark):
    rng = np.random.default_rng(1)
    s = np.concatenate([rng.normal(size=3000).round(3), np.full(1500, 0.1)])
    y = rng.integers(0, 2, size=len(s))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = auc(scored(spark, zip(s, y))).first()["auc"]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == pytest.approx(brute(s, y), abs=1e-12)


def test_auc_by_group(spark):
    rng = np.random.default_rng(2)
    s, y, g = rng.normal(size=900).round(1), rng.integers(0, 2, 900), rng.integers(0, 4, 900)
    df = spark.createDataFrame(
        [(float(a), int(b), int(c)) for a, b, c in zip(s, y, g)], "score double, y int, g int"
    )
    for r in auc(df, by=["g"]).collect():
        assert r["auc"] == pytest.approx(brute(s[g == r["g"]], y[g == r["g"]]))


def test_alc_golden(spark):
    curve = spark.createDataFrame(
        [("a", i, v) for i, v in enumerate([0.5, 0.6, 0.8, 0.9])], "strategy string, draw int, auc double"
    )
    assert normalised_alc(curve).first()["alc"] == pytest.approx(0.4)
    assert first_reach(curve, 0.8).first()["first_draw"] == 2
    assert first_reach(curve, 0.99).first()["first_draw"] is None


def test_mean_curve_is_cut_to_the_shortest_fold(spark):
    rows = [("a", 0, d, 0.5 + d / 10) for d in range(4)] + [("a", 1, d, 0.7) for d in range(2)]
    curves = spark.createDataFrame(rows, "strategy string, fold int, draw int, auc double")
    got = [(r["draw"], r["auc"]) for r in mean_curve(curves).orderBy("draw").collect()]
    assert [d for d, _ in got] == [0, 1]
    assert [v for _, v in got] == pytest.approx([0.6, 0.65])
    assert mean_curve(curves.drop("strategy"), by=[]).count() == 2


def test_reliability_golden(spark):
    df = scored(spark, zip([0, 0.05, 0.1, 0.15, 0.55, 0.95, 1], [0, 0, 1, 0, 1, 1, 1]))
    got = {r["bin"]: (r["mean_score"], r["positive_rate"]) for r in reliability_curve(df).collect()}
    assert got[1] == pytest.approx((0.075, 0.5))
    assert got[2] == pytest.approx((0.15, 0.0))
    assert got[6] == pytest.approx((0.55, 1.0))
    assert got[10] == pytest.approx((0.975, 1.0))
    assert all(got[i] == (None, None) for i in (3, 4, 5, 7, 8, 9)) and len(got) == 10


def test_reliability_can_scale_first(spark):
    df = scored(spark, [(-2, 0), (0, 1), (2, 1)])
    got = {r["bin"]: r["n"] for r in reliability_curve(df, bins=2, normalise=True).collect()}
    assert got == {1: 1, 2: 1}


@pytest.mark.parametrize("flat,expected", [(0.4, 0.4), (4.0, 0.25), (1.0, 1.0)])
def test_flat_scores(spark, flat, expected):
    df = spark.range(3).select("id", F.lit(flat).alias("score"))
    assert [r["score"] for r in min_max(df).collect()] == [expected] * 3
