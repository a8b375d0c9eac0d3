"""Selection inside folds, the long model, and exact order statistics for groups."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelpool.operators.long_model import fold_margins, fold_model_auc, fold_weights
from labelpool.operators.select import (
    combined_features,
    fold_scores,
    fold_selection,
    keep_features,
    select_features,
    top_percentile,
    training_sums,
    SCORERS,
)
from labelpool.operators import rounds
from labelpool.operators.rounds import fold_rounds
from labelpool.plans.cuts import first_of_groups, nth_texts, order_values, quantiles

LONG = "id long, feature string, value double"


@pytest.fixture(scope="module")
def folded(spark):
    rng = random.Random(4)
    ids = range(60)
    y = {i: int(rng.random() < 0.4) for i in ids}
    fold = {i: rng.randrange(4) for i in ids}
    rows = [(i, f"f{j:02d}", round(rng.random() * (1 + y[i] * (j % 3 == 0)), 3) + 0.1)
            for i in ids for j in range(12) if rng.random() < 0.5]
    # Only rows of fold 2 have it, and it is their label.
    rows += [(i, "leak", 1.0 + 9 * y[i]) for i in ids if fold[i] == 2]
    rows += [(100 + i, "f01", 1.0) for i in range(5)]
    labels = [(i, y[i], fold[i]) for i in ids] + [(100, None, 1)]
    return (
        spark.createDataFrame(rows, LONG), spark.createDataFrame(labels, "id long, y int, fold int"), rows, y, fold
    )


@pytest.mark.parametrize("scorer", ["chi2", "anova"])
def test_fold_scores_are_those_of_the_training_side(folded, scorer):
    features, labels, *_ = folded
    got = {(r.fold, r.feature): (r.rows, r.score) for r in fold_scores(features, labels, scorer).collect()}
    want = {}
    for f in range(4):
        side = labels.where(F.col("fold") != f)
        for r in SCORERS[scorer](features, side).collect():
            want[f, r.feature] = (r.rows, r.score)
    assert got.keys() == want.keys()
    assert not [k for k in want if k[1] == "leak" and k[0] == 2]
    for k, (rows, score) in want.items():
        assert got[k][0] == rows
        assert got[k][1] == pytest.approx(score, rel=1e-9, abs=1e-12)


def test_each_fold_selects_without_its_own_rows(folded):
    features, labels, rows, _, _ = folded
    out = select_features(features, labels, 40, within_fold=True)
    got = {}
    for r in out.collect():
        got.setdefault(r.fold, set()).add((r.id, r.feature, r.value))
    for f in range(4):
        side = select_features(features, labels.where(F.col("fold") != f), 40)
        assert got[f] == {tuple(r) for r in side.collect()}
    assert "leak" not in {n for _, n, _ in got[2]}
    # Selected again, a fold looks at its own features only.
    again = select_features(out, labels, 50, within_fold=True)
    for f in range(4):
        mine = out.where(F.col("fold") == f).drop("fold")
        side = select_features(mine, labels.where(F.col("fold") != f), 50)
        assert {tuple(r) for r in again.where(F.col("fold") == f).drop("fold").collect()} == {
            tuple(r) for r in side.collect()
        }


def test_combined_within_fold(folded):
    features, labels, *_ = folded
    args = (["all"], 50, 50, 60)
    out = combined_features(features, features, labels, *args, prefix=True, within_fold=True)
    for f in (0, 2):
        side = combined_features(features, features, labels.where(F.col("fold") != f), *args, prefix=True)
        assert sorted(map(tuple, out.where(F.col("fold") == f).drop("fold").collect())) == sorted(
            map(tuple, side.collect())
        )


def test_long_model_is_the_closed_form(folded):
    features, labels, rows, y, fold = folded
    sums = training_sums(features, labels)
    got = {r.id: r.margin for r in fold_margins(features, labels, fold_weights(sums)).collect()}
    names = sorted({n for _, n, _ in rows})
    x = np.zeros((60, len(names)))
    for i, n, v in rows:
        if i < 60:
            x[i, names.index(n)] = v
    truth = np.array([y[i] for i in range(60)])
    home = np.array([fold[i] for i in range(60)])
    aucs = {}
    for f in range(4):
        a, b = x[(home != f) & (truth == 0)], x[(home != f) & (truth == 1)]
        var = (((a - a.mean(0)) ** 2).sum(0) + ((b - b.mean(0)) ** 2).sum(0)) / (len(a) + len(b) - 2)
        w = np.where(var > 1e-12, (b.mean(0) - a.mean(0)) / np.where(var > 1e-12, var, 1), 0)
        if f == 2:
            w[names.index("leak")] = 0
        bias = math.log(len(b) / len(a)) - w @ (a.mean(0) + b.mean(0)) / 2
        m = x @ w + bias
        for i in np.flatnonzero(home == f):
            assert got[i] == pytest.approx(m[i], abs=1e-6)
        pos, neg = m[(home == f) & (truth == 1)], m[(home == f) & (truth == 0)]
        aucs[f] = np.mean([(p > q) + (p == q) / 2 for p in pos for q in neg])
    assert {r.fold: r.auc for r in fold_model_auc(features, labels, sums).collect()} == pytest.approx(aucs)


def test_folds_of_nothing(spark, folded):
    features, labels, *_ = folded
    none = spark.createDataFrame([], LONG)
    assert fold_selection(none, labels, 10).count() == 0
    assert keep_features(none, fold_selection(none, labels, 10)).count() == 0
    with pytest.raises(ValueError):
        training_sums(features, labels.limit(0))


@pytest.mark.parametrize("step", [0.5, 1 / 7, 1 / 4096])
def test_order_values_by_group(spark, step):
    rng = np.random.default_rng(3)
    groups = {
        0: rng.normal(size=900),
        1: np.r_[np.full(700, 0.5), rng.normal(size=40) * 1e-300, [np.inf] * 9, [-np.inf] * 5, -0.0, 0.0],
        2: np.array([5e-324, -5e-324, 1.7e308, -1.7e308, 1.0, np.nextafter(1.0, 2)]),
        3: np.array([7.0]),
    }
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g int, v double")
    found = order_values(df, "v", lambda n: [1, (n + 1) // 2, n], F.col("g"), step)
    for g, vs in groups.items():
        s = np.sort(vs)
        assert found[g] == (len(s), [s[0], s[(len(s) + 1) // 2 - 1], s[-1]])
    for q in (0.0, 0.37, 0.9):
        for g, (n, value) in quantiles(df.where("g IN (0, 3)"), "v", q, F.col("g"), step).items():
            assert (n, value) == (len(groups[g]), pytest.approx(np.percentile(groups[g], 100 * q), rel=1e-12))
    assert order_values(df.where("g > 9"), "v", lambda n: [1]) == {}


def test_no_window_over_a_whole_table(spark, capsys):
    """The cut is found by counts: what is left to run is a filter."""
    scores = spark.createDataFrame([(f"f{i}", float(i % 40)) for i in range(400)], "feature string, score double")
    kept = top_percentile(scores, 33)
    kept.explain()
    plan = capsys.readouterr().out
    assert "Window" not in plan and "Exchange" not in plan and "Sort" not in plan
    assert kept.count() == int(400 * 0.33)


def test_percentile_by_group_is_that_of_each(spark):
    rng = random.Random(8)
    rows = [(g, f"n{i}", rng.choice([None, 0.0, 1.0, 2.5, rng.random()])) for g in range(3) for i in range(50)]
    scores = spark.createDataFrame(rows, "fold int, feature string, score double")
    got = {(r.fold, r.feature) for r in top_percentile(scores, 35, "fold").collect()}
    for g in range(3):
        own = top_percentile(scores.where(F.col("fold") == g), 35)
        assert {n for f, n in got if f == g} == {r.feature for r in own.collect()}


def test_nth_texts_of_groups(spark):
    rng = random.Random(1)
    groups = {g: sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(60)})
              for g in range(3)}
    df = spark.createDataFrame([(g, t) for g, ts in groups.items() for t in ts], "g int, t string")
    for small in (1, 5, 10_000):
        ranks = {0: 1, 1: 17, 2: len(groups[2])}
        assert nth_texts(df, "t", ranks, F.col("g"), small) == {g: groups[g][r - 1] for g, r in ranks.items()}


def test_first_rows_of_groups(spark):
    """Heavy ties, infinite keys, large ids, groups smaller than the limit."""
    rng = random.Random(6)
    rows = []
    for g, n in ((0, 300), (1, 40), (2, 3)):
        ids = rng.sample(range(2**62, 2**62 + 5000), n)
        rows += [(g, rng.choice([1.0, 1.0, 1.0, 2.5, -3.0, math.inf, rng.random()]), i) for i in ids]
    df = spark.createDataFrame(rows, "fold int, k double, id long").repartition(5)
    for limit in (1, 2, 37, 120, 1000):
        got = sorted((r.fold, r.draw, r.k, r.id) for r in first_of_groups(df, "fold", "k", "id", limit).collect())
        want = []
        for g in range(3):
            best = sorted((k, i) for f, k, i in rows if f == g)[:limit]
            want += [(g, d, k, i) for d, (k, i) in enumerate(best)]
        assert got == want
    assert first_of_groups(df.limit(0), "fold", "k", "id", 5).count() == 0


def test_large_batches_are_those_of_the_ranking(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 3)).round(1)
    rows = [(i, v.tolist(), int(v.sum() + rng.normal() > 0), i % 3) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y int, fold int")
    for name in ("entropy", "simple_margin"):
        want = fold_rounds(df, name, 3, 2, 20)[1].collect()
        with monkeypatch.context() as m:
            m.setattr(rounds, "WINDOW_ROWS", 5)
            got = fold_rounds(df, name, 3, 2, 20)[1].collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
