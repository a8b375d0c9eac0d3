"""The hinge classifier over long features against Spark ML's own."""

import pickle
import random
from itertools import groupby

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.linalg import Vectors

from labelpool.operators import long_svm, models
from labelpool.operators.long_svm import _entries, cross_validate_hinge
from labelpool.queries import text


def table(spark, n=48, d=60, k=2):
    draw = random.Random(4)
    weights = [draw.gauss(0, 1) for _ in range(d)]
    rows = []
    for i in range(n):
        idx = sorted(draw.sample(range(1, d), 8))
        values = [draw.random() + 0.1 for _ in idx]
        score = sum(v * weights[j] for j, v in zip(idx, values, strict=True))
        # Feature 0 never varies, so it has no scale and no weight.
        rows.append((Vectors.sparse(d, [0, *idx], [0.3, *values]), int(score + draw.gauss(0, 0.5) > 0), i % k))
    return spark.createDataFrame(rows, ["features", "y", "fold"])


def test_agrees_with_spark_ml(spark):
    rows = table(spark)
    # Ten steps and more fill the history.
    estimator = models.hinge(max_iter=11)
    assert cross_validate_hinge(estimator, rows, 2) == pytest.approx(
        models.cross_validate(estimator, rows, 2), abs=1e-12
    )


def test_folds_without_rows_are_refused(spark):
    with pytest.raises(ValueError, match="fold 2 is empty"):
        cross_validate_hinge(models.hinge(), table(spark), 3)


def test_a_feature_twice_in_a_row_is_refused():
    # A vector as it comes from a written table: nothing has looked at its indices.
    vector = Vectors.sparse(4, [1, 2], [0.5, 0.5])
    vector.indices[1] = 1
    with pytest.raises(ValueError, match="names a feature twice"):
        _entries(vector)


def test_query_sends_no_gradient_through_the_driver(spark, tmp_path, monkeypatch):
    draw, words = random.Random(7), [f"word{i}" for i in range(60)]
    docs = [(i, " ".join(draw.choices(words, k=12)), "en", "web", 70) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality long, toxic long").write.parquet(
        f"{tmp_path}/labels.parquet"
    )

    def through_the_driver(*_):
        raise AssertionError("LinearSVC.fit sends a gradient of all features to the driver in every step")

    monkeypatch.setattr(LinearSVC, "fit", through_the_driver)
    monkeypatch.setattr(LinearSVC, "_fit", through_the_driver)
    short = models.hinge(max_iter=2)
    monkeypatch.setattr(text.models, "hinge", lambda: short)
    (row,) = text.text_model_cv(spark, str(tmp_path)).collect()
    assert 0 <= row["auc"] <= 1


def many(n=4000, d=5000, width=60):
    """``((features, y, fold), number)`` of more values than a record may hold."""
    draw = np.random.default_rng(5)
    for i in range(n):
        idx = np.sort(draw.choice(d, width, replace=False))
        yield {"features": Vectors.sparse(d, idx, draw.random(width) + 0.1), "y": float(i % 2), "fold": i % 3}, i


def test_values_of_a_block_come_in_short_records_of_row_order():
    parts, size = 2, 1500
    pieces = [p for p in long_svm._split(many(), parts, size) if p[0] == 1]
    random.Random(6).shuffle(pieces)
    records = list(long_svm._tiles(iter(pieces)))
    # One block of all its 120,000 values was 1.5 MB in one record, and several times that in its making.
    assert max(len(pickle.dumps(record)) for record in records) < 1 << 20
    found = []
    for _, (_, tile) in long_svm._whole_tiles(iter(records)):
        rows = np.repeat(tile["row"], tile["lengths"]) + tile["r"] * size
        found += zip(rows.tolist(), (tile["col"] * parts + 1).tolist(), tile["value"].tolist(), strict=True)
    assert [r for r, _ in groupby(found, lambda v: v[0])] == sorted({r for r, _, _ in found})
    assert sorted(found) == [
        (i, int(j), v)
        for row, i in many()
        for j, v in zip(row["features"].indices, row["features"].values, strict=True)
        if j % parts == 1
    ]


def test_the_state_of_a_block_comes_in_short_records():
    # With all its history, one record of these 3,000 features and ten folds took 6 MB.
    k, d, sizes = 10, 3000, np.full(10, 9)
    strips = [strip for _, (_, strip) in long_svm._start(iter([(0, ("none", None))]), sizes, d, 1)]
    full = np.zeros(long_svm.STRIP)
    state = {"s": [full.copy() for _ in range(10)], "y": [full.copy() for _ in range(10)]}
    state |= {name: full.copy() for name in ("x", "g", "dir", "xt", "gt")}
    largest = strips[0] | {"folds": [{n: [x.copy() for x in v] if isinstance(v, list) else v.copy()
                                      for n, v in state.items()} for _ in range(k)]}
    assert len(pickle.dumps(largest)) < 1 << 20
    widths = [strip["scale"].shape[1] for strip in strips]
    assert sum(widths) == d and max(widths) <= long_svm.STRIP
    assert [strip["lo"] for strip in strips] == np.cumsum([0, *widths[:-1]]).tolist()
    assert [strip["extra"] for strip in strips] == [0] * (len(strips) - 1) + [1]


def test_scales_are_those_of_the_training_rows():
    d, k, size, sizes = 40, 3, 50, np.full(3, 200)
    rows = [(row, i) for row, i in many(300, d, 6)]
    records = long_svm._tiles(long_svm._split(iter(rows), 1, size))
    (strip,) = [s for _, (_, s) in long_svm._start(records, sizes, d, 1)]
    dense = np.array([row["features"].toArray() for row, _ in rows])
    for f in range(k):
        own = dense[[row["fold"] != f for row, _ in rows]]
        assert strip["scale"][f] == pytest.approx(1 / own.std(axis=0, ddof=1), rel=1e-12)
        assert strip["mean"][f] == pytest.approx(own.mean(axis=0) / own.std(axis=0, ddof=1), rel=1e-12)
