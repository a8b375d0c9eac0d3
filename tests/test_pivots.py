"""Nearest rows with blocks left out by the triangle inequality, against all pairs."""

import numpy as np
import pytest

from labelpool.operators.neighbours import knn_join
from labelpool.plans import pivots
from labelpool.plans.kernels import block_distances

SCHEMA = "id long, x array<double>"


def frame(spark, ids, x, parts=5):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], SCHEMA).repartition(parts)


def plain(ids_a, a, ids_b, b, metric, k):
    d = np.round(block_distances(metric, a, b), 12)
    out = {}
    for i, row in zip(ids_a.tolist(), d):
        order = sorted((v, j) for v, j in zip(row.tolist(), ids_b.tolist()) if j != i)[:k]
        out[i] = [(j, pytest.approx(v, abs=1e-11)) for v, j in order]
    return out


def got_of(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r["id"], [])) + 1
        out[r["id"]].append((r["nbr"], r["d"]))
    return out


def clustered(rng, n, dim=6, centres=12):
    c = rng.normal(size=(centres, dim)) * 50
    return c[rng.integers(0, centres, n)] + rng.normal(size=(n, dim))


@pytest.mark.parametrize("metric", ["euclidean", "cityblock", "chebyshev"])
def test_nearest_neighbours_of_a_pool(spark, metric):
    rng = np.random.default_rng(1)
    x = clustered(rng, 500)
    x[100:140] = x[99]  # equal rows
    ids = rng.permutation(2000)[:500]
    df = frame(spark, ids, x)
    assert got_of(pivots.nearest(df, df, metric, 4, block_bytes=1 << 10)) == plain(ids, x, ids, x, metric, 4)


def test_nearest_rows_of_another_set(spark):
    rng = np.random.default_rng(2)
    a, b = clustered(rng, 300), clustered(rng, 90) * 1.1
    ids_a, ids_b = np.arange(300), np.arange(250, 340)
    left, right = frame(spark, ids_a, a), frame(spark, ids_b, b)
    for k in (1, 120):
        assert got_of(pivots.nearest(left, right, "euclidean", k, 1 << 10)) == plain(ids_a, a, ids_b, b, "euclidean", k)


def test_blocks_of_clusters_are_left_out(spark, monkeypatch):
    """On clustered rows most pairs of blocks never meet; on one cluster none is left out."""
    rng = np.random.default_rng(3)
    shares = {}
    for name, x in {"clusters": clustered(rng, 1600, centres=16), "one": rng.normal(size=(400, 6)) * 1e-3}.items():
        ids = np.arange(len(x))
        df = frame(spark, ids, x)
        seen = []
        plain_surviving = pivots.surviving

        def counting(left, right):
            pairs = plain_surviving(left, right)
            seen.append((pairs.count(), left.count() * right.count()))
            return pairs

        monkeypatch.setattr(pivots, "surviving", counting)
        assert pivots.nearest(df, df, "euclidean", 3, block_bytes=1 << 10).count() == 3 * len(x)
        monkeypatch.undo()
        shares[name] = seen[0][0] / seen[0][1]
    assert shares["clusters"] < 0.25 < shares["one"]


def test_pool_of_many_blocks_uses_bounds(spark, monkeypatch):
    """The join gives the same by both ways."""
    from labelpool.operators import neighbours

    rng = np.random.default_rng(4)
    x = clustered(rng, 200)
    df = frame(spark, np.arange(200), x)
    want = got_of(knn_join(df, 5))
    monkeypatch.setattr(neighbours, "ONE_TILE", 1 << 10)
    assert got_of(knn_join(df, 5)) == {i: [(n, pytest.approx(d, abs=1e-11)) for n, d in v] for i, v in want.items()}


def test_few_rows(spark):
    one = frame(spark, [3], np.ones((1, 2)))
    assert got_of(pivots.nearest(one, one, "euclidean", 2)) == {}
    none = spark.createDataFrame([], SCHEMA)
    assert pivots.nearest(none, none, "euclidean", 2).count() == 0
    assert pivots.nearest(none, one, "euclidean", 2).count() == 0
    assert pivots.nearest(one, none, "euclidean", 2).count() == 0
    two = frame(spark, [3, 3], np.array([[1.0, 1.0], [2.0, 2.0]]))
    assert pivots.nearest(two, one, "euclidean", 2).count() == 0
    with pytest.raises(ValueError):
        pivots.nearest(one, one, "cosine", 2)


def test_blocks_stay_few_and_rows_leave_with_k(spark, monkeypatch):
    """Blocks of a large pool are bounded in number, and a tile gives a row k candidates at most."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 4))
    x[7:40] = x[6]  # equal rows
    ids = rng.permutation(9000)[:3000]
    df = frame(spark, ids, x)
    monkeypatch.setattr(pivots, "SUMMARIES", 12)
    counts, plain_surviving = [], pivots.surviving

    def counting(left, right):
        counts.append(left.count())
        return plain_surviving(left, right)

    monkeypatch.setattr(pivots, "surviving", counting)
    got = got_of(pivots.nearest(df, df, "euclidean", 5, block_bytes=1 << 10))
    assert got == plain(ids, x, ids, x, "euclidean", 5)
    assert counts[0] <= 12 + 8  # a block more for every part of the ranges at most


@pytest.mark.parametrize("metric", ["euclidean", "cityblock", "chebyshev"])
@pytest.mark.parametrize("scale, offset", [(1.0, 0.0), (1e-3, 1e3), (1e-20, 0.0), (1e25, 0.0)])
def test_what_is_cut_roughly_is_exact(metric, scale, offset):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 16)) * scale + offset
    blocks = [(np.arange(i, i + 30), x[i : i + 30]) for i in range(0, 300, 30)]
    ids, bounds = np.arange(20), np.full(20, np.inf)
    got = pivots.nearest_in(metric, ids, x[:20], bounds, blocks, np.zeros(10), 4)
    d = np.round(block_distances(metric, x[:20], x), 12)
    want = [sorted((v, j) for j, v in enumerate(row) if j != i)[:4] for i, row in enumerate(d.tolist())]
    assert got[0].tolist() == np.repeat(ids, 4).tolist()
    if scale > 1e-12:  # smaller distances are all equal after rounding
        assert got[1].tolist() == [j for row in want for _, j in row]
    assert np.allclose(got[2], [v for row in want for v, _ in row], rtol=1e-9, atol=1e-12)
