"""Column distances against block distances and hand-worked values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelpool.functions.vectors import DISTANCES, distance
from labelpool.operators.spaces import pivoted_cholesky, space
from labelpool.plans.blocks import all_pairs, block_count, cross_pairs
from labelpool.plans.kernels import BLOCK_DISTANCES, block_distances

RNG = np.random.default_rng(7)
A, B = RNG.normal(size=(6, 5)), RNG.normal(size=(6, 5))
POSITIVE = {"jensenshannon"}
SETS = set("hamming matching jaccard dice rogerstanimoto sokalmichener russellrao sokalsneath yule kulczynski1 kulsinski".split())


def shaped(metric, m):
    if metric in POSITIVE:
        return np.abs(m)
    return (m > 0).astype(float) if metric in SETS else m


def test_both_forms_know_the_same_metrics(spark):
    assert set(DISTANCES) == set(BLOCK_DISTANCES)
    with pytest.raises(ValueError):
        distance("nope", F.col("a"), F.col("b"))


def test_column_and_block_forms_agree(spark):
    for metric in DISTANCES:
        a, b = shaped(metric, A), shaped(metric, B)
        rows = [(i, a[i].tolist(), b[i].tolist()) for i in range(6)]
        df = spark.createDataFrame(rows, "id int, a array<double>, b array<double>")
        got = [r["d"] for r in df.orderBy("id").select(distance(metric, F.col("a"), F.col("b")).alias("d")).collect()]
        want = np.diag(block_distances(metric, a, b))
        for g, w in zip(got, want):
            if g is None:
                assert not np.isfinite(w), metric
            else:
                assert g == pytest.approx(w, abs=1e-9), metric


@pytest.mark.parametrize(
    "metric,a,b,expected",
    [
        ("euclidean", [0, 0], [3, 4], 5.0),
        ("sqeuclidean", [0, 0], [3, 4], 25.0),
        ("cityblock", [0, 0], [3, -4], 7.0),
        ("chebyshev", [0, 0], [3, -4], 4.0),
        ("canberra", [0, 1], [0, 3], 0.5),
        ("braycurtis", [1, 2], [3, 4], 0.4),
        ("cosine", [1, 0], [1, 1], 1 - 1 / np.sqrt(2)),
        ("correlation", [1, 2, 3], [3, 2, 1], 2.0),
        ("hamming", [1, 0, 1, 1], [1, 1, 1, 0], 0.5),
        ("jaccard", [1, 0, 0, 1], [1, 1, 0, 0], 2 / 3),
        ("dice", [1, 0, 1], [1, 1, 0], 0.5),
        ("rogerstanimoto", [1, 0, 1, 0], [1, 1, 0, 0], 4 / 6),
        ("russellrao", [1, 0, 1, 0], [1, 1, 0, 0], 0.75),
        ("sokalsneath", [1, 0, 1, 0], [1, 1, 0, 0], 0.8),
        ("yule", [1, 0, 1, 0], [1, 1, 0, 0], 1.0),
        ("kulczynski1", [1, 0, 1, 0], [1, 1, 0, 0], 0.5),
        ("kulsinski", [1, 0, 1, 0], [1, 1, 0, 0], 5 / 6),
        ("jensenshannon", [1, 0], [0, 1], np.sqrt(np.log(2))),
    ],
)
def test_worked_values(metric, a, b, expected):
    got = block_distances(metric, np.array([a], float), np.array([b], float))[0, 0]
    assert got == pytest.approx(expected)


def test_near_copies_have_exact_small_distances():
    base = RNG.normal(size=(1, 64)) * 100
    near = base.copy()
    near[0, 3] += 1e-7
    assert block_distances("euclidean", base, base)[0, 0] == 0.0
    assert block_distances("euclidean", base, near)[0, 0] == pytest.approx(1e-7, rel=1e-3)


def _pool(spark, m, start=0):
    return spark.createDataFrame(
        [(start + i, r.tolist()) for i, r in enumerate(m)], "id long, x array<double>"
    )


def test_blocked_pairs_see_every_pair_once(spark):
    points = RNG.normal(size=(300, 3))
    points[100:200] = points[0]  # a third of the rows are copies

    def count(d, rows, cols):
        own = rows[:, None] == cols[None, :]
        return {"id": rows, "s": np.where(own, 0, d).sum(1), "n": (~own).sum(1)}

    out = all_pairs(_pool(spark, points), "euclidean", count, ["id", "s", "n"])
    assert block_count(300, 3, 8) > 1
    got = out.groupBy("id").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("id").collect()
    full = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1)).sum(1)
    assert [r["n"] for r in got] == [299] * 300
    assert np.allclose([r["s"] for r in got], full)


def test_cross_pairs_broadcast_and_blocked_agree(spark):
    left, right = RNG.normal(size=(200, 3)), RNG.normal(size=(150, 3))
    nearest = lambda d, r, c: {"id": r, "d": d.min(1)}
    want = np.sqrt(((left[:, None] - right[None]) ** 2).sum(-1)).min(1)
    for limit in (1 << 20, 0):
        out = cross_pairs(
            _pool(spark, left), _pool(spark, right, 1000), "euclidean", nearest, ["id", "d"], limit
        )
        got = out.groupBy("id").agg(F.min("d").alias("d")).orderBy("id").collect()
        assert np.allclose([r["d"] for r in got], want)


def test_scaled_spaces_match_their_definitions(spark):
    m = RNG.normal(size=(40, 3)) * np.array([1.0, 5.0, 0.2]) + 2
    pool = _pool(spark, m)
    vi = np.linalg.pinv(np.cov(m.T))
    gap = m - m[0]
    for metric, want in (
        ("mahalanobis", np.sqrt(np.einsum("ij,jk,ik->i", gap, vi, gap))),
        ("seuclidean", np.sqrt((gap**2 / m.var(axis=0, ddof=1)).sum(1))),
    ):
        frame = space(metric, pool)
        got = np.array([r["x"] for r in frame.apply(pool).orderBy("id").collect()])
        assert np.allclose(np.sqrt(((got - got[0]) ** 2).sum(1)), want)
    with pytest.raises(ValueError):
        space("nope", pool)


@pytest.mark.parametrize("rank", [1, 3, 5])
def test_pivoted_cholesky(rank):
    """The factor has as many columns as the matrix has rank, in the order of what is left."""
    rng = np.random.default_rng(rank)
    base = rng.normal(size=(5, rank)) * np.array([[1e-6], [1], [1e5], [3], [0.01]])
    cov = base @ base.T
    factor, order = pivoted_cholesky(cov)
    assert factor.shape == (5, rank) and len(set(order)) == rank
    unit = np.sqrt(np.diag(cov))
    assert np.allclose((factor @ factor.T) / unit / unit[:, None], cov / unit / unit[:, None])
    assert np.allclose(np.triu(factor[order] / unit[order][:, None], 1), 0)


def test_whitened_distances_are_those_of_the_pseudo_inverse(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 3)) @ rng.normal(size=(3, 3))
    x = np.c_[x, x[:, 0] - 2 * x[:, 1], np.full(80, 7.0)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    frame = space("mahalanobis", df.repartition(3))
    assert frame.rank == 3
    got = np.array([r.x for r in frame.apply(df).orderBy("id").collect()])
    inverse = np.linalg.pinv(np.cov(x.T))
    for i, j in ((0, 1), (5, 70), (33, 34)):
        gap = x[i] - x[j]
        assert np.linalg.norm(got[i] - got[j]) == pytest.approx(np.sqrt(gap @ inverse @ gap), rel=1e-7)
    flat = space("mahalanobis", df.withColumn("x", F.transform("x", lambda v: v * 0)))
    assert flat.rank == 0 and flat.apply(df).first()["x"] == [0.0]


def test_units_do_not_matter(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3))
    of = lambda scale: spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(x * scale)], "id long, x array<double>")
    a, b = of([1, 1, 1]), of([1e-7, 1, 1e8])
    p, q = (np.array([r.x for r in space("mahalanobis", d).apply(d).orderBy("id").collect()]) for d in (a, b))
    assert np.linalg.norm(p[0] - p[1]) == pytest.approx(np.linalg.norm(q[0] - q[1]), rel=1e-9)
