import hashlib
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelpool.functions.hashing import hash_order
from labelpool.operators.pool import move_to_labeled, take_rows
from labelpool.operators.splits import (
    assign_roles,
    binarise_sorted,
    split_test,
    split_u_l,
    stratified_folds,
    unlabeled_size,
)
from labelpool.plans.cuts import first_rows, hash_cuts, nth_text, quantile


def hashed(i, seed):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(5000).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"))


def test_split_sizes_and_hash_order(rows):
    got = split_u_l(rows, 0.9, 4)
    u = {r["id"] for r in got.where("role = 'U'").collect()}
    order = sorted(range(5000), key=lambda i: hashed(i, 4))
    assert u == set(order[:4500])
    assert {r["id"] for r in split_u_l(rows.repartition(7), 0.9, 4).where("role = 'U'").collect()} == u


@given(st.integers(2, 10_000), st.floats(0.01, 0.99))
@settings(max_examples=60, deadline=None)
def test_unlabeled_size_leaves_two_sides(n, share):
    try:
        size = unlabeled_size(n, share)
    except ValueError:
        assert n - math.ceil(share * n) <= 1
    else:
        assert size == math.ceil(share * n) and n - size > 1


def test_bad_shares_are_refused(spark, rows):
    for share in (0, 1, 1.5, -0.1):
        with pytest.raises(ValueError):
            split_u_l(rows, share)
    with pytest.raises(ValueError):
        split_u_l(spark.range(3).toDF("id"), 0.9)
    with pytest.raises(ValueError):
        split_u_l(rows.where("id < 0"))


def test_test_split_by_count_and_share(rows):
    assert split_test(rows, 20, 1).where("is_test").count() == 20
    assert split_test(rows, 0.25, 1).where("is_test").count() == 1250
    with pytest.raises(ValueError):
        split_test(rows, 5000)


def test_roles(rows):
    counts = {r["role"]: r["count"] for r in assign_roles(rows, 0.2, 0.9).groupBy("role").count().collect()}
    assert counts == {"T": 1000, "U": 3600, "L": 400}


def test_folds_are_balanced(rows):
    got = stratified_folds(rows, 7, 3)
    sizes = [r["count"] for r in got.groupBy("fold").count().collect()]
    assert sum(sizes) == 5000 and max(sizes) - min(sizes) <= 1
    for y in (0, 1):
        sizes = [r["count"] for r in got.where(F.col("y") == y).groupBy("fold").count().collect()]
        assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1
    again = stratified_folds(rows.repartition(5), 7, 3)
    assert got.exceptAll(again).count() == 0


def test_hash_cuts_per_group(rows):
    cuts = hash_cuts(rows, hash_order("id", 2), lambda n: [0, 1, n // 2, n], by=F.col("y"))
    for y, (n, texts) in cuts.items():
        order = sorted(hashed(i, 2) for i in range(5000) if (i % 3 == 0) == bool(y))
        assert n == len(order)
        assert texts == ["", order[0], order[n // 2 - 1], order[-1]]


def test_nth_text_with_small_steps(spark):
    names = sorted({f"{w}{i}" for w in ("a", "ab", "abc", "zé", "Ω") for i in range(40)} | {"a", "ab", "abc"})
    names.sort(key=lambda s: s.encode())
    df = spark.createDataFrame([(n,) for n in names], "name string")
    for rank in (1, 2, 3, 44, 83, 120, len(names)):
        assert nth_text(df, "name", rank, small=3) == names[rank - 1]
    with pytest.raises(ValueError):
        nth_text(df, "name", len(names) + 1)


def test_quantile_is_exact_with_ties_and_coarse_brackets(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(size=2000), np.full(1000, 0.25), [-1e300, 7.0]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for q in (0.0, 0.1, 0.58, 0.6, 0.66, 0.995, 1.0):
        for error in (1e-4, 0.02):
            n, got = quantile(df, "v", q, error)
            assert n == len(values)
            assert got == pytest.approx(np.percentile(values, 100 * q), rel=1e-12)


def test_binarise_sorted(spark):
    df = spark.createDataFrame([("no",), ("yes",), (None,)], "l string")
    got = {(r["l"], r["y"]) for r in binarise_sorted(df, "l").collect()}
    assert got == {("no", 0), ("yes", 1), (None, None)}
    with pytest.raises(ValueError):
        binarise_sorted(df.where("l = 'no'"), "l")
    three = df.union(spark.createDataFrame([("other",)], "l string"))
    with pytest.raises(Exception, match="more than two"):
        binarise_sorted(three, "l").collect()


def test_taking_and_moving_rows(spark):
    data = spark.createDataFrame(
        [(0, [1.0, 2.0, 3.0], 8), (1, [4.0, 5.0, 6.0], 4), (2, [7.0, 8.0, 9.0], 5)],
        "id long, x array<double>, y int",
    )
    assert [r["y"] for r in take_rows(data, 1).collect()] == [4]
    assert sorted(r["y"] for r in take_rows(data, [0, 2]).collect()) == [5, 8]
    u, labeled = move_to_labeled(data.where("id > 0"), data.where("id = 0"), take_rows(data, 2))
    assert [r["id"] for r in u.collect()] == [1]
    assert sorted(r["id"] for r in labeled.collect()) == [0, 2]


def test_first_rows_with_a_large_limit(spark, monkeypatch):
    from labelpool.plans import cuts

    df = spark.range(3000).select((F.col("id") * 7919 % 1000).alias("a"), F.col("id").alias("b"))
    want = [tuple(r) for r in df.orderBy("a", "b").limit(1234).collect()]
    monkeypatch.setattr(cuts, "SMALL_LIMIT", 10)
    for limit, expected in ((1234, want), (5000, 3000)):
        got = sorted(tuple(r) for r in first_rows(df.repartition(9), ["a", "b"], limit).collect())
        assert got == expected if isinstance(expected, list) else len(got) == expected


@pytest.mark.parametrize("limit", [1, 7, 100, 1233, 4000, 10_000])
def test_first_rows_counting_copies(spark, limit):
    df = spark.range(900).select((F.col("id") * 7919 % 1000).alias("a"), (F.col("id") % 4 + 1).alias("m"))
    want = [r["a"] for r in df.orderBy("a").collect() for _ in range(r["m"])][:limit]
    got = first_rows(df.repartition(5), ["a"], limit, "m")
    assert sorted(r["a"] for r in got.collect() for _ in range(r["m"])) == want
