"""Repeatable splits: unlabeled / labeled / test roles and stratified folds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelpool.functions.hashing import hash_order
from labelpool.plans.cuts import HASH_DIGITS, hash_cuts


def unlabeled_size(n: int, u_share: float) -> int:
    """Size of U for ``n`` training rows; both sides must be usable."""
    if not 0 < u_share < 1:
        raise ValueError("u_share must lie between 0 and 1")
    size = math.ceil(u_share * n)
    if not 0 < size < n:
        raise ValueError("u_share must leave both U and L non-empty")
    if n - size <= 1:
        raise ValueError("L needs more than one row")
    return size


def split_u_l(
    df: DataFrame, u_share: float = 0.9, seed: int = 0, id_col: str = "id"
) -> DataFrame:
    """Add ``role``: the first ceil(share * n) rows in hash order are 'U', the rest 'L'."""
    key = hash_order(id_col, seed)
    cuts = hash_cuts(df, key, lambda n: [unlabeled_size(n, u_share)])
    if not cuts:
        raise ValueError("no rows to split")
    _, (last_u,) = cuts[0]
    return df.withColumn("role", F.when(key <= last_u, "U").otherwise("L"))


def split_test(
    df: DataFrame, test: int | float = 0.25, seed: int = 0, id_col: str = "id"
) -> DataFrame:
    """Add ``is_test``: a row count (int) or a share (float) of the rows in hash order."""
    key = hash_order(id_col, seed)

    def ranks(n: int) -> list[int]:
        size = test if isinstance(test, int) else math.ceil(test * n)
        if not 0 < size < n:
            raise ValueError("both the training and the test side need rows")
        return [size]

    cuts = hash_cuts(df, key, ranks)
    if not cuts:
        raise ValueError("no rows to split")
    return df.withColumn("is_test", key <= cuts[0][1][0])


def assign_roles(
    df: DataFrame,
    test_share: float = 0.2,
    u_share: float = 0.9,
    seed: int = 1,
    id_col: str = "id",
) -> DataFrame:
    """Add ``role``: first T, then U, then L along one hash order."""
    key = hash_order(id_col, seed)

    def ranks(n: int) -> list[int]:
        n_test = math.ceil(test_share * n)
        return [n_test, n_test + unlabeled_size(n - n_test, u_share)]

    cuts = hash_cuts(df, key, ranks)
    if not cuts:
        raise ValueError("no rows to split")
    last_t, last_u = cuts[0][1]
    return df.withColumn(
        "role", F.when(key <= last_t, "T").when(key <= last_u, "U").otherwise("L")
    )


def stratified_folds(
    df: DataFrame, k: int, seed: int = 0, id_col: str = "id", y_col: str = "y"
) -> DataFrame:
    """Add ``fold`` in 0..k-1: sizes differ by at most one, overall and within each class. Rows
    without a label belong to no class and are left out.

    A row's position in (class, hash) order modulo ``k``. Positions come from row counts per
    (class, hash prefix), summed up over at most 65,536 prefixes per class, plus the rank inside
    the prefix; no class is ever sorted in one task.
    """
    if k < 2:
        raise ValueError("need at least two folds")
    keyed = df.withColumn("_h", hash_order(id_col, seed)).withColumn(
        "_b", F.substring("_h", 1, HASH_DIGITS)
    )
    before = Window.orderBy(y_col, "_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        keyed.groupBy(y_col, "_b")
        .count()
        .select(
            y_col, "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start")
        )
    )
    inside = Window.partitionBy(y_col, "_b").orderBy("_h", id_col)
    return (
        keyed.join(starts, [y_col, "_b"])
        .withColumn(
            "fold",
            F.pmod(F.col("_start") + F.row_number().over(inside) - 1, F.lit(k)).cast("int"),
        )
        .select(*df.columns, "fold")
    )


def training_rows(df: DataFrame, fold: int) -> DataFrame:
    """The training side of a fold; nothing is copied to files."""
    return df.where(F.col("fold") != fold)


def test_rows(df: DataFrame, fold: int) -> DataFrame:
    return df.where(F.col("fold") == fold)


def binarise(label: Column, negative: str = "n", positive: str = "y") -> Column:
    """0/1 from two label texts, any case; everything else is NULL."""
    text = F.lower(F.trim(label))
    return F.when(text == positive, 1).when(text == negative, 0)


def binarise_sorted(df: DataFrame, label: str, out: str = "y") -> DataFrame:
    """0/1 by the sorted order of exactly two distinct labels."""
    ends = df.agg(F.min(label).alias("lo"), F.max(label).alias("hi")).first()
    lo, hi = ends["lo"], ends["hi"]
    if lo is None or lo == hi:
        raise ValueError("need exactly two distinct labels")
    third = F.col(label).isNotNull() & ~F.col(label).isin(lo, hi)
    return df.withColumn(
        out,
        F.when(third, F.raise_error(F.lit("more than two distinct labels")).cast("int"))
        .when(F.col(label) == hi, 1)
        .when(F.col(label) == lo, 0),
    )
