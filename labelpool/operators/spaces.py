"""Rescaling vectors so that a scaled metric becomes plain Euclidean distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import ElementwiseProduct
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANK_TOLERANCE = 1e-12


def centre(df: DataFrame, x: str = "x") -> DataFrame:
    """One row with the mean vector ``c``."""
    return df.select(array_to_vector(x).alias("v")).agg(
        vector_to_array(Summarizer.mean(F.col("v"))).alias("c")
    )


class Space:
    """``apply`` maps vectors to a space where ``metric`` is one of the plain distances."""

    def __init__(self, metric: str):
        self.metric = metric

    def apply(self, df: DataFrame, x: str = "x") -> DataFrame:
        return df


class _Scaled(Space):
    """Each dimension divided by its standard deviation."""

    def __init__(self, df: DataFrame):
        super().__init__("euclidean")
        var = (
            df.select(array_to_vector("x").alias("v"))
            .agg(Summarizer.variance(F.col("v")).alias("v"))
            .first()["v"]
            .toArray()
        )
        with np.errstate(divide="ignore"):
            factors = 1.0 / np.sqrt(var)
        # x/0 has no meaning unless the dimension is constant, where every difference is 0/0.
        self.undefined = not np.isfinite(factors).all()
        self.scale = ElementwiseProduct(
            scalingVec=Vectors.dense(factors), inputCol="_v", outputCol="_s"
        )

    def apply(self, df: DataFrame, x: str = "x") -> DataFrame:
        if self.undefined:
            raise ValueError("seuclidean needs a non-zero variance in every dimension")
        vectors = df.withColumn("_v", array_to_vector(x))
        return self.scale.transform(vectors).withColumn(x, vector_to_array("_s")).drop("_v", "_s")


def covariance(df: DataFrame) -> tuple[np.ndarray, int]:
    """Sample covariance of ``x`` and the number of rows.

    Each task adds up the products of its rows less the mean, so one d x d matrix a task leaves it.
    """
    middle = centre(df).first()["c"]
    dim = len(middle) if middle else 0

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dim, dim)), 0
        for batch in batches:
            rows = _matrix(batch.column(0), dim) - np.array(middle)
            total, n = total + rows.T @ rows, n + len(rows)
        yield pa.RecordBatch.from_arrays([pa.array([[float(n), *total.ravel()]])], ["g"])

    rows = df.select(F.col("x").cast("array<double>").alias("x"))
    parts = rows.mapInArrow(scan, "g array<double>").select(array_to_vector("g").alias("g"))
    found = parts.agg(Summarizer.sum(F.col("g")).alias("g")).first()["g"]
    if found is None or not dim:
        return np.zeros((0, 0)), 0
    sums = found.toArray()
    n = int(sums[0])
    return sums[1:].reshape(dim, dim) / max(n - 1, 1), n


def pivoted_cholesky(cov: np.ndarray, tolerance: float = RANK_TOLERANCE) -> tuple[np.ndarray, list[int]]:
    """``(factor, order)`` with factor @ factor.T = cov and as many columns as cov has rank.

    Columns are taken in the order of the variance that is left of them, as a share of their own
    (so units do not matter); equal shares go to the earlier column. What is left of a column that
    the ones before explain is at most ``tolerance``, and it gets no column of its own.
    """
    dim = len(cov)
    scale = np.sqrt(np.diag(cov))
    unit = np.where(scale > 0, scale, 1.0)
    rest = cov / unit[:, None] / unit[None, :]
    factor, order = np.zeros((dim, 0)), []
    while len(order) < dim:
        left = np.round(np.diag(rest), 9)
        left[order] = -1.0
        at = int(left.argmax())
        if rest[at, at] <= tolerance:
            break
        column = rest[:, at] / np.sqrt(rest[at, at])
        column[order] = 0.0
        factor, rest = np.column_stack([factor, column]), rest - np.outer(column, column)
        order.append(at)
    return factor * scale[:, None], order


class _Whitened(Space):
    """Mahalanobis distance with the pseudo-inverse of the sample covariance.

    With cov = F F', F of full column rank, the distance is the length of F+ (x - y). A column
    that is a sum of others adds no column to F. The d x d matrix is factored on the driver.
    """

    def __init__(self, df: DataFrame):
        super().__init__("euclidean")
        cov, _ = covariance(df)
        factor, order = pivoted_cholesky(cov)
        self.dim, self.rank = len(cov), len(order)
        if self.rank == self.dim:
            # Rows in pivot order are a triangle: solved without loss whatever the units are.
            turn = np.zeros((self.rank, self.dim))
            if self.dim:
                turn[:, order] = np.linalg.inv(factor[order])
        else:
            turn = np.linalg.pinv(factor, rcond=1e-15) if self.rank else np.zeros((1, self.dim))
        self.turn = turn

    def apply(self, df: DataFrame, x: str = "x") -> DataFrame:
        turn, names = self.turn, df.columns
        at = names.index(x)
        schema = T.StructType(
            [T.StructField(x, T.ArrayType(T.DoubleType())) if f.name == x else f for f in df.schema.fields]
        )

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = _matrix(batch.column(at), turn.shape[1]) @ turn.T
                ends = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
                turned = pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))
                columns = [turned if i == at else c for i, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays(columns, names)

        if not self.dim:
            return df
        return df.withColumn(x, F.col(x).cast("array<double>")).mapInArrow(scan, schema)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def space(metric: str, rows: DataFrame) -> Space:
    """The space for a metric; ``rows`` (id, x) fixes the scales of the scaled metrics."""
    if metric == "mahalanobis":
        return _Whitened(rows)
    if metric == "seuclidean":
        return _Scaled(rows)
    from labelpool.functions.vectors import DISTANCES

    if metric not in DISTANCES:
        raise ValueError(f"unknown distance metric {metric!r}")
    return Space(metric)
