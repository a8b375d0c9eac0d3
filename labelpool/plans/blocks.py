"""Work over all pairs of vectors as one shuffle of bounded blocks.

Rows get a block number from a hash of their id, so identical or clustered vectors never gather in
one block. A row is sent to every pair of blocks it belongs to; one task sees two blocks, reduces
its distance matrix to a few numbers per row, and only those leave the task. No pair row is ever
produced. Memory per task is bounded by the block size, whatever the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelpool.plans.kernels import block_distances

# Two blocks and their copies fit in a worker; a larger block means fewer copies in the shuffle.
BLOCK_BYTES = 32 << 20
TILE_CELLS = 1 << 20
BROADCAST_BYTES = 64 << 20

# kernel(distances, ids of their rows, ids of their columns) -> columns of partial results
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]]


def _matrix(table: pa.Table, column: str = "x") -> np.ndarray:
    arrays = table.column(column).combine_chunks()
    if isinstance(arrays, pa.ChunkedArray):
        arrays = pa.concat_arrays(arrays.chunks)
    flat = arrays.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1) if table.num_rows else flat.reshape(0, 0)


def _tiles(metric, kernel, ids_a, a, ids_b, b) -> list[dict[str, np.ndarray]]:
    """Kernel results of one block pair, with at most ``TILE_CELLS`` distances in memory."""
    step = max(1, TILE_CELLS // max(1, len(ids_b)))
    return [
        kernel(block_distances(metric, a[s : s + step], b), ids_a[s : s + step], ids_b)
        for s in range(0, len(ids_a), step)
    ]


def _to_arrow(parts: list[dict[str, np.ndarray]], schema: pa.Schema) -> pa.Table:
    if not parts:
        return schema.empty_table()
    columns = {n: np.concatenate([p[n] for p in parts]) for n in schema.names}
    return pa.table([pa.array(columns[n], schema.field(n).type) for n in schema.names], schema)


_ARROW = {"id": pa.int64(), "nbr": pa.int64(), "n": pa.int64()}


def _schemas(columns: list[str]) -> tuple[T.StructType, pa.Schema]:
    spark_schema = T.StructType(
        [T.StructField(c, T.LongType() if c in _ARROW else T.DoubleType()) for c in columns]
    )
    return spark_schema, pa.schema([(c, _ARROW.get(c, pa.float64())) for c in columns])


def block_count(rows: int, dim: int, cores: int, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks small enough for memory and, on little data, enough of them to keep cores busy."""
    by_memory = math.ceil(rows * dim * 8 / block_bytes)
    by_cores = min(math.ceil(math.sqrt(2 * cores)) + 1, math.ceil(rows / 64))
    return max(1, by_memory, by_cores)


def _size(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    return row["n"], row["d"] or 0


def all_pairs(df: DataFrame, metric: str, kernel: Kernel, columns: list[str]) -> DataFrame:
    """Reduce the distances between every row of ``(id, x)`` and every row, itself included.

    Each unordered pair of blocks is computed once and serves both its sides.
    """
    n, dim = _size(df)
    cores = df.sparkSession.sparkContext.defaultParallelism
    blocks = block_count(n, dim, cores)
    out_schema, arrow_schema = _schemas(columns)
    home = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    spread = (
        df.select("id", "x", home.alias("home"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .select(
            "id",
            "x",
            F.least("home", "other").alias("p"),
            F.greatest("home", "other").alias("q"),
            (F.col("home") <= F.col("other")).alias("first"),
        )
    )

    def reduce(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        x = _matrix(table)
        if table.column("p")[0] == table.column("q")[0]:
            return _to_arrow(_tiles(metric, kernel, ids, x, ids, x), arrow_schema)
        side = table.column("first").to_numpy(zero_copy_only=False).astype(bool)
        parts = _tiles(metric, kernel, ids[side], x[side], ids[~side], x[~side])
        parts += _tiles(metric, kernel, ids[~side], x[~side], ids[side], x[side])
        return _to_arrow(parts, arrow_schema)

    tasks = _task_count(spread, blocks * (blocks + 1) // 2, n * dim * 8 * blocks)
    return (
        spread.repartition(tasks, "p", "q").groupBy("p", "q").applyInArrow(reduce, out_schema)
    )


def cross_pairs(
    left: DataFrame,
    right: DataFrame,
    metric: str,
    kernel: Kernel,
    columns: list[str],
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Reduce the distances from every row of ``left`` to every row of ``right``.

    A counted ``right`` below ``broadcast_bytes`` is sent to all executors and ``left`` is not
    shuffled; a larger one is cut into blocks that meet the blocks of ``left``.
    """
    out_schema, arrow_schema = _schemas(columns)
    m, dim = _size(right)
    spark = left.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if m * (dim + 1) * 8 <= broadcast_bytes:
        table = right.select("id", F.col("x").cast("array<double>").alias("x")).toArrow()
        shared = spark.sparkContext.broadcast((table.column("id").to_numpy(), _matrix(table)))

        def scan(batches):
            ids_b, b = shared.value
            for batch in batches:
                table = pa.Table.from_batches([batch])
                if not table.num_rows or not len(ids_b):
                    continue
                parts = _tiles(
                    metric, kernel, table.column("id").to_numpy(), _matrix(table), ids_b, b
                )
                yield from _to_arrow(parts, arrow_schema).to_batches()

        return _spread_small(left.select("id", "x"), dim, cores).mapInArrow(scan, out_schema)

    n, _ = _size(left)
    lb, rb = block_count(n, dim, cores), block_count(m, dim, cores)

    def keyed(df: DataFrame, own: str, count: int, other: str, others: int, first: bool):
        return df.select(
            "id",
            "x",
            F.pmod(F.xxhash64("id"), F.lit(count)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other),
            F.lit(first).alias("first"),
        ).select("id", "x", "p", "q", "first")

    spread = keyed(left, "p", lb, "q", rb, True).unionByName(keyed(right, "q", rb, "p", lb, False))

    def reduce(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        x = _matrix(table)
        side = table.column("first").to_numpy(zero_copy_only=False).astype(bool)
        if side.all() or not side.any():
            return arrow_schema.empty_table()
        parts = _tiles(metric, kernel, ids[side], x[side], ids[~side], x[~side])
        return _to_arrow(parts, arrow_schema)

    tasks = _task_count(spread, lb * rb, (n * rb + m * lb) * dim * 8)
    return (
        spread.repartition(tasks, "p", "q").groupBy("p", "q").applyInArrow(reduce, out_schema)
    )


def _task_count(df: DataFrame, groups: int, shuffled_bytes: int) -> int:
    """Enough tasks for the cores and for 128 MB of input each; the work per byte is high, so
    adaptive coalescing by bytes alone would leave cores idle."""
    spark = df.sparkSession
    floor = max(
        spark.sparkContext.defaultParallelism * 2,
        int(spark.conf.get("spark.sql.shuffle.partitions")),
    )
    return max(1, min(groups, max(floor, math.ceil(shuffled_bytes / (128 << 20)))))


def _spread_small(df: DataFrame, dim: int, cores: int) -> DataFrame:
    """Spread a pool that file splits alone would give to fewer tasks than there are cores."""
    small = df.count() * dim * 8 <= cores * (128 << 20)
    return df.repartition(cores) if small else df
