"""Exact nearest rows under a metric, leaving out blocks that the triangle inequality rules out.

*Blocks.* PIVOTS rows are drawn by the hash of their id. Rows are ordered by their nearest pivot, the
distance to it, and their id, range-partitioned, and cut into blocks of bounded size, so alike rows
lie together and equal ones do not pile up. A block knows its smallest and largest distance to every
pivot: the pivot table.

*Bounds.* For rows x and y and a pivot p, d(x, y) >= |d(x, p) - d(y, p)|. So no row of block b is
nearer to a row of block c than the largest gap between their ranges over all pivots. On the other
hand the k-th nearest row of x is not farther than the k-th nearest in x's own block, nor than
the k-th nearest pivot, since pivots are rows too. A pair of blocks whose gap is larger than the
largest such distance in its left block is left out.

*Work.* Block summaries meet in groups; blocks grow with the rows, up to BLOCK_BYTES, so that there
are about SUMMARIES of them where that is enough. Surviving pairs are gathered into tiles of up to
TILE_BYTES a side, so a task holds a bounded number of rows and a block is copied once for each tile
it is needed in. Inside a tile a block meets many others at once, the likeliest first; the bounds are
applied again with what was found so far, and a row leaves with its k nearest of the tile only.
Where nothing can be left out (isotropic rows) the work is quadratic: one product of matrices and one
comparison for a pair of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelpool.plans.kernels import block_distances
from labelpool.session import materialise

# Distances of these obey the triangle inequality for all vectors.
METRICS = frozenset({"euclidean", "cityblock", "chebyshev", "minkowski", "hamming", "matching"})
PIVOTS = 32
# Bytes of a block; least blocks on each side of a tile; summaries that meet at once.
BLOCK_BYTES, BUNCH, SUMMARIES = 256 << 10, 32, 2048
# Bytes of a side of a tile; rows that look together, and rows that they meet at once.
TILE_BYTES, GROUP, STRIP = 16 << 20, 256, 2048
# Distances are rounded to this many digits before they are ordered; bounds leave room for it.
DIGITS, ROOM = 12, 1e-9

BLOCK_SCHEMA = (
    "block bigint, ids array<bigint>, x binary, low array<double>, high array<double>, bounds array<double>,"
    " reach double"
)
_BLOCK = pa.schema(
    [("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("x", pa.binary()), ("low", pa.list_(pa.float64())),
     ("high", pa.list_(pa.float64())), ("bounds", pa.list_(pa.float64())), ("reach", pa.float64())]
)
HITS = "id bigint, nbr bigint, d double"


def _matrix(table: pa.Table | pa.RecordBatch, column: str, dim: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in pa.chunked_array(table.column(column)).chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(table.num_rows, dim)


def _checked(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = block_distances(metric, a, b)
    if np.isnan(d).any():
        raise ValueError("undefined distance between two rows")
    return d


def nearest_of(
    rows: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(row, d, id, rank)`` of the k smallest pairs of each row, in order of row, distance and id."""
    order = np.lexsort((ids, d, rows))
    rows, d, ids = rows[order], d[order], ids[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    first = rank < k
    return rows[first], d[first], ids[first], rank[first]


def _apart(metric: str, a: np.ndarray, b: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of the named pairs of rows, by difference."""
    out, step = np.empty(len(r)), max(1, (8 << 20) // (8 * max(1, a.shape[1])))
    for s in range(0, len(r), step):
        gap = a[r[s : s + step]] - b[c[s : s + step]]
        out[s : s + step] = np.abs(gap).sum(-1) if metric == "cityblock" else np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return out


def _rough_sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """City block distances in single precision, component by component over what fits a cache."""
    a, columns = a.astype(np.float32), np.ascontiguousarray(b.astype(np.float32).T)
    out, step = np.zeros((len(a), len(b)), np.float32), max(1, (1 << 15) // max(1, len(b)))
    for s in range(0, len(a), step):
        rows, total = a[s : s + step], out[s : s + step]
        gap = np.empty_like(total)
        for at, column in enumerate(columns):
            np.abs(np.subtract(rows[:, at, None], column, out=gap), out=gap)
            total += gap
    return out


def within(metric: str, a: np.ndarray, b: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row of a, row of b, distance)`` of the pairs that are within the bound of their row of ``a``.

    Euclidean distances are cut by one matrix product, city block ones by sums in single precision, both
    with room for their rounding; what is left is measured by difference in double precision.
    """
    near = None
    if metric == "cityblock":
        long_a, long_b = np.abs(a).sum(-1), np.abs(b).sum(-1)
        if np.maximum(long_a.max(initial=0.0), long_b.max(initial=0.0)) < 1e30:  # not so for NaN
            room = (a.shape[1] + 2) * (2.0**-22 * (long_a + long_b.max(initial=0.0)) + 1e-44)
            near = np.flatnonzero(_rough_sums(a, b) <= (bounds + room)[:, None])
    if metric == "euclidean":
        sq_a, sq_b = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
        if np.isfinite(sq_a).all() and np.isfinite(sq_b).all():
            squares, kind = sq_a + sq_b.max(initial=0.0), np.float64
            room = 1e-9 * squares
            # Single precision where its rounding is small beside every bound.
            rough = (a.shape[1] + 4) * 2.0**-22 * squares
            least = (bounds * bounds).min(initial=np.inf)
            if rough.max(initial=0.0) <= 1e-2 * least and least > 1e-30 and squares.max(initial=0.0) < 1e30:
                room, kind = rough, np.float32
            # One more column adds the squares of b inside the product.
            products = np.c_[a, np.ones(len(a))].astype(kind) @ np.c_[-2.0 * b, sq_b].astype(kind).T
            cut = (bounds * bounds - sq_a + room).astype(kind)
            near = np.flatnonzero(products <= cut[:, None])
    if near is not None:
        r, c = np.divmod(near, len(b))
        return r, c, np.round(_apart(metric, a, b, r, c), DIGITS)
    d = np.round(_checked(metric, a, b), DIGITS)
    r, c = np.nonzero(d <= bounds[:, None])
    return r, c, d[r, c]


def nearest_in(
    metric: str, ids: np.ndarray, x: np.ndarray, bounds: np.ndarray, others: list[tuple[np.ndarray, np.ndarray]],
    gap: np.ndarray, k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(id, nbr, d)``: for some alike rows the k nearest rows of other blocks, which are ``gap`` away at least."""
    order = np.argsort(gap, kind="stable")
    rows, d, nbr = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    # The first strips are short: what they find bounds the longer ones.
    at, limit = 0, STRIP // 8
    while at < len(order) and gap[order[at]] <= bounds.max():
        strip, size, limit = [], 0, min(STRIP, 2 * limit)
        while at < len(order) and gap[order[at]] <= bounds.max() and (not size or size + len(others[order[at]][0]) <= limit):
            strip.append(others[order[at]])
            size += len(strip[-1][0])
            at += 1
        ids_b, b = (np.concatenate(c) for c in zip(*strip))
        r, c, near = within(metric, x, b, bounds)
        other = ids[r] != ids_b[c]
        rows, d, nbr, rank = nearest_of(
            np.r_[rows, r[other]], np.r_[d, near[other]], np.r_[nbr, ids_b[c[other]]], k
        )
        # What was found here bounds what may still be found.
        last = rank == k - 1
        bounds = bounds.copy()
        bounds[rows[last]] = np.minimum(bounds[rows[last]], d[last] * (1 + ROOM) + ROOM)
    return ids[rows], nbr, d


def kth(d: np.ndarray, k: int) -> np.ndarray:
    """The k-th smallest of each row, infinite if there are fewer."""
    if d.shape[1] < k:
        return np.full(len(d), np.inf)
    return np.partition(d, k - 1, axis=1)[:, k - 1]


def make_blocks(rows: DataFrame, metric: str, k: int, pivot_ids: np.ndarray, pivots: np.ndarray, rows_in_block: int,
                own: bool) -> DataFrame:
    """Blocks of ``rows (id, x)`` with the bound of every row; ``own`` if the rows look among themselves."""
    dim = pivots.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast((pivot_ids, pivots))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, p = shared.value
        for batch in batches:
            if batch.num_rows:
                d = _checked(metric, _matrix(batch, "x", dim), p)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])],
                    ["id", "x", "cell", "r"],
                )

    def block(number: int, table: pa.Table) -> pa.RecordBatch:
        named, p = shared.value
        ids, x = table.column("id").to_numpy(), _matrix(table, "x", dim)
        to_pivots = _checked(metric, x, p)
        among = to_pivots
        if own:
            # A pivot that is the row itself is no neighbour of it; the block's own rows are.
            among = np.where(ids[:, None] == named[None, :], np.inf, to_pivots)
            inside = np.where(ids[:, None] == ids[None, :], np.inf, _checked(metric, x, x))
            bounds = np.minimum(kth(among, k), kth(inside, k))
        else:
            bounds = kth(among, k)
        bounds = bounds * (1 + ROOM) + ROOM
        row = {"block": number, "ids": ids.tolist(), "x": np.ascontiguousarray(x).tobytes(),
               "low": to_pivots.min(axis=0).tolist(), "high": to_pivots.max(axis=0).tolist(),
               "bounds": bounds.tolist(), "reach": float(bounds.max())}
        return pa.RecordBatch.from_pylist([row], _BLOCK)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            while held.num_rows >= rows_in_block:
                yield block(number, held.slice(0, rows_in_block))
                number, held = number + 1, held.slice(rows_in_block)
        if held is not None and held.num_rows:
            yield block(number, held)

    return materialise(
        rows.select("id", F.col("x").cast("array<double>").alias("x"))
        .mapInArrow(place, "id bigint, x array<double>, cell int, r double")
        .repartitionByRange("cell", "r", "id")
        .sortWithinPartitions("cell", "r", "id")
        .select("id", "x")
        .mapInArrow(cut, BLOCK_SCHEMA),
        "metric-blocks",
    )


def gaps(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> np.ndarray:
    """Per pair of blocks the least distance their rows can have, by the best pivot."""
    out = np.zeros((len(low_a), len(low_b)))
    for p in range(low_a.shape[1]):
        np.maximum(out, low_b[None, :, p] - high_a[:, None, p], out=out)
        np.maximum(out, low_a[:, None, p] - high_b[None, :, p], out=out)
    return out


def surviving(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(block, other)``: pairs of blocks that may hold a neighbour, from the pivot table alone."""
    count = right.count()
    groups = max(1, -(-count // SUMMARIES))
    bunches = max(1, -(-left.count() // SUMMARIES))
    own = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
        side = lambda t, c: np.array(t.column(c).to_pylist())
        near = gaps(side(a, "low"), side(a, "high"), side(b, "low"), side(b, "high")) <= side(a, "reach")[:, None]
        i, j = np.nonzero(near)
        return pa.table({"block": a.column("block").to_numpy()[i], "other": b.column("block").to_numpy()[j]})

    return materialise(
        left.select("block", "low", "high", "reach", own(bunches).alias("i"), every(groups).alias("j"))
        .groupBy("i", "j")
        .cogroup(
            right.select("block", "low", "high", own(groups).alias("j"), every(bunches).alias("i")).groupBy("i", "j")
        )
        .applyInArrow(meet, "block bigint, other bigint"),
        "block-pairs",
    )


def nearest(left: DataFrame, right: DataFrame, metric: str, k: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(id, rank, nbr, d)``: the exact k nearest rows of ``right (id, x)`` for every row of
    ``left``; a row of the same id is not its own neighbour. Ties go to the smaller id.

    ``left`` and ``right`` may be the same DataFrame. ``metric`` is one of METRICS. A row finds
    fewer than k rows only if there are fewer.
    """
    if metric not in METRICS:
        raise ValueError(f"{metric!r} gives no triangle bounds")
    spark = left.sparkSession
    dim = right.agg(F.max(F.size("x"))).first()[0]
    empty = spark.createDataFrame([], "id bigint, rank int, nbr bigint, d double")
    if dim is None:
        return empty
    drawn = right.orderBy(F.xxhash64("id"), "id").select("id", F.col("x").cast("array<double>").alias("x"))
    # At least k + 1 pivots, so that each row has k other ones among them where there are so many.
    table = drawn.limit(max(PIVOTS, k + 1)).toArrow().combine_chunks()
    pivot_ids, pivots = table.column("id").to_numpy(), _matrix(table, "x", dim)
    counts = {"right": right.count()}
    counts["left"] = counts["right"] if left is right else left.count()

    def in_block(rows: int) -> int:
        given = max(16, block_bytes // (8 * dim))
        return max(given, min(-(-rows // SUMMARIES), BLOCK_BYTES // (8 * dim)))

    blocks = make_blocks(right, metric, k, pivot_ids, pivots, in_block(counts["right"]), own=left is right)
    if left is right:
        asking = blocks.toDF(*blocks.columns)  # columns of their own, for the joins below
    else:
        asking = make_blocks(left, metric, k, pivot_ids, pivots, in_block(counts["left"]), own=False)
    pairs = surviving(asking, blocks)
    # Consecutive blocks, which are alike, form a bunch: as many as a tile holds, if the cores have
    # enough tiles then.
    cores = spark.sparkContext.defaultParallelism

    def bunches(df: DataFrame, rows: int) -> DataFrame:
        bytes_of_block = 8 * dim * in_block(rows)
        by_cores = -(-rows // (in_block(rows) * max(1, round((4 * cores) ** 0.5))))
        per = max(BUNCH, min(TILE_BYTES // bytes_of_block, by_cores))
        parts = df.groupBy(F.shiftright("block", 32).alias("part")).count().collect()
        starts, start = [], 0
        for part, n in sorted((r["part"], r["count"]) for r in parts):
            starts.append((part, start))
            start += n
        named = df.select("block", F.shiftright("block", 32).alias("part"))
        number = F.col("start") + F.col("block").bitwiseAND(F.lit((1 << 32) - 1))
        return named.join(spark.createDataFrame(starts, "part bigint, start bigint"), "part").select(
            "block", F.floor(number / per).alias("bunch")
        )

    mine_of = bunches(asking, counts["left"]).withColumnRenamed("bunch", "i")
    theirs_of = bunches(blocks, counts["right"]).select(F.col("block").alias("other"), F.col("bunch").alias("j"))
    tiles = materialise(
        pairs.join(mine_of, "block").join(theirs_of, "other").select("i", "j", "block", "other"), "tiles"
    )

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        parts = []
        if a.num_rows and b.num_rows:
            a = a.sort_by("block")
            side = lambda t, c: np.array(t.column(c).to_pylist())
            gap = gaps(side(a, "low"), side(a, "high"), side(b, "low"), side(b, "high"))
            others = [(np.array(i), np.frombuffer(x).reshape(-1, dim))
                      for i, x in zip(b.column("ids").to_pylist(), b.column("x").to_pylist())]
            # Blocks of few rows look together.
            several = max(1, GROUP * 8 * dim // max(len(x) for x in a.column("x").to_pylist()))
            for at in range(0, a.num_rows, several):
                rows = a.slice(at, several).to_pydict()
                ids, bounds = np.concatenate(rows["ids"]), np.concatenate(rows["bounds"])
                x = np.frombuffer(b"".join(rows["x"])).reshape(-1, dim)
                parts.append(nearest_in(metric, ids, x, bounds, others, gap[at : at + several].min(axis=0), k))
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [[], [], []]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                         pa.array(columns[2], pa.float64())], ["id", "nbr", "d"])

    met = tiles.select("i", "j").distinct().count()
    tasks = max(1, min(met, max(4 * cores, int(spark.conf.get("spark.sql.shuffle.partitions")), met // 2)))
    mine = tiles.select("i", "j", "block").distinct().join(asking, "block").repartition(tasks, "i", "j")
    theirs = tiles.select("i", "j", F.col("other").alias("block")).distinct().join(
        blocks.select("block", "ids", "x", "low", "high"), "block"
    ).repartition(tasks, "i", "j")
    theirs = theirs.toDF(*theirs.columns)
    hits = mine.groupBy("i", "j").cogroup(theirs.groupBy("i", "j")).applyInArrow(compare, HITS)
    order = Window.partitionBy("id").orderBy("d", "nbr")
    return (
        hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("id", "rank", "nbr", "d")
    )
