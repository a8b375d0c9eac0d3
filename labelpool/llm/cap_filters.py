"""Near-duplicate vectors by cosine with spherical-cap filters.

*Filters.* A filter is a direction c of a random product code: the vector, turned by sign flips and
Hadamard transforms, is cut into BLOCKS parts, and c joins one of the code words of each part, so a
code of B words a part has B^BLOCKS directions. A vector passes a filter if <u, c> reaches the
height of the cap; list decoding finds all such directions from the sorted products of the parts
without trying all of them, and the best direction always counts. CODES independent codes are used.
The height follows from the number of vectors, so that about BUCKET of them pass a filter.

1. Equal vectors are one class, so copies are never compared with each other.
2. Classes are joined on the filters they pass. What travels is the class and its turned vector in
   one byte a component, whose error is known: two classes are connected if their cosine may reach
   the threshold. A bucket emits one edge for each of its members at most, never its pairs.
3. Connected classes are families. Only their vectors are moved, in tiles of two blocks, and all
   pairs of a family are compared in double precision, whether they share a filter or not. A tile
   gives numbers of links, and one edge for each row at most.

Pairs of cosine >= 0.95 share a filter, directly or by a chain, in more than 99 % of cases (measured
in the tests); none below the threshold is linked. Buckets and families of any size are cut into
tiles of bounded size; the work inside a family stays quadratic, since every link is counted.

Defined cases: vectors that are NULL, zero, or hold NULL or non-finite components link with nothing.
Shorter vectors count as padded with zeros. Every row is a vector of its own, rows of a shared or
NULL id too; a component's id is its smallest id that is not NULL. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelpool.llm.components import components
from labelpool.llm.exact_topk import usable
from labelpool.llm.near_dedup import _tiles, _whole_tiles
from labelpool.llm.spread import join_by_part
from labelpool.session import materialise

#: Codes, parts of a code, filters of all codes a random vector passes beside the best of each.
CODES, BLOCKS, PASSED = 10, 2, 6.0
#: Vectors that pass a filter, and rows of a block: a tile compares two blocks.
BUCKET, TILE = 256, 512
SEED = 20240607
#: Rows whose filters are found at once.
STEP = 512


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; the largest component is taken out first, so nothing overflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True, initial=1e-320)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The orthogonal Hadamard transform of every row; the width is a power of two."""
    n, width = rows.shape
    step = 1
    while step < width:
        pairs = rows.reshape(n, -1, 2, step)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return rows / math.sqrt(width)


def cap_height(share: float, width: int) -> float:
    """The product that this share of the sphere's directions exceeds."""
    s = np.linspace(-1.0, 1.0, 200_001)
    density = np.maximum(1 - s * s, 0.0) ** max((width - 3) / 2, 0.0)
    above = np.cumsum(density[::-1])[::-1] / density.sum()
    return float(s[np.searchsorted(-above, -share)])


class Codes:
    """Filters for ``rows`` vectors of ``width`` components."""

    def __init__(self, rows: int, width: int):
        self.width = max(2 * BLOCKS, 1 << max(0, width - 1).bit_length())
        share = min(BUCKET / max(rows, 1), 0.05)
        self.words = max(4, math.ceil((PASSED / CODES / share) ** (1 / BLOCKS)))
        self.height = cap_height(PASSED / CODES / self.words**BLOCKS, self.width)
        rng = np.random.default_rng(SEED)
        self.signs = rng.choice([-1.0, 1.0], (CODES, 2, self.width))
        size = self.width // BLOCKS
        books = rng.normal(size=(CODES, BLOCKS, size, self.words))
        self.books = books / np.sqrt((books**2).sum(axis=2, keepdims=True) * BLOCKS)

    def turned(self, u: np.ndarray, code: int) -> np.ndarray:
        full = np.zeros((len(u), self.width))
        full[:, : u.shape[1]] = u
        for sign in self.signs[code]:
            full = hadamard(full * sign)
        return full

    def decode(self, u: np.ndarray, code: int) -> tuple[np.ndarray, np.ndarray]:
        """``(row, filter)`` of all directions a row exceeds, and of its best one."""
        parts = self.turned(u, code).reshape(len(u), BLOCKS, -1)
        products = [parts[:, b] @ self.books[code, b] for b in range(BLOCKS)]
        order = [np.argsort(-p, axis=1, kind="stable") for p in products]
        ranked = [np.take_along_axis(p, o, axis=1) for p, o in zip(products, order)]
        # The best direction counts even if it lies below the cap.
        least = np.minimum(self.height, sum(r[:, 0] for r in ranked)) - 1e-12
        row, total, name = np.arange(len(u)), np.zeros(len(u)), np.zeros(len(u), np.int64)
        for b in range(BLOCKS):
            # What the parts still to come can add at most.
            rest = sum((r[:, 0] for r in ranked[b + 1 :]), np.zeros(len(u)))
            need = least[row] - total - rest[row]
            # Words that suffice, counted in one search: each row's products lie in a range of their own.
            flat = (4.0 * np.arange(len(u))[:, None] - ranked[b]).ravel()
            many = np.searchsorted(flat, 4.0 * row - need, "right") - row * self.words
            at = np.repeat(np.arange(len(row)), many)
            rank = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            row = row[at]
            total = total[at] + ranked[b][row, rank]
            name = name[at] * self.words + order[b][row, rank]
        return row, code * self.words**BLOCKS + name


def _dense(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles, padded with zeros."""
    out = np.zeros((len(column), width))
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = column.flatten().to_numpy(
        zero_copy_only=False
    )
    return out


def _filter_scan(codes, width: int) -> Callable:
    """``(key, id, small, scale, error)``: one row for each filter a class passes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codes.value
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                batch = whole.slice(at, STEP)
                u = unit(_dense(batch.column(1), width))
                turned = made.turned(u, 0)
                scale = np.abs(turned).max(axis=1) / 127
                small = np.rint(turned / scale[:, None]).astype(np.int8)
                error = np.sqrt(((turned - small * scale[:, None]) ** 2).sum(axis=1))
                found = [made.decode(u, c) for c in range(CODES)]
                row = np.concatenate([r for r, _ in found])
                bytes_ = pa.array([x.tobytes() for x in small], pa.binary())
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([f for _, f in found])), batch.column(0).take(take),
                     bytes_.take(take), pa.array(scale[row]), pa.array(error[row])],
                    ["key", "id", "small", "scale", "error"],
                )

    return scan


def connected(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the first row of its component."""
    label = np.arange(len(near))
    seen = ~near.any(axis=1)
    for root in np.flatnonzero(~seen).tolist():
        if seen[root]:
            continue
        seen[root] = True
        front = np.array([root])
        while len(front):
            front = np.flatnonzero(near[front].any(axis=0) & ~seen)
            seen[front] = True
            label[front] = root
    return label


def _groups(table: pa.Table) -> list[tuple[int, int]]:
    """Ranges of rows with equal key, i, j."""
    key = [table.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j")]
    change = np.zeros(table.num_rows, bool)
    change[:1] = True
    for k in key:
        change[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(change)
    return list(zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows]))


def _bucket_scan(threshold: float) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_tiles(batches, 3, lambda t: np.ones(t.num_rows, np.int64), 20_000):
            ids = table.column("id").to_numpy()
            small = np.frombuffer(b"".join(table.column("small").to_pylist()), np.int8)
            small = small.reshape(table.num_rows, -1).astype(np.float32)
            scale, error = table.column("scale").to_numpy(), table.column("error").to_numpy()
            left, right = [], []
            for a, z in _groups(table):
                if z - a < 2:
                    continue

                # |<u, v> - <u', v'>| <= |u - u'| |v| + |u'| |v - v'|, and |u'| <= 1 + |u - u'|.
                cosine = (small[a:z] @ small[a:z].T) * (scale[a:z, None] * scale[a:z])
                slack = error[a:z, None] + (1 + error[a:z, None]) * error[a:z] + 1e-4
                near = cosine + slack >= threshold
                np.fill_diagonal(near, False)
                label = connected(near | near.T)
                moved = np.flatnonzero(label != np.arange(z - a))
                left.append(ids[a + moved])
                right.append(ids[a + label[moved]])
            if left:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"]
                )

    return scan


def _link_scan(threshold: float, width: int) -> Callable:
    """``(id, links, to)`` from tiles of families: rows linked to a class, weighted by their
    number, and another class of its component in the tile, or itself."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_tiles(batches, 3, lambda t: np.ones(t.num_rows, np.int64), 4 * TILE):
            ids, own = table.column("id").to_numpy(), table.column("own").to_numpy()
            size = table.column("size").to_numpy()
            u = unit(_dense(table.column("x").combine_chunks(), width))
            links, to = np.zeros(len(ids), np.int64), ids.copy()
            i, j = table.column("i").to_numpy(), table.column("j").to_numpy()
            for a, z in _groups(table):
                near = u[a:z] @ u[a:z].T >= threshold
                np.fill_diagonal(near, False)
                if i[a] != j[a]:
                    # A tile of two blocks counts pairs between them only.
                    near &= own[a:z, None] != own[a:z]
                links[a:z] = near @ size[a:z]
                to[a:z] = ids[a + connected(near)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(to)], ["id", "links", "to"])

    return scan


def _classes(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows ``(vec, h1, h2)`` and classes ``(h1, h2, size, least, x)`` of equal usable vectors."""
    x = F.transform(F.col(vector_col), lambda v: v + F.lit(0).cast("float"))  # -0.0 is 0.0
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("vec"),
        F.when(usable(F.col(vector_col)) & F.exists(vector_col, lambda v: v != 0), x).alias("x"),
    )
    # Two halves of SHA-256 of the components as text, which is exact.
    sha = F.sha2(F.concat_ws(",", F.transform("x", lambda v: v.cast("string"))), 256)
    half = lambda at: F.conv(F.substring(sha, at, 15), 16, 10).cast("bigint")
    rows = rows.withColumn("h1", F.when(F.col("x").isNotNull(), half(1))).withColumn(
        "h2", F.when(F.col("x").isNotNull(), half(17))
    )
    classes = rows.where("x IS NOT NULL").groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("size"), F.min("vec").alias("least"), F.first("x").alias("x")
    )
    return rows.drop("x"), classes


def cap_near_dedup(
    vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``(id_col, n_links, component_id, kept)``, one row for each row of ``vectors``."""
    spark = vectors.sparkSession
    rows, classes = _classes(vectors, id_col, vector_col)
    rows = materialise(rows, "vectors")
    # A class goes by a number of its own: the order of its digest, over all classes.
    classes = materialise(classes.withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    n, width = classes.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(1))).first()
    codes = spark.sparkContext.broadcast(Codes(n, width))
    passed = classes.select("id", "x").mapInArrow(
        _filter_scan(codes, width), "key bigint, id bigint, small binary, scale double, error double"
    )
    passed = materialise(passed, "filters")
    sizes = passed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("blocks"), F.count(F.lit(1)).alias("n"))
    members = join_by_part(passed, sizes.where("n > 1").drop("n"), ["key"], "id").where("blocks IS NOT NULL")
    edges = (
        _tiles(members, "key", "blocks")
        .select("key", "i", "j", "id", "small", "scale", "error")
        .mapInArrow(_bucket_scan(threshold), "a bigint, b bigint")
    )
    families = materialise(components(edges).withColumnRenamed("root", "key"), "families")
    blocks = families.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("blocks"))
    inside = join_by_part(families, blocks, ["key"], "id").join(classes.select("id", "size", "x"), "id")
    linked = materialise(
        _tiles(inside.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "key", "blocks")
        .select("key", "i", "j", "id", "own", "size", "x")
        .mapInArrow(_link_scan(threshold, width), "id bigint, links bigint, to bigint"),
        "links",
    )
    links = linked.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(linked.where("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b")))
    named = (
        classes.select("id", "h1", "h2", "size", "least")
        .join(links, "id", "left")
        .join(roots, "id", "left")
        .withColumn("root", F.coalesce("root", "id"))
    )
    named = materialise(named, "linked-classes")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    known = join_by_part(named, least, ["root"], "id").select(
        "h1", "h2", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
    )
    return join_by_part(rows, known, ["h1", "h2"], "vec").select(
        F.col("vec").alias(id_col),
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        # Vectors that link with nothing stand for themselves.
        F.when(F.col("n_links").isNull(), F.col("vec")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
