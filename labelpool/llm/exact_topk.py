"""Exact top-k search by inner product with block-at-a-time pruning.

*Index.* Vectors of integers are laid in an order that keeps alike ones together: by their best of
PIVOTS pivot vectors, then by the product with it, then by id, range-partitioned, so equal vectors
do not pile up. Consecutive ranges of BLOCK vectors are blocks. A block's forward index holds its
ids and components; its summary holds the largest and smallest value of every component. About
SHARD_BYTES of blocks make a shard, which is one row of a written table and has a summary too.

*Search.* A query's bound for a block is the sum over its components of the query's value times the
block's largest (if the value is positive) or smallest (if not) value: no vector of the block can
score more. A query's blocks are scored in the order of their bounds until the bound falls below
the k-th best score so far, or equals it while the block's smallest id is larger than the k-th id.

1. Queries are first searched in the shard they lie in, which gives a first k-th score.
2. Queries lying in one shard form a chunk. Chunks meet the summaries of all shards in groups of
   bounded size; a chunk goes on to a shard only if some query's bound reaches its k-th score.
3. The surviving (shard, group of chunks) pairs meet the shards' blocks; each gives the best k of
   each query, or fewer; the best k of these are the result.

Every task sees one shard and a bounded group of chunks. Queries against all vectors stay a
product in the worst case; pruning decides how much of it is done, not what comes out.

Defined cases: a NULL vector, or one that holds NULL or a non-finite component, takes no part.
Shorter vectors count as padded with zeros. Ties go to the smaller id. A row never finds rows of
its own id; otherwise repeated rows are found once each. Rows with a NULL id take no part.
Repeated query rows are one query; if rows of one id differ, the best scores over them count.
Components and products have to fit in 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelpool.session import materialise

PIVOTS, BLOCK = 128, 128
SHARD_BYTES = 4 << 20
#: Shards whose summaries meet a group of chunks at once, and chunks in a group.
SUMMARIES, CHUNKS = 1024, 32
EXACT = float(1 << 52)


def integers(column: Column) -> Column:
    """floor(1024 * x) of every component."""
    return F.transform(column, lambda x: F.floor(F.lit(1024.0) * x.cast("double")))


def usable(column: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return column.isNotNull() & ~F.exists(column, bad)


def _pack(rows: np.ndarray) -> bytes:
    return np.ascontiguousarray(rows, np.int64).tobytes()


def _unpack(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, np.int64).reshape(-1, width)


def _dense(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    out = np.zeros((len(column), width), np.int64)
    size = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exactly; in floating point where that cannot round."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    limit = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if limit < EXACT:
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Per query and block, the summed maxima of the query's terms."""
    return product(np.maximum(q, 0), high) + product(np.minimum(q, 0), low)


class Best:
    """The k best (score, id) of one query so far."""

    def __init__(self, k: int, least: tuple[int, int] | None = None):
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: A k-th best known from elsewhere.
        self.least = least

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.id = score[order], ids[order]

    def kth(self) -> tuple[int, int] | None:
        own = (int(self.score[-1]), int(self.id[-1])) if len(self.id) == self.k else None
        if own is None or self.least is None:
            return own or self.least
        return max(own, self.least, key=lambda x: (x[0], -x[1]))


def search_shard(qid: int, q: np.ndarray, bound: np.ndarray, shard: dict, best: Best) -> int:
    """Adds the shard's best rows for one query; returns how many blocks were scored."""
    order = np.lexsort((shard["first_id"], -bound))
    done = 0
    for b in order.tolist():
        kth = best.kth()
        if kth is not None and (bound[b], -shard["first_id"][b]) < (kth[0], -kth[1]):
            break
        a, z = shard["starts"][b], shard["starts"][b + 1]
        ids = shard["ids"][a:z]
        score = product(q[None, :], shard["data"][a:z])[0]
        keep = ids != qid
        if kth is not None:
            keep &= score >= kth[0]
        if keep.any():
            best.add(score[keep], ids[keep])
        done += 1
    return done


def _open(row: dict, width: int) -> dict:
    ids = np.frombuffer(row["ids"], np.int64)
    starts = np.r_[np.arange(0, len(ids), BLOCK), len(ids)]
    return {
        "ids": ids,
        "data": _unpack(row["data"], width),
        "high": _unpack(row["high"], width),
        "low": _unpack(row["low"], width),
        "starts": starts,
        "first_id": np.minimum.reduceat(ids, starts[:-1]),
    }


def build_index(vectors: DataFrame, width: int) -> DataFrame:
    """One row for each shard, from ``vectors (id, v array<bigint>, is_query)``."""
    pivots = np.zeros((0, width))
    chosen = vectors.orderBy(F.xxhash64("id"), "id").select("v").limit(PIVOTS).toArrow()
    if chosen.num_rows:
        pivots = _dense(chosen.column("v").combine_chunks(), width).astype(float)
        pivots /= np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-9)
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)
    rows_in_shard = max(BLOCK, SHARD_BYTES // (8 * max(width, 1)) // BLOCK * BLOCK)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            likeness = _dense(batch.column(1), width).astype(float) @ shared.value.T
            best = np.argmax(likeness, axis=1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(best.astype(np.int32)),
                 pa.array(likeness[np.arange(len(best)), best])],
                ["id", "v", "is_query", "pivot", "likeness"],
            )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def shard(ids, data, asks):
            starts = np.arange(0, len(ids), BLOCK)
            high, low = np.maximum.reduceat(data, starts), np.minimum.reduceat(data, starts)
            row = [
                (part << 32) + made, _pack(ids), _pack(data), asks.astype(np.int8).tobytes(),
                _pack(high), _pack(low), _pack(high.max(axis=0)), _pack(low.min(axis=0)),
                int(ids.min()),
            ]
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], INDEX_NAMES)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column(0).to_numpy(), _dense(batch.column(1), width),
                         batch.column(2).to_numpy(zero_copy_only=False)))
            if sum(len(x[0]) for x in held) >= rows_in_shard:
                ids, data, asks = (np.concatenate(x) for x in zip(*held))
                at = 0
                while len(ids) - at >= rows_in_shard:
                    z = at + rows_in_shard
                    yield shard(ids[at:z], data[at:z], asks[at:z])
                    made, at = made + 1, z
                held = [(ids[at:], data[at:], asks[at:])] if at < len(ids) else []
        if held:
            yield shard(*(np.concatenate(x) for x in zip(*held)))

    placed = vectors.mapInArrow(
        place, "id bigint, v array<bigint>, is_query boolean, pivot int, likeness double"
    )
    return materialise(
        placed.repartitionByRange("pivot", "likeness", "id")
        .sortWithinPartitions("pivot", "likeness", "id")
        .select("id", "v", "is_query")
        .mapInArrow(pack, INDEX_SCHEMA),
        "shards",
    )


INDEX_SCHEMA = (
    "shard bigint, ids binary, data binary, asks binary, high binary, low binary,"
    " top binary, bottom binary, first_id bigint"
)
INDEX_NAMES = [c.split()[0] for c in INDEX_SCHEMA.split(", ")]
HIT_SCHEMA = "query_id bigint, vec_id bigint, score bigint"


def _hits(found: list[tuple[int, Best]]) -> dict[str, np.ndarray]:
    nothing = np.zeros(0, np.int64)
    return {
        "query_id": np.concatenate([nothing, *(np.full(len(b.id), q) for q, b in found)]).astype(np.int64),
        "vec_id": np.concatenate([nothing, *(b.id for _, b in found)]),
        "score": np.concatenate([nothing, *(b.score for _, b in found)]),
    }


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best other rows of every query row."""
    ready = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"),
        integers(F.col(vector_col)).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"),
    )
    width = max(1, ready.agg(F.max(F.size("v"))).first()[0] or 0)
    index = build_index(ready, width)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each shard's own queries, searched there: one chunk row."""
        for batch in batches:
            for row in batch.to_pylist():
                shard = _open(row, width)
                asks = np.frombuffer(row["asks"], np.int8).astype(bool)
                if not asks.any():
                    continue
                both = np.unique(np.c_[shard["ids"][asks], shard["data"][asks]], axis=0)
                ids, q = both[:, 0], both[:, 1:]
                limit = bounds(q, shard["high"], shard["low"])
                kth = np.full((len(ids), 3), 0, np.int64)
                found = []
                for i, qid in enumerate(ids.tolist()):
                    best = Best(k)
                    search_shard(qid, q[i], limit[i], shard, best)
                    found.append((qid, best))
                    if best.kth() is not None:
                        kth[i] = (1, *best.kth())
                hits = _hits(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x]) for x in (row["shard"], _pack(ids), _pack(q), _pack(kth),
                                             *(_pack(hits[c]) for c in hits))],
                    ["chunk", "qids", "q", "kth", "hit_q", "hit_v", "hit_s"],
                )

    chunks = materialise(
        index.select("shard", "ids", "data", "asks", "high", "low").mapInArrow(
            home, "chunk bigint, qids binary, q binary, kth binary, hit_q binary, hit_v binary, hit_s binary"
        ),
        "chunks",
    )
    shards = index.agg(F.count(F.lit(1))).first()[0]
    groups = max(1, -(-shards // SUMMARIES))
    bunches = max(1, -(-shards // CHUNKS))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asking = chunks.withColumn("bunch", own("chunk", bunches))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        """Pairs of chunk and shard in which some query may still find a row."""
        pairs: list[tuple[int, int, int]] = []
        if right.num_rows:
            high = _unpack(b"".join(right.column("top").to_pylist()), width)
            low = _unpack(b"".join(right.column("bottom").to_pylist()), width)
            ids, first = right.column("shard").to_numpy(), right.column("first_id").to_numpy()
            for row in left.to_pylist():
                kth = _unpack(row["kth"], 3)
                limit = bounds(_unpack(row["q"], width), high, low)
                open_ = (kth[:, :1] == 0) | (limit > kth[:, 1:2]) | (
                    (limit == kth[:, 1:2]) & (first[None, :] < kth[:, 2:])
                )
                for s in ids[open_.any(axis=0)].tolist():
                    if s != row["chunk"]:
                        pairs.append((s, row["chunk"], row["bunch"]))
        cols = list(zip(*pairs)) if pairs else [[], [], []]
        return pa.table({"shard": pa.array(cols[0], pa.int64()), "chunk": pa.array(cols[1], pa.int64()),
                         "bunch": pa.array(cols[2], pa.int32())})

    pairs = materialise(
        asking.select("chunk", "bunch", "q", "kth", every(groups).alias("group"))
        .groupBy("group", "bunch")
        .cogroup(
            index.select("shard", "top", "bottom", "first_id", own("shard", groups).alias("group"),
                         every(bunches).alias("bunch")).groupBy("group", "bunch")
        )
        .applyInArrow(meet, "shard bigint, chunk bigint, bunch int"),
        "pairs",
    )

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, Best]] = []
        for stored in right.to_pylist():
            shard = _open(stored, width)
            for row in left.to_pylist():
                q, kth = _unpack(row["q"], width), _unpack(row["kth"], 3)
                limit = bounds(q, shard["high"], shard["low"])
                for i, qid in enumerate(np.frombuffer(row["qids"], np.int64).tolist()):
                    best = Best(k, (int(kth[i, 1]), int(kth[i, 2])) if kth[i, 0] else None)
                    search_shard(qid, q[i], limit[i], shard, best)
                    found.append((qid, best))
        return pa.table(_hits(found))

    elsewhere = (
        pairs.join(chunks.select("chunk", "qids", "q", "kth"), "chunk")
        .groupBy("shard", "bunch")
        .cogroup(
            pairs.select(F.col("shard").alias("to"), F.col("bunch").alias("by")).distinct()
            .join(
                index.select(F.col("shard").alias("to"), "ids", "data", "high", "low"), "to"
            )
            .groupBy("to", "by")
        )
        .applyInArrow(score, HIT_SCHEMA)
    )

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(row[c], np.int64)) for c in ("hit_q", "hit_v", "hit_s")],
                    ["query_id", "vec_id", "score"],
                )

    hits = chunks.select("hit_q", "hit_v", "hit_s").mapInArrow(at_home, HIT_SCHEMA).union(elsewhere)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        hits.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
