"""Near-duplicate detection: a multi-index Hamming join of b-bit signatures, confirmed on sets.

A document is the set of its distinct word shingles. Its signature is SLOTS minimum hashes of that
set, 16 bits of each. The distance of two signatures is the number of slots that differ.

*Candidates.* Signatures are split into CHUNKS chunks. If two of them differ in at most
``CHUNKS * (ERRORS + 1) - 1`` slots, then by the pigeonhole principle some chunk differs in at most
ERRORS slots, so for some choice of ERRORS slots to leave out, the rest of that chunk is equal. A
key is made for every chunk and choice; equal keys put documents into one bucket, and no pair
within the threshold is lost. (A pair of similarity 0.8 misses all buckets with a chance of about
one in a million.) Bucket members are compared by signature in tiles of two bounded blocks; a tile
returns at most one edge for each of its documents, never its pairs. The connected *families* hold
all pairs that can be similar.

*Confirmation.* Only texts of families are read again. Their full sets are intersected, again in
tiles of bounded size, through the postings of each tile; links are pairs with
``100 * intersection >= 100 * similarity * union``. A tile returns edges that keep its linked
documents together, and the components of all tiles' edges are those of the exact link graph.

Documents of equal sets form a class first (128 bits of set digest and the set's size), and only
one of a class goes on, so groups of copies cost one document, however large they are.

Defined cases: NULL text, or text without words, has an empty set and no links; a text with fewer
words than a shingle is one shingle. Rows of one id are one document, whatever their texts. A NULL
id takes no part: its component is NULL and it is kept. Ties cannot occur, the smallest id of a
component names it. One row comes out for every row that goes in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelpool.llm.bytescan import BLANKS, flat, groups_of, mix, per_doc, words
from labelpool.llm.components import components
from labelpool.llm.spread import join_by_part, maybe_ids
from labelpool.session import materialise

SLOTS, CHUNKS, ERRORS = 32, 8, 1
WIDTH = SLOTS // CHUNKS
#: Pairs up to this distance stay candidates; the pigeonhole rule vouches for less.
FAR = 20
#: Documents in a block of a bucket; documents and shingles in a block of a family.
BUCKET_BLOCK, SET_BLOCK, SET_WEIGHT = 1024, 512, 1 << 19
_SLICE = 1 << 20
_rng = np.random.default_rng(11)
_PLACE = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(0, 1 << 63, SLOTS, dtype=np.uint64)
_TIMES = _rng.integers(0, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: (chunk, slots kept) of every key.
KEYS = [
    tuple(c * WIDTH + s for s in kept)
    for c in range(CHUNKS)
    for kept in combinations(range(WIDTH), WIDTH - ERRORS)
]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, counts)``: the distinct shingles of each text, sorted, one text after another."""
    sets, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for a, b in groups_of(offsets, _SLICE):
        base = offsets[a]
        h, _, _, doc = words(data[base : offsets[b]], offsets[a : b + 1] - base, BLANKS)
        n_words = np.bincount(doc, minlength=b - a)
        if len(h) >= size:
            n = len(h) - size + 1
            s = np.zeros(n, np.uint64)
            for k in range(size):
                s += h[k : k + n] * _PLACE[k % 64]
            inside = doc[:n] == doc[size - 1 :]
            s, owner = mix(s[inside]), doc[:n][inside]
        else:
            s, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        few = np.flatnonzero((n_words > 0) & (n_words < size))
        if len(few):
            first = per_doc(n_words)
            short = np.array(
                [
                    np.sum(h[first[d] : first[d + 1]] * _PLACE[: n_words[d]])
                    + np.uint64(n_words[d])
                    for d in few
                ],
                np.uint64,
            )
            s, owner = np.concatenate([s, mix(short)]), np.concatenate([owner, few])
            order = np.argsort(owner, kind="stable")
            s, owner = s[order], owner[order]
        at = per_doc(np.bincount(owner, minlength=b - a))
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
            s[lo:hi].sort()
        fresh = np.ones(len(s), bool)
        fresh[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
        sets.append(s[fresh])
        counts[a:b] = np.bincount(owner[fresh], minlength=b - a)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), counts


def _signature_scan(size: int) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            sigs, tops, lows, sizes = [], [], [], []
            for a, b in groups_of(offsets, _SLICE):
                s, n = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                some = n > 0
                at = per_doc(n)[:-1][some]
                sig = np.zeros((b - a, SLOTS), np.uint16)
                ends = np.zeros((2, b - a), np.uint64)
                if len(at):
                    for k in range(SLOTS):
                        least = np.minimum.reduceat((s ^ _FLIP[k]) * _TIMES[k], at)
                        sig[some, k] = (least >> np.uint64(20)).astype(np.uint16)
                    ends[0, some] = np.add.reduceat(mix(s ^ np.uint64(0xA5A5A5A5)), at)
                    ends[1, some] = np.add.reduceat(mix(s + np.uint64(0x1234567)), at)
                sigs.append(sig)
                tops.append(ends[0])
                lows.append(ends[1])
                sizes.append(n)
            sig = np.concatenate(sigs) if sigs else np.zeros((0, SLOTS), np.uint16)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64)),
                    pa.array((np.concatenate(tops) if tops else np.zeros(0, np.uint64)).view(np.int64)),
                    pa.array((np.concatenate(lows) if lows else np.zeros(0, np.uint64)).view(np.int64)),
                    _binary(sig),
                ],
                ["id", "n", "d1", "d2", "sig"],
            )

    return scan


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    at = (np.arange(len(rows) + 1) * rows.shape[1] * rows.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(rows)])


def _matrix(column: pa.Array) -> np.ndarray:
    data, offsets = flat(column)
    return data.view(np.uint16).reshape(len(offsets) - 1, SLOTS)


def _key_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sig = _matrix(batch.column(1)).astype(np.int64)
        keys = np.empty((len(sig), len(KEYS)), np.int64)
        for k, slots in enumerate(KEYS):
            packed = np.full(len(sig), k, np.int64)
            for s in slots:
                packed = (packed << 16) | sig[:, s]
            keys[:, k] = packed
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.ravel()), pa.array(np.repeat(ids, len(KEYS)))], ["key", "id"]
        )


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes is connected to by the edges (a, b)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if np.array_equal(before, label):
            return label


def _whole_tiles(batches: Iterator[pa.RecordBatch], n_keys: int, weight: Callable, limit: int):
    """Tables of whole tiles (rows of equal first columns lie together), of about ``limit`` weight."""
    held: list[pa.Table] = []
    total = 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if table.num_rows == 0:
            continue
        key = np.stack(
            [table.column(k).to_numpy().astype(np.int64) for k in range(n_keys)], axis=1
        )
        turns = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        w = np.cumsum(weight(table))
        start = 0
        if held:
            last = [held[-1].column(k)[-1].as_py() for k in range(n_keys)]
            if last != key[0].tolist():
                turns = np.concatenate([[0], turns])
        for t in turns.tolist():
            so_far = total + (w[t - 1] if t else 0) - (w[start - 1] if start else 0)
            if so_far >= limit and (held or t > start):
                yield pa.concat_tables([*held, table.slice(start, t - start)]).combine_chunks()
                held, total, start = [], 0, t
        held.append(table.slice(start))
        total += int(w[-1] - (w[start - 1] if start else 0))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _bucket_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that connect the members of each tile that are within FAR of each other."""
    for table in _whole_tiles(batches, 3, lambda t: np.ones(t.num_rows, np.int64), 20_000):
        key = np.stack([table.column(k).to_numpy().astype(np.int64) for k in range(3)], axis=1)
        ids = table.column(3).to_numpy()
        sig = _matrix(table.column(4).combine_chunks())
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        sizes = np.diff(np.r_[starts, len(ids)])
        left, right = [], []
        for g in np.unique(sizes).tolist():
            if g < 2:
                continue
            firsts = starts[sizes == g]
            i, j = np.triu_indices(g, 1)
            step = max(1, (1 << 19) // len(i))
            for at in range(0, len(firsts), step):
                base = firsts[at : at + step, None]
                for p in range(0, len(i), 1 << 19):
                    x = (base + i[None, p : p + (1 << 19)]).ravel()
                    y = (base + j[None, p : p + (1 << 19)]).ravel()
                    near = (sig[x] != sig[y]).sum(axis=1) <= FAR
                    left.append(x[near])
                    right.append(y[near])
        if not left:
            continue
        yield from _edges(ids, np.concatenate(left), np.concatenate(right))


def _edges(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One edge from each id to the smallest id that the pairs connect it to."""
    names, node = np.unique(ids, return_inverse=True)
    label = spanning(len(names), node[a], node[b])
    moved = np.flatnonzero(label != np.arange(len(names)))
    yield pa.RecordBatch.from_arrays(
        [pa.array(names[moved]), pa.array(names[label[moved]])], ["a", "b"]
    )


def links(s: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets with 100 * intersection >= percent * union, by the postings of the sets."""
    owner = np.repeat(np.arange(len(n)), n)
    _, term = np.unique(s, return_inverse=True)
    order = np.argsort(term, kind="stable")
    posted = owner[order]
    first = per_doc(np.bincount(term))
    length = first[1:] - first[:-1]
    shared = length[term] > 1
    at = per_doc(n)
    left, right = [], []
    for u in range(len(n)):
        own = term[at[u] : at[u + 1]][shared[at[u] : at[u + 1]]]
        if not len(own):
            continue
        size = length[own]
        total = int(size.sum())
        ends = np.cumsum(size)
        both = np.bincount(
            posted[np.arange(total) + np.repeat(first[own] - (ends - size), size)], minlength=len(n)
        )
        near = np.flatnonzero(100 * both >= percent * (n[u] + n - both))
        near = near[(near > u) & (both[near] > 0)]
        left.append(np.full(len(near), u))
        right.append(near)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _set_scan(size: int, percent: int) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def weight(t):
            return t.column(5).to_numpy() + (SET_WEIGHT // SET_BLOCK)

        for table in _whole_tiles(batches, 3, weight, SET_WEIGHT):
            data, offsets = flat(table.column(4).combine_chunks())
            a, b = links(*shingle_sets(data, offsets, size), percent)
            yield from _edges(table.column(3).to_numpy(), a, b)

    return scan


def _tiles(members: DataFrame, group: str, blocks: str) -> DataFrame:
    """Each member once for every tile of its group: all pairs of blocks that hold its block."""
    own = F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")
    return (
        members.withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
        .withColumn("i", F.least("_own", "_other"))
        .withColumn("j", F.greatest("_own", "_other"))
        .drop("_own", "_other", blocks)
        .repartition(group, "i", "j")
        .sortWithinPartitions(group, "i", "j")
    )


def near_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
) -> DataFrame:
    """``(id_col, n_shingles, component_id, kept)``, one row per row of ``docs``."""
    frame = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    made = materialise(
        frame.mapInArrow(
            _signature_scan(shingle), "id bigint, n bigint, d1 bigint, d2 bigint, sig binary"
        ),
        "signatures",
    )
    some = made.where("id IS NOT NULL AND n > 0")
    classes = materialise(
        some.groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"), F.min_by("sig", "id").alias("sig")),
        "set-classes",
    )
    linked = _confirmed(frame, _families(classes), shingle, percent)
    # Rows of one id are one document, so an id that stands in several classes links them.
    repeated = (
        some.select("id", "n", "d1", "d2")
        .join(some.groupBy("id").count().where("count > 1").select("id"), "id", "left_semi")
        .join(classes.select("n", "d1", "d2", "rep"), ["n", "d1", "d2"])
        .select(F.col("id").alias("a"), F.col("rep").alias("b"))
    )
    roots = components(linked.union(repeated)).select(F.col("id").alias("rep"), "root")
    named = classes.join(roots, "rep", "left").select(
        "n", "d1", "d2", F.coalesce("root", "rep").alias("component_id")
    )
    return (
        join_by_part(made.drop("sig"), named, ["n", "d1", "d2"], "id")
        .select(
            F.col("id").alias(id_col),
            F.col("n").alias("n_shingles"),
            F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
        )
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
    )


def _families(classes: DataFrame) -> DataFrame:
    """``(id, root)`` of the documents that a chain of near signatures connects to another."""
    keys = classes.select(F.col("rep").alias("id"), "sig").mapInArrow(
        lambda batches: _key_scan(batches), "key bigint, id bigint"
    )
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = (
        keys.join(sizes, "key")
        .withColumn("blocks", F.ceil(F.col("size") / BUCKET_BLOCK))
        .select("key", "id", "blocks")
        .join(classes.select(F.col("rep").alias("id"), "sig"), "id")
    )
    near = _tiles(members.select("key", "id", "sig", "blocks"), "key", "blocks").select(
        "key", "i", "j", "id", "sig"
    ).mapInArrow(_bucket_scan, "a bigint, b bigint")
    return components(near)


def _confirmed(frame: DataFrame, families: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Edges (a, b) that keep together exactly what links on full sets connect."""
    families = materialise(families, "families")
    texts = maybe_ids(frame, families.select("id"), "id").join(families, "id").select(
        "root",
        "id",
        "text",
        # One shingle begins at each blank at most.
        (F.length("text") - F.length(F.translate("text", " \n", "")) + 1).cast("bigint").alias("w"),
    )
    texts = materialise(texts, "family-texts")
    weights = texts.groupBy("root").agg(
        F.greatest(
            F.ceil(F.count(F.lit(1)) / SET_BLOCK), F.ceil(F.sum("w") / SET_WEIGHT)
        ).alias("blocks")
    )
    tiles = _tiles(texts.join(weights, "root"), "root", "blocks")
    return tiles.select("root", "i", "j", "id", "text", "w").mapInArrow(
        _set_scan(shingle, percent), "a bigint, b bigint"
    )
