"""Exact deduplication by content-defined chunk recipes.

A text is cut where a rolling hash of its last bytes says so, so equal passages give equal chunks
wherever they stand. The *recipe* of a text is its ordered list of chunk identifiers. Texts are
equal when their recipes are, so long texts are never moved for the comparison:

1. one scan makes recipes of chunk hashes;
2. the contents of the chunks move once, at most once per task and hash, to find out whether every
   hash stands for one content only. Hashes that do not are given numbered identifiers by content,
   and the recipes that use them are rewritten. The identifiers are then proven, not assumed;
3. recipes, a few numbers each, are grouped; a partial count before the shuffle makes a group that
   holds a third of all rows as cheap as any other. Rows find their group by a join
   that deals out a large group's rows.

Defined cases: NULL text counts as empty; all empty texts are one group. A repeated row counts
each time and is returned each time. A NULL id takes part in its group, never as the row to keep
unless all ids of the group are NULL. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelpool.llm.bytescan import flat, groups_of
from labelpool.llm.spread import join_by_part
from labelpool.session import materialise

#: Chunks have MIN to MAX bytes, about MIN + 2^BITS on average.
MIN, MAX, BITS = 256, 8192, 11
_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)
_SLICE = 4 << 20


def cut_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(ends, counts)``: where each chunk ends in the flat buffer, and chunks per text."""
    ends: list[np.ndarray] = []
    counts = np.zeros(len(offsets) - 1, np.int64)
    for a, b in groups_of(offsets, _SLICE):
        base = int(offsets[a])
        marks = _marks(data[base : int(offsets[b])]) + base
        for d in range(a, b):
            lo, hi = int(offsets[d]), int(offsets[d + 1])
            if lo == hi:
                continue
            own, at = [], lo
            inside = marks[np.searchsorted(marks, lo + MIN) : np.searchsorted(marks, hi)]
            for m in inside.tolist():
                while m - at > MAX:
                    at += MAX
                    own.append(at)
                if m - at >= MIN:
                    own.append(m)
                    at = m
            while hi - at > MAX:
                at += MAX
                own.append(at)
            if at < hi:
                own.append(hi)
            counts[d] = len(own)
            ends.append(np.array(own, np.int64))
    return (np.concatenate(ends) if ends else np.zeros(0, np.int64)), counts


def _marks(data: np.ndarray) -> np.ndarray:
    """Places after a byte at which the rolling hash of the last 32 bytes has BITS low zeros."""
    out = []
    for at in range(0, len(data), _SLICE):
        part = data[max(0, at - 31) : at + _SLICE]
        h = _GEAR[part]
        for k in (1, 2, 4, 8, 16):
            # Twice as many bytes of history; an older byte is shifted out at the top.
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
        found = np.flatnonzero((h >> np.uint32(32 - BITS)) == 0) + 1 + max(0, at - 31)
        out.append(found[found > at])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _chunk_hashes(data: np.ndarray, ends: np.ndarray, bits: int) -> np.ndarray:
    view, at, mask = memoryview(np.ascontiguousarray(data)), 0, (1 << bits) - 1
    out = np.empty(len(ends), np.uint64)
    for i, end in enumerate(ends.tolist()):
        digest = hashlib.blake2b(view[at:end], digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little") & mask
        at = end
    return out.view(np.int64)


def recipes(docs: DataFrame, id_col: str, text_col: str, hash_bits: int = 64) -> DataFrame:
    """``(id, sha, recipe)``: SHA-256 of the text and the hashes of its chunks in order."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            ends, counts = cut_points(data, offsets)
            view = memoryview(np.ascontiguousarray(data))
            bounds = offsets.tolist()
            sha = [hashlib.sha256(view[a:b]).digest() for a, b in zip(bounds, bounds[1:])]
            starts = np.zeros(len(counts) + 1, np.int32)
            np.cumsum(counts, out=starts[1:])
            lists = pa.ListArray.from_arrays(
                pa.array(starts), pa.array(_chunk_hashes(data, ends, hash_bits))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sha, pa.binary()), lists], ["id", "sha", "recipe"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        scan, f"id {kind}, sha binary, recipe array<bigint>"
    )


def chunks(docs: DataFrame, text_col: str, hash_bits: int = 64, where: str = "") -> DataFrame:
    """``(hash, content)`` of every chunk, once per batch; with ``where``, an id column, also
    ``id`` and ``pos`` for each of its places."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(0))
            ends, counts = cut_points(data, offsets)
            if not len(ends):
                continue
            hashes = _chunk_hashes(data, ends, hash_bits)
            starts = np.zeros(len(ends) + 1, np.int64)
            starts[1:] = ends
            content = pa.Array.from_buffers(
                pa.large_binary(),
                len(ends),
                [None, pa.py_buffer(starts), pa.py_buffer(np.ascontiguousarray(data))],
            ).cast(pa.binary())
            columns = [pa.array(hashes), content]
            if where:
                doc = np.repeat(np.arange(len(counts)), counts)
                first = np.cumsum(counts) - counts
                columns += [
                    batch.column(1).take(pa.array(doc)),
                    pa.array((np.arange(len(ends)) - first[doc]).astype(np.int32)),
                ]
            names = ["hash", "content", "id", "pos"][: len(columns)]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "hash bigint, content binary"
    wanted = [F.col(text_col).alias("text")]
    if where:
        schema += f", id {docs.schema[where].dataType.simpleString()}, pos int"
        wanted.append(F.col(where).alias("id"))
    return docs.select(*wanted).mapInArrow(scan, schema)


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64
) -> DataFrame:
    """One row per row of ``docs``: ``(id_col, keep_id, group_size, kept, text_sha256)``.

    Of equal texts the row with the largest id stays. ``hash_bits`` below 64 is for tests of
    colliding chunk hashes; the result does not depend on it.
    """
    made = materialise(recipes(docs, id_col, text_col, hash_bits), "recipes")
    contents = chunks(docs, text_col, hash_bits).groupBy("hash").agg(
        F.min("content").alias("low"), F.max("content").alias("high")
    )
    shared = materialise(contents.where("low <> high").select("hash"), "shared-hashes")
    steps = "transform(recipe, h -> named_struct('hash', h, 'n', 0))"
    if shared.isEmpty():
        proven = made.withColumn("recipe", F.expr(steps))
    else:
        proven = _number_contents(docs, made, shared, id_col, text_col, hash_bits)
    groups = proven.groupBy("recipe").agg(
        F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    return join_by_part(proven, groups, ["recipe"], "id").select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _number_contents(docs, made, shared, id_col, text_col, hash_bits):
    """Recipes in which a hash of several contents is told apart by the content's number."""
    from pyspark.sql import Window

    # Ids can repeat or be NULL, so rows are matched by id and SHA-256, which is equal for equal
    # texts; differing texts of one id and one SHA-256 do not occur.
    distinct = (
        chunks(docs, text_col, hash_bits).join(shared, "hash", "left_semi").distinct()
    )
    numbered = distinct.withColumn(
        "n", F.row_number().over(Window.partitionBy("hash").orderBy("content")) - 1
    )
    keyed = docs.select(
        F.struct(
            F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("s")
        ).alias("row"),
        F.col(text_col).alias("text"),
    ).dropDuplicates(["row"])
    places = (
        chunks(keyed, "text", hash_bits, where="row")
        .join(numbered, ["hash", "content"])
        .groupBy("id")
        .agg(F.map_from_entries(F.collect_list(F.struct("pos", "n"))).alias("at"))
    )
    return (
        made.join(
            places.select(
                F.col("id.id").alias("_id"), F.unhex("id.s").alias("_sha"), F.col("at")
            ),
            F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")),
            "left",
        )
        .withColumn(
            "recipe",
            F.expr(
                "transform(recipe, (h, i) -> named_struct('hash', h, 'n', coalesce(at[i], 0)))"
            ),
        )
        .select("id", "sha", "recipe")
    )
