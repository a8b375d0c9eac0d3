"""Ranked lexical search the other way round: documents stream through an index of the items.

Few items are asked for in very many documents, so not the documents but the items are indexed:
term -> (item, times in the item). The index is broadcast, each task streams the term counts of its
documents through it, and keeps for every item the best ``k`` documents seen so far. No document is
ever shuffled; what leaves a task is its heaps, which are merged in two steps.

1. A first scan counts, over all documents, N (documents with a term), L (terms with repeats) and
   for every term of the items df (documents that hold it).
2. A second scan scores. With w = floor(1000 * ln((2N + 2) / (2 df + 1))) and, for a document of n
   terms, m = 25 + (75 n N) div L, a term that stands tf times in the document adds
   w * ((10^9 tf) div (1000 tf + 8 m)) for each time it stands in the item.

A block of the index holds at most POSTINGS entries, which is counted before it is broadcast (one
item with more distinct terms is a block of its own); each further block scans the documents again.

Terms are maximal runs of ASCII letters and digits and of all characters above U+007F; only A-Z are
lower-cased. They are found by a 64-bit hash and then compared byte by byte.

Defined cases: NULL and empty texts have no term; such documents are not ranked and such items have
no result. Equal scores go to the smaller document id, NULL ids last; a document row that stands
twice is ranked twice. Rows of items that share an id, a NULL id too, are one item with the terms of
all of them. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelpool.llm.bytescan import byte_class, flat, groups_of, words
from labelpool.session import materialise

#: Entries (term, item) of one block of the index: some 40 MB.
POSTINGS = 1 << 20
#: Bytes of text scanned at once, and cells (document, item) scored at once.
SCAN, CELLS = 4 << 20, 1 << 21
#: Partitions whose heaps are merged in the first step.
MERGE = 256

GAPS = byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
LOW = (1 << 26) - 1


def terms_of(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(_LOWER))


class ItemIndex:
    """The postings of one block of items."""

    def __init__(self, items: pa.Array, item: np.ndarray, term: list[str], n: np.ndarray):
        #: Ids by item number.
        self.items = items
        names = sorted(set(term))
        number = {t: i for i, t in enumerate(names)}
        entry = np.fromiter((number[t] for t in term), np.int64, len(term))
        order = np.lexsort((item, entry))
        self.item, self.n = item[order].astype(np.int64), n[order].astype(np.int64)
        self.first = np.r_[0, np.cumsum(np.bincount(entry, minlength=len(names)))].astype(np.int64)
        self.data, self.at = flat(pa.array(names, pa.large_string()))
        h = words(self.data, self.at, GAPS)[0]
        self.by_hash = np.argsort(h)
        self.hashes = h[self.by_hash]
        if len(names) != len(np.unique(h)):
            raise RuntimeError("two terms of the items have the same hash")

    def __len__(self) -> int:
        return len(self.hashes)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """``(doc, term, tf, n)``: terms of the index by document, and each document's length."""
        h, lo, hi, doc = words(data, offsets, GAPS)
        length = np.bincount(doc, minlength=len(offsets) - 1)
        if not len(self) or not len(h):
            nothing = np.zeros(0, np.int64)
            return nothing, nothing, nothing, length
        slot = np.minimum(np.searchsorted(self.hashes, h), len(self) - 1)
        same = self.hashes[slot] == h
        term, lo, hi, doc = self.by_hash[slot[same]], lo[same], hi[same], doc[same]
        keep = self._equal(data, lo, hi, term)
        pair, tf = np.unique(doc[keep] * len(self) + term[keep], return_counts=True)
        return pair // len(self), pair % len(self), tf, length

    def _equal(self, data, lo, hi, term) -> np.ndarray:
        """Whether the bytes are those of the term, A-Z lower-cased."""
        size = hi - lo
        keep = size == self.at[term + 1] - self.at[term]
        rows = np.flatnonzero(keep)
        for part in np.array_split(rows, max(1, int(size[rows].sum()) >> 22)):
            n = size[part]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            mine = data[inside + np.repeat(lo[part], n)]
            mine = np.where((mine >= 65) & (mine <= 90), mine + 32, mine)
            differ = mine != self.data[inside + np.repeat(self.at[term[part]], n)]
            keep[part[np.repeat(np.arange(len(part)), n)[differ]]] = False
        return keep


class Heaps:
    """For every item the k best (score, document); NULL ids are the largest."""

    def __init__(self, items: int, k: int):
        self.k, self.held = k, [np.zeros((0, 4), np.int64)]
        #: A document below this score is not among the item's k best.
        self.least = np.ones(items, np.int64)

    def add(self, item, score, without, doc) -> None:
        self.held.append(np.column_stack([item, score, without, doc]))
        if sum(map(len, self.held)) > max(1 << 16, 4 * self.k * len(self.least)):
            self.best()

    def best(self) -> np.ndarray:
        """Rows ``(item, score, id is NULL, id)``, the k best of each item, best first."""
        rows = np.concatenate(self.held)
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
        first = np.searchsorted(rows[:, 0], rows[:, 0])
        place = np.arange(len(rows)) - first
        last = rows[place == self.k - 1]
        self.least[last[:, 0]] = last[:, 1]
        self.held = [rows[place < self.k]]
        return self.held[0]


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def length_terms(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """m of documents with n terms; in Python's integers where 64 bits might not hold it."""
    if int(n.max(initial=0)) * n_docs * 75 < 1 << 62:
        return 25 + (75 * n.astype(np.int64) * n_docs) // max(total, 1)
    return np.array([25 + (75 * int(x) * n_docs) // total for x in n], np.int64)


def score_chunk(index: ItemIndex, doc, term, tf, m, w, docs: int) -> np.ndarray:
    """Scores of ``docs`` documents by item, exact: sums of the low and high bits are apart."""
    part = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
    size = index.first[term + 1] - index.first[term]
    at = np.arange(size.sum()) + np.repeat(index.first[term] - (np.cumsum(size) - size), size)
    add = np.repeat(part, size) * index.n[at]
    cell = np.repeat(doc, size) * len(index.items) + index.item[at]
    cells = docs * len(index.items)
    low = np.bincount(cell, add & LOW, cells).astype(np.int64)
    high = np.bincount(cell, add >> 26, cells).astype(np.int64)
    return (low + (high << 26)).reshape(docs, len(index.items))


def _index_blocks(items: DataFrame, item_id: str, text_col: str, limit: int) -> Iterator[ItemIndex]:
    """Blocks of at most ``limit`` postings, or of one item."""
    kind = items.schema[item_id].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = [Counter(terms_of(t)) for t in batch.column(1).to_pylist()]
            row = np.repeat(np.arange(len(counted)), [len(c) for c in counted])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)),
                 pa.array([t for c in counted for t in c], pa.string()),
                 pa.array([n for c in counted for n in c.values()], pa.int64())],
                ["item", "term", "n"],
            )

    found = items.select(F.col(item_id).alias("item"), F.col(text_col).alias("text")).mapInArrow(
        scan, f"item {kind.simpleString()}, term string, n bigint"
    )
    found = materialise(found.groupBy("item", "term").agg(F.sum("n").alias("n")), "postings")
    sizes = found.groupBy("item").agg(F.count(F.lit(1)).alias("size"))
    blocks = 1
    while True:
        block = F.pmod(F.xxhash64("item"), F.lit(blocks))
        # Per block its entries, and its items: one alone cannot be split.
        made = sizes.groupBy(block.alias("b")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("items"))
        if made.where((F.col("size") > limit) & (F.col("items") > 1)).isEmpty():
            break
        blocks *= 2
    for b in range(blocks):
        table = found.where(block == b).toArrow().combine_chunks()
        if not table.num_rows:
            continue
        coded = table.column("item").combine_chunks().dictionary_encode("encode")
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        yield ItemIndex(
            coded.dictionary, coded.indices.to_numpy(), table.column("term").to_pylist(),
            table.column("n").to_numpy(),
        )


def _statistics(docs: DataFrame, shared) -> tuple[int, int, np.ndarray]:
    """``(N, L, df)`` over all documents; df by term of the index."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        df, n_docs, total = np.zeros(len(index), np.int64), 0, 0
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for a, z in groups_of(offsets, SCAN):
                _, term, _, n = index.counts(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
                df += np.bincount(term, minlength=len(index))
                n_docs, total = n_docs + int((n > 0).sum()), total + int(n.sum())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[seen, -1, -2]), pa.array(np.r_[df[seen], n_docs, total])], ["term", "n"]
        )

    rows = docs.mapInArrow(scan, "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect()
    counted = {t: n for t, n in rows}
    df = np.zeros(len(shared.value), np.int64)
    for t, n in counted.items():
        if t >= 0:
            df[t] = n
    return counted.get(-1, 0), counted.get(-2, 0), df


def _hits(docs: DataFrame, shared, stats, k: int, schema: str) -> DataFrame:
    """``(part, item, doc, score)``: the heaps of every task."""
    n_docs, total, df = stats
    w = weights(n_docs, df)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        index = shared.value
        heaps = Heaps(len(index.items), k)
        step = max(1, CELLS // max(1, len(index.items)))
        for batch in batches:
            data, offsets = flat(batch.column(1))
            without = batch.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            ids = batch.column(0).fill_null(0).to_numpy().astype(np.int64)
            for a, z in groups_of(offsets, SCAN):
                doc, term, tf, n = index.counts(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
                m = length_terms(n, n_docs, total)
                for at in range(0, z - a, step):
                    some = slice(*np.searchsorted(doc, [at, at + step]))
                    count = min(step, z - a - at)
                    scores = score_chunk(index, doc[some] - at, term[some], tf[some], m[at : at + count], w, count)
                    row, item = np.nonzero(scores >= heaps.least)
                    heaps.add(item, scores[row, item], without[a + at + row], ids[a + at + row])
        best = heaps.best()
        part = TaskContext.get().partitionId() // MERGE
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(best), part, np.int64)), index.items.take(pa.array(best[:, 0])),
             pa.array(best[:, 3], pa.int64(), mask=best[:, 2] == 1), pa.array(best[:, 1])],
            ["part", "item", "doc", "score"],
        )

    return docs.mapInArrow(scan, schema)


def _best(hits: DataFrame, k: int, *by: str | Column) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def reversed_search(
    docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id",
    text_col: str = "text", postings: int = POSTINGS,
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k best documents of every item, scores above 0."""
    spark = docs.sparkSession
    kind = items.schema[item_id].dataType.simpleString()
    schema = f"part bigint, item {kind}, doc bigint, score bigint"
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    parts = []
    for index in _index_blocks(items, item_id, text_col, postings):
        shared = spark.sparkContext.broadcast(index)
        parts.append(_hits(texts, shared, _statistics(texts, shared), k, schema))
    hits = reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)
    merged = _best(_best(hits, k, "item", "part"), k, "item")
    return merged.select(
        F.col("item").alias(item_id), "rank", F.col("doc").alias(doc_id), "score"
    )
