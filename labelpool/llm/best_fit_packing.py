"""Best-fit packing of documents into bins under conflicts.

Documents are dealt into shards of about SHARD rows by a hash, equal rows round the shards, and
every shard is packed by itself, so a task holds a bounded number of lengths and never a text. Inside a shard the
longest document comes first. Bins are kept ordered by what is left in them; each carries one
bitmap of the sources and one of the duplicate clusters it holds. From the tightest bin that a
document fits in, the search goes on to the next larger rest until a bin shares neither source nor
cluster with it; if none does, a bin is opened. A document longer than a bin fills bins of its own
and only its rest is packed.

A source or cluster that holds a third of all rows is spread over all shards like any other; it
costs bins, since no bin may hold two of it, but no task more rows.

Defined cases: a NULL or blank text has length 0 and is packed like any other. A NULL source
conflicts with nothing, a NULL text belongs to no cluster. Ties in length go to the smaller
cluster, then the smaller id; ties in rest to the bin opened first. Every row gives at least one
row; repeated rows are copies of each other, so they share no bin. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD = 1000
#: Copies of one row that are unfolded together.
COPIES = 10_000
CAPACITY = 2048


def n_words(column: Column) -> Column:
    """Runs of characters other than white space."""
    return F.coalesce(F.regexp_count(column, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def best_fit(items: list[tuple[int, int | None, int | None]], capacity: int) -> list[tuple[int, int]]:
    """``(bin, offset)`` of each ``(length, source, cluster)``, in the order given."""
    rests: list[tuple[int, int]] = []
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for length, source, cluster in items:
        s = 0 if source is None else 1 << source
        c = 0 if cluster is None else 1 << cluster
        at = bisect_left(rests, (length, -1))
        while at < len(rests) and (sources[rests[at][1]] & s or clusters[rests[at][1]] & c):
            at += 1
        if at < len(rests):
            rest, b = rests.pop(at)
        else:
            rest, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= s
        clusters[b] |= c
        out.append((b, capacity - rest))
        insort(rests, (rest - length, b))
    return out


def _dealt(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` with their ``shard``: equal rows are counted and dealt round, one after the other.

    The count is a partial sum before the shuffle, and a run of copies is unfolded block by block,
    so neither a task nor a shard gets all copies of a row. Nothing depends on the order of rows.
    """
    kinds = ["id", "source", "cluster", "n"]
    blocks = F.sequence(F.lit(0).cast("bigint"), F.expr("(copies - 1) div %d" % COPIES))
    first = F.col("block") * COPIES
    copies = F.sequence(first, F.least(first + COPIES, F.col("copies")) - 1)
    return (
        rows.groupBy(*kinds)
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("block", F.explode(blocks))
        .repartition(*kinds, "block")
        .withColumn("copy", F.explode(copies))
        .select(
            *kinds,
            F.pmod(F.xxhash64(*kinds) % shards + F.col("copy"), F.lit(shards)).cast("int").alias("shard"),
        )
    )


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    capacity: int = CAPACITY,
    shard_rows: int = SHARD,
    cluster: Column | None = None,
    length: Column | None = None,
) -> DataFrame:
    """One row for each piece: ``(id_col, piece, shard, bin, bin_offset, first_word, n_words)``.

    ``cluster`` tells duplicates apart and is a hash of the text unless given; ``length`` is the
    number of words unless given.
    """
    if cluster is None:
        cluster = F.when(F.col(text_col).isNotNull(), F.xxhash64(text_col))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        cluster.cast("bigint").alias("cluster"),
        F.greatest(F.lit(0), n_words(F.col(text_col)) if length is None else length).cast("bigint").alias("n"),
    )
    shards = max(1, -(-docs.count() // shard_rows))
    dealt = _dealt(rows, shards)

    def packed(table: pa.Table) -> pa.Table:
        ids, sources, clusters, lengths, shard = (c.to_pylist() for c in table.columns)
        order = sorted(
            range(len(ids)),
            key=lambda i: (
                -(lengths[i] % capacity), clusters[i] is None, clusters[i] or 0, ids[i] is None, ids[i] or 0
            ),
        )
        number: dict = {}
        code = lambda x: None if x is None else number.setdefault(x, len(number))
        source_code = [code(("s", s) if s is not None else None) for s in sources]
        number = {}
        cluster_code = [code(c) for c in clusters]
        placed = best_fit(
            [(lengths[i] % capacity, source_code[i], cluster_code[i]) for i in order
             if lengths[i] % capacity or lengths[i] == 0],
            capacity,
        )
        bins = max((b for b, _ in placed), default=-1) + 1
        rows, at = [], 0
        for i in order:
            full, rest = divmod(lengths[i], capacity)
            for p in range(full):
                rows.append((ids[i], p, shard[i], bins, 0, p * capacity, capacity))
                bins += 1
            if rest or lengths[i] == 0:
                b, offset = placed[at]
                at += 1
                rows.append((ids[i], full, shard[i], b, offset, full * capacity, rest))
        kinds = [table.schema.field("id").type, *[pa.int64()] * 6]
        return pa.table(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
            names=["id", "piece", "shard", "bin", "bin_offset", "first_word", "n_words"],
        )

    return (
        dealt.groupBy("shard")
        .applyInArrow(
            packed,
            f"id {kind}, piece bigint, shard bigint, bin bigint, bin_offset bigint,"
            " first_word bigint, n_words bigint",
        )
        .withColumnRenamed("id", id_col)
    )
