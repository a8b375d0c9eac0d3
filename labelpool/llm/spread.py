"""Joins that stay even: keys that hold a third of all rows, and long texts met by a few ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts into which the rows of one key are dealt.
SALTS = 64


def join_by_part(rows: DataFrame, named: DataFrame, keys: list[str], by: str) -> DataFrame:
    """``rows`` left-joined to ``named``, which has one row for each value of ``keys``.

    Rows are dealt by the key and a salt from column ``by``. The named rows are first joined to
    the distinct (key, salt) pairs, of which a key has at most SALTS, so no row is repeated more
    often than its parts exist, and the rows of a frequent key are never together in one task.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    parts = dealt.select(*keys, "_salt").distinct().join(named, keys)
    return dealt.join(parts, [*keys, "_salt"], "left").drop("_salt")


#: Bits of the filter on ids: at most 2^18 rows of two numbers, whatever the data.
FILTER_BITS = 1 << 24


def _flagged(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``_maybe``: whether the id may be among ``ids``, whose first column has them.

    The filter is a bitmap of FILTER_BITS bits, 64 to a row, which is broadcast. A full one flags
    all rows; what is flagged is then decided by a join.
    """
    name = ids.columns[0]
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), (slot(c) % 64).cast("int"))
    bits = ids.groupBy(F.floor(slot(name) / 64).alias("_word")).agg(F.bit_or(one(name)).alias("_bits"))
    return (
        rows.join(F.broadcast(bits), F.floor(slot(column) / 64) == F.col("_word"), "left")
        .withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(one(column)) != 0, F.lit(False)))
        .drop("_word", "_bits")
    )


def maybe_ids(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose id may be among ``ids (id)``, without a shuffle; the caller's join decides."""
    return _flagged(rows, ids, column).where("_maybe").drop("_maybe")


def with_ids(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose id is among ``ids (id)``; only rows that pass the filter are shuffled.

    The join is by sort and merge at every size, so cost grows evenly with the data.
    """
    name = ids.columns[0]
    return maybe_ids(rows, ids, column).join(ids.hint("merge"), F.col(column) == F.col(name), "left_semi")


def without_ids(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose id is not among ``ids (id)``; a NULL id is not. Few rows that stay are moved."""
    name = ids.columns[0]
    flagged = _flagged(rows, ids, column)
    doubtful = flagged.where("_maybe").drop("_maybe")
    return (
        flagged.where("NOT _maybe").drop("_maybe")
        .union(doubtful.join(ids.hint("merge"), F.col(column) == F.col(name), "left_anti"))
    )
