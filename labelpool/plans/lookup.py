"""Joining a large table to a keyed lookup table when some keys are very frequent."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hot keys that are broadcast at most, with a few numbers or a short array each.
MAX_HOT = 100_000


def skew_lookup(
    facts: DataFrame,
    dim: DataFrame,
    key: str,
    weight: Column,
    spread: str,
    hot_weight: int = 1_000_000,
) -> DataFrame:
    """Inner join of ``facts`` to ``dim`` on ``key`` that holds for hot keys.

    ``weight`` is a column of ``dim`` telling how many fact rows carry the key. A key is hot above
    ``hot_weight`` and above 1/MAX_HOT of all weight, so there are at most MAX_HOT hot keys, which
    are broadcast. All other keys go through an ordinary join. Where 1/MAX_HOT of all weight is
    more than ``hot_weight``, that join is dealt out further: fact rows get a salt from ``spread``
    and each lookup row is repeated for every salt, so no key brings more than about
    ``hot_weight`` rows to one place. Fact rows that already found a hot key take a key of their
    own there, so that they neither match nor pile up in one task. ``facts`` is read once.
    """
    values = [c for c in dim.columns if c != key]
    total = dim.agg(F.sum(weight)).first()[0] or 0
    share = total / MAX_HOT
    salts = max(1, math.ceil(share / max(hot_weight, 1)))
    is_hot = F.coalesce((weight > hot_weight) & (weight > share), F.lit(False))
    hot = dim.where(is_hot).select(
        F.col(key), F.struct(*values).alias("_hot")
    )
    cold = dim.where(~is_hot).select(
        F.col(key).cast("string").alias("_k"),
        F.struct(*values).alias("_cold"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_s"),
    )
    found = F.coalesce("_hot", "_cold")
    return (
        facts.join(F.broadcast(hot), key, "left")
        .withColumn(
            "_k",
            F.when(F.col("_hot").isNull(), F.col(key).cast("string")).otherwise(
                F.concat(F.lit("\u0000"), F.col(spread).cast("string"))
            ),
        )
        .withColumn("_s", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
        .join(cold, ["_k", "_s"], "left")
        .withColumn("_found", found)
        .where(F.col("_found").isNotNull())
        .select(*facts.columns, *[F.col(f"_found.{v}").alias(v) for v in values])
    )


def split_lookup(
    facts: DataFrame, dim: DataFrame, key: str, weight: Column, spread: str, part_rows: int = 1_000_000,
    absent: dict[str, Column] | None = None,
) -> DataFrame:
    """Inner join of a written table ``facts`` to ``dim`` on ``key`` that leaves most rows in place.

    ``dim`` has a key once, and ``weight`` tells how many fact rows carry it. The keys of largest
    weight, MAX_HOT at most, are broadcast, and their fact rows are not moved; in texts they hold
    nearly all of them. Only the other rows are dealt by key, with as many salts from ``spread``
    that none brings more than about ``part_rows`` rows to one place. ``facts`` is read twice if
    ``dim`` has more than MAX_HOT keys. With ``absent`` facts whose key ``dim`` lacks stay, with those
    values (the others are NULL); such keys should be rare.
    """
    values, how = [c for c in dim.columns if c != key], "inner" if absent is None else "left"
    filled = [F.coalesce(c, (absent or {}).get(c, F.lit(None))).alias(c) for c in values]
    sizes = dim.groupBy(F.floor(F.log2(weight) * 8).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.max(weight).alias("top"))
    found = sorted((r["s"] if r["s"] is not None else -1, r["n"], r["top"] or 0) for r in sizes.collect())
    room = MAX_HOT
    while found and found[-1][1] <= room:
        room -= found.pop()[1]
    if not found:
        return facts.join(F.broadcast(dim), key, how).select(*facts.columns, *filled)
    top = found[-1][2]
    is_hot = F.coalesce(weight > top, F.lit(False))
    hot, cold = dim.where(is_hot), dim.where(~is_hot)
    rest, on = facts.join(F.broadcast(hot.select(key)), key, "left_anti"), [key]
    salts = math.ceil(top / part_rows)
    if salts > 1:
        rest = rest.withColumn("_s", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
        cold = cold.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        on = [key, "_s"]
    out, looked_up = [*facts.columns, *values], rest.join(cold, on, how)
    return facts.join(F.broadcast(hot), key).select(*out).unionByName(looked_up.select(*facts.columns, *filled))


def salted_join(
    facts: DataFrame, dim: DataFrame, key: str, spread: str, part_rows: int = 1_000_000
) -> DataFrame:
    """Inner join of ``facts`` to ``dim`` on ``key``, both of which may have many rows a key.

    Nothing is broadcast by force and no key is named hot. The fact rows of every key are counted,
    the largest count sets the number of salts, and facts are dealt by (key, salt from ``spread``),
    about ``part_rows`` rows of a key at most to a place. A row of ``dim`` is repeated once for each
    (key, salt) that fact rows really have: a key of n rows repeats it n times at most, and a key
    without facts not at all. ``spread`` should tell the fact rows of a key apart; rows that agree
    in it stay together. NULL keys match nothing.
    """
    given = facts.where(F.col(key).isNotNull())
    largest = given.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    salts = max(1, math.ceil(largest / part_rows))
    dealt = given.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    placed = dealt.select(key, "_salt").distinct().join(dim, key)
    return dealt.join(placed, [key, "_salt"]).drop("_salt")
