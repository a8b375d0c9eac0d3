"""Exact order statistics without sorting the whole table in one task.

Each function runs two small aggregations and returns plain values, so that the caller can use
them as literals: the big table is then only filtered, never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelpool.session import materialise

# 16 ** 4 buckets: at 10 ** 11 rows one bucket holds about 1.5 million of them.
HASH_DIGITS = 4

# Rows per partition that one task may still merge for a sorted limit.
SMALL_LIMIT = 10_000


def hash_cuts(
    df: DataFrame,
    key: Column,
    ranks: Callable[[int], Sequence[int]],
    by: Column | None = None,
) -> dict[object, tuple[int, list[str]]]:
    """The hash texts at the given 1-based ranks, per group of ``by``.

    ``key`` is a hash text (see ``hash_order``); ``ranks`` maps a group's row count to the ranks
    wanted, and rank 0 gives the empty text. The first job counts rows per hash prefix (at most
    65,536, or 4,096 per group), the second ranks only the rows of the few buckets that hold a wanted rank.
    ``by`` must have few values, such as folds.
    """
    digits = HASH_DIGITS if by is None else HASH_DIGITS - 1
    keyed = df.select((F.lit(0) if by is None else by).alias("g"), key.alias("h")).withColumn(
        "b", F.substring("h", 1, digits)
    )
    counts: dict[object, list[tuple[str, int]]] = {}
    for row in sorted(keyed.groupBy("g", "b").count().collect()):
        counts.setdefault(row["g"], []).append((row["b"], row["count"]))

    wanted: dict[object, list[tuple[str, int] | None]] = {}
    totals: dict[object, int] = {}
    for group, buckets in counts.items():
        totals[group] = sum(c for _, c in buckets)
        wanted[group] = [_locate(buckets, rank) for rank in ranks(totals[group])]
    spots = sorted({(g, *s) for g, found in wanted.items() for s in found if s is not None})
    texts: dict[tuple, str] = {}
    if spots:
        hit = F.lit(False)
        for g, b, rank in spots:
            hit = hit | ((F.col("g") == g) & (F.col("b") == b) & (F.col("rank") == rank))
        buckets_hit = F.lit(False)
        for g, b in sorted({(g, b) for g, b, _ in spots}):
            buckets_hit = buckets_hit | ((F.col("g") == g) & (F.col("b") == b))
        ranked = keyed.where(buckets_hit).withColumn(
            "rank", F.row_number().over(Window.partitionBy("g", "b").orderBy("h"))
        )
        texts = {(r["g"], r["b"], r["rank"]): r["h"] for r in ranked.where(hit).collect()}
    return {
        g: (totals[g], ["" if s is None else texts[(g, *s)] for s in found])
        for g, found in wanted.items()
    }


def _locate(buckets: Sequence[tuple[object, int]], rank: int) -> tuple[object, int] | None:
    """The bucket that holds ``rank`` and the rank inside it."""
    if rank <= 0:
        return None
    seen = 0
    for bucket, count in buckets:
        if seen + count >= rank:
            return bucket, rank - seen
        seen += count
    raise ValueError(f"rank {rank} is beyond the {seen} rows")


def first_rows(
    df: DataFrame, order_by: Sequence[str | Column], limit: int, copies: str | None = None
) -> DataFrame:
    """The first ``limit`` rows in order, for limits too large for one task to merge. Which rows
    they are is exact; in what order they come is not said.

    ``orderBy().limit(n)`` sends n rows of every partition to a single task. Here the rows are
    range-partitioned and sorted, written once with their position, and cut where the row counts
    per partition say. ``copies`` names a column that says how many times a row counts; the last
    row kept may then keep fewer copies.
    """
    if limit <= SMALL_LIMIT and copies is None:
        return df.orderBy(*order_by).limit(limit)
    # The position counts up along partitions in range order and along rows within them.
    placed = materialise(
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33)),
        "sorted",
    )
    weight = F.lit(1) if copies is None else F.col(copies)
    totals = placed.groupBy("_part").agg(F.sum(weight).alias("n")).collect()
    left, edge = limit, None
    for number, n in sorted(map(tuple, totals)):
        if n >= left:
            edge = number
            break
        left -= n
    if edge is None:
        return placed.drop("_at", "_part")
    before = placed.where(F.col("_part") < edge)
    last = placed.where(F.col("_part") == edge)
    if copies is None:
        last = last.where(F.col("_at") < (edge << 33) + left)
    else:
        upto = F.sum(copies).over(Window.partitionBy("_part").orderBy("_at"))
        last = (
            last.withColumn("_room", F.lit(left) - upto + F.col(copies))
            .where(F.col("_room") > 0)
            .withColumn(copies, F.least(F.col(copies), "_room"))
            .drop("_room")
        )
    return before.unionByName(last).drop("_at", "_part")


def numbered(df: DataFrame, order_by: Sequence[str | Column], name: str) -> DataFrame:
    """``df`` with the position, from 0, that each row has in order; the order must be total.

    Rows are range-partitioned and sorted, written once, and numbered by their place in the range
    plus the rows of the ranges before it, one number for each range.
    """
    placed = materialise(
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33).cast("int")),
        "sorted",
    )
    sizes = placed.groupBy("_part").count().orderBy("_part").collect()
    offsets, total = [], 0
    for row in sizes:
        offsets.append((row["_part"], total))
        total += row["count"]
    # One row for each range.
    known = df.sparkSession.createDataFrame(offsets, "_part int, _before bigint")
    return (
        placed.join(F.broadcast(known), "_part")
        .withColumn(name, F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_before"))
        .drop("_at", "_part", "_before")
    )


def nth_text(df: DataFrame, column: str, rank: int, small: int = 10_000) -> str:
    """The ``rank``-th smallest distinct text of a column (1-based)."""
    return nth_texts(df, column, {0: rank}, F.lit(0), small)[0]


def nth_texts(
    df: DataFrame, column: str, ranks: dict[int, int], by: Column, small: int = 10_000
) -> dict[int, str]:
    """The text at the given 1-based rank of each group; texts are distinct inside a group.

    Narrows by prefix, all groups together: each step counts texts by one more character within the
    prefixes found so far, until few enough are left to order.
    """
    keyed = df.select(by.alias("g"), F.col(column).alias("t"))
    open_, found, few = {g: ("", rank) for g, rank in ranks.items()}, {}, {}

    def inside(prefixes: dict[int, tuple[str, int]]) -> DataFrame:
        hit = F.lit(False)
        for g, (prefix, _) in prefixes.items():
            hit = hit | ((F.col("g") == g) & F.col("t").startswith(prefix))
        return keyed.where(hit)

    while open_:
        length = F.lit(0)
        for g, (prefix, _) in open_.items():
            length = F.when(F.col("g") == g, len(prefix) + 1).otherwise(length)
        counts: dict[int, list[tuple[str, int]]] = {g: [] for g in open_}
        next_prefix = F.col("t").substr(F.lit(1), length).alias("p")
        for row in inside(open_).groupBy("g", next_prefix).count().orderBy("p").collect():
            counts[row["g"]].append((row["p"], row["count"]))
        for g, (prefix, left) in list(open_.items()):
            spot = _locate(counts[g], left)
            p, rest = spot
            del open_[g]
            if p == prefix:  # the text that ends here
                found[g] = prefix
            elif dict(counts[g])[p] <= small:
                few[g] = (p, rest)
            else:
                open_[g] = (p, rest)
    if few:
        rank = F.row_number().over(Window.partitionBy("g").orderBy("t"))
        last = F.lit(0)
        for g, (_, rest) in few.items():
            last = F.when(F.col("g") == g, rest).otherwise(last)
        rows = inside(few).withColumn("rank", rank).where(F.col("rank") == last).collect()
        found |= {r["g"]: r["t"] for r in rows}
    return found


def order_values(
    df: DataFrame,
    column: str,
    ranks: Callable[[int], Sequence[int]] | dict[object, Sequence[int]],
    by: Column | None = None,
    step: float = 1 / 4096,
) -> dict[object, tuple[int, list[float]]]:
    """Row count and the values at the 1-based ranks, per group of ``by`` (few groups). Ranks are
    a function of the group's row count, or given for each group that is asked for.

    By radix refinement, for all groups together: rows are counted by sign and exponent of the
    value, then inside the bucket that holds a rank by ``1 / step`` parts of its range, and so on
    until all values of the bucket are equal. A double has 52 further bits, so with 4,096 parts
    that takes five more counts at most; each collects a few numbers for each part, and no value
    is ever sorted. Infinite values are values; NULL and NaN must not occur. Whole numbers stay
    whole.
    """
    v = F.col("v")
    size = F.floor(F.log2(F.abs(v.cast("double")))).cast("long") + 2000
    coarse = (
        F.when(v == 0, 0)
        .when(F.abs(v.cast("double")) == math.inf, F.when(v > 0, 4000).otherwise(-4000))
        .otherwise(F.when(v > 0, size).otherwise(-size))
    )
    whole = df.schema[column].dataType.typeName() in ("long", "integer")
    keyed = df.select(
        (F.lit(0) if by is None else by).alias("g"),
        (F.col(column) if whole else F.col(column).cast("double")).alias("v"),
    )

    def count(rows: DataFrame, *keys: Column) -> dict[object, list]:
        out: dict[object, list] = {}
        made = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        for row in sorted(made.collect(), key=lambda r: r["b"]):
            out.setdefault(row[0], []).append((row["lo"], row["hi"], row["n"]))
        return out

    first = count(keyed, F.col("g"), coarse.alias("b"))
    totals = {g: sum(n for *_, n in buckets) for g, buckets in first.items()}
    if isinstance(ranks, dict):
        wanted = {g: list(rs) for g, rs in ranks.items() if g in totals}
    else:
        wanted = {g: list(ranks(n)) for g, n in totals.items()}
    # (group, rank) -> (smallest, largest value of its bucket, rank inside)
    spots = {(g, r): _spot(first[g], r) for g, rs in wanted.items() for r in rs}
    while True:
        targets = sorted({(g, lo, hi) for (g, _), (lo, hi, _) in spots.items() if lo < hi})
        if not targets:
            return {g: (totals[g], [spots[g, r][0] for r in rs]) for g, rs in wanted.items()}
        target, part = F.lit(None).cast("int"), F.lit(0)
        for k, (g, lo, hi) in enumerate(targets):
            here = (F.col("g") == g) & (v >= lo) & (v <= hi)
            target = F.when(here, k).otherwise(target)
            share = (v - F.lit(lo)) / F.lit(hi - lo)
            last = math.ceil(1 / step) - 1
            part = F.when(here, F.least(F.floor(share / step), F.lit(last))).otherwise(part)
        rows = keyed.withColumn("k", target).where("k IS NOT NULL")
        finer = count(rows, F.col("k"), part.alias("b"))
        at = {t: k for k, t in enumerate(targets)}
        spots = {
            (g, r): _spot(finer[at[g, lo, hi]], rest) if lo < hi else (lo, hi, rest)
            for (g, r), (lo, hi, rest) in spots.items()
        }


def _spot(buckets: Sequence[tuple[float, float, int]], rank: int) -> tuple[float, float, int]:
    """The ends of the bucket that holds ``rank``, and the rank inside it."""
    (lo, hi), rest = _locate([((lo, hi), n) for lo, hi, n in buckets], rank)
    return lo, hi, rest


def quantiles(
    df: DataFrame, column: str, q: float, by: Column | None = None, step: float = 1 / 4096
) -> dict[object, tuple[int, float]]:
    """Per group: row count and the exact, linearly interpolated quantile of a double column."""

    def ranks(n: int) -> list[int]:
        position = (n - 1) * q
        return [math.floor(position) + 1, math.ceil(position) + 1]

    out = {}
    for g, (n, (low, high)) in order_values(df, column, ranks, by, step).items():
        fraction = (n - 1) * q - math.floor((n - 1) * q)
        out[g] = (n, low if low == high else low + (high - low) * fraction)
    return out


def quantile(df: DataFrame, column: str, q: float, step: float = 1 / 4096) -> tuple[int, float]:
    """Row count and the exact, linearly interpolated quantile of a double column without NULLs."""
    found = quantiles(df, column, q, step=step)
    if not found:
        raise ValueError("no rows")
    return found[0]


def first_of_groups(df: DataFrame, group: str, key: str, tie: str, limit: int) -> DataFrame:
    """The first ``limit`` rows of every group in the order of ``key`` and ``tie``, with ``draw``
    from 0, however large limit and groups are.

    ``key`` is a number without NULL or NaN, ``tie`` a whole number that is unique in a group;
    there are few groups. The cuts are found by counts, the rows that pass are numbered by ranges,
    so no task orders a group. ``df`` is read several times: pass a written table.
    """
    g, k, t = F.col(group), F.col(key), F.col(tie)
    cuts = order_values(df, key, lambda n: [min(limit, n)], g)
    if not cuts or limit < 1:
        return df.where(F.lit(False)).withColumn("draw", F.lit(0).cast("bigint"))

    def of(values: dict, kind: str) -> Column:
        out = F.lit(None).cast(kind)
        for name, value in values.items():
            out = F.when(g == F.lit(name), F.lit(value).cast(kind)).otherwise(out)
        return out

    cut = of({name: value for name, (_, (value,)) in cuts.items()}, df.schema[key].dataType.simpleString())
    counts = df.groupBy(g.alias("g")).agg(
        F.count_if(k < cut).alias("below"), F.count_if(k == cut).alias("ties")
    )
    room = {}
    for row in counts.collect():
        left = min(limit, cuts[row["g"]][0]) - row["below"]
        if left < row["ties"]:
            room[row["g"]] = [left]
    last = {}
    if room:
        found = order_values(df.where(k == cut), tie, room, g)
        last = {name: value for name, (_, (value,)) in found.items()}
    fits = (k < cut) | ((k == cut) & (of(last, "long").isNull() | (t <= of(last, "long"))))
    placed = numbered(df.where(fits), [group, key, tie], "draw")
    before, offset = {}, 0
    for name in sorted(cuts):
        before[name], offset = offset, offset + min(limit, cuts[name][0])
    return placed.withColumn("draw", F.col("draw") - of(before, "long"))
