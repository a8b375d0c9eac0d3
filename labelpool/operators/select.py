"""Scoring features against a 0/1 label and keeping the best share of them."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelpool.operators.features import family_filter, union_features
from labelpool.plans.cuts import nth_texts, numbered, quantiles
from labelpool.plans.lookup import split_lookup
from labelpool.session import materialise

# Equal scores must compare equal whatever the order of summation was.
SCORE_DIGITS = 9


def _sums() -> list[Column]:
    """Rows, sum per class and sum of squares of one feature's labeled rows."""
    v = F.col("value")

    def of(cls: int) -> Column:
        return F.sum(F.when(F.col("y") == cls, v).otherwise(0.0))

    return [
        F.count(F.lit(1)).alias("rows"), of(0).alias("s0"), of(1).alias("s1"), F.sum(v * v).alias("ss")
    ]


def class_sums(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Per feature: its labeled rows, sum and sum of squares per class; plus class sizes ``n0, n1``.

    Rows without a stored value count as zero through the class sizes. Only labeled rows are read
    further than the join with the labels.
    """
    sizes = labels.agg(
        F.struct(
            F.count_if(F.col("y") == 0).cast("double").alias("n0"),
            F.count_if(F.col("y") == 1).cast("double").alias("n1"),
        ).alias("c")
    )
    known = labels.where("y IS NOT NULL").select("id", "y")
    return (
        features.join(known, "id")
        .groupBy("feature")
        .agg(*_sums())
        .withColumn("_c", sizes.scalar())
        .select("*", "_c.n0", "_c.n1")
        .drop("_c")
    )


def training_sums(features: DataFrame, labels: DataFrame) -> DataFrame:
    """``(fold, feature, rows, s0, s1, ss, n0, n1)`` of the training side of every fold.

    ``labels`` is ``(id, y, fold)``. Sums are made once per feature and fold; a fold's training side
    adds up those of the other folds (nothing is taken away again, so nothing cancels out), and a
    feature that stands in the held-out fold only is not there. Features that have a ``fold``
    themselves, because they were chosen for it, are summed over the rows of the other folds.
    """
    known = labels.where("y IS NOT NULL").select("id", "y", F.col("fold").cast("int").alias("_home"))
    sizes: dict[int, list[int]] = {}
    for row in known.groupBy("_home", "y").count().collect():
        if row["y"] in (0, 1):
            sizes.setdefault(row["_home"], [0, 0])[row["y"]] += row["count"]
    folds = sorted(sizes)
    if not folds:
        raise ValueError("no labeled rows")
    total = [sum(n[cls] for n in sizes.values()) for cls in (0, 1)]

    def size(cls: int) -> Column:
        pairs = [F.lit(x) for f in folds for x in (f, float(total[cls] - sizes[f][cls]))]
        return F.element_at(F.create_map(*pairs), F.col("fold")).alias(f"n{cls}")

    rows = features.join(known, "id")
    names = ["rows", "s0", "s1", "ss"]
    if "fold" in features.columns:
        sums = rows.where("fold <> _home").groupBy("fold", "feature").agg(*_sums())
        return sums.select("fold", "feature", *names, size(0), size(1))
    by_fold = rows.groupBy("feature", "_home").agg(*_sums())
    parts = by_fold.groupBy("feature").agg(
        F.array_sort(F.collect_list(F.struct("_home", *names))).alias("parts")
    )
    sides = parts.withColumn("fold", F.explode(F.array(*[F.lit(f) for f in folds]))).withColumn(
        "parts", F.filter("parts", lambda p: p["_home"] != F.col("fold"))
    )

    def add(name: str) -> Column:
        zero = F.lit(0).cast("bigint") if name == "rows" else F.lit(0.0)
        return F.aggregate("parts", zero, lambda acc, p: acc + p[name]).alias(name)

    return (
        sides.where(F.size("parts") > 0)
        .select("fold", "feature", *[add(n) for n in names])
        .select("*", size(0), size(1))
    )


def _chi2() -> Column:
    """Chi-square of the class sums against the class shares."""
    n0, n1 = F.col("n0"), F.col("n1")
    all_ = F.col("s0") + F.col("s1")

    def part(observed: str, size: Column) -> Column:
        expected = all_ * F.try_divide(size, n0 + n1)
        gap = F.col(observed) - expected
        return F.try_divide(gap * gap, expected)

    return part("s0", n0) + part("s1", n1)


def _anova() -> Column:
    """One-way F. NULL for a constant feature."""
    n0, n1, s0, s1 = (F.col(c) for c in ("n0", "n1", "s0", "s1"))
    n = n0 + n1
    by_class = F.try_divide(s0 * s0, n0) + F.try_divide(s1 * s1, n1)
    between = by_class - F.try_divide((s0 + s1) * (s0 + s1), n)
    within = F.col("ss") - by_class
    tiny = F.col("ss") * 1e-14
    return F.when(within > tiny, between / F.try_divide(within, F.lit(-2.0) + n)).when(
        between > tiny, F.lit(math.inf)
    )


SCORES: dict[str, Callable[[], Column]] = {"chi2": _chi2, "anova": _anova}


def chi2_scores(features: DataFrame, labels: DataFrame) -> DataFrame:
    """``(feature, rows, score)``: chi-square against the label, on labeled rows."""
    return class_sums(features, labels).select("feature", "rows", _chi2().alias("score"))


def anova_scores(features: DataFrame, labels: DataFrame) -> DataFrame:
    """``(feature, rows, score)``: one-way F, on labeled rows. NULL for a constant feature."""
    return class_sums(features, labels).select("feature", "rows", _anova().alias("score"))


SCORERS = {"chi2": chi2_scores, "anova": anova_scores}


def fold_scores(features: DataFrame, labels: DataFrame, scorer: str = "chi2") -> DataFrame:
    """``training_sums`` with a ``score``: each fold's scores come from its training side alone."""
    return training_sums(features, labels).withColumn("score", _scorer(scorer, SCORES)())


def _scorer(name: str, table: dict):
    if name not in table:
        raise ValueError(f"unknown scorer {name!r}")
    return table[name]


def top_percentile(scores: DataFrame, percent: float, by: str | None = None) -> DataFrame:
    """The scored features above the ``100 - percent`` percentile of the score, per group of ``by``.

    Features exactly at it follow in name order while the total stays within
    ``floor(n * percent / 100)``. Undefined scores rank lowest. ``by`` has few values, such as
    folds; all of them are cut by the same jobs.
    """
    if not 0 <= percent <= 100:
        raise ValueError("percent must lie between 0 and 100")
    if percent == 100:
        return scores
    if percent == 0:
        return scores.where(F.lit(False))
    lowest = F.lit(-1.7e308)
    g = F.lit(0) if by is None else F.col(by)
    ranked = scores.withColumn(
        "_r", F.coalesce(F.round("score", SCORE_DIGITS), F.when(F.col("score") > 0, F.col("score")), lowest)
    )
    r = F.col("_r")
    cuts = quantiles(ranked, "_r", (100 - percent) / 100, None if by is None else g)
    if not cuts:
        if by is None:
            raise ValueError("no rows")
        return scores
    cut = _of_group(g, {key: value for key, (_, value) in cuts.items()}, "double")
    counts = ranked.groupBy(g.alias("g")).agg(
        F.count_if(r > cut).alias("above"), F.count_if(r == cut).alias("ties")
    )
    whole, some = {}, {}
    for row in counts.collect():
        room = int(cuts[row["g"]][0] * percent / 100) - row["above"]
        whole[row["g"]] = room >= row["ties"]
        if 0 < room < row["ties"]:
            some[row["g"]] = room
    last = nth_texts(ranked.where(r == cut), "feature", some, g) if some else {}
    fits = _of_group(g, whole, "boolean") | F.coalesce(
        F.col("feature") <= _of_group(g, last, "string"), F.lit(False)
    )
    return ranked.where((r > cut) | ((r == cut) & fits)).drop("_r")


def _of_group(group: Column, values: dict, kind: str) -> Column:
    """The value of the row's group, NULL for a group without one."""
    out = F.lit(None).cast(kind)
    for key, value in values.items():
        out = F.when(group == key, F.lit(value).cast(kind)).otherwise(out)
    return out


def rank_features(scores: DataFrame) -> DataFrame:
    """Best score first, names in order among equals."""
    return scores.orderBy(F.col("score").desc_nulls_last(), "feature")


def number_features(scores: DataFrame) -> DataFrame:
    """Add ``rank`` from 1, in the order of ``rank_features`` with scores equal up to rounding as
    ties; numbered by ranges, so no task orders all features."""
    order = [F.round("score", SCORE_DIGITS).desc_nulls_last(), F.col("feature")]
    return numbered(scores, order, "rank").withColumn("rank", F.col("rank") + 1)


def keep_features(features: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of the kept features; very frequent features do not pile up in one task.

    If ``kept`` has a ``fold``, so has the result: a row stands once for each fold that keeps its
    feature, and a row that has a fold already stays if its own fold keeps the feature. Rows of
    frequent features are not moved. ``features`` is read several times: pass a written table.
    """
    if "fold" not in kept.columns:
        names, key = kept.select("feature", F.lit(True).alias("_kept")), ["feature"]
    elif "fold" in features.columns:
        names, key = kept.select("fold", "feature", F.lit(True).alias("_kept")), ["fold", "feature"]
    else:
        names = kept.groupBy("feature").agg(F.sort_array(F.collect_list("fold")).alias("_kept"))
        key = ["feature"]
    named = F.concat_ws(":", *key)
    counted = features.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"))
    # Frequent features that are not kept are there too, so that their rows are dropped in place.
    wanted = counted.join(names, key, "left")
    if len(key) > 1:
        wanted, features = wanted.withColumn("_key", named).drop(*key), features.withColumn("_key", named)
    wanted = materialise(wanted, "kept-features")
    found = split_lookup(features, wanted, key[0] if len(key) == 1 else "_key", F.col("_rows"), "id")
    found = found.where(F.col("_kept").isNotNull())
    columns = [c for c in features.columns if c != "_key"]
    if "fold" in kept.columns and len(key) == 1:
        return found.select(F.explode("_kept").alias("fold"), *columns)
    return found.select(*columns)


def select_features(
    features: DataFrame,
    labels: DataFrame,
    percent: float,
    scorer: str = "chi2",
    within_fold: bool = False,
) -> DataFrame:
    """Keep the best ``percent`` of the features. Score on training rows only by passing their
    labels only; rows without a label are kept in the result all the same.

    With ``within_fold`` the labels have a ``fold``, and each fold keeps what its training side
    alone tells, so that nothing of a held-out row leaks into the features it is judged by. The
    result then has a ``fold`` too; its rows of the fold itself are the test side. Features that
    have a ``fold`` already are selected again inside it.
    """
    score = _scorer(scorer, SCORERS)
    if within_fold:
        return keep_features(features, fold_selection(features, labels, percent, scorer))
    if percent >= 100:
        return features
    scores = materialise(score(features, labels), "feature-scores")
    return keep_features(features, top_percentile(scores, percent))


def fold_selection(
    features: DataFrame, labels: DataFrame, percent: float, scorer: str = "chi2"
) -> DataFrame:
    """The rows of ``fold_scores`` that each fold's training side selects."""
    scores = materialise(fold_scores(features, labels, scorer), "fold-scores")
    return top_percentile(scores, percent, "fold")


def combined_features(
    text_features: DataFrame,
    record_features: DataFrame,
    labels: DataFrame,
    families: list[str] | tuple[str, ...] = ("all",),
    text_percent: float = 12,
    record_percent: float = 10,
    final_percent: float = 65,
    patterns: dict[str, str] | None = None,
    prefix: bool = False,
    within_fold: bool = False,
) -> DataFrame:
    """Select text features, filter and select record features, put them together, select again.

    With ``within_fold`` all three selections look at each fold's training side alone, and the
    result has a ``fold``, as in ``select_features``.
    """
    record_features = family_filter(record_features, families, patterns)

    def best(features: DataFrame, percent: float) -> DataFrame:
        if within_fold:
            return fold_selection(features, labels, percent).select("fold", "feature", "score")
        scores = materialise(chi2_scores(features, labels), "feature-scores")
        return top_percentile(scores, percent).select("feature", "score")

    # Tagged by part, so that equal names stay two features and ties keep the order of the parts.
    parts = {"0": text_features, "1": record_features}
    if final_percent >= 100 and not within_fold:
        kept = union_features(
            {"0": select_features(text_features, labels, text_percent),
             "1": select_features(record_features, labels, record_percent)}, prefix=True
        )
    else:
        # A selection leaves a feature's rows alone, so its score is the same in the last one, and
        # the rows are met once, with what all selections kept.
        shares = {"0": text_percent, "1": record_percent}
        tagged = [
            best(df, shares[part]).withColumn("feature", F.concat(F.lit(f"{part}:"), "feature"))
            for part, df in parts.items()
        ]
        chosen = materialise(tagged[0].unionByName(tagged[1]), "chosen")
        chosen = materialise(top_percentile(chosen, final_percent, "fold" if within_fold else None), "chosen")
        kept = keep_features(union_features(parts, prefix=True), chosen)
    bare = F.expr("substring(feature, 3)")
    if prefix:
        name = F.when(F.col("feature").startswith("0:"), "text:").otherwise("record:")
        bare = F.concat(name, bare)
    return kept.withColumn("feature", bare)


def erfc(z: np.ndarray) -> np.ndarray:
    """Complementary error function of non-negative numbers: series below 2, fraction above."""
    out = np.full(z.shape, np.nan)
    low, high = z < 2, z >= 2
    x = z[low]
    term = total = x * 2 / math.sqrt(math.pi)
    for n in range(1, 60):
        term = term * (-x * x) / n
        total = total + term / (2 * n + 1)
    out[low] = 1 - total
    x = z[high]
    tail = x.copy()
    for n in range(120, 0, -1):
        tail = x + n / 2 / tail
    with np.errstate(under="ignore"):
        out[high] = np.exp(-x * x) / (tail * math.sqrt(math.pi))
    return out


def chi2_p_value(score: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom."""

    @F.pandas_udf("double")
    def tail(values: pd.Series) -> pd.Series:
        z = np.sqrt(values.to_numpy(dtype=float, na_value=np.nan) / 2)
        return pd.Series(erfc(z)).where(values.notna())

    return tail(score)


def _log_beta_half(a: float) -> float:
    """ln B(a, 1/2). For large a by the expansion of the ratio of gammas, where they would cancel."""
    if a < 1000:
        return math.lgamma(a) + math.lgamma(0.5) - math.lgamma(a + 0.5)
    return 0.5 * math.log(math.pi / a) + 1 / (8 * a) - 1 / (192 * a**3)


def _beta_fraction(x: np.ndarray, a: float, b: float) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by Lentz's method, until it rests."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    m = 0
    while True:
        m += 1
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if not np.any(np.abs(d * c - 1) > 1e-15) or m > 100 + 10 * math.sqrt(a + b):
            return h


def f_tail(f: np.ndarray, dof: int) -> np.ndarray:
    """P(F > f) with (1, dof) degrees of freedom: the regularised incomplete beta function at
    dof / (dof + f), in log space, for every number of degrees of freedom."""
    out = np.full(f.shape, np.nan)
    out[f <= 0] = 1.0
    out[np.isposinf(f)] = 0.0
    inner = (f > 0) & np.isfinite(f)
    v = f[inner]
    a, b = dof / 2, 0.5
    x, y = dof / (dof + v), v / (dof + v)
    log_front = -a * np.log1p(v / dof) + b * np.log(y) - _log_beta_half(a)
    near_one = x >= (a + 1) / (a + b + 2)
    with np.errstate(under="ignore"):
        front = np.exp(log_front)
        # Each branch is the same function; the fraction settles fast on its own side only.
        tail = np.empty_like(v)
        tail[~near_one] = front[~near_one] * _beta_fraction(x[~near_one], a, b) / a
        tail[near_one] = 1 - front[near_one] * _beta_fraction(y[near_one], b, a) / b
    out[inner] = tail
    return out


def f_p_value(score: Column, n: int) -> Column:
    """Upper tail of F with (1, n - 2) degrees of freedom."""

    @F.pandas_udf("double")
    def tail(values: pd.Series) -> pd.Series:
        return pd.Series(f_tail(values.to_numpy(dtype=float, na_value=np.nan), n - 2)).where(values.notna())

    return tail(score)
