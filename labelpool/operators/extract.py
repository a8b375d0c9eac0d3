"""Relational extraction of subject-predicate-object rows and profiles of the result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelpool.plans.cuts import first_rows
from labelpool.plans.lookup import salted_join

# The semantic types and predicates kept by default.
SEMANTIC_TYPES = (
    "gngm", "aapp", "nnon", "phsu", "clnd", "orch", "vita", "opco", "horm", "strd", "antb", "inch",
)
PREDICATES = ("INHIBITS", "INTERACTS_WITH", "STIMULATES")

# Output columns of the extraction, in order.
EXTRACTED = (
    "PMID", "predicate", "INDICATOR_TYPE",
    "SUBJECT_TEXT", "s_type", "SUBJECT_SCORE", "SUBJECT_DIST", "SUBJECT_MAXDIST", "s_cui",
    "OBJECT_TEXT", "o_type", "OBJECT_SCORE", "OBJECT_DIST", "OBJECT_MAXDIST", "o_cui",
    "SENTENCE", "TYPE",
)


def either_key_join(left: DataFrame, right: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """Inner join on ``right.key = left.a OR right.key = left.b``.

    A disjunction would force a nested loop over all pairs. Each left row is instead repeated once
    per distinct key, which makes it an ordinary equi-join with the same multiplicity: a right row
    matches a left row once even if both its keys are equal.
    """
    keys = F.array_distinct(F.filter(F.array(a, b), lambda k: k.isNotNull()))
    return left.withColumn(key, F.explode(keys)).join(right, key)


def either_key_join_dealt(
    left: DataFrame, right: DataFrame, a: str, b: str, key: str, spread: str,
    part_rows: int = 1_000_000,
) -> DataFrame:
    """``either_key_join`` for a right side too large to broadcast and keys that hold a large part
    of the left rows: each left key's rows are dealt by ``spread``, see ``salted_join``."""
    keys = F.array_distinct(F.filter(F.array(a, b), lambda k: k.isNotNull()))
    return salted_join(left.withColumn(key, F.explode(keys)), right, key, spread, part_rows)


def extract_predications(
    sentence_predication: DataFrame,
    predication: DataFrame,
    sentence: DataFrame,
    concept: DataFrame,
    concept_semtype: DataFrame,
    subject_types: Sequence[str] = SEMANTIC_TYPES,
    object_types: Sequence[str] = SEMANTIC_TYPES,
    predicates: Sequence[str] = PREDICATES,
    limit: int | None = None,
    order_by: Sequence[str] = ("PMID", "predicate", "SUBJECT_TEXT", "OBJECT_TEXT", "SENTENCE"),
) -> DataFrame:
    """The 17-column extraction: filters on the predication table, three equi-joins, and the
    concept join on subject or object, a row per matching concept and semantic type. ``limit``,
    if given, takes the first rows of ``order_by``."""
    wanted = predication.where(
        F.col("s_type").isin(list(subject_types))
        & F.col("o_type").isin(list(object_types))
        & F.col("predicate").isin(list(predicates))
    )
    # The concept tables add no columns, only repetitions: count them per key before the join.
    concepts = (
        concept.select("CONCEPT_ID", F.col("CUI").alias("_cui"))
        .join(concept_semtype.select("CONCEPT_ID"), "CONCEPT_ID")
        .groupBy("_cui")
        .agg(F.count("*").alias("_copies"))
    )
    rows = sentence_predication.join(
        wanted.withColumnRenamed("PID", "PREDICATION_ID"), "PREDICATION_ID"
    ).join(sentence, "SENTENCE_ID")
    out = either_key_join(rows, concepts, "s_cui", "o_cui", "_cui").select(*EXTRACTED, "_copies")
    if limit is not None:
        order = [*order_by, *[c for c in EXTRACTED if c not in order_by]]
        out = first_rows(out, order, limit, "_copies")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(*EXTRACTED)


def rename_schema_version(df: DataFrame) -> DataFrame:
    """Old column names (version 26) to the current ones (version 30)."""
    return df.withColumnsRenamed(
        {"s_type": "SUBJECT_SEMTYPE", "o_type": "OBJECT_SEMTYPE", "predicate": "PREDICATE"}
    )


def distinct_in_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values over several columns together: one column ``value``."""
    return df.select(F.explode(F.array(*columns)).alias("value")).where(
        F.col("value").isNotNull()
    ).distinct()


def distinct_counts(df: DataFrame, columns: Sequence[str], members: DataFrame) -> DataFrame:
    """How many distinct values the columns hold, and how many of them are listed in
    ``members(value)``."""
    values = distinct_in_columns(df, columns)
    listed = members.select("value").distinct().withColumn("_in", F.lit(True))
    return values.join(listed, "value", "left").agg(
        F.count("*").alias("n_values"), F.count("_in").alias("n_members")
    )


def group_profile(df: DataFrame, key: str, positive: Column) -> DataFrame:
    """Rows and share of positives per group, largest group first."""
    share = F.avg(F.when(positive, 100.0).otherwise(0.0))
    return (
        df.groupBy(key)
        .agg(F.count("*").alias("n"), share.alias("pct_positive"))
        .withColumn("pct_negative", 100 - F.col("pct_positive"))
        .orderBy(F.desc("n"), key)
    )


def membership_counts(
    df: DataFrame, key: str, subject: str, object_: str, members: DataFrame
) -> DataFrame:
    """Per group, rows whose subject, object, either or both are listed in ``members(value)``.

    The list is joined twice as flags; Spark broadcasts it when its size allows.
    """
    listed = members.select("value").distinct()
    flagged = df.join(
        listed.select(F.col("value").alias(subject), F.lit(True).alias("_s")), subject, "left"
    ).join(listed.select(F.col("value").alias(object_), F.lit(True).alias("_o")), object_, "left")
    s, o = F.col("_s").isNotNull(), F.col("_o").isNotNull()
    return flagged.groupBy(key).agg(
        F.count_if(s).alias("subj"),
        F.count_if(o).alias("obj"),
        F.count_if(s | o).alias("any"),
        F.count_if(s & o).alias("all"),
    )


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence[str]) -> DataFrame:
    """Counts of fixed column values per row value; absent pairs are 0."""
    return df.groupBy(rows).agg(
        *[F.count_if(F.col(columns) == v).alias(v) for v in values]
    )


def fold_profile(df: DataFrame, flags: dict[str, Column], fold: str = "fold", y: str = "y") -> DataFrame:
    """Per fold, the share of positives and the flag counts of its *training* side.

    One aggregation per fold; a training side is the total minus the fold, taken on k rows.
    """
    own = df.groupBy(fold).agg(
        F.count("*").alias("n"),
        F.sum(F.col(y).cast("long")).alias("pos"),
        *[F.count_if(flag).alias(name) for name, flag in flags.items()],
    )
    everything = Window.partitionBy()

    def rest(name: str) -> Column:
        return F.sum(name).over(everything) - F.col(name)

    return own.select(
        fold,
        rest("n").alias("n"),
        F.try_divide(rest("pos") * F.lit(100.0), rest("n")).alias("pct_positive"),
        *[rest(name).alias(name) for name in flags],
    )
