"""Annotation: what people still have to label, with highlighted spans, and merging their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelpool.functions.text import collapse_blanks, find
from labelpool.operators.splits import binarise


def _slice(text: Column, start: Column, stop: Column) -> Column:
    return F.substring(text, start + 1, F.greatest(stop - start, F.lit(0)))


def with_spans(
    df: DataFrame, sentence: str = "SENTENCE", subject: str = "SUBJECT_TEXT", object_: str = "OBJECT_TEXT"
) -> DataFrame:
    """Add the cleaned texts, the span positions, a ``status`` and the five display parts.

    ``status``: ``bad_subject`` / ``bad_object`` for a missing text, ``subject_not_found`` /
    ``object_not_found``, else ``ok``. The parts are before, first span, between, second span,
    after; NULL unless the status is ok. Overlapping spans print their overlap twice.
    """
    s, o = F.col("subject"), F.col("object")
    text = F.col("sentence")
    out = df.withColumns(
        {
            "sentence": collapse_blanks(F.col(sentence)),
            "subject": collapse_blanks(F.col(subject)),
            "object": collapse_blanks(F.col(object_)),
        }
    ).withColumns({"subject_start": find(text, s), "object_start": find(text, o)})
    out = out.withColumn(
        "status",
        F.when(s.isNull(), "bad_subject")
        .when(o.isNull(), "bad_object")
        .when(F.col("subject_start") < 0, "subject_not_found")
        .when(F.col("object_start") < 0, "object_not_found")
        .otherwise("ok"),
    )
    subject_span = F.struct(
        F.col("subject_start").alias("a"), (F.col("subject_start") + F.length(s)).alias("e")
    )
    object_span = F.struct(
        F.col("object_start").alias("a"), (F.col("object_start") + F.length(o)).alias("e")
    )
    subject_first = F.col("subject_start") < F.col("object_start")
    out = out.withColumns(
        {
            "_1": F.when(subject_first, subject_span).otherwise(object_span),
            "_2": F.when(subject_first, object_span).otherwise(subject_span),
        }
    )
    ok = F.col("status") == "ok"
    zero, end = F.lit(0), F.length(text)
    parts = {
        "before": _slice(text, zero, F.col("_1.a")),
        "first_span": _slice(text, F.col("_1.a"), F.col("_1.e")),
        "between": _slice(text, F.col("_1.e"), F.col("_2.a")),
        "second_span": _slice(text, F.col("_2.a"), F.col("_2.e")),
        "after": _slice(text, F.col("_2.e"), end),
    }
    return out.withColumns({name: F.when(ok, part) for name, part in parts.items()}).drop("_1", "_2")


def summary_line(
    subject_type: str = "SUBJECT_SEMTYPE",
    predicate: str = "PREDICATE",
    indicator: str = "INDICATOR_TYPE",
    object_type: str = "OBJECT_SEMTYPE",
) -> Column:
    """``subject (type) ** PREDICATE (indicator) ** object (type)`` over ``with_spans`` columns."""
    return F.format_string(
        "%s (%s) ** %s (%s) ** %s (%s)",
        "subject", subject_type, predicate, indicator, "object", object_type,
    )


def annotation_queue(rows: DataFrame, annotations: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows nobody has answered yet; a skip ('s') is an answer too."""
    return rows.join(annotations.select(id_col).distinct(), id_col, "left_anti")


def latest_labels(annotations: DataFrame) -> DataFrame:
    """``(id, label, annotated_at)``: the last answer per id; partial maxima before the shuffle,
    so a row answered very often is no burden."""
    return annotations.groupBy("id").agg(
        F.max(F.struct("annotated_at", "label")).alias("m")
    ).select("id", F.col("m.label").alias("label"), F.col("m.annotated_at").alias("annotated_at"))


def training_labels(annotations: DataFrame) -> DataFrame:
    """``(id, y)`` from y / n answers; skipped rows and unknown answers are left out."""
    return (
        latest_labels(annotations)
        .select("id", binarise(F.col("label")).alias("y"))
        .where(F.col("y").isNotNull())
    )


def attach_labels(rows: DataFrame, annotations: DataFrame) -> DataFrame:
    """Rows with a usable label and that label as ``y``."""
    return rows.join(training_labels(annotations), "id")
