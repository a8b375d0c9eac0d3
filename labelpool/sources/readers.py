"""Readers. Schemas are always given: inference would read every file twice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelpool.operators.splits import binarise_sorted
from labelpool.session import materialise

ANNOTATED_ROW = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in [
            ("id", T.LongType()),
            ("T/F", T.StringType()),
            ("PREDICATE", T.StringType()),
            ("INDICATOR_TYPE", T.StringType()),
            ("SUBJECT_TEXT", T.StringType()),
            ("SUBJECT_SEMTYPE", T.StringType()),
            ("SUBJECT_CUI", T.StringType()),
            ("OBJECT_TEXT", T.StringType()),
            ("OBJECT_SEMTYPE", T.StringType()),
            ("OBJECT_CUI", T.StringType()),
            ("SENTENCE", T.StringType()),
            ("TYPE", T.StringType()),
        ]
    ]
)

RESULT_CURVES = "strategy string, iteration int, fold int, draw int, auc double"
RESULT_CHOICES = "strategy string, iteration int, fold int, draw int, id bigint, y int"


def read_delimited(
    spark: SparkSession, path: str, schema: T.StructType | str, sep: str = "\t"
) -> DataFrame:
    """A delimited file with a header line; .gz and .bz2 are unpacked by name. A row that does not
    fit the schema fails the job."""
    return spark.read.csv(
        path, schema=schema, sep=sep, header=True, enforceSchema=False, mode="FAILFAST"
    )


def header_of(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names from the header line alone."""
    return spark.read.csv(path, sep=sep, header=True, inferSchema=False).columns


def read_feature_matrix(
    spark: SparkSession, path: str, label: str = "T/F", id_col: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(id, feature, value)`` and ``(id, y)`` from a wide matrix with a label column.

    Without an id column rows are numbered in file order: file after file, line after line; the
    numbered rows are written once, so that features and labels agree. Zeros are not stored.
    Quotes around header names are dropped. Labels are 0 and 1, or two texts, of which the first
    in order becomes 0. A cell that is no number fails the job.
    """
    names = header_of(spark, path)
    clean = [n.strip().strip('"') for n in names]
    fields = [
        T.StructField(
            n,
            T.LongType() if c == id_col else T.StringType() if c == label else T.DoubleType(),
        )
        for n, c in zip(names, clean, strict=True)
    ]
    # Positions, not names: names that differ in case only cannot both be Spark columns.
    positions = [f"c{i}" for i in range(len(names))]
    raw = spark.read.csv(
        path, schema=T.StructType(fields), header=True, enforceSchema=True, mode="FAILFAST"
    )
    wide = raw.toDF(*positions)
    at = dict(zip(clean, positions, strict=True))
    if label not in at:
        raise ValueError(f"no label column {label!r}")
    wide = (
        materialise(wide.withColumn("_id", F.monotonically_increasing_id()), "numbered")
        if id_col is None
        else wide.withColumn("_id", F.col(at[id_col]))
    )
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(p).alias("value"))
            for c, p in zip(clean, positions, strict=True)
            if c not in (label, id_col)
        ]
    ).cast("array<struct<feature:string,value:double>>")
    features = wide.select(F.col("_id").alias("id"), F.inline(entries)).where("value <> 0")
    return features, _zero_one(wide.select(F.col("_id").alias("id"), F.trim(at[label]).alias("text")))


def _zero_one(labels: DataFrame) -> DataFrame:
    """``(id, y)`` from label texts: numbers 0 and 1 as they are, else two texts in their order."""
    number = F.col("text").try_cast("double")
    other = labels.agg(F.count_if(F.col("text").isNotNull() & ~F.coalesce(number.isin(0, 1), F.lit(False))))
    if other.first()[0] == 0:
        return labels.select("id", number.cast("int").alias("y"))
    return binarise_sorted(labels, "text").select("id", "y")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One trimmed line per row, as ``value``."""
    return spark.read.text(path).select(F.trim("value").alias("value"))


def read_tables(spark: SparkSession, names: Sequence[str], **jdbc: str) -> dict[str, DataFrame]:
    """Tables of a relational database by JDBC, or of the session catalog without options.

    Pass ``partitionColumn`` / bounds / ``numPartitions`` to read in parallel.
    """
    if not jdbc:
        return {n: spark.table(n) for n in names}
    return {n: spark.read.format("jdbc").options(**jdbc, dbtable=n).load() for n in names}


def read_results(
    spark: SparkSession,
    path: str,
    iterations: Sequence[int] | None = None,
    ignore_missing: bool = False,
    schema: str = RESULT_CURVES,
) -> DataFrame:
    """Curves of several runs. Expected iterations without any row are an error, or are ignored."""
    df = spark.read.schema(schema).parquet(path)
    if iterations is not None:
        df = df.where(F.col("iteration").isin(list(iterations)))
        if not ignore_missing:
            seen = {r["iteration"] for r in df.select("iteration").distinct().collect()}
            missing = sorted(set(iterations) - seen)
            if missing:
                raise FileNotFoundError(f"no results for iterations {missing}")
    return df
