"""Writers. Existing results are refused, existing splits are reused."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelpool.plans.cuts import numbered
from labelpool.plans.lookup import skew_lookup
from labelpool.session import materialise


def write_new(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Fail if the target exists."""
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def write_once(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write unless the target exists already, then read it."""
    df.write.mode("ignore").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_curves(curves: DataFrame, path: str) -> None:
    """Learning curves ``(strategy, iteration, fold, draw, auc)``."""
    curves.write.mode("append").partitionBy("strategy", "iteration").parquet(path)


def write_choices(choices: DataFrame, path: str) -> None:
    """Choice order ``(strategy, iteration, fold, draw, id, y)``."""
    choices.write.mode("append").partitionBy("strategy", "iteration").parquet(path)


def append_annotations(annotations: DataFrame, path: str) -> None:
    """Answers ``(id, label, annotated_at)``."""
    annotations.select("id", "label", "annotated_at").write.mode("append").parquet(path)


#: Characters of lines that are handed on at a time.
_CHUNK = 4_000_000


def write_feature_matrix(
    features: DataFrame, labels: DataFrame, path: str, label: str = "T/F"
) -> None:
    """Wide CSV with the label as last column and a header in each file.

    ``features`` is ``(id, feature, value)``, ``labels`` is ``(id, y)``. Names are numbered on
    Spark; entries and labels are dealt out by id and sorted by id and number, and a line is
    written as they pass, so a task holds one line, not a cell for each feature of its rows. Every
    label row gives a line; rows without labels give none. Cells without an entry are 0.0, NULL
    values, labels and ids empty. Of several values of one cell the largest stays. NULL feature
    names are left out. A matrix without rows is a header.
    """
    spark = features.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    named = (
        features.where("feature IS NOT NULL").groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    )
    places = materialise(numbered(named, ["feature"], "place"), "places")
    width = places.count()
    nothing = {
        "key": F.lit(None).cast("string"), "place": F.lit(None).cast("bigint"),
        "value": F.lit(None).cast("double"), "y": F.lit(None).cast("string"),
        "names": F.lit(None).cast("array<string>"),
    }

    def row(kind: int, part: Column, **own: Column) -> list[Column]:
        cells = (nothing | own).items()
        return [part.cast("int").alias("part"), F.lit(kind).alias("kind"), *[c.alias(n) for n, c in cells]]

    dealt = F.pmod(F.xxhash64("key"), F.lit(parts))
    # A header is one line and so one value; every file needs it.
    header = places.agg(
        F.array_sort(F.collect_list(F.struct("place", "feature"))).alias("all")
    ).select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("at"), F.col("all.feature").alias("names"))
    known = labels.select(F.col("id").cast("string").alias("key"), F.col("y").cast("string").alias("y"))
    entries = skew_lookup(
        features.where("id IS NOT NULL").select("id", "feature", "value"), places, "feature", F.col("n"), "id"
    ).select(F.col("id").cast("string").alias("key"), "place", F.col("value").cast("double").alias("value"))
    rows = (
        header.select(*row(0, F.col("at"), names=F.col("names")))
        .union(known.select(*row(1, dealt, key=F.col("key"), y=F.col("y"))))
        .union(
            entries.select(*row(2, dealt, key=F.col("key"), place=F.col("place"), value=F.col("value")))
        )
        .repartition(parts, "part")
        # The header first, then by id its labels and its entries from left to right.
        .sortWithinPartitions(F.col("kind") > 0, "key", "kind", "place", "value")
    )

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _chunks(_lines(batches, width, label)):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["value"])

    rows.mapInArrow(lines, "value string").write.mode("errorifexists").text(path)


def _lines(batches: Iterator[pa.RecordBatch], width: int, label: str) -> Iterator[str]:
    """The lines of one file from its sorted header, label and entry rows."""
    header, key, ys, cells, filled = None, None, [], [], 0

    def closed() -> Iterator[str]:
        body = "".join(cells) + ",0.0" * (width - filled)
        for y in ys:
            yield f"{key or ''}{body},{y or ''}"

    for batch in batches:
        for _, kind, own, place, value, y, names in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == 0:
                if header is None:
                    header = ",".join(_quoted(n) for n in ["id", *names, label])
                    yield header
            elif kind == 1:
                if own != key or not ys:
                    yield from closed()
                    key, ys, cells, filled = own, [], [], 0
                ys.append(y)
            elif ys and own == key:
                cell = "," if value is None else f",{float(value)!r}"
                if place < filled:
                    cells[-1] = cell
                else:
                    cells.append(",0.0" * (place - filled))
                    cells.append(cell)
                    filled = place + 1
    yield from closed()


def _chunks(lines: Iterator[str]) -> Iterator[list[str]]:
    some, size = [], 0
    for line in lines:
        some.append(line)
        size += len(line)
        if size > _CHUNK:
            yield some
            some, size = [], 0
    if some:
        yield some


def _quoted(name: str) -> str:
    """A header cell; names that would break the line are put in quotes."""
    if any(c in name for c in ',"\n\r'):
        return '"' + name.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return name


def ranked_lines(ranked: DataFrame) -> DataFrame:
    """``name :: score :: p`` per line, six significant digits, in the given order."""
    number = lambda c: F.format_string("%.6g", F.col(c))
    return ranked.select(F.concat_ws(" :: ", "feature", number("score"), number("p")).alias("value"))


def write_ranked_features(ranked: DataFrame, path: str) -> None:
    """Text file of ranked features, best first."""
    ranked_lines(ranked).write.mode("errorifexists").text(path)
