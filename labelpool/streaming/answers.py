"""Answers that people revise, and the rate at which they arrive, as streams.

A person may answer the same row again, and answers come late or twice. ``LatestFit`` keeps the
latest answer of every id as keyed state; when it changes, the earlier one is taken out of the
model's sums and the new one put in, so the model always is the one of the latest answers and no
history is read again. ``ArrivalRates`` counts answers by event-time windows under a watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from labelpool.operators.moments import class_moments
from labelpool.streaming.labels import StreamingFit

STATE = "at timestamp, answer_id bigint, y int, x array<double>"
CHANGES = "id bigint, sign int, y int, x array<double>"


def _newest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of every Arrow batch the latest answer by id: an id with a third of all answers is thinned
    out before the shuffle, as a partial aggregate would."""
    for batch in batches:
        yield batch.sort_values(["at", "answer_id"]).drop_duplicates("id", keep="last")


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    old = state.get if state.exists else None
    new = old
    for batch in batches:
        for at, answer_id, y, x in zip(batch["at"], batch["answer_id"], batch["y"], batch["x"]):
            if new is None or (pd.Timestamp(at), answer_id) > (pd.Timestamp(new[0]), new[1]):
                given = not pd.isna(y)
                new = (
                    pd.Timestamp(at).to_pydatetime(), int(answer_id), int(y) if given else None,
                    [float(v) for v in x] if given else None,
                )
    if new == old:
        return
    state.update(new)
    changes = [(key[0], -1, *old[2:])] if old is not None and old[2] is not None else []
    changes += [(key[0], 1, *new[2:])] if new[2] is not None else []
    if changes:
        out = pd.DataFrame(changes, columns=["id", "sign", "y", "x"])
        yield out.astype({"y": "int32", "sign": "int32"})


def label_changes(answers: DataFrame) -> DataFrame:
    """``(id, sign, y, x)``: what each micro-batch takes out of (-1) and puts into (+1) the labels.

    ``answers`` is a stream of ``(answer_id, id, at, y, x)``. The answer with the largest
    ``(at, answer_id)`` holds, in whatever order answers arrive; a repeated one changes nothing. A
    NULL ``y`` withdraws the label of its row. Answers without id, answer_id or time, and labels
    without ``x``, are left out. State is one row for each id that was ever answered.
    """
    known = answers.select(
        F.col("id").cast("bigint"), F.col("at").cast("timestamp"),
        F.col("answer_id").cast("bigint"), F.col("y").cast("int"), F.col("x").cast("array<double>"),
    ).where("id IS NOT NULL AND answer_id IS NOT NULL AND at IS NOT NULL AND (y IS NULL OR x IS NOT NULL)")
    return (
        known.mapInPandas(_newest, known.schema)
        .groupBy("id")
        .applyInPandasWithState(_update, CHANGES, STATE, "update", GroupStateTimeout.NoTimeout)
    )


class LatestFit(StreamingFit):
    """The closed-form model of the latest answers; ``model`` is that of ``StreamingFit``.

    Every micro-batch writes the sums it adds less those it takes out to a partition of its own, so
    a batch that is run again counts once.
    """

    def _add(self, batch: DataFrame, batch_id: int) -> None:
        moments = class_moments(batch, by=["sign"]).select(
            F.col("y").cast("int").alias("y"),
            (F.col("n") * F.col("sign")).alias("n"),
            *[F.transform(c, lambda v: v * F.col("sign")).alias(c) for c in ("s1", "s2")],
        )
        moments.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        """``stream`` is ``(answer_id, id, at, y, x)``."""
        writer = (
            label_changes(stream).writeStream.outputMode("update").foreachBatch(self._add)
            .option("checkpointLocation", checkpoint)
        )
        return writer.trigger(availableNow=True).start() if available_now else writer.start()


class ArrivalRates:
    """Answers by tumbling event-time window and ``kind``, each counted once.

    A row repeated under its ``answer_id`` within ``lateness`` counts once. A row later than
    ``lateness`` behind the newest time seen in earlier micro-batches may be left out, since its
    window is closed and its state gone: that is what bounds the state. Rows without a time are
    left out. Counts of windows still open are kept up to date, not held back, so nothing is
    missing when the stream ends.
    """

    COUNTS = "start timestamp, kind string, n bigint, batch bigint"

    def __init__(self, path: str, width: str = "1 hour", lateness: str = "1 day"):
        self.path, self.width, self.lateness = path, width, lateness

    def _write(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        """``stream`` is ``(answer_id, at timestamp, kind)``."""
        counted = (
            stream.where("at IS NOT NULL")
            .withWatermark("at", self.lateness)
            .dropDuplicatesWithinWatermark(["answer_id"])
            .groupBy(F.window("at", self.width), "kind")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("window.start").alias("start"), F.col("kind").cast("string").alias("kind"), "n")
        )
        writer = (
            counted.writeStream.outputMode("update").foreachBatch(self._write)
            .option("checkpointLocation", checkpoint)
        )
        return writer.trigger(availableNow=True).start() if available_now else writer.start()

    def counts(self, spark: SparkSession) -> DataFrame:
        """``(start, kind, n)``: of every window the count of the last micro-batch that changed it."""
        versions = spark.read.schema(self.COUNTS).parquet(self.path)
        return versions.groupBy("start", "kind").agg(F.max_by("n", "batch").alias("n"))
