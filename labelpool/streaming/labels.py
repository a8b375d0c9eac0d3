"""Labels that arrive as a stream update the model; new pool rows are scored as they come."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from labelpool.operators.moments import DiscriminantModel, Sums, class_moments

MOMENTS = "y int, n bigint, s1 array<double>, s2 array<double>, batch bigint"


class StreamingFit:
    """The closed-form model fitted incrementally, one additive row set per micro-batch.

    Each micro-batch overwrites its own partition, so a batch that is run again after a failure
    counts once. A row must be labeled once; answers given twice are resolved beforehand
    (``operators.annotate.latest_labels``).
    """

    def __init__(self, path: str):
        self.path = path

    def _add(self, batch: DataFrame, batch_id: int) -> None:
        moments = class_moments(batch).withColumn("y", F.col("y").cast("int"))
        moments.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        """``stream`` is ``(x, y)``."""
        writer = stream.writeStream.foreachBatch(self._add).option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start() if available_now else writer.start()

    def model(self, spark: SparkSession) -> DiscriminantModel:
        # Thousands of micro-batches may have been added up: sum them on the cluster first.
        parts = spark.read.schema(MOMENTS).parquet(self.path)
        total = parts.groupBy("y").agg(
            F.sum("n").alias("n"),
            vector_to_array(Summarizer.sum(array_to_vector("s1"))).alias("s1"),
            vector_to_array(Summarizer.sum(array_to_vector("s2"))).alias("s2"),
        )
        return DiscriminantModel(Sums.of(total.collect()))


def score_stream(stream: DataFrame, model: DiscriminantModel) -> DataFrame:
    """Add ``margin`` and ``prob`` to a stream of ``(id, x)``: no state, no shuffle."""
    return model.transform(stream)
