"""Streaming ingestion: a folder of remote-write batches as a file stream, appended to the stored layout.

A receiver drops files of samples (labels, ts, value, and is_stale, which it has to set because Spark does not keep the bits of a NaN).
Each micro-batch is deduplicated, its series are listed once an hour, and both are appended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.ingest import Table, split

INPUT = "labels map<string,string>, ts long, value double, is_stale boolean"


def start(
    spark: SparkSession, source: str, table: Table, checkpoint: str, every: str | None = "5 seconds", files_per_batch: int = 10, fmt: str = "json"
) -> StreamingQuery:
    """Run the stream; every=None takes what is there and ends."""
    stream = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(source)

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            table.write(*split(batch))
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return writer.start()


def rolling(stream: DataFrame, width: str = "5 minutes", late: str = "24 hours") -> DataFrame:
    """min, max, sum and count of each series and window of a stream (metric_name, series_id, ts, value); windows close `late` after their end."""
    timed = stream.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "metric_name", "series_id").agg(
        F.min("value").alias("val_min"), F.max("value").alias("val_max"), F.sum("value").alias("val_sum"), F.count(F.lit(1)).alias("val_count")
    )
