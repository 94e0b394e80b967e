"""Freshness and review queues over streams (extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexweave.operators.freshness import compare


def watch_snapshots(stream: DataFrame, stored: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Compares each micro-batch of snapshots with the stored manifest and
    appends the changes; a batch is written under its own id, so a retried
    batch replaces what it wrote."""

    def handle(batch: DataFrame, number: int) -> None:
        compare(batch.select("name"), batch, stored).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_counts(stream: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Tumbling counts per event type with a watermark for late rows."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
