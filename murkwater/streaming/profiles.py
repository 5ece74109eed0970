"""Incremental profiles of a growing table (an extension): counts by column and class, batch by batch.

Each micro-batch is reduced to one row for each value of a group and window and appended under its batch
number, so a batch that is run again after a failure replaces its own rows and totals stay right.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(events: DataFrame, time: str, group: str, value: str, length: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Streaming or batch: (start, group, n, missing, total) by tumbling window; events later than ``late`` are left out of streams."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    grouped = rows.groupBy(F.window(time, length).alias("w"), F.col(group).alias("group"))
    return grouped.agg(F.count("*").alias("n"), F.count_if(F.col(value).isNull()).alias("missing"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), "group", "n", "missing", "total")


def incremental(events: DataFrame, group: str, value: str, path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that writes each micro-batch's partial profile to ``path/batch=<number>`` and ends when the source is read."""

    def save(batch: DataFrame, number: int) -> None:
        partial = batch.groupBy(F.col(group).alias("group")).agg(F.count("*").alias("n"), F.count_if(F.col(value).isNull()).alias("missing"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))
        partial.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark: SparkSession, path: str) -> DataFrame:
    """(group, n, missing, total, least, most) of all batches so far."""
    parts = spark.read.parquet(path)
    return parts.groupBy("group").agg(F.sum("n").alias("n"), F.sum("missing").alias("missing"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))
