"""Streams of log events: a date-partitioned sink, daily compaction, watermarked buckets."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_events(stream: DataFrame, root: str, checkpoint: str, once: bool = False) -> Any:
    """Appends a stream of events to a log with one directory a day."""
    out = stream.withColumn("date", F.to_date("ts")).writeStream.format("parquet").partitionBy("date").option("path", root).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime="5 seconds")).start()


def compact_day(spark: SparkSession, root: str, day: str, out: str, files: int = 1) -> None:
    """A day's files as few files in time order."""
    events = spark.read.parquet(root).where(F.col("date") == F.to_date(F.lit(day))).drop("date")
    events.repartitionByRange(files, "ts").sortWithinPartitions("ts").write.mode("overwrite").parquet(out)


def bucket_counts(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) in tumbling windows of a stream; the timestamp is cast, since
    watermarks take no zoneless ones."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
