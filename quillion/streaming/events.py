"""Windowed counts over a stream of events; the batch form gives what the stream ends with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their value by type and window; events later than ``late`` no longer count in a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    counts = timed.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("cnt"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("window_start"), "event_type", "cnt", "total")


def stream_files(spark: SparkSession, path: str, files_a_batch: int = 10) -> DataFrame:
    """A stream over a folder of Parquet files, with the schema of those that are there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)
