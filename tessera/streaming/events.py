"""Structured Streaming forms of the replay-safe event import and of event statistics (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def once(events: DataFrame, key: str = "event_id", at: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each event once, within the watermark; the state holds ids no longer than that."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, *, at: str = "ts", width: str = "1 day", delay: str = "1 hour", key: str = "event_type", value: str = "value") -> DataFrame:
    """Count and sum per window and key; late events beyond the watermark are dropped."""
    w = events.withWatermark(at, delay).groupBy(F.window(at, width), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("window.start").alias("window_start"), key, "n", "total")


def follow(spark: SparkSession, path: str) -> DataFrame:
    """Appended log files as a stream of lines."""
    return spark.readStream.text(path)


def run_to(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what is there into Parquet files, each row once however often this is called, and return them as a table."""
    q = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there and return it as a table."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
