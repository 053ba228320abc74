"""Windowed counts over event streams. The same transformation runs over a batch and over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _marked(events: DataFrame, ts: str, late: str) -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events


def counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes", ts: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """(start, kind, n, total) per tumbling window; on a stream, events later than the watermark are left out."""
    out = _marked(events, ts, late).groupBy(F.window(ts, length).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", ts: str = "ts", user: str = "user_id") -> DataFrame:
    """(user, start, end, n): runs of a user's events with no gap as long as ``gap``."""
    out = _marked(events, ts, late).groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count("*").alias("n"))
    return out.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def follow(spark: SparkSession, folder: str, schema, out: str, checkpoint: str, length: str = "1 hour"):
    """Start a query that appends closed windows of the files arriving in a folder to a table; ends when all is read."""
    stream = counts(spark.readStream.schema(schema).parquet(folder), length)
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
