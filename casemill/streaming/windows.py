"""Event-time windows; the same expressions serve batch frames and streams with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def late_bound(rows: DataFrame, ts: str, delay: str) -> DataFrame:
    return rows.withWatermark(ts, delay) if rows.isStreaming else rows


def tumbling(events: DataFrame, size: str = "1 hour", *, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    w = F.window(ts, size)
    return late_bound(events, ts, delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "1 hour", slide: str = "30 minutes", *, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    return late_bound(events, ts, delay).groupBy(F.window(ts, size, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", *, ts: str = "ts", key: str = "user_id", delay: str = "10 minutes") -> DataFrame:
    return late_bound(events, ts, delay).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def read_events(spark, folder: str, schema) -> DataFrame:
    """A stream over Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def write_append(rows: DataFrame, folder: str, checkpoint: str, mode: str = "append"):
    """Starts the stream with all that is there and ends when it is done."""
    return rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
