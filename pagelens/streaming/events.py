"""Streaming over progress events: profiles of stages and quiet periods.

The events are append-only; a watermark bounds what is kept for late ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ts TIMESTAMP, event STRING, stage STRING, capture_id STRING, seconds DOUBLE, error STRING"


def read_progress(spark: SparkSession, path: str, schema: str = SCHEMA, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the JSON lines that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def stage_windows(events: DataFrame, *, ts: str = "ts", stage: str = "stage", seconds: str = "seconds", window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Runs, total and mean seconds of each stage in each window. Works on streams and on tables."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, window), F.col(stage)).agg(F.count("*").alias("runs"), F.sum(seconds).alias("total"), F.avg(seconds).alias("mean"))
    return counted.select(F.col("window.start").alias("start"), F.col(stage).alias("stage"), "runs", "total", "mean")


def quiet_periods(events: DataFrame, key: str, *, ts: str = "ts", gap: str = "30 minutes", late: str = "5 minutes") -> DataFrame:
    """Bursts of events of a key that a pause of at least gap ends: begin, end and number."""
    found = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), F.col(key)).agg(F.count("*").alias("events"), F.max(ts).alias("last"))
    return found.select(key, F.col("session_window.start").alias("begin"), "last", "events")


def write(stream: DataFrame, path: str, checkpoint: str, *, mode: str = "append", available_now: bool = True):
    """Starts a query that writes Parquet and stops when all that is there has been read."""
    writer = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
