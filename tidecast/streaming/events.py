"""Streaming extension: windowed counts and sessions over an event stream, with watermarks for late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, ts: str = "ts", length: str = "1 day", slide: str | None = None, late: str | None = "1 hour", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """(start, by, n, total) per tumbling or sliding window; works on batches and, under a watermark, on streams."""
    if events.isStreaming and late:
        events = events.withWatermark(ts, late)
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return events.groupBy(w, *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", ts: str = "ts", by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """(by, start, end, n) of bursts without a pause longer than the gap."""
    return events.groupBy(*by, F.session_window(ts, gap)).agg(F.count("*").alias("n")).select(*by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def run_once(counts: DataFrame, path: str, checkpoint: str) -> None:
    """Drains what is there into a Parquet sink, exactly once under the checkpoint."""
    counts.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
