"""Activity per project over time; the same columns serve batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_event_time(df: DataFrame, col: str, delay: str | None = None) -> DataFrame:
    """Zone-less times as UTC instants, with a watermark on streams."""
    timed = df.withColumn(col, F.col(col).cast("timestamp"))
    return timed.withWatermark(col, delay) if delay else timed


def activity_windows(df: DataFrame, time: str, size: str, slide: str | None = None) -> DataFrame:
    """Items per project and kind in tumbling or sliding windows."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return df.groupBy("project_id", "kind", window.alias("w")).agg(F.count(F.lit(1)).alias("items")).select(
        "project_id", "kind", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "items"
    )


def activity_sessions(df: DataFrame, time: str, gap: str) -> DataFrame:
    """Work sessions of a project: activity without a pause of ``gap``, with its snapshots."""
    return df.groupBy("project_id", F.session_window(time, gap).alias("w")).agg(
        F.max(time).alias("ended_at"),
        F.count_if(F.col("kind") == "snapshot").alias("snapshot_count"),
        F.count(F.lit(1)).alias("items"),
    ).select("project_id", F.col("w.start").alias("started_at"), "ended_at", "snapshot_count", "items")


def drop_replays(stream: DataFrame, id: str, time: str, delay: str) -> DataFrame:
    """Drop events whose id was already seen within ``delay``."""
    return with_event_time(stream, time, delay).dropDuplicatesWithinWatermark([id])
