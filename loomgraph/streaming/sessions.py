"""Event sessions in batch, and the same gap rule as a stream with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions(events: DataFrame, minutes: int = 30) -> DataFrame:
    """Numbered sessions per user; the window sorts one user's events, which spills."""
    order = Window.partitionBy("user_id").orderBy("ts")
    gap = F.col("ts") - F.lag("ts").over(order)
    marked = events.withColumn("new", F.when(gap <= F.expr(f"INTERVAL {minutes} MINUTE"), 0).otherwise(1))
    grouped = marked.withColumn("session", F.sum("new").over(order))
    return grouped.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


def session_stream(stream: DataFrame, minutes: int = 30, late: str = "1 hour") -> DataFrame:
    """The streaming form: session windows per user, state dropped once the watermark passes."""
    window = F.session_window("ts", f"{minutes} minutes")
    return stream.withWatermark("ts", late).groupBy("user_id", window.alias("w")).agg(F.count(F.lit(1)).alias("events")).select("user_id", "w.start", "w.end", "events")
