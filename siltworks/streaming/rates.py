"""Windowed rates: one definition for batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_rate(events: DataFrame, ts: str, key: str, width: str, seconds: int, late: str | None = None) -> DataFrame:
    """Rows and rate of each key and tumbling window; on a stream ``late`` is the watermark's delay."""
    at = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if events.isStreaming and late:
        at = at.withWatermark("_ts", late)
    each = at.groupBy(F.window("_ts", width).alias("w"), F.col(key)).agg(F.count("*").alias("n"))
    return each.select(F.col("w.start").alias("start"), key, "n", F.round(F.col("n") / seconds, 9).alias("rate"))


