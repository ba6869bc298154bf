"""Event-time operators; each works on a batch and on a stream with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str) -> DataFrame:
    g = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
    return g.select(F.col("w.start").alias("win_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    g = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("win_start"), "n")
