"""Streams of plays; each function takes and returns a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapedeck.functions.columns import is_skip


def stream_plays(plays: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Each (ts, uri) once, however often it arrives within the watermark."""
    return plays.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["ts", "uri"])


def stream_rolling(plays: DataFrame, size: str = "7 days", slide: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Plays and skip rate of each window."""
    out = plays.withWatermark("ts", watermark).groupBy(F.window("ts", size, slide)).agg(F.count("*").alias("plays"), F.round(F.avg(is_skip(F.col("reason_end")).cast("int")), 6).alias("skip_rate"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "plays", "skip_rate")


def stream_sessions(plays: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour", by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Start, plays and minutes of each listener's sessions."""
    out = plays.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap), *by).agg(F.count("*").alias("plays"), F.round(F.sum("minutes"), 4).alias("minutes"))
    return out.select(*by, F.col("session_window.start").alias("started_at"), "plays", "minutes")
