"""Sessions: plays of one listener without a longer gap between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sessionize(plays: DataFrame, *, gap_minutes: int = 30, by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Start, end, plays and minutes of each session; a gap of just gap_minutes doesn't end one."""
    order = Window.partitionBy(*by).orderBy("ts", "play_id")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order))
    started = plays.withColumn("new", F.coalesce(gap > gap_minutes * 60_000_000, F.lit(True)).cast("int"))
    numbered = started.withColumn("session", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "session").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("plays"), F.round(F.sum("minutes"), 4).alias("minutes"))
