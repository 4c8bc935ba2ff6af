"""What is still to be looked up, and how far lookups have come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing(plays: DataFrame, known: DataFrame, key: str = "uri", retry: tuple[str, ...] = ()) -> DataFrame:
    """Played recordings that `known` doesn't have, or has with a status to be tried again, the most played first."""
    done = known.where(~F.col("status").isin(*retry)) if retry else known
    return plays.groupBy(key).agg(F.count("*").alias("plays")).join(done.select(key).distinct(), key, "left_anti").orderBy(F.desc("plays"), key)


def seed_queue(plays: DataFrame, known: DataFrame, least: int = 2) -> DataFrame:
    """Recordings heard to their end so many times that have no status yet."""
    done = plays.where("reason_end = 'trackdone'").groupBy("uri").agg(F.count("*").alias("completed")).where(F.col("completed") >= least)
    return done.join(known.select("uri").distinct(), "uri", "left_anti")


def obsession_tier(plays: DataFrame, scores: DataFrame, lyrics: DataFrame, *, top: int = 500, least: int = 10) -> DataFrame:
    """The best scored recordings and those played often, as far as their lyrics are there (uri, status: ok)."""
    often = plays.groupBy("uri").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("uri")
    tier = scores.orderBy(F.desc("score"), "uri").limit(top).select("uri").union(often).distinct()
    return tier.join(lyrics.where("status = 'ok'").select("uri").distinct(), "uri", "left_semi")


def coverage_report(plays: DataFrame, known: DataFrame) -> DataFrame:
    """Played recordings by status of a lookup (`none` without one), with their share."""
    n = plays.select("uri").distinct().join(known.select("uri", "status"), "uri", "left").groupBy(F.coalesce("status", F.lit("none")).alias("status")).agg(F.count("*").alias("recordings"))
    return n.join(F.broadcast(n.agg(F.sum("recordings").alias("total"))), how="cross").select("status", "recordings", F.round(F.col("recordings") / F.col("total"), 6).alias("share"))


def top_credits(plays: DataFrame, credits: DataFrame) -> DataFrame:
    """Plays of what each person is credited for in each role."""
    counts = plays.groupBy("uri").agg(F.count("*").alias("n"))
    return credits.select("uri", "person", "role").distinct().join(counts, "uri").groupBy("person", "role").agg(F.sum("n").alias("plays"))


def pool_by_source(pool: DataFrame) -> DataFrame:
    """Rows by status and mean score of each source of a pool."""
    kinds = ("fresh", "played", "liked", "skipped", "expired")
    return pool.groupBy("source").agg(F.count("*").alias("total"), *[F.sum((F.col("status") == k).cast("int")).alias(k) for k in kinds], F.round(F.avg("score"), 6).alias("mean_score"))


def audio_queue(taste: DataFrame, features: DataFrame, *, as_of: str, days: int = 30, n: int = 50) -> DataFrame:
    """The best-liked tracks (track_id, score) to fetch features (track_id, found, fetched_at) of: never fetched, or not found
    more than `days` days ago."""
    t = taste.join(features.select("track_id", "found", "fetched_at"), "track_id", "left")
    again = ~F.col("found") & (F.col("fetched_at") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))
    return t.where(F.col("found").isNull() | again).select("track_id", "score").orderBy(F.desc("score"), "track_id").limit(n)
