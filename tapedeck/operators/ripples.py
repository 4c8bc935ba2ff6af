"""What is heating up: recordings played much in two weeks for how often they were played at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapedeck.functions.columns import js_round
from tapedeck.sources.shared import cut

DAY = 86400


def ripple_scores(plays: DataFrame, *, as_of: str, n: int = 10) -> DataFrame:
    """The n recordings with the highest (3 x last 3 days + 2 x days 4-7 + days 8-14) / (lifetime + 3), rounded before ranking."""
    end = F.unix_timestamp(F.lit(as_of).cast("timestamp"))
    days = (end - F.unix_timestamp("ts")) / DAY
    inside = days <= 14
    weight = F.when(days <= 3, 3.0).when(days <= 7, 2.0).when(inside, 1.0).otherwise(0.0)
    r = plays.where(days >= 0).groupBy("uri", "artist_name").agg(
        F.count("*").alias("lifetime"),
        F.sum(weight).alias("weighted"),
        F.sum(inside.cast("int")).alias("in_window"),
        F.min("ts").alias("first_play"),
        F.max("ts").alias("last_play"),
        F.max(F.when(~inside, F.col("ts"))).alias("last_before"),
    )
    r = r.where("in_window > 0").withColumn("score", js_round(F.col("weighted") / (F.col("lifetime") + 3), 2))
    return r.orderBy(F.desc("score"), F.desc("last_play"), "uri").limit(n)


def familiarity(plays: DataFrame, ripples: DataFrame, *, as_of: str) -> DataFrame:
    """ripples with familiarity: 62.5 % the artist's and 37.5 % the track's percentile among plays before the window; 50 with none, 0 for a new one."""
    before = plays.where(F.unix_timestamp("ts") < F.unix_timestamp(F.lit(as_of).cast("timestamp")) - 14 * DAY)
    # plays are read once for both keys, their counts and totals
    played = cut(before.groupBy("uri", "artist_name").agg(F.count("*").alias("n")))
    out = ripples
    for key, name in (("artist_name", "artist"), ("uri", "track")):
        counts = played.groupBy(key).agg(F.sum("n").alias("n"))
        # how many keys have so many plays or fewer, from one row for each number of plays; the ripples are few
        hist = counts.groupBy("n").agg(F.count("*").alias("keys"))
        mine = out.select(key).distinct().join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias(f"{name}_before"))
        ranks = F.broadcast(mine).join(hist, F.col("n") <= F.col(f"{name}_before"), "left").groupBy(key, f"{name}_before").agg(F.coalesce(F.sum("keys"), F.lit(0)).alias("less"))
        total = hist.agg(F.coalesce(F.sum("keys"), F.lit(0)).alias("total"))
        ranks = ranks.join(F.broadcast(total), how="cross").select(key, f"{name}_before", F.when(F.col("total") > 0, F.col("less") / F.col("total") * 100).otherwise(50.0).alias(f"{name}_percentile"))
        out = out.join(F.broadcast(ranks), key)
    score = js_round(F.col("artist_percentile") * 0.625 + F.col("track_percentile") * 0.375)
    return out.withColumn("familiarity", score).drop("artist_percentile", "track_percentile")


def split_ripples(ripples: DataFrame, *, as_of: str) -> DataFrame:
    """Marks new arrivals (first played at most 21 days ago) and returning waves."""
    cutoff = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - 21 * DAY
    return ripples.withColumn("wave", F.when(F.unix_timestamp("first_play") >= cutoff, "new arrival").otherwise("returning"))


def ripple_facts(ripples: DataFrame, *, as_of: str) -> DataFrame:
    """The first true of five facts on each ripple, and how well the artist was known."""
    end = F.unix_timestamp(F.lit(as_of).cast("timestamp"))
    years = F.floor((end - F.unix_timestamp("last_before")) / DAY / 365)
    weeks = F.greatest(F.lit(1.0), (end - 14 * DAY - F.unix_timestamp("first_play")) / (7 * DAY))
    rate = F.when(F.col("track_before") > 0, F.col("track_before") / weeks).otherwise(0.0)
    gone = (end - F.unix_timestamp("last_before")) / DAY > 365
    fact = (
        F.when(F.col("artist_before") == 0, F.concat(F.lit("first time hearing "), "artist_name"))
        .when(F.col("track_before") <= 2, F.concat(F.lit("new from "), "artist_name"))
        .when(gone, F.concat(F.lit("returning after "), years, F.when(years == 1, " year").otherwise(" years")))
        .when((rate > 0) & (F.col("in_window") >= 5 * rate), F.concat("in_window", F.lit(" plays this week, "), "track_before", F.lit(" before")))
        .otherwise(F.concat("in_window", F.lit(" plays in the last two weeks")))
    )
    known = F.when(F.col("artist_before") == 0, "brand new").when(F.col("artist_before") < 50, "trace history").otherwise("established")
    return ripples.withColumns({"fact": fact, "relationship": known})


#: Phrases that a fact must not hold.
BLOCKED = ("you'?re really into", "great pick", "trending now", "on repeat", "can'?t stop listening", "obsessed with", "banger", "slaps", "fire", "vibes")


def validate_facts(df: DataFrame, column: str, *, words: int = 12, chars: int = 80) -> DataFrame:
    """df with `reason`: why a fact isn't fit to be shown, null if it is."""
    c = F.col(column)
    reason = (
        F.when(F.size(F.split(F.trim(c), r"\s+")) > words, "too many words")
        .when(F.length(c) > chars, "too long")
        .when(c.rlike('["“”]'), "contains quotation marks")
        .when(c.rlike(r"[\x{1F600}-\x{1F9FF}\x{2600}-\x{27BF}]"), "contains emoji")
        .when(c.rlike(r"[!?;:,]\s*$"), "bad trailing punctuation")
        .when(c.rlike("(?i)" + "|".join(BLOCKED)), "blocked phrase")
    )
    return df.withColumn("reason", reason)
