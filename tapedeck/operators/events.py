"""From player polls to classified plays, and the context in force at each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

JITTER_MS = 5000
LEAST_MS = 5000


def derive_play_events(polls: DataFrame, *, reconcile: bool = True, by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Runs of playing polls of one track whose progress doesn't fall by over JITTER_MS; each ends at the next poll.

    Runs under LEAST_MS and open last runs give no event. completed: 0.8 of the duration or more (without one, over
    60 s); replayed: the track began anew; else abandoned. `reconcile` drops an abandoned event that the same track follows.
    """
    order = Window.partitionBy(*by).orderBy("observed_at", "poll_id")

    def before(c: str):
        return F.lag(c).over(order)

    on = F.col("is_playing") & F.col("track_id").isNotNull()
    fell = F.coalesce(F.col("progress_ms") < before("progress_ms") - JITTER_MS, F.lit(False))
    same = F.coalesce(before("is_playing") & (before("track_id") == F.col("track_id")), F.lit(False))
    p = polls.withColumns({"on": on, "new": (~(on & same) | fell).cast("int"), "next_at": F.lead("observed_at").over(order), "next_track": F.lead("track_id").over(order), "next_progress": F.lead("progress_ms").over(order)})
    p = p.withColumn("segment", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("on")
    last = F.max_by(F.struct("progress_ms", "duration_ms", "next_at", "next_track", "next_progress"), F.struct("observed_at", "poll_id"))
    e = p.groupBy(*by, "segment").agg(F.min("observed_at").alias("started_at"), F.min_by("track_id", F.struct("observed_at", "poll_id")).alias("track_id"), last.alias("last"))
    e = e.select(*by, "track_id", "started_at", F.col("last.*")).withColumnRenamed("next_at", "ended_at")
    listened = F.expr("(unix_micros(ended_at) - unix_micros(started_at)) div 1000")
    played = F.coalesce(F.col("progress_ms"), F.lit(0)) / F.col("duration_ms")
    ended = F.when(F.col("duration_ms") > 0, played >= 0.8).otherwise(F.col("duration_listened_ms") > 60_000)
    again = F.coalesce((F.col("next_track") == F.col("track_id")) & (F.col("next_progress") < F.col("progress_ms") - JITTER_MS), F.lit(False))
    e = e.withColumn("duration_listened_ms", listened).where(F.col("duration_listened_ms") >= LEAST_MS)
    e = e.withColumn("classification", F.when(again, "replayed").when(ended, "completed").otherwise("abandoned"))
    if reconcile:
        follows = F.lead("track_id").over(Window.partitionBy(*by).orderBy("ended_at", "started_at"))
        e = e.withColumn("follows", follows).where((F.col("classification") != "abandoned") | F.col("follows").isNull() | (F.col("follows") != F.col("track_id")))
    local = F.from_utc_timestamp("started_at", "America/New_York")
    return e.select(*by, "track_id", "started_at", "ended_at", "duration_listened_ms", F.when(F.col("duration_ms") > 0, F.col("duration_ms")).alias("track_duration_ms"), "classification", F.hour(local).alias("hour_of_day"), (F.dayofweek(local) - 1).alias("day_of_week"))


def as_of_join(left: DataFrame, right: DataFrame, *, left_ts: str, right_ts: str, take: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """left with the columns `take` of the latest right row at or before it, null where there is none.

    Without `by`, time is cut into days and each day starts from the last right row before it, so that no task holds all rows.
    """
    day = F.col("at").cast("date")
    tagged = left.withColumns({"at": F.col(left_ts), "found": F.lit(None).cast(right.select(F.struct(*take)).schema[0].dataType), "side": F.lit(1)})
    other = right.select(F.col(right_ts).alias("at"), *by, F.struct(*take).alias("found"), F.lit(0).alias("side"))
    rows = tagged.unionByName(other, allowMissingColumns=True).withColumn("day", day)
    # one row a day and key: small enough for one running window each
    days = rows.groupBy(*by, "day").agg(F.max_by("found", F.when(F.col("side") == 0, F.struct("at", "found"))).alias("closing"))
    running = Window.partitionBy(*by).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*by, "day", F.last("closing", ignorenulls=True).over(running).alias("opening"))
    within = Window.partitionBy(*by, "day").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("found", F.last("found", ignorenulls=True).over(within)).where("side = 1")
    return rows.join(days, [*by, "day"], "left").select(*left.columns, *[F.coalesce("found", "opening")[c].alias(c) for c in take])


DIMENSIONS = ("daylight_phase", "weather_condition", "location_label")


def context_affinity(linked: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, least: int = 10) -> DataFrame:
    """How much likelier a track is in a bucket than anything is: shrunk to 1 below ten plays, within 0.5 to 2.

    Bucket totals count all linked events, track counts only completed and replayed ones; no rows below `least` events.
    """
    long = linked.select("track_id", F.col("classification").isin("completed", "replayed").alias("done"), F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("bucket")) for d in dimensions])).alias("x")).select("track_id", "done", "x.*").where("bucket is not null")
    cells = long.groupBy("track_id", "dimension", "bucket").agg(F.sum(F.col("done").cast("int")).alias("sample_size"), F.count("*").alias("rows"))
    buckets = cells.groupBy("dimension", "bucket").agg(F.sum("rows").alias("in_bucket"))
    tracks = linked.groupBy("track_id").agg(F.sum(F.col("classification").isin("completed", "replayed").cast("int")).alias("of_track"), F.count("*").alias("rows"))
    total = tracks.agg(F.sum("rows").alias("total"))
    lift = (F.col("sample_size") / F.col("of_track")) / (F.col("in_bucket") / F.col("total"))
    shrunk = 1 + (lift - 1) * F.least(F.lit(1.0), F.col("sample_size") / 10)
    out = cells.drop("rows").where("sample_size > 0").join(buckets, ["dimension", "bucket"]).join(tracks.drop("rows"), "track_id").join(F.broadcast(total), how="cross")
    return out.where(F.col("total") >= least).select("track_id", "dimension", "bucket", F.round(F.greatest(F.lit(0.5), F.least(F.lit(2.0), shrunk)), 6).alias("affinity"), "sample_size")


def top_affinities(affinities: DataFrame, *, least: int = 5, beyond: float = 0.1, n: int = 5) -> DataFrame:
    """The strongest affinities of each bucket."""
    strong = affinities.where((F.col("sample_size") >= least) & (F.abs(F.col("affinity") - 1) > beyond))
    rank = F.row_number().over(Window.partitionBy("dimension", "bucket").orderBy(F.desc("affinity"), F.desc("sample_size"), "track_id"))
    return strong.withColumn("rank", rank).where(F.col("rank") <= n)


#: All dimensions of a snapshot that affinities may be learned for; DIMENSIONS are those of the test tables' snapshots.
ALL_DIMENSIONS = (*DIMENSIONS, "device_type", "day_of_week", "calendar_category")


def add_context_columns(df: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """daylight_phase from at, sunrise and sunset (timestamps), or from the local hour of at where one of those is null, and
    condition from weather_code (WMO)."""
    t, rise, fall = (F.unix_timestamp(c) for c in ("at", "sunrise", "sunset"))
    phase = F.when(t < rise - 3600, "night").when(t < rise, "pre_dawn").when(t < rise + 10800, "morning").when(t < fall - 3600, "midday").when(t < fall, "golden_hour").when(t < fall + 1800, "dusk").otherwise("night")
    hour = F.hour(F.from_utc_timestamp("at", zone))
    by_hour = F.when(hour < 6, "night").when(hour < 8, "pre_dawn").when(hour < 11, "morning").when(hour < 17, "midday").when(hour < 19, "golden_hour").when(hour < 20, "dusk").otherwise("night")
    phase = F.when(t.isNotNull() & (rise.isNull() | fall.isNull()), by_hour).otherwise(phase)
    c = F.col("weather_code")
    sky = F.when(c == 0, "clear").when(c <= 3, "partly_cloudy").when(c <= 48, "fog").when(c <= 57, "overcast").when(c <= 67, "rain").when(c <= 77, "snow").when(c <= 82, "rain").when(c <= 86, "snow").when(c >= 95, "thunderstorm").otherwise("overcast")
    return df.withColumns({"daylight_phase": phase, "condition": sky})


OUTCOMES = ("completed", "abandoned", "replayed", "skipped")


def _outcomes():
    return [F.sum((F.col("classification") == o).cast("int")).alias(o) for o in OUTCOMES]


def event_stats(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Outcome counts and the skip rate, in which abandoned listens, neither skipped nor completed, don't count."""
    out = events.groupBy(*by).agg(F.count("*").alias("events"), *_outcomes())
    counted = F.col("events") - F.col("abandoned")
    return out.withColumn("skip_rate", F.when(counted > 0, F.round(F.col("skipped") / counted, 6)))


def track_play_stats(events: DataFrame) -> DataFrame:
    e = events.groupBy("track_id").agg(F.count("*").alias("play_count"), *_outcomes(), F.max("ended_at").alias("last_played"))
    return e.drop("abandoned")


def artist_play_stats(events: DataFrame) -> DataFrame:
    """Plays and different tracks of every credited artist."""
    return events.select("track_id", F.explode(F.array_distinct("artist_ids")).alias("artist_id")).groupBy("artist_id").agg(F.count("*").alias("plays"), F.countDistinct("track_id").alias("tracks"))


def artist_taste(stats: DataFrame) -> DataFrame:
    """Artist scores from plays and tracks; rank memberships may stand in boolean columns top_short, top_medium, top_long, followed."""
    def member(c: str, weight: int):
        return F.when(F.col(c), weight).otherwise(0) if c in stats.columns else F.lit(0)

    score = member("top_short", 5) + member("top_medium", 3) + member("top_long", 2) + member("followed", 2)
    score = score + F.log2(1 + F.col("plays")) * 0.5 + F.least("tracks", F.lit(10)) * 0.3
    return stats.withColumn("score", F.floor(score * 100 + 0.5) / 100)


def track_taste(stats: DataFrame, *, as_of: str) -> DataFrame:
    """Track scores from outcomes, with a bonus that fades over 30 days; flags may stand in boolean columns."""
    days = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("last_played")) / 86400
    score = F.log2(1 + F.col("play_count")) * 0.5 - F.col("skipped") * 1.5 + F.col("completed") * 0.3 + F.col("replayed") * 2
    for c, weight in (("liked", 3), ("top_short", 5), ("top_medium", 3), ("top_long", 2), ("current_season", 3)):
        if c in stats.columns:
            score = score + F.when(F.col(c), weight).otherwise(0)
    if "seasonal_playlists" in stats.columns:
        score = score + F.coalesce("seasonal_playlists", F.lit(0)) * 1.5
    if "artist_score" in stats.columns:
        score = score + F.coalesce("artist_score", F.lit(0.0)) * 0.3
    score = score + F.when(days < 30, 2 * (1 - days / 30)).otherwise(0)
    return stats.withColumn("score", F.floor(score * 100 + 0.5) / 100)


def session_performance(events: DataFrame) -> DataFrame:
    """Outcomes of each agent session, with the share that was heard to the end or again."""
    out = event_stats(events.where("session_id is not null"), ("session_id",))
    return out.withColumn("success", F.round((F.col("completed") + F.col("replayed")) / F.col("events"), 6))


def calibration(events: DataFrame, scores: DataFrame) -> DataFrame:
    """Outcomes by tier of the tracks' scores."""
    tier = F.when(F.col("score") >= 10, "high").when(F.col("score") >= 5, "medium").when(F.col("score") > 0, "low").otherwise("none")
    return event_stats(events.join(scores.select("track_id", tier.alias("tier")), "track_id"), ("tier",))


def daily_summary(events: DataFrame, *, as_of: str, hours: int = 24) -> DataFrame:
    """Outcomes and minutes of the hours up to as_of."""
    end = F.lit(as_of).cast("timestamp")
    recent = events.where((F.col("ended_at") < end) & (F.col("ended_at") >= end - F.make_dt_interval(F.lit(0), F.lit(hours))))
    return recent.agg(F.count("*").alias("events"), *[F.coalesce(c, F.lit(0)).alias(o) for c, o in zip(_outcomes(), OUTCOMES, strict=True)], F.floor(F.coalesce(F.sum("duration_listened_ms"), F.lit(0)) / 60000).alias("minutes"), F.countDistinct("track_id").alias("tracks"))


def recent_history(events: DataFrame, scores: DataFrame, n: int = 50) -> DataFrame:
    """The latest n events with their track's score."""
    latest = events.orderBy(F.desc("ended_at"), F.desc("event_id")).limit(n)
    return latest.join(scores.select("track_id", "score").dropDuplicates(["track_id"]), "track_id", "left").select("event_id", "ended_at", "track_id", "classification", "session_id", "score")


def context_maturity(affinities: DataFrame, least: int = 5) -> DataFrame:
    """For each dimension the buckets seen, those with a track of enough samples, and the mean sample size."""
    trained = F.countDistinct(F.when(F.col("sample_size") >= least, F.col("bucket")))
    return affinities.groupBy("dimension").agg(F.countDistinct("bucket").alias("buckets"), trained.alias("trained"), F.round(F.avg("sample_size"), 6).alias("mean_samples"))


def top_tracks(events: DataFrame, n: int = 10) -> DataFrame:
    """Tracks with most completed or replayed events."""
    good = events.where(F.col("classification").isin("completed", "replayed")).groupBy("track_id").agg(F.count("*").alias("plays"))
    return good.orderBy(F.desc("plays"), "track_id").limit(n)
