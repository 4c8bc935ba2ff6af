"""Why the tracks of planned sessions were picked, which of them won, and which signals tell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapedeck.functions.columns import js_round

GOOD = ("completed", "replayed")


def _one(df: DataFrame, key: str, **columns: str) -> DataFrame:
    """The named columns of one row of each key."""
    return df.dropDuplicates([key]).select(key, *[F.col(c).alias(a) for a, c in columns.items()])


def session_explain(sessions: DataFrame, session_tracks: DataFrame, taste: DataFrame, pool: DataFrame, snapshots: DataFrame, observed: DataFrame, fits: DataFrame) -> DataFrame:
    """Every track of every session with its name, score, acoustic fit, a note on it, and an array of reasons in order.

    sessions: session_id, mode, snapshot_id (or null). session_tracks: session_id, position, track_id, source (familiar, or
    where it was found), outcome. taste: track_id, track_name, score and the signals read below. pool: track_id,
    track_name, source_detail, score. snapshots: snapshot_id, weather_condition, daylight_phase. observed: track_id and
    track_name of polls. fits: track_id, fits (`acoustics.mode_fits`). Positions count from 1 in the result. Tracks of
    sessions that aren't there have no rows; signals that are null don't hold; of repeated keys on the right any row counts.

    A name is that of the taste row, for new tracks else that of the pool, else the first observed one, else the id.
    """
    around = _one(snapshots, "snapshot_id", weather="weather_condition", phase="daylight_phase")
    of = _one(sessions, "session_id", mode="mode", snapshot_id="snapshot_id").join(around, "snapshot_id", "left")
    t = taste.dropDuplicates(["track_id"]).select("track_id", F.struct(*[c for c in taste.columns if c != "track_id"]).alias("t"))
    p = _one(pool, "track_id", p_name="track_name", detail="source_detail", p_score="score")
    seen = observed.where("track_name is not null").groupBy("track_id").agg(F.min("track_name").alias("seen"))
    rows = session_tracks.select("session_id", "position", "track_id", "source", "outcome").join(of, "session_id")
    for side in (t, p, seen, fits):
        rows = rows.join(side, "track_id", "left")

    def when(condition, reason):
        return F.when(condition, reason if not isinstance(reason, str) else F.lit(reason))

    plays, ends, lists, now = F.col("t.play_count"), F.col("t.complete_count"), F.col("t.seasonal_playlist_count"), F.coalesce("t.current_season_present", F.lit(False))
    signals = F.array_compact(F.array(
        when(F.col("t.in_top_tracks_short"), "In your current top tracks"),
        when(F.col("t.in_top_tracks_medium"), "In your medium-term top tracks"),
        when(F.col("t.in_top_tracks_long"), "In your long-term top tracks"),
        when(F.col("t.in_liked_songs"), "In your liked songs"),
        when(now, "In your current season playlist"),
        when((lists > 0) & ~now, F.concat(F.lit("In "), lists, F.lit(" seasonal playlist(s)"))),
        when(plays > 3, F.concat(F.lit("Played "), plays, F.lit(" times"))),
        when(ends > 2, F.concat(F.lit("Completed "), ends, F.lit(" times (low skip)"))),
    ))
    signals = F.when(F.col("t").isNull(), F.array(F.lit("Familiar track"))).when(F.size(signals) == 0, F.array(F.lit("Matches your taste profile"))).otherwise(signals)
    told = F.when(F.col("detail") != "", F.concat(F.lit("Discovery: "), F.col("detail"))).otherwise("Fresh discovery")
    found = F.array(told, F.concat(F.lit("Predicted fit score: "), F.coalesce(F.col("p_score").cast("decimal(18, 1)").cast("string"), F.lit("?"))))
    mood = F.array_compact(F.array(when(F.col("weather").isin("rain", "overcast"), F.concat(F.lit("Weather bias: "), F.col("weather"))), when((F.col("phase") == "night") & (F.col("mode") == "unwinding"), "Night unwinding: comfort pick")))
    familiar = F.coalesce(F.col("source") == "familiar", F.lit(False))
    name = F.coalesce("t.track_name", F.when(~familiar, F.col("p_name")))
    fit, way = F.col("f.fit"), F.concat(F.when(F.col("f.above"), "High ").when(~F.col("f.above"), "Low "), F.col("f.dominant"))
    note = F.when(fit > 1.1, F.concat(way, F.lit(" match for "), F.col("mode"))).when(fit < 0.9, F.concat(way, F.lit(" for "), F.col("mode")))
    rows = rows.withColumn("f", F.col("fits")[F.col("mode")])
    return rows.select(
        "session_id", (F.col("position") + 1).alias("position"), "track_id", F.coalesce(F.when(name != "", name), "seen", "track_id").alias("track_name"), "source", "outcome",
        F.col("t.score").alias("score"), js_round(fit, 2).alias("acoustic_fit"), note.alias("acoustic_note"), F.concat(F.when(familiar, signals).otherwise(found), mood).alias("reasons"),
    )


def agent_wins(sessions: DataFrame, session_tracks: DataFrame, taste: DataFrame, artists: DataFrame, pool: DataFrame, n: int = 25) -> DataFrame:
    """The latest n tracks of sessions that were heard to the end or again, with names and signals; ties by session, then position.

    sessions: session_id, mode, invoked_at. taste: track_id, track_name, primary_artist_id, score, flags and counts. artists: artist_id,
    artist_name (empty where there is none)."""
    won = session_tracks.where(F.col("outcome").isin(*GOOD)).join(_one(sessions, "session_id", mode="mode", invoked_at="invoked_at"), "session_id")
    top = won.orderBy(F.desc("invoked_at"), "session_id", "position").limit(n).select("session_id", "position", "track_id", "source", "outcome", "mode", "invoked_at")
    ids = top.select("track_id").distinct()
    # n tracks at most are looked up
    t = taste.join(F.broadcast(ids), "track_id", "left_semi").dropDuplicates(["track_id"]).withColumnRenamed("track_name", "t_name")
    p = _one(pool.join(F.broadcast(ids), "track_id", "left_semi"), "track_id", p_name="track_name")
    a = _one(artists.join(F.broadcast(t.select(F.col("primary_artist_id").alias("artist_id")).distinct()), "artist_id", "left_semi"), "artist_id", artist_name="artist_name")
    out = top.join(t, "track_id", "left").join(p, "track_id", "left").join(a.withColumnRenamed("artist_id", "primary_artist_id"), "primary_artist_id", "left")
    signals = ("score", "in_liked_songs", "in_top_tracks_short", "in_top_tracks_medium", "play_count", "complete_count")
    return out.select("session_id", "position", "track_id", "source", "outcome", F.coalesce("t_name", "p_name").alias("track_name"), F.coalesce("artist_name", F.lit("")).alias("artist_name"), *signals, "mode", "invoked_at")


#: Signals of a taste row, in the order of the report.
SIGNALS = (
    ("Liked Songs", "in_liked_songs"),
    ("Top Tracks (Short)", "in_top_tracks_short"),
    ("Top Tracks (Medium)", "in_top_tracks_medium"),
    ("Seasonal Playlist", "seasonal_playlist_count > 0"),
    ("High Play Count (10+)", "play_count >= 10"),
)


def signal_effectiveness(events: DataFrame, taste: DataFrame, session_tracks: DataFrame) -> DataFrame:
    """How many events of sessions had each signal, and how many of those were heard to the end or again; the last signal is a new
    track. A signal that no event has is there with zeros; events of other classes don't count."""
    e = events.where("session_id is not null").where(F.col("classification").isin("completed", "skipped", "replayed", "abandoned")).select("session_id", "track_id", F.col("classification").isin(*GOOD).cast("long").alias("good"))
    flags = taste.dropDuplicates(["track_id"]).select("track_id", *[F.coalesce(F.expr(c), F.lit(False)).cast("long").alias(f"s{i}") for i, (_, c) in enumerate(SIGNALS)])
    new = session_tracks.where("source like 'fresh:%'").select("session_id", "track_id", F.lit(1).cast("long").alias("new")).distinct()
    # per track and session first: what is joined is no longer an event each
    e = e.groupBy("session_id", "track_id").agg(F.count("*").alias("n"), F.sum("good").alias("good")).join(new, ["session_id", "track_id"], "left").join(flags, "track_id", "left")
    names = [*[f"s{i}" for i in range(len(SIGNALS))], "new"]
    one = e.agg(*[F.coalesce(F.sum(F.col(c) * F.col(of)), F.lit(0)).alias(f"{c}_{of}") for c in names for of in ("n", "good")])
    labels = [*[label for label, _ in SIGNALS], "Fresh Discovery"]
    return one.select(F.inline(F.array(*[F.struct(F.lit(label).alias("signal"), F.col(f"{c}_n").alias("has_signal"), F.col(f"{c}_good").alias("satisfied")) for label, c in zip(labels, names, strict=True)])))
