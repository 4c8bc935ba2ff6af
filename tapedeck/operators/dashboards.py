"""What a day's or a week's page shows: outcomes with fresh tracks, ranked names, sessions, pools, and queues of open lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapedeck.operators.events import OUTCOMES, event_stats

ZONE = "America/New_York"


def mark_fresh(events: DataFrame, session_tracks: DataFrame) -> DataFrame:
    """events with `fresh`: whether the event's session (session_id) took its track from a fresh source (fresh:...)."""
    picked = session_tracks.where(F.col("source").startswith("fresh:")).select("session_id", "track_id").distinct().withColumn("fresh", F.lit(True))
    return events.join(picked, ["session_id", "track_id"], "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))


def period_stats(events: DataFrame, session_tracks: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """event_stats with fresh_plays and fresh_share of all events; without `by` and events one row of zeros and null shares."""
    marked = mark_fresh(events, session_tracks)
    fresh = marked.where("fresh").groupBy(*by).agg(F.count("*").alias("fresh_plays"))
    stats = event_stats(events, by)
    keys = F.lit(True)
    for c in by:
        keys = keys & F.col(f"s.{c}").eqNullSafe(F.col(f"f.{c}"))
    out = stats.alias("s").join(F.broadcast(fresh).alias("f") if not by else fresh.alias("f"), keys, "left")
    n = F.coalesce(F.col("f.fresh_plays"), F.lit(0))
    return out.select("s.*", n.alias("fresh_plays"), F.when(F.col("s.events") > 0, F.round(n / F.col("s.events"), 6)).alias("fresh_share"))


def top_lists(events: DataFrame, tracks: DataFrame, artists: DataFrame, *, as_of: str, hours: int = 24, n: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """The most heard tracks and artists of the hours up to as_of: *by, list, rank, id, name, plays.

    Tracks are named by `tracks` (track_id, track_name), else by their id; the artist of an event is the first of its
    artist_ids, named by `artists` (artist_id, artist_name; blank names don't count), else by the event's own artist_name where
    it has that column, else Unknown artist. Of several names the greatest stands; ties go to the least id; events without an
    id are in neither list.
    """
    end = F.lit(as_of).cast("timestamp")
    recent = events.where((F.col("ended_at") < end) & (F.col("ended_at") >= end - F.make_dt_interval(F.lit(0), F.lit(hours))))
    own = F.nullif(F.trim("artist_name"), F.lit("")) if "artist_name" in events.columns else F.lit(None).cast("string")
    ids = F.array(F.struct(F.lit("track").alias("list"), F.col("track_id").alias("id"), F.lit(None).cast("string").alias("own")), F.struct(F.lit("artist").alias("list"), F.get("artist_ids", F.lit(0)).alias("id"), own.alias("own")))
    counts = recent.select(*by, F.inline(ids)).where("id is not null").groupBy(*by, "list", "id").agg(F.count("*").alias("plays"), F.max("own").alias("own"))
    order = Window.partitionBy(*by, "list").orderBy(F.desc("plays"), "id")
    # only the ranked rows meet the names
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    names = tracks.select(F.lit("track").alias("list"), F.col("track_id").alias("id"), F.col("track_name").alias("known")).unionByName(artists.select(F.lit("artist").alias("list"), F.col("artist_id").alias("id"), F.col("artist_name").alias("known")))
    names = names.where(F.trim("known") != "").groupBy("list", "id").agg(F.max("known").alias("known"))
    none = F.when(F.col("list") == "track", F.col("id")).otherwise("Unknown artist")
    return top.join(names, ["list", "id"], "left").select(*by, "list", "rank", "id", F.coalesce("known", "own", none).alias("name"), "plays")


def context_counts(linked: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """Events by value of each dimension of the snapshots that they are linked to: dimension, bucket, events; nulls don't count."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("bucket")) for d in dimensions])
    return linked.select(F.inline(pairs)).where("bucket is not null").groupBy("dimension", "bucket").agg(F.count("*").alias("events"))


def dashboard(events: DataFrame, sessions: DataFrame, session_tracks: DataFrame, *, as_of: str, zone: str = ZONE, by: tuple[str, ...] = ()) -> DataFrame:
    """Two rows for each key: `today`, from the local midnight before as_of on, and `week`, from six days earlier: *by, span, tracks, minutes
    (rounded), outcomes, skip_rate, fresh_played, fresh_completed, fresh_skipped, sessions, session_tracks, session_completed,
    session_skipped.

    Takes events (*by, ended_at, classification, duration_listened_ms, session_id, track_id), sessions (*by, session_id,
    invoked_at) and session_tracks (session_id, track_id, source, outcome). Events and sessions from as_of on don't count;
    each table is read once, and rows are counted by key and day before they meet. A key with neither in a span has no row for it.
    """
    end = F.lit(as_of).cast("timestamp")
    today = F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(end, zone)), zone)

    def spans(df: DataFrame, ts: str) -> DataFrame:
        recent = df.where((F.col(ts) < end) & (F.col(ts) >= today - F.make_dt_interval(F.lit(6))))
        return recent.withColumn("span", F.explode(F.array_compact(F.array(F.lit("week"), F.when(F.col(ts) >= today, "today")))))

    def n(on) -> object:
        return F.sum(F.coalesce(on, F.lit(False)).cast("int"))

    heard, kind = F.col("fresh"), F.col("classification")
    e = spans(mark_fresh(events, session_tracks), "ended_at").groupBy(*by, "span").agg(
        F.count("*").alias("tracks"), F.floor(F.coalesce(F.sum("duration_listened_ms"), F.lit(0)) / 60000 + 0.5).alias("minutes"), *[n(kind == o).alias(o) for o in OUTCOMES],
        n(heard).alias("fresh_played"), n(heard & (kind == "completed")).alias("fresh_completed"), n(heard & (kind == "skipped")).alias("fresh_skipped"))
    per_session = session_tracks.groupBy("session_id").agg(F.count("*").alias("n"), n(F.col("outcome") == "completed").alias("done"), n(F.col("outcome") == "skipped").alias("left"))
    s = spans(sessions, "invoked_at").join(per_session, "session_id").groupBy(*by, "span").agg(F.count("*").alias("sessions"), F.sum("n").alias("session_tracks"), F.sum("done").alias("session_completed"), F.sum("left").alias("session_skipped"))
    sums = [c for c in (*e.columns, *s.columns) if c not in (*by, "span")]
    # one row a key and span on either side: a union and a sum, so that null keys meet too
    out = e.unionByName(s, allowMissingColumns=True).groupBy(*by, "span").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])
    return out.withColumn("skip_rate", F.when(F.col("tracks") > 0, F.round(F.col("skipped") / F.col("tracks"), 6)))


def recent_named(events: DataFrame, taste: DataFrame, artists: DataFrame, session_tracks: DataFrame, *, n: int = 25) -> DataFrame:
    """The latest n events with track_name, score, primary_artist_id (taste: track_id, track_name, score, primary_artist_id),
    artist_name (artists: artist_id, artist_name) and session_source (that of the session's track, the least of several).
    The events are cut before anything is looked up; each lookup has one row a key, so there are n rows or fewer."""
    latest = events.orderBy(F.desc("ended_at"), F.desc("event_id")).limit(n).select("event_id", "ended_at", "track_id", "classification", "session_id")
    t = taste.groupBy("track_id").agg(F.max(F.struct("score", "track_name", "primary_artist_id")).alias("t")).select("track_id", "t.*")
    a = artists.groupBy(F.col("artist_id").alias("primary_artist_id")).agg(F.max("artist_name").alias("artist_name"))
    of = session_tracks.groupBy("session_id", "track_id").agg(F.min("source").alias("session_source"))
    return latest.join(t, "track_id", "left").join(a, "primary_artist_id", "left").join(of, ["session_id", "track_id"], "left")


def affinity_buckets(affinities: DataFrame, plays: DataFrame) -> DataFrame:
    """How many samples each bucket has: dimension, bucket, samples, from_plays. Where there are no affinities at all, daylight and
    day of week are counted from plays (ts, local_hour) instead."""
    live = affinities.groupBy("dimension", "bucket").agg(F.sum("sample_size").alias("samples"), F.lit(False).alias("from_plays"))
    h = F.col("local_hour")
    # Hours at which parts of the day begin, and names of days from Sunday on.
    light = F.when(h < 5, "night").when(h < 7, "dawn").when(h < 10, "morning").when(h < 17, "day").when(h < 20, "evening").otherwise("dusk")
    day = F.element_at(F.array(*map(F.lit, ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"))), F.dayofweek("ts"))
    pairs = F.array(F.struct(F.lit("daylight_phase").alias("dimension"), light.alias("bucket")), F.struct(F.lit("day_of_week").alias("dimension"), day.alias("bucket")))
    empty = affinities.limit(1).agg((F.count("*") == 0).alias("none")).where("none")
    counted = plays.join(F.broadcast(empty), how="cross").select(F.inline(pairs)).groupBy("dimension", "bucket").agg(F.count("*").alias("samples"), F.lit(True).alias("from_plays"))
    return live.unionByName(counted)


def analysis_queue(lyrics: DataFrame, analyses: DataFrame, *, longer: int = 50) -> DataFrame:
    """Recordings (uri) whose lyrics (uri, status, instrumental, lyrics) are there, sung and longer than `longer` letters, with no
    analysis status (uri, status) or none but parse_error and pending."""
    ready = lyrics.where((F.col("status") == "ok") & ~F.coalesce("instrumental", F.lit(False)) & (F.length("lyrics") > longer)).select("uri").distinct()
    done = analyses.where(~F.col("status").isin("parse_error", "pending")).select("uri").distinct()
    return ready.join(done, "uri", "left_anti")


def embedding_queue(analyses: DataFrame, lyrics: DataFrame, embeddings: DataFrame, *, kinds: tuple[str, ...] = ("lyrics", "analysis")) -> DataFrame:
    """Recordings with an analysis and lyrics that are ok but not an embedding (uri, kind) of each kind: uri, missing (the kinds, in order)."""
    ok = analyses.where("status = 'ok'").select("uri").distinct().join(lyrics.where("status = 'ok'").select("uri").distinct(), "uri", "left_semi")
    have = embeddings.where(F.col("kind").isin(*kinds)).groupBy("uri").agg(F.collect_set("kind").alias("have"))
    missing = F.array_except(F.array(*map(F.lit, kinds)), F.coalesce("have", F.array().cast("array<string>")))
    return ok.join(have, "uri", "left").select("uri", missing.alias("missing")).where(F.size("missing") > 0)


def stage_coverage(plays: DataFrame, stages: dict[str, DataFrame]) -> DataFrame:
    """How far each stage (uri, status) has come over all played recordings: stage, status (none: not tried), recordings, share,
    plays. Plays are counted once for each recording; of several statuses of a recording the greatest stands."""
    counts = plays.groupBy("uri").agg(F.count("*").alias("n"))
    known = [df.groupBy("uri").agg(F.max("status").alias(name)) for name, df in stages.items()]
    out = counts
    for k in known:
        out = out.join(k, "uri", "left")
    rows = out.select("n", F.inline(F.array(*[F.struct(F.lit(s).alias("stage"), F.coalesce(s, F.lit("none")).alias("status")) for s in stages])))
    found = rows.groupBy("stage", "status").agg(F.count("*").alias("recordings"), F.sum("n").alias("plays"))
    return found.withColumn("share", F.round(F.col("recordings") / F.sum("recordings").over(Window.partitionBy("stage")), 6))


def credits_by_track(credits: DataFrame) -> DataFrame:
    """Each recording's credits (uri, person, role) as one text, "person (role)" in order, each once."""
    one = F.concat(F.col("person"), F.lit(" ("), F.col("role"), F.lit(")"))
    return credits.groupBy("uri").agg(F.array_join(F.array_sort(F.collect_set(one)), ", ").alias("credits"))


def top_played_status(plays: DataFrame, stages: dict[str, DataFrame], *, n: int = 20) -> DataFrame:
    """The n most played recordings with their status in each stage (uri, status); none where there is none."""
    out = plays.groupBy("uri").agg(F.count("*").alias("plays")).orderBy(F.desc("plays"), "uri").limit(n)
    for name, df in stages.items():
        out = out.join(df.groupBy("uri").agg(F.max("status").alias(name)), "uri", "left").withColumn(name, F.coalesce(name, F.lit("none")))
    return out


def mean_by_tag(df: DataFrame, tags: str, rating: str, *, least: int = 2) -> DataFrame:
    """Mean rating of the rows that have each tag of an array column, from `least` rows on; a row counts once for a tag."""
    return df.where(F.col(rating).isNotNull()).select(F.explode(F.array_distinct(tags)).alias("tag"), rating).where("tag is not null").groupBy("tag").agg(F.count("*").alias("n"), F.round(F.avg(rating), 6).alias("mean")).where(F.col("n") >= least)


def high_low(df: DataFrame, features: tuple[str, ...], rating: str, *, high: float = 4, low: float = 2) -> DataFrame:
    """Means of each feature among rows rated `high` or more and `low` or less, how many rows these are, and the difference."""
    side = F.when(F.col(rating) >= high, "high").when(F.col(rating) <= low, "low")
    one = df.withColumn("side", side).agg(*[F.count(F.when(F.col("side") == s, 1)).alias(f"n_{s}") for s in ("high", "low")], *[F.avg(F.when(F.col("side") == s, F.col(f))).alias(f"{s}_{f}") for s in ("high", "low") for f in features])
    rows = [F.struct(F.lit(f).alias("feature"), F.round(f"high_{f}", 6).alias("high"), F.round(f"low_{f}", 6).alias("low"), F.round(F.col(f"high_{f}") - F.col(f"low_{f}"), 6).alias("difference")) for f in features]
    return one.select("n_high", "n_low", F.inline(F.array(*rows)))
