"""Acoustic profiles, the discovery pool, queues and what listeners made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapedeck.operators.history import SONG, _cutoff, _weight, early_skip, keyed
from tapedeck.sources.shared import cut

#: First hour, end and whether only on weekdays, of modes that are told from the time.
HOURS = {"waking_up": (6, 9, False), "working": (9, 18, True), "unwinding": (18, 23, False), "sleeping": (23, 6, False)}
LEAST_SAMPLES, LEAST_SPREAD, SPREAD = 10, 0.05, 18
FIT = (0.7, 1.4)
#: Tasks that tracks are dealt over: one small file of tracks gives a row for each of many modes.
PARTS = 64


def track_signals(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """One row for each track of any source (track_id, track_name), with a flag for each; the name is of the first source that has it."""
    tagged = None
    for i, (name, df) in enumerate(sources):
        one = df.select("track_id", F.col("track_name").alias("name"), F.lit(i).alias("priority"), F.lit(name).alias("source"))
        tagged = one if tagged is None else tagged.unionByName(one)
    flags = [F.max(F.col("source") == n).alias(n) for n, _ in sources]
    return tagged.groupBy("track_id").agg(F.min_by("name", F.struct("priority", "name")).alias("track_name"), *flags)


def mode_by_hour(hour, day):
    """The mode of an hour of a day (0 = Sunday), or null."""
    modes = []
    for name, (start, end, weekdays) in HOURS.items():
        inside = (hour >= start) & (hour < end) if start < end else (hour >= start) | (hour < end)
        modes.append(F.when(inside & (~day.isin(0, 6)) if weekdays else inside, name))
    return F.coalesce(*modes)


def acoustic_profile(events: DataFrame, features: DataFrame, names: list[str]) -> DataFrame:
    """Weighted mean and spread of each feature over completed and replayed (1.5) events, for each mode and overall.

    events: track_id, classification, hour_of_day, day_of_week and mode, of the session or null."""
    e = events.where(F.col("classification").isin("completed", "replayed")).join(features, "track_id")
    mode = F.coalesce("mode", mode_by_hour(F.col("hour_of_day"), F.col("day_of_week")))
    modes = F.array_compact(F.array(mode, F.lit("overall")))
    long = e.select(F.when(F.col("classification") == "replayed", 1.5).otherwise(1.0).alias("w"), F.explode(modes).alias("mode"), *names)
    cells = long.select("w", "mode", F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(n).cast("double").alias("x")) for n in names])).alias("f")).select("w", "mode", "f.*")
    s = cells.groupBy("mode", "dimension").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("x")).alias("wx"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("wxx"), F.count("*").alias("sample_size"))
    mean = F.col("wx") / F.col("w")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("wxx") / F.col("w") - mean * mean))
    return s.select("mode", "dimension", F.round(mean, 4).alias("mean"), F.round(spread, 4).alias("stddev"), "sample_size", (F.col("sample_size") >= LEAST_SAMPLES).alias("trained"))


def acoustic_fit(features: DataFrame, profile: DataFrame, names: list[str]) -> DataFrame:
    """How well each track fits each mode of a profile (a few rows a mode), 0.7 to 1.4, the feature that is furthest off and whether it lies above (null: on the mean)."""
    # a track's rows meet each mode in one row: none is shuffled or sorted once for each mode and feature
    rows = features.repartition(PARTS, "track_id").groupBy("track_id").agg(F.collect_list(F.struct(*[F.col(n).cast("double").alias(n) for n in names])).alias("rows"))
    modes = profile.groupBy("mode").agg(F.collect_list(F.struct("dimension", "mean", F.greatest("stddev", F.lit(LEAST_SPREAD)).alias("spread"))).alias("of"))

    def feature(row, n):
        return F.transform(F.filter("of", lambda c: c["dimension"] == n), lambda c: F.struct(((row[n] - c["mean"]) / c["spread"]).alias("z"), F.lit(n).alias("dimension")))

    def against(row):
        return F.concat(*[feature(row, n) for n in names])

    cells = rows.join(F.broadcast(modes), how="cross").select("track_id", "mode", F.flatten(F.transform("rows", against)).alias("cells")).where(F.size("cells") > 0)
    d = F.aggregate("cells", F.lit(0.0), lambda total, x: total + F.coalesce(x["z"] * x["z"], F.lit(0.0)))

    def off(x):
        zz = F.round(x["z"] * x["z"], 9)
        return F.struct(zz.alias("zz"), x["dimension"].alias("dimension"), F.when(zz > 0, x["z"] > 0).alias("above"))

    furthest = F.array_max(F.transform("cells", off))
    low, high = FIT
    fit = F.greatest(F.lit(low), F.least(F.lit(high), high - (high - low) * d / SPREAD))
    return cells.select("track_id", "mode", F.round(fit, 6).alias("fit"), furthest.alias("furthest")).select("track_id", "mode", "fit", F.col("furthest.dimension").alias("dominant"), F.col("furthest.above").alias("above"))


def new_candidates(candidates: DataFrame, known: DataFrame, pool: DataFrame) -> DataFrame:
    """Candidates (track_id, track_name, artist_name, arrival) that nobody knows: one of each id, then one of each name, the first to arrive."""
    fresh = candidates.join(known.select("track_id").distinct(), "track_id", "left_anti")
    for keys in (["track_id"], ["tkey", "akey"]):
        order = Window.partitionBy(*keys).orderBy("arrival", "track_id")
        fresh = keyed(fresh).withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")
    return fresh.join(keyed(pool).select("tkey", "akey").distinct(), ["tkey", "akey"], "left_anti")


def allocate_pool(scored: DataFrame, *, slots: int = 50, editorial: float = 0.7) -> DataFrame:
    """The best of each class (editorial or not) for its share of the slots, none below 0."""
    share = -int(-slots * editorial // 1)
    rank = F.row_number().over(Window.partitionBy("is_editorial").orderBy(F.desc("score"), "track_id"))
    return scored.withColumn("rank", rank).where((F.col("rank") <= F.when(F.col("is_editorial"), share).otherwise(slots - share)) & (F.col("score") >= 0))


def pool_expire(pool: DataFrame, *, as_of: str) -> DataFrame:
    gone = (F.col("status") == "fresh") & (F.col("expires_at") < F.lit(as_of).cast("timestamp"))
    return pool.withColumn("status", F.when(gone, "expired").otherwise(F.col("status")))


def pool_upsert(pool: DataFrame, found: DataFrame, *, now: str, days: int = 21) -> DataFrame:
    """pool (track_id, source, score, status, expires_at and any others) after found (track_id, source, score and any of pool's others) came in.

    The higher score stays, with its source and source_detail (the pool's on a tie; of several found, the best). A track
    that was liked or skipped keeps its status and expiry; any other is fresh again for so many days. Of further columns
    the pool's values stay where they aren't null, so that an empty name never replaces one; new tracks get the found ones,
    found_at is `now` for them where it isn't given, and status_changed_at stays what it was.
    """
    others = [c for c in pool.columns if c not in ("track_id", "source", "source_detail", "score", "status", "expires_at")]
    detail = [c for c in ("source_detail",) if c in pool.columns]
    given = [c for c in [*others, *detail] if c in found.columns]
    new = found.groupBy("track_id").agg(F.max_by(F.struct("score", "source", *given), F.struct("score", "source", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in given])).alias("n")).withColumn("came", F.lit(True))
    both = pool.join(new, "track_id", "full")
    came, stays = F.coalesce("came", F.lit(False)), F.coalesce(F.col("status").isin("liked", "skipped"), F.lit(False))
    fresh, better = came & ~stays, came & (F.col("score").isNull() | (F.col("n.score") > F.col("score")))
    values = {
        "source": F.when(better, F.col("n.source")).otherwise(F.col("source")),
        "score": F.greatest("score", "n.score"),
        "status": F.when(fresh, "fresh").otherwise(F.col("status")),
        "expires_at": F.when(fresh, F.lit(now).cast("timestamp") + F.make_dt_interval(F.lit(days))).otherwise(F.col("expires_at")),
    }
    values |= {c: F.when(better, F.col(f"n.{c}") if c in given else F.lit(None)).otherwise(F.col(c)) for c in detail}
    values |= {c: F.coalesce(F.col(c), F.col(f"n.{c}")) if c in given else F.col(c) for c in others}
    if "found_at" in others:
        values["found_at"] = F.coalesce(values["found_at"], F.when(came, F.lit(now).cast("timestamp")))
    return both.select("track_id", *[values[c].alias(c) for c in pool.columns if c != "track_id"])


def pool_mark(pool: DataFrame, outcomes: DataFrame) -> DataFrame:
    """pool with the status that the latest outcome (track_id, at, status: played, liked or skipped) gives each track, and
    when; tracks without one keep both."""
    last = outcomes.groupBy("track_id").agg(F.max(F.struct("at", "status")).alias("o"))
    before = F.col("status_changed_at") if "status_changed_at" in pool.columns else F.lit(None).cast("timestamp")
    return pool.join(last, "track_id", "left").withColumns({"status": F.coalesce("o.status", "status"), "status_changed_at": F.coalesce("o.at", before)}).drop("o")


def top_by_taste(scores: DataFrame, id: str, n: int = 30) -> DataFrame:
    """The n rows with the highest taste score."""
    return scores.orderBy(F.desc("score"), id).limit(n)


def pool_top(pool: DataFrame, n: int = 50) -> DataFrame:
    return pool.where("status = 'fresh'").orderBy(F.desc("score"), "track_id").limit(n)


def promote_submissions(submissions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Notified submissions become added_to_pool (score 0.7), or rejected where the catalog lacks the track or its artist; others stay."""
    found = catalog.select("track_id", F.col("artist_name").isNotNull().alias("ok")).dropDuplicates(["track_id"])
    notified = F.col("status") == "notified"
    out = submissions.join(found, "track_id", "left")
    status = F.when(notified & F.coalesce("ok", F.lit(False)), "added_to_pool").when(notified, "rejected").otherwise(F.col("status"))
    return out.withColumns({"status": status, "score": F.when(notified & F.coalesce("ok", F.lit(False)), 0.7)}).drop("ok")


def generate_queue(plays: DataFrame, *, as_of: str, slots: int = 20, lost_share: float = 0.3, per_artist: int = 3, core: list[str] = (), boost: float = 1.15, min_plays: int = 20, years_gone: float = 2, skips: int = 3) -> DataFrame:
    """position, uri, kind: recordings by affinity, at most per_artist of an artist and none that is skipped often lately,
    with lost favourites at every fourth place."""
    # plays are read and joined once, all else comes from these counts
    early = F.coalesce(early_skip(as_of), F.lit(False)).cast("int")
    cells = cut(keyed(plays).groupBy(*SONG, "uri").agg(F.count("*").alias("n"), F.max("ts").alias("last"), F.sum(_weight(as_of)).alias("affinity"), F.sum(early).alias("early")))
    tracks = cells.where("uri is not null").groupBy("uri").agg(F.round(F.sum("affinity"), 2).alias("affinity"), F.max("akey").alias("akey"), F.sum("early").alias("early"))
    vetoed = tracks.where(F.col("early") >= max(skips, 1)).select("uri")
    n_lost = int(slots * lost_share + 0.5)
    songs = cells.groupBy(*SONG).agg(F.sum("n").alias("plays"), F.max("last").alias("last"), F.max_by("uri", F.struct("n", "uri")).alias("uri"))
    gone = songs.where((F.col("plays") >= min_plays) & (F.col("last") < _cutoff(as_of, years_gone)))
    lost = gone.orderBy(F.desc("plays"), *SONG).limit(slots).join(vetoed, "uri", "left_anti").select("uri", "akey", F.col("plays").cast("double").alias("score"))
    liked = tracks.where(F.col("early") < max(skips, 1)).join(lost.select("uri"), "uri", "left_anti")
    liked = liked.withColumn("score", F.when(F.col("akey").isin(*core), F.col("affinity") * boost).otherwise(F.col("affinity")))
    of_artist = Window.partitionBy("akey").orderBy(F.desc("score"), "uri")
    # from here on there are `slots` rows at most
    regular = liked.withColumn("k", F.row_number().over(of_artist)).where(F.col("k") <= per_artist).orderBy(F.desc("score"), "uri").limit(slots - n_lost)
    counts = regular.groupBy("akey").agg(F.count("*").alias("taken"))
    lost = lost.join(counts, "akey", "left").withColumn("k", F.row_number().over(of_artist) + F.coalesce("taken", F.lit(0))).where(F.col("k") <= per_artist).orderBy(F.desc("score"), "uri").limit(n_lost)
    whole = Window.partitionBy("kind").orderBy(F.desc("score"), "uri")
    both = regular.select("uri", "score", F.lit("liked").alias("kind")).unionByName(lost.select("uri", "score", F.lit("lost").alias("kind")))
    ranked = both.withColumn("i", F.row_number().over(whole) - 1)
    sizes = ranked.agg(F.sum((F.col("kind") == "liked").cast("int")).alias("n"), F.sum((F.col("kind") == "lost").cast("int")).alias("m"))
    place = F.when(F.col("kind") == "lost", F.least((F.col("i") + 1) * 3, F.col("n") + F.col("i"))).when(F.col("i") < 3, F.col("i")).otherwise(F.col("i") + F.least(F.col("m"), F.floor((F.col("i") - 3) / 2) + 1))
    return ranked.join(F.broadcast(sizes), how="cross").select(place.cast("int").alias("position"), "uri", "kind")


def backfill_recent(recent: DataFrame, polls: DataFrame, *, slot_seconds: int = 300) -> DataFrame:
    """Plays that polling missed: recent (user_id, track_id, played_at, duration_ms) without a poll of the track between
    30 s before the start and 30 s after the end. Heard for the gap since the play before, at most the duration."""
    before = F.lag("played_at").over(Window.partitionBy("user_id").orderBy("played_at", "track_id"))
    gap = F.expr("(unix_micros(played_at) - unix_micros(before)) div 1000")
    r = recent.withColumn("before", before).withColumn("listened_ms", F.least(F.coalesce(gap, F.col("duration_ms")), F.col("duration_ms"))).drop("before")
    end = F.unix_timestamp("played_at")
    r = r.withColumns({"from_s": end - F.floor(F.col("listened_ms") / 1000) - 30, "to_s": end + 30})
    slots = r.select("user_id", "track_id", "played_at", "from_s", "to_s", F.explode(F.sequence(F.floor(F.col("from_s") / slot_seconds), F.floor(F.col("to_s") / slot_seconds))).alias("slot"))
    seen = F.unix_timestamp("observed_at")
    p = polls.select("user_id", "track_id", seen.alias("at"), F.floor(seen / slot_seconds).alias("slot"))
    known = slots.join(p, ["user_id", "track_id", "slot"]).where("at between from_s and to_s").select("user_id", "track_id", "played_at").distinct()
    out = r.join(known, ["user_id", "track_id", "played_at"], "left_anti")
    return out.select("user_id", "track_id", "played_at", "listened_ms", F.when(F.col("listened_ms") / F.col("duration_ms") >= 0.8, "completed").otherwise("abandoned").alias("classification"))


def session_feedback(sessions: DataFrame, tracks: DataFrame, events: DataFrame) -> DataFrame:
    """What became of each session (session_id, user_id, invoked_at): outcomes of its tracks (session_id, track_id,
    position) since it began, skips in a row at its end (three shift it to the familiar), and whether three of five or
    more events among its first five tracks were skips (which resets its context)."""
    own = sessions.select("session_id", "user_id", "invoked_at").join(tracks.select("session_id", "track_id", "position"), "session_id")
    e = own.join(events.select("user_id", "event_id", "track_id", "ended_at", "classification"), ["user_id", "track_id"]).where("ended_at >= invoked_at")
    order = Window.partitionBy("session_id").orderBy("ended_at", "event_id")
    skip = F.col("classification") == "skipped"
    e = e.withColumns({"i": F.row_number().over(order), "skip": skip, "early": (F.col("position") < 5) & (F.col("classification") != "replayed")})

    def count(c):
        return F.sum(c.cast("int"))

    kinds = [count(F.col("classification") == k).alias(k) for k in ("completed", "replayed", "skipped", "abandoned")]
    trailing = F.max("i") - F.coalesce(F.max(F.when(~F.col("skip"), F.col("i"))), F.lit(0))
    out = e.groupBy("session_id").agg(F.count("*").alias("events"), *kinds, trailing.alias("trailing_skips"), count(F.col("early")).alias("early"), count(F.col("early") & F.col("skip")).alias("early_skips"))
    return out.select("session_id", "events", "completed", "replayed", "skipped", "abandoned", "trailing_skips", (F.col("trailing_skips") >= 3).alias("familiarity_shift"), ((F.col("early_skips") >= 3) & (F.col("early") >= 5)).alias("context_reset"))
