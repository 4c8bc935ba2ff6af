"""Sessions: what the context does to tracks, candidates of each request, and plans drawn from them."""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapedeck.functions.columns import js_round

#: Dimension, bucket, multiplier, condition on the snapshot (with its mode), condition on the track, reason.
RULES = (
    ("daylight_phase", "night", 1.15, "daylight_phase = 'night' AND mode IN ('unwinding', 'sleeping')", "play_count > 0 AND skip_count / play_count < 0.1", "a night to unwind: seldom skipped"),
    ("daylight_phase", "night_work_penalty", 0.9, "daylight_phase = 'night' AND mode IN ('unwinding', 'sleeping')", "last_played_hour BETWEEN 9 AND 17", "a night to unwind: last played at work"),
    ("daylight_phase", "morning", 1.2, "daylight_phase IN ('pre_dawn', 'morning') AND mode = 'waking_up'", "current_season_present", "waking up: of this season"),
    ("weather_condition", "rain", 1.1, "weather_condition = 'rain'", "play_count > 0 AND skip_count / play_count < 0.1", "rain: seldom skipped"),
    ("weather_condition", "overcast", 1.1, "weather_condition = 'overcast'", "play_count > 0 AND skip_count / play_count < 0.1", "overcast: seldom skipped"),
    ("weather_condition", "hot_midday", 1.15, "weather_temp_f > 80 AND daylight_phase = 'midday'", "current_season_present", "a hot midday: of this season"),
    ("weather_condition", "cold", 1.1, "weather_temp_f < 35", "seasonal_playlist_count > 0", "cold: on seasonal playlists"),
    ("device_type", "Speaker", 1.0, "device_type = 'Speaker' AND mode <> 'driving'", "true", "on a speaker: albums go together"),
    ("device_type", "mobile_moving", 1.1, "device_type = 'Smartphone' AND is_in_motion", "true", "on the move"),
    ("device_type", "mobile_moving_familiar", 1.1, "device_type = 'Smartphone' AND is_in_motion", "play_count >= 5", "on the move: often played"),
    ("bluetooth_context", "car", 1.15, "bluetooth_context = 'car'", "true", "in the car"),
    ("calendar_category", "focus", 1.15, "calendar_category = 'focus'", "complete_count > 2", "focus: often heard to the end"),
    ("calendar_category", "workout", 1.1, "calendar_category = 'workout'", "play_count >= 3", "workout: often played"),
)
#: Dimensions of a snapshot for which learned affinities hold without a rule.
LEARNED = ("daylight_phase", "weather_condition", "location_label", "device_type", "day_of_week", "calendar_category")
LEAST_SAMPLES, BEYOND, CLAMP = 5, 0.05, (0.5, 2.0)
#: How likely a fresh track is at each place of a session, at most, and by how much each mode changes it (discover: always).
ARC = ((0.0, 0.0), (0.25, 0.1), (0.5, 0.3), (0.75, 0.5), (0.9, 0.2), (1.0, 0.0))
MOST_FRESH = 0.7
FRESH = {"waking_up": 0.5, "working": 0.8, "driving": 0.3, "brainstorming": 1.5, "unwinding": 0.6, "sleeping": 0.2}


def _together(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Rows of a listener in one task, where they meet and are counted without further shuffles. The number of parts is
    given, lest few be made of rows that are small before they meet."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by) if by else df


def _meeting(left: DataFrame, right: DataFrame, by: tuple[str, ...], keys: list[str]) -> DataFrame:
    """left joined with right by `by` and keys. A join would shuffle both again by all of these, and what comes of it once
    more by what is counted; as lists of a listener's rows of the same keys they stay in the listener's task."""
    if not by:
        return left.join(right, keys)
    of = [[c for c in df.columns if c not in (*by, *keys)] for df in (left, right)]
    rows = [left.select(*by, *keys, F.struct(*of[0]).alias("l")), right.select(*by, *keys, F.struct(*of[1]).alias("r"))]
    both = rows[0].unionByName(rows[1], allowMissingColumns=True).dropna(subset=[*by, *keys])
    lists = both.groupBy(*by, *keys).agg(F.collect_list("l").alias("l"), F.collect_list("r").alias("r"))
    return lists.select(*by, *keys, "r", F.inline("l")).select("*", F.inline("r")).drop("r")


def context_biases(tracks: DataFrame, snapshots: DataFrame, affinities: DataFrame, by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """What speaks for or against a track in a context: *by, snapshot_id, track_id, dimension, bucket, multiplier, learned, reason.

    Takes tracks (*by, track_id, play_count, skip_count, complete_count, last_played_hour, seasonal_playlist_count,
    current_season_present), snapshots (*by, snapshot_id, mode and the columns that RULES and LEARNED name; nulls fire
    nothing) and affinities (track_id, dimension, bucket, affinity, sample_size, and those of `by` that it has). A rule gives
    way to the track's affinity for its bucket from LEAST_SAMPLES on; other affinities of so many samples hold in their
    bucket if they are over BEYOND from 1. Tracks meet snapshots by rules and buckets that both have, never all with all.
    """
    # a rule is told by its dimension and bucket, of which each has one rule
    fires = [F.when(F.expr(on), F.struct(F.lit(d).alias("dimension"), F.lit(b).alias("bucket"), F.lit(i).alias("rule"), F.lit(False).alias("around"))) for i, (d, b, _, on, _, _) in enumerate(RULES)]
    values = [F.when(F.col(d).isNotNull(), F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("bucket"), F.lit(None).cast("int").alias("rule"), F.lit(True).alias("around"))) for d in LEARNED]
    here = _together(snapshots, by).select(*by, "snapshot_id", F.inline(F.array_compact(F.array(*fires, *values))))
    here = here.groupBy(*by, "snapshot_id", "dimension", "bucket").agg(F.max("rule").alias("rule"), F.max("around").alias("around"))

    own = [*[c for c in by if c in affinities.columns], "track_id"]
    known = affinities.where(F.col("sample_size") >= LEAST_SAMPLES)
    felt = known.groupBy(*own).agg(F.collect_list(F.struct("dimension", "bucket", F.lit(False).alias("held"), "affinity", "sample_size")).alias("felt"))
    nothing = [F.lit(None).cast(known.schema[c].dataType).alias(c) for c in ("affinity", "sample_size")]
    holds = F.array_compact(F.array(*[F.when(F.expr(on), F.struct(F.lit(d).alias("dimension"), F.lit(b).alias("bucket"), F.lit(True).alias("held"), *nothing)) for d, b, _, _, on, _ in RULES]))
    tags = _together(tracks.join(felt, own, "left").select(*by, "track_id", holds.alias("holds"), "felt"), by)
    tags = tags.select(*by, "track_id", F.inline(F.concat("holds", F.coalesce("felt", F.filter("holds", lambda x: F.lit(False))))))
    beyond = F.abs(F.col("affinity") - 1) > BEYOND
    tags = tags.groupBy(*by, "track_id", "dimension", "bucket").agg(F.max("held").alias("held"), *[F.max(c).alias(c) for c in ("affinity", "sample_size")], *[F.max(F.when(beyond, F.col(c))).alias(f"{c}_beyond") for c in ("affinity", "sample_size")])

    # each bucket of a snapshot and of a track has one row, so what meets needs no grouping
    met = _meeting(here, tags, by, ["dimension", "bucket"])
    ruled = F.col("rule").isNotNull() & F.col("held")
    met = met.where(ruled | (F.col("around") & F.col("affinity_beyond").isNotNull()))
    affinity, samples = (F.when(ruled, F.col(c)).otherwise(F.col(f"{c}_beyond")) for c in ("affinity", "sample_size"))
    learned = affinity.isNotNull()
    multiplier, rule_reason = (F.get(F.array(*[F.lit(r[i]) for r in RULES]), F.col("rule")) for i in (2, 5))
    reason = F.when(learned, F.concat(F.lit("learned from "), samples.cast("string"), F.lit(" plays"))).otherwise(rule_reason)
    return met.select(*by, "snapshot_id", "track_id", "dimension", "bucket", F.coalesce(affinity, multiplier).alias("multiplier"), learned.alias("learned"), reason.alias("reason"))


def context_multiplier(biases: DataFrame, by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """The product of each track's biases in each snapshot, within CLAMP; no row where nothing speaks (which is 1)."""
    low, high = CLAMP
    product = F.greatest(F.lit(low), F.least(F.lit(high), F.product("multiplier")))
    return biases.groupBy(*by, "snapshot_id", "track_id").agg(F.round(product, 6).alias("multiplier"), F.count("*").alias("biases"))


def bias_summary(biases: DataFrame, keys: tuple[str, ...] = ("snapshot_id",)) -> DataFrame:
    """Each bucket that speaks in a snapshot, for how many tracks, its mean multiplier and one of its reasons."""
    out = biases.groupBy(*keys, "dimension", "bucket").agg(F.count("*").alias("tracks"), F.avg("multiplier").alias("mean"), F.min("reason").alias("reason"))
    return out.withColumn("mean", js_round(F.round("mean", 9), 3))


def candidate_pool(taste: DataFrame, fresh: DataFrame, events: DataFrame, *, blocked: DataFrame | None = None, familiar: int = 200, new: int = 50, recent: int = 50, by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """What each listener's requests may draw from, whatever their context: *by, track_id, artist_id, score, source. Takes what session_candidates takes."""

    def first(df: DataFrame, n: int, *order) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order, "track_id"))
        return df.withColumn("k", rank).where(F.col("k") <= n).drop("k")

    last = first(events.groupBy(*by, "track_id").agg(F.max("started_at").alias("at")), recent, F.desc("at")).select(*by, "track_id")
    out = blocked.select(*by, "track_id") if blocked is not None else last.limit(0)
    gone = last.unionByName(out).distinct()
    best = first(taste.where("score > 0"), familiar, F.desc("score")).select(*by, "track_id", "artist_id", "score", F.lit("familiar").alias("source"))
    found = first(fresh, new, F.desc("score")).select(*by, "track_id", "artist_id", "score", F.concat(F.lit("fresh:"), "source").alias("source"))
    return best.unionByName(found).join(gone, [*by, "track_id"], "left_anti")


def in_pool(tracks: DataFrame, pool: DataFrame, by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Those tracks that are familiar ones of a pool: multipliers of others are not asked for."""
    return tracks.join(pool.where("source = 'familiar'").select(*by, "track_id"), [*by, "track_id"], "left_semi")


def session_candidates(
    requests: DataFrame, taste: DataFrame, fresh: DataFrame, events: DataFrame, *, multipliers: DataFrame | None = None, fit: DataFrame | None = None, blocked: DataFrame | None = None,
    familiar: int = 200, new: int = 50, recent: int = 50, by: tuple[str, ...] = ("user_id",),
) -> DataFrame:
    """What each request may draw from: request_id, track_id, artist_id, score, source ("familiar" or "fresh:" and where from).

    Takes requests (request_id, *by, mode, snapshot_id), taste (*by, track_id, artist_id, score), fresh (*by, track_id,
    artist_id, score, source), events (*by, track_id, started_at), blocked (*by, track_id), multipliers (*by,
    snapshot_id, track_id, multiplier) and fit (track_id, mode, fit); a track without one of the last two counts as 1.
    The `familiar` best tracks above 0 and the `new` best fresh ones of each listener, without the `recent` different
    tracks that were played last and the blocked ones. Lists are cut before recent tracks go, ties by track_id, so that a
    request has familiar + new candidates at most. A familiar score is taste * multiplier * fit, a fresh one score * fit.
    """
    pool = candidate_pool(taste, fresh, events, blocked=blocked, familiar=familiar, new=new, recent=recent, by=by)
    c = requests.select("request_id", *by, "mode", "snapshot_id").join(pool, [*by])
    if multipliers is not None:
        c = c.join(multipliers.select(*by, "snapshot_id", "track_id", "multiplier"), [*by, "snapshot_id", "track_id"], "left")
    if fit is not None:
        c = c.join(fit.select("track_id", "mode", "fit"), ["track_id", "mode"], "left")
    one = F.lit(1.0)
    times = F.when(F.col("source") == "familiar", F.coalesce("multiplier", one) if multipliers is not None else one).otherwise(one) * (F.coalesce("fit", one) if fit is not None else one)
    return c.select("request_id", "track_id", "artist_id", F.round(F.col("score") * times, 6).alias("score"), "source")


def fresh_ratio(place: Column, mode: Column) -> Column:
    """How likely a fresh track is at a place (0 to 1) of a session of a mode: ARC between its points, times the mode's factor, at most MOST_FRESH."""
    place = F.greatest(F.lit(0.0), F.least(F.lit(1.0), place))
    base = F.coalesce(*[F.when(place <= p1, r0 + (place - p0) / (p1 - p0) * (r1 - r0)) for (p0, r0), (p1, r1) in zip(ARC, ARC[1:], strict=False)])
    factor = F.coalesce(*[F.when(mode == m, f) for m, f in FRESH.items()], F.lit(1.0))
    return F.when(mode == "discover", 1.0).otherwise(F.least(base * factor, F.lit(MOST_FRESH)))


def chance(*parts) -> float:
    """A number between 0 and 1, the same for the same parts on any machine: the first 52 bits of their MD5."""
    digest = hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()
    return (int(digest[:13], 16) + 0.5) / (1 << 52)


def chances(*parts):
    """chance(*parts, last) as a function of the last part."""
    first = hashlib.md5("".join(f"{p}|" for p in parts).encode())

    def drawn(last) -> float:
        digest = first.copy()
        digest.update(str(last).encode())
        return (int(digest.hexdigest()[:13], 16) + 0.5) / (1 << 52)

    return drawn


PLAN = "request_id {id}, position int, track_id {track}, artist_id string, source string, place_ratio double"


def plan_sessions(requests: DataFrame, candidates: DataFrame, *, seed: int = 0) -> DataFrame:
    """A session for each request: request_id, position (from 0), track_id, artist_id, source, place_ratio.

    Takes requests (request_id, mode, n_tracks) and candidates (request_id, track_id, artist_id, score, source: "familiar"
    or other), as session_candidates gives them: some hundreds a request, which is one row when it is drawn. Place by
    place a fresh track is due with the probability place_ratio, else a familiar one; of those that are left one is drawn
    in proportion to its score (0.1 at least; a tenth of that right after the same artist), or one of the other kind where
    none is left. A session ends early when both are used up; requests without candidates have no rows, a track that is
    given twice counts as the better one. Draws hang on seed, request, position and track only: the same rows at any partitioning.
    """
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    place = F.when(F.col("n_tracks") > 1, F.col("position") / (F.col("n_tracks") - 1)).otherwise(0.0)
    places = requests.where("n_tracks > 0").select("request_id", "mode", "n_tracks", F.explode(F.sequence(F.lit(0), F.col("n_tracks") - 1)).alias("position"))
    ratios = places.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", fresh_ratio(place, F.col("mode")).alias("r")))), lambda x: x["r"]).alias("ratios"))
    best = F.max_by(F.struct(F.col("artist_id").cast("string").alias("artist_id"), "score", "source"), F.struct("score", "source"))
    pool = candidates.groupBy("request_id", "track_id").agg(best.alias("x")).groupBy("request_id").agg(F.collect_list(F.struct("track_id", "x.artist_id", "x.score", "x.source")).alias("c"))
    pool = pool.join(ratios, "request_id").select("request_id", "ratios", *[F.col("c")[c].alias(c) for c in ("track_id", "artist_id", "score", "source")])
    names = ["request_id", "position", "track_id", "artist_id", "source", "place_ratio"]

    def session(request, ratios, of) -> list[tuple]:
        left: dict[bool, dict] = {}
        for t, a, w, s in of:
            left.setdefault(s == "familiar", {})[t] = (a, max(w if w is not None and w == w else 0.0, 0.1), s)
        rows, last, any_fresh = [], None, False in left
        for position, ratio in enumerate(ratios):
            familiar = not (any_fresh and chance(seed, request, position) < ratio)
            pool, same = left.get(familiar), 0.1
            if not pool:
                pool, same = left.get(not familiar), 1.0
            if not pool:
                break
            drawn = chances(seed, request, position)
            # the least of exponential waiting times falls to each in proportion to its weight
            wait = [(-math.log(drawn(t)) / (w * same if a is not None and a == last else w), t) for t, (a, w, _) in pool.items()]
            track = min(wait)[1]
            last, _, source = pool.pop(track)
            rows.append((request, position, track, last, source, ratio))
        return rows

    def draw(batches):
        for b in batches:
            rows = []
            for request, ratios, *of in zip(*[c.to_pylist() for c in b.columns], strict=True):
                rows += session(request, ratios, zip(*of, strict=True))
            if rows:
                kind = b.schema.field("request_id").type, pa.int32(), b.schema.field("track_id").type.value_type, pa.string(), pa.string(), pa.float64()
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kind, strict=True)], names=names)

    return pool.mapInArrow(draw, PLAN.format(id=kinds["request_id"], track=kinds["track_id"]))


def score_candidates(candidates: DataFrame, artist_taste: DataFrame, seasonal: DataFrame) -> DataFrame:
    """candidates (candidate_id, artist_ids with the first as its own, source, is_editorial) with the score that taste gives them.

    From artists' scores (artist_id, score) and those on seasonal playlists (artist_id). Found by artist: 0.6 of the own
    artist's score, 0.2 of each other's, 2 if seasonal, 1.5 for a followed artist's release. Editorial: 5 if the own artist
    is unknown, else 0.3 of the score, at most 3; 0.1 of each other's, at most 1; 1 if seasonal. An artist named twice
    beside the own one counts twice, as often as it is named. Null or empty artist_ids know nobody.
    """
    credit = candidates.select("candidate_id", F.posexplode_outer("artist_ids").alias("i", "artist_id"), F.get("artist_ids", F.lit(0)).alias("own"))
    credit = credit.where("i is null or i = 0 or artist_id <> own")
    known = credit.join(artist_taste.select("artist_id", "score"), "artist_id", "left").join(seasonal.select("artist_id", F.lit(True).alias("seasonal")).distinct(), "artist_id", "left")
    own, other = F.col("i") == 0, F.col("i") > 0
    sums = known.groupBy("candidate_id").agg(
        F.max(F.when(own, F.col("score"))).alias("own_score"), F.coalesce(F.max(F.when(own, F.col("seasonal"))), F.lit(False)).alias("seasonal"),
        F.coalesce(F.sum(F.when(other, F.col("score") * 0.2)), F.lit(0.0)).alias("others"), F.coalesce(F.sum(F.when(other & F.col("score").isNotNull(), F.least(F.col("score") * 0.1, F.lit(1.0)))), F.lit(0.0)).alias("capped"),
    )
    j = candidates.join(sums, "candidate_id")
    plain = F.coalesce(F.col("own_score") * 0.6, F.lit(0.0)) + F.col("others") + F.when(F.col("seasonal"), 2).otherwise(0) + F.when(F.col("source") == "followed_artist_release", 1.5).otherwise(0)
    editorial = F.when(F.col("own_score").isNull(), 5.0).otherwise(F.least(F.col("own_score") * 0.3, F.lit(3.0))) + F.col("capped") + F.when(F.col("seasonal"), 1).otherwise(0)
    return j.withColumn("score", js_round(F.when(F.col("is_editorial"), editorial).otherwise(plain), 2)).drop("own_score", "seasonal", "others", "capped")
