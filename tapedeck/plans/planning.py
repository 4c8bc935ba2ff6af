"""Queries over contexts, candidates and planned sessions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapedeck.operators import planning as p
from tapedeck.operators.events import artist_play_stats
from tapedeck.sources.bridge import EVENTS_SQL, play_events

MODES = ("waking_up", "unwinding", "sleeping", "driving", "brainstorming", "discover")
SEED = 7


def _k(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def _pick(values, at):
    return F.get(F.array(*map(F.lit, values)), at)


def _snapshots(spark, sf_dir):
    k = F.col("k")
    return _k(spark, sf_dir).where("event_type = 'signup'").select(
        "user_id", F.col("event_id").alias("snapshot_id"), _pick(MODES, k % 6).alias("mode"), _pick(("night", "morning", "midday"), k % 3).alias("daylight_phase"),
        _pick(("clear", "rain", "overcast", None), k % 4).alias("weather_condition"), (k * 7 % 100).alias("weather_temp_f"), F.concat(F.lit("place "), k % 4).alias("location_label"),
        _pick(("Speaker", "Smartphone", None), k % 3).alias("device_type"), (k % 2 == 0).alias("is_in_motion"), F.when(k % 5 == 0, "car").alias("bluetooth_context"),
        _pick(("focus", "workout", None, None), k % 4).alias("calendar_category"), (F.dayofweek("ts") - 1).alias("day_of_week"),
    )


def _taste(spark, sf_dir):
    e, t = play_events(spark, sf_dir), F.col("track_id").cast("int")
    of = {"skip_count": "skipped", "complete_count": "completed"}
    g = e.groupBy("user_id", "track_id").agg(F.count("*").alias("play_count"), *[F.sum((F.col("classification") == v).cast("int")).alias(c) for c, v in of.items()], F.max_by(F.hour("ended_at"), F.struct("ended_at", "event_id")).alias("last_played_hour"), F.max("ended_at").alias("started_at"))
    return g.withColumns({"seasonal_playlist_count": t % 3, "current_season_present": t % 2 == 0, "artist_id": (t % 25).cast("string"), "score": (F.col("play_count") + 2 * F.col("complete_count") - 2 * F.col("skip_count")).cast("double")})


def _affinities(spark, sf_dir):
    k = F.col("k")
    at = F.array(*[F.struct(F.lit(d).alias("dimension"), b.alias("bucket")) for d, b in (("location_label", F.concat(F.lit("place "), k % 4)), ("weather_condition", _pick(("clear", "rain", "overcast", None), k % 4)), ("daylight_phase", _pick(("night", "morning", "midday"), k % 3)), ("device_type", _pick(("Speaker", "mobile_moving", "Computer"), k % 3)))])
    rows = _k(spark, sf_dir).where("event_type = 'signup'").select(F.col("k").cast("string").alias("track_id"), "event_id", F.inline(at)).where("bucket is not null")
    return rows.groupBy("track_id", "dimension", "bucket").agg((F.count("*") / 4).cast("int").alias("sample_size"), (F.lit(0.8) + F.sum("event_id") % 40 / 100).alias("affinity"))


def _fresh(spark, sf_dir):
    g = _k(spark, sf_dir).where("event_type = 'view'").groupBy("user_id", "k").agg((F.count("*") * 1.5).alias("score"))
    return g.select("user_id", F.concat(F.lit("new "), F.col("k")).alias("track_id"), (F.col("k") % 7).cast("string").alias("artist_id"), F.col("score").cast("double").alias("score"), _pick(("blog", "artist"), F.col("k") % 2).alias("source"))


def _fit(spark, sf_dir):
    t = _k(spark, sf_dir).select("k").distinct()
    return t.select(F.col("k").cast("string").alias("track_id"), F.posexplode(F.array(*map(F.lit, MODES))).alias("i", "mode")).select("track_id", "mode", (F.lit(0.7) + (F.col("track_id").cast("int") * 13 + F.col("i") * 7) % 8 / 10).alias("fit"))


def _biases(spark, sf_dir, pool=None):
    taste = _taste(spark, sf_dir)
    return p.context_biases(taste if pool is None else p.in_pool(taste, pool), _snapshots(spark, sf_dir), _affinities(spark, sf_dir))


def _requests(spark, sf_dir):
    return _snapshots(spark, sf_dir).select(F.col("snapshot_id").alias("request_id"), "user_id", "mode", "snapshot_id", (5 + F.col("snapshot_id") % 8).cast("int").alias("n_tracks"))


def _candidates(spark, sf_dir):
    taste = _taste(spark, sf_dir)
    how = {"blocked": taste.where("track_id = '13'"), "familiar": 25, "new": 12, "recent": 8}
    fresh = _fresh(spark, sf_dir)
    # contexts are weighed for tracks that may be drawn, and not for all that a listener has heard
    biases = _biases(spark, sf_dir, p.candidate_pool(taste, fresh, taste, **how))
    return p.session_candidates(_requests(spark, sf_dir), taste, fresh, taste, multipliers=p.context_multiplier(biases), fit=_fit(spark, sf_dir), **how)


def _plan(spark, sf_dir):
    return p.plan_sessions(_requests(spark, sf_dir), _candidates(spark, sf_dir), seed=SEED).withColumn("place_ratio", F.round("place_ratio", 6))


def _discovered(spark, sf_dir):
    i = F.col("p_partkey")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(i.cast("bigint").alias("candidate_id"), F.array((i % 25).cast("string"), (i % 7).cast("string"), (F.col("p_size") % 30).cast("string")).alias("artist_ids"), F.when(i % 3 == 0, "followed_artist_release").otherwise("search").alias("source"), (i % 2 == 0).alias("is_editorial"))


def _scored(spark, sf_dir):
    artists = artist_play_stats(play_events(spark, sf_dir)).where("cast(artist_id as int) < 20").selectExpr("artist_id", "plays / 50 as score")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("cast(n_nationkey as string) as artist_id").where("cast(artist_id as int) % 4 = 0")
    return p.score_candidates(_discovered(spark, sf_dir), artists, nations).drop("artist_ids")


RULES_SQL = ", ".join(f"({i}, '{d}', '{b}', {m}::DOUBLE, '{r}')" for i, (d, b, m, _, _, r) in enumerate(p.RULES))
_MODES = "[" + ", ".join(f"'{m}'" for m in MODES) + "]"
CONTEXT = EVENTS_SQL + f""", ev AS (SELECT *, (props->>'$.k')::INT AS k FROM events),
 snaps AS (SELECT user_id, event_id AS snapshot_id, {_MODES}[k % 6 + 1] AS mode, ['night', 'morning', 'midday'][k % 3 + 1] AS daylight_phase, ['clear', 'rain', 'overcast', NULL][k % 4 + 1] AS weather_condition, k * 7 % 100 AS weather_temp_f,
  'place ' || (k % 4) AS location_label, ['Speaker', 'Smartphone', NULL][k % 3 + 1] AS device_type, k % 2 = 0 AS is_in_motion, CASE WHEN k % 5 = 0 THEN 'car' END AS bluetooth_context, ['focus', 'workout', NULL, NULL][k % 4 + 1] AS calendar_category, dayofweek(ts) AS day_of_week FROM ev WHERE event_type = 'signup'),
 taste AS (SELECT *, track_id::INT % 3 AS seasonal_playlist_count, track_id::INT % 2 = 0 AS current_season_present, (track_id::INT % 25)::VARCHAR AS artist_id, (play_count + 2 * complete_count - 2 * skip_count)::DOUBLE AS score FROM (
  SELECT user_id, track_id, count(*) AS play_count, sum((classification = 'skipped')::INT) AS skip_count, sum((classification = 'completed')::INT) AS complete_count, max((ended_at, event_id, hour(ended_at)))[3] AS last_played_hour, max(ended_at) AS started_at FROM play_events GROUP BY ALL)),
 around AS (SELECT k, event_id, unnest(['location_label', 'weather_condition', 'daylight_phase', 'device_type']) AS dimension, unnest(['place ' || (k % 4), ['clear', 'rain', 'overcast', NULL][k % 4 + 1], ['night', 'morning', 'midday'][k % 3 + 1], ['Speaker', 'mobile_moving', 'Computer'][k % 3 + 1]]) AS bucket FROM ev WHERE event_type = 'signup'),
 known AS (SELECT * FROM (SELECT k::VARCHAR AS track_id, dimension, bucket, count(*) // 4 AS sample_size, 0.8::DOUBLE + sum(event_id) % 40 / 100 AS affinity FROM around WHERE bucket IS NOT NULL GROUP BY ALL) WHERE sample_size >= 5),
 rules(rule, dimension, bucket, multiplier, reason) AS (VALUES {RULES_SQL}),
 fires AS ({" UNION ALL ".join(f"SELECT user_id, snapshot_id, {i} AS rule FROM snaps WHERE {on}" for i, (_, _, _, on, _, _) in enumerate(p.RULES))}),
 holds AS ({" UNION ALL ".join(f"SELECT user_id, track_id, {i} AS rule FROM taste WHERE {on}" for i, (_, _, _, _, on, _) in enumerate(p.RULES))}),
 ruled AS (SELECT f.user_id, snapshot_id, h.track_id, r.dimension, r.bucket, coalesce(affinity, multiplier) AS multiplier, affinity IS NOT NULL AS learned, CASE WHEN affinity IS NULL THEN reason ELSE 'learned from ' || sample_size || ' plays' END AS reason
  FROM fires f JOIN holds h ON h.user_id = f.user_id AND h.rule = f.rule JOIN rules r ON r.rule = f.rule LEFT JOIN known a ON a.track_id = h.track_id AND a.dimension = r.dimension AND a.bucket = r.bucket),
 felt AS (SELECT s.user_id, snapshot_id, t.track_id, a.dimension, a.bucket, affinity AS multiplier, true AS learned, 'learned from ' || sample_size || ' plays' AS reason FROM snaps s JOIN taste t ON t.user_id = s.user_id JOIN known a ON a.track_id = t.track_id
  WHERE abs(affinity - 1) > 0.05 AND a.bucket = CASE a.dimension WHEN 'location_label' THEN location_label WHEN 'weather_condition' THEN weather_condition WHEN 'daylight_phase' THEN daylight_phase WHEN 'device_type' THEN device_type END),
 biases AS (SELECT * FROM ruled UNION ALL SELECT * FROM felt f WHERE NOT EXISTS (SELECT 1 FROM ruled r WHERE r.user_id = f.user_id AND r.snapshot_id = f.snapshot_id AND r.track_id = f.track_id AND r.dimension = f.dimension AND r.bucket = f.bucket)),
 times AS (SELECT user_id, snapshot_id, track_id, round(greatest(0.5, least(2.0, product(multiplier))), 6) AS multiplier, count(*) AS biases FROM biases GROUP BY ALL) """
CANDIDATES = CONTEXT + """, requests AS (SELECT snapshot_id AS request_id, user_id, mode, snapshot_id, 5 + snapshot_id % 8 AS n_tracks FROM snaps),
 last_played AS (SELECT user_id, track_id FROM taste QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY started_at DESC, track_id) <= 8),
 fresh AS (SELECT user_id, 'new ' || k AS track_id, (k % 7)::VARCHAR AS artist_id, (count(*) * 1.5)::DOUBLE AS score, 'fresh:' || ['blog', 'artist'][k % 2 + 1] AS source FROM ev WHERE event_type = 'view' GROUP BY user_id, k),
 pool AS (SELECT user_id, track_id, artist_id, score, 'familiar' AS source FROM taste WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, track_id) <= 25
  UNION ALL SELECT * FROM fresh QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, track_id) <= 12),
 allowed AS (SELECT * FROM pool p WHERE track_id <> '13' AND NOT EXISTS (SELECT 1 FROM last_played l WHERE l.user_id = p.user_id AND l.track_id = p.track_id)),
 fits AS (SELECT track_id, mode, 0.7::DOUBLE + (track_id::INT * 13 + i * 7) % 8 / 10 AS fit FROM (SELECT DISTINCT k::VARCHAR AS track_id FROM ev), (SELECT unnest(range(0, 6)) AS i, unnest(""" + _MODES + """) AS mode)),
 candidates AS (SELECT request_id, a.track_id, a.artist_id, round(score * CASE WHEN source = 'familiar' THEN coalesce(multiplier, 1) ELSE 1 END * coalesce(fit, 1), 6) AS score, source FROM requests r JOIN allowed a ON a.user_id = r.user_id
  LEFT JOIN times t ON t.user_id = r.user_id AND t.snapshot_id = r.snapshot_id AND t.track_id = a.track_id LEFT JOIN fits f ON f.track_id = a.track_id AND f.mode = r.mode) """  # fmt: skip


def _chance(*parts: str) -> str:
    return f"((('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496)"


_BASE = "CASE " + " ".join(f"WHEN place <= {p1} THEN {r0} + (place - {p0}) / ({p1}::DOUBLE - {p0}) * ({r1}::DOUBLE - {r0})" for (p0, r0), (p1, r1) in zip(p.ARC, p.ARC[1:], strict=False)) + " END"
_FACTOR = "CASE mode " + " ".join(f"WHEN '{m}' THEN {f}" for m, f in p.FRESH.items()) + " ELSE 1 END"
PLAN = CANDIDATES.replace("WITH play_events", "WITH RECURSIVE play_events", 1) + f""", places AS (SELECT request_id, mode, n_tracks, unnest(range(0, n_tracks)) AS position FROM requests),
 placed AS (SELECT *, position::DOUBLE / (n_tracks - 1) AS place FROM places),
 ratios AS (SELECT request_id, position, CASE WHEN mode = 'discover' THEN 1.0::DOUBLE ELSE least(({_BASE}) * ({_FACTOR}), 0.7) END AS ratio FROM placed),
 due AS (SELECT *, {_chance(str(SEED), "request_id", "position")} < ratio AND request_id IN (SELECT request_id FROM candidates WHERE source <> 'familiar') AS fresh FROM ratios),
 steps AS (SELECT DISTINCT request_id, -1::BIGINT AS position, [''] AS used, NULL::VARCHAR AS track_id, NULL::VARCHAR AS artist_id, NULL::VARCHAR AS source, 0.0::DOUBLE AS ratio FROM candidates
  UNION ALL SELECT request_id, position, used, track_id, artist_id, source, ratio FROM (
   SELECT s.request_id, d.position, list_append(s.used, c.track_id) AS used, c.track_id, c.artist_id, c.source, d.ratio,
    row_number() OVER (PARTITION BY s.request_id ORDER BY ((c.source <> 'familiar') <> d.fresh)::INT, -ln({_chance(str(SEED), "s.request_id", "d.position", "c.track_id")}) / (greatest(c.score, 0.1) * CASE WHEN (c.source <> 'familiar') = d.fresh AND c.artist_id = s.artist_id THEN 0.1 ELSE 1 END), c.track_id) AS k
   FROM steps s JOIN due d ON d.request_id = s.request_id AND d.position = s.position + 1 JOIN candidates c ON c.request_id = s.request_id WHERE NOT list_contains(s.used, c.track_id)) WHERE k = 1)
 SELECT request_id, position::INT AS position, track_id, artist_id, source, round(ratio, 6) AS place_ratio FROM steps WHERE position >= 0"""

JOBS = {
    "e10_context_multiplier": (lambda s, d: p.context_multiplier(_biases(s, d)), CONTEXT + "SELECT * FROM times"),
    "e10_bias_summary": (
        lambda s, d: p.bias_summary(_biases(s, d)),
        CONTEXT + "SELECT snapshot_id, dimension, bucket, count(*) AS tracks, floor(round(avg(multiplier), 9) * 1000 + 0.5) / 1000 AS mean, min(reason) AS reason FROM biases GROUP BY ALL",
    ),
    "e11_session_candidates": (_candidates, CANDIDATES + "SELECT * FROM candidates"),
    "e12_plan_sessions": (_plan, PLAN),
    "e15_score_candidates": (
        _scored,
        EVENTS_SQL
        + """, artists AS (SELECT artist_id, count(*) / 50 AS score FROM (SELECT unnest(list_distinct(artist_ids)) AS artist_id FROM play_events) WHERE artist_id::INT < 20 GROUP BY artist_id),
 seasonal AS (SELECT n_nationkey::VARCHAR AS artist_id FROM nation WHERE n_nationkey % 4 = 0),
 c AS (SELECT p_partkey::BIGINT AS candidate_id, (p_partkey % 25)::VARCHAR AS own, [(p_partkey % 7)::VARCHAR, (p_size % 30)::VARCHAR] AS others, CASE WHEN p_partkey % 3 = 0 THEN 'followed_artist_release' ELSE 'search' END AS source, p_partkey % 2 = 0 AS is_editorial FROM part),
 o AS (SELECT candidate_id, sum(0.2::DOUBLE * score) AS others, sum(least(0.1::DOUBLE * score, 1)) AS capped FROM (SELECT candidate_id, own, unnest(others) AS artist_id FROM c) x JOIN artists USING (artist_id) WHERE artist_id <> own GROUP BY candidate_id)
 SELECT c.candidate_id, source, is_editorial, floor((CASE WHEN is_editorial THEN CASE WHEN a.score IS NULL THEN 5 ELSE least(0.3::DOUBLE * a.score, 3) END + coalesce(capped, 0) + CASE WHEN s.artist_id IS NULL THEN 0 ELSE 1 END
  ELSE coalesce(0.6::DOUBLE * a.score, 0) + coalesce(o.others, 0) + CASE WHEN s.artist_id IS NULL THEN 0 ELSE 2 END + CASE WHEN source = 'followed_artist_release' THEN 1.5 ELSE 0 END END) * 100 + 0.5) / 100 AS score
 FROM c LEFT JOIN artists a ON a.artist_id = own LEFT JOIN o ON o.candidate_id = c.candidate_id LEFT JOIN seasonal s ON s.artist_id = own""",
    ),
}
