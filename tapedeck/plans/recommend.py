"""Queries over profiles, the pool, queues and feedback, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapedeck.operators import recommend as r
from tapedeck.operators.coverage import audio_queue
from tapedeck.sources.bridge import EVENTS_SQL, PLAYS_SQL, POLLS_SQL, play_events, plays, polls

AS_OF = "2001-11-05"
NAMES = ["energy", "valence"]


def _features(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("cast(p_partkey AS string) AS track_id", "p_size / 50 AS energy", "(p_partkey % 7) / 7 AS valence")


def _profile(spark, sf_dir):
    e = play_events(spark, sf_dir)
    e = e.withColumns({"hour_of_day": F.hour("ended_at"), "day_of_week": F.dayofweek("ended_at") - 1, "mode": F.when(F.col("session_id").isin("s0", "s1", "s2"), "driving")})
    return r.acoustic_profile(e, _features(spark, sf_dir), NAMES)


FEATURES = "features AS (SELECT p_partkey::VARCHAR AS track_id, p_size / 50 AS energy, (p_partkey % 7) / 7 AS valence FROM part)"
PROFILE = f"""{FEATURES}, wide AS (SELECT *, CASE WHEN classification = 'replayed' THEN 1.5::DOUBLE ELSE 1 END AS w, hour(ended_at) AS h, dayofweek(ended_at) AS d FROM play_events JOIN features USING (track_id) WHERE classification IN ('completed', 'replayed')),
 moded AS (SELECT w, energy, valence, unnest(['overall', CASE WHEN session_id IN ('s0', 's1', 's2') THEN 'driving' WHEN h >= 6 AND h < 9 THEN 'waking_up' WHEN h >= 9 AND h < 18 AND d NOT IN (0, 6) THEN 'working' WHEN h >= 18 AND h < 23 THEN 'unwinding' WHEN h >= 23 OR h < 6 THEN 'sleeping' END]) AS mode FROM wide),
 cells AS (SELECT w, mode, unnest(['energy', 'valence']) AS dimension, unnest([energy, valence]) AS x FROM moded WHERE mode IS NOT NULL),
 profile AS (SELECT mode, dimension, round(sum(w * x) / sum(w), 4) AS mean, round(sqrt(sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ** 2), 4) AS stddev, count(*) AS sample_size, count(*) >= 10 AS trained FROM cells GROUP BY ALL) """


def _scored(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS track_id", "p_type = 'ECONOMY' AS is_editorial", "p_retailprice - 950 AS score")


def _recent(spark, sf_dir):
    e = play_events(spark, sf_dir).where("classification = 'completed'")
    return e.select("user_id", (F.col("track_id").cast("int") % 3).cast("string").alias("track_id"), (F.col("ended_at") + F.expr("INTERVAL 3 MINUTES")).alias("played_at"), F.lit(200000).cast("long").alias("duration_ms"))


def _sessions(spark, sf_dir):
    return play_events(spark, sf_dir).where("event_id % 50 = 0").selectExpr("event_id AS session_id", "user_id", "ended_at AS invoked_at")


def _session_tracks(spark, sf_dir):
    return _sessions(spark, sf_dir).select("session_id", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("position")).select("session_id", "position", ((F.col("session_id") + F.col("position") * 2) % 100).cast("string").alias("track_id"))


def _queue_sql() -> str:
    years = f"(epoch(TIMESTAMP '{AS_OF}') - floor(epoch(ts))) / (365.25 * 86400)"
    return f""", vetoed AS (SELECT uri FROM plays WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND reason_end = 'fwdbtn' AND ms_played < 30000 GROUP BY uri HAVING count(*) >= 1),
 songs AS (SELECT tkey, akey, sum(n)::BIGINT AS plays, max(last) AS last_played, max((n, uri))[2] AS uri FROM (SELECT tkey, akey, uri, count(*) AS n, max(ts) AS last FROM plays GROUP BY ALL) GROUP BY ALL),
 lost0 AS (SELECT uri, akey, plays::DOUBLE AS score FROM songs WHERE plays >= 5 AND last_played < TIMESTAMP '{AS_OF}' + INTERVAL 1 DAY - to_seconds(0.25 * 365.25 * 86400) ORDER BY plays DESC, tkey, akey LIMIT 20),
 lost1 AS (SELECT * FROM lost0 WHERE uri NOT IN (SELECT uri FROM vetoed)),
 liked AS (SELECT uri, max(akey) AS akey, round(sum(least(minutes, 7.0) * exp(-({years}) / 3) * CASE WHEN reason_end = 'trackdone' THEN 1.5 ELSE 1.0 END), 2) * CASE WHEN max(akey) = 'brand#7' THEN 1.15::DOUBLE ELSE 1 END AS score FROM plays WHERE uri NOT IN (SELECT uri FROM vetoed) AND uri NOT IN (SELECT uri FROM lost1) GROUP BY uri),
 regular AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY akey ORDER BY score DESC, uri) AS k FROM liked) WHERE k <= 3 ORDER BY score DESC, uri LIMIT 14),
 lost AS (SELECT uri, score FROM (SELECT l.*, row_number() OVER (PARTITION BY l.akey ORDER BY score DESC, uri) + coalesce(taken, 0) AS k FROM lost1 l LEFT JOIN (SELECT akey, count(*) AS taken FROM regular GROUP BY akey) t ON t.akey = l.akey) WHERE k <= 3 ORDER BY score DESC, uri LIMIT 6),
 ranked AS (SELECT uri, 'liked' AS kind, row_number() OVER (ORDER BY score DESC, uri) - 1 AS i FROM regular UNION ALL SELECT uri, 'lost', row_number() OVER (ORDER BY score DESC, uri) - 1 FROM lost)
 SELECT uri, kind, (CASE WHEN kind = 'lost' THEN least((i + 1) * 3, (SELECT count(*) FROM regular) + i) WHEN i < 3 THEN i ELSE i + least((SELECT count(*) FROM lost), (i - 3) // 2 + 1) END)::INT AS position FROM ranked"""


def _signals(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS track_id", "p_name AS track_name", "p_size")
    return r.track_signals([("liked", p.where("p_size < 10")), ("top_short", p.where("p_size % 4 = 0").withColumn("track_name", F.upper("track_name"))), ("played", p.where("p_size > 5"))])


def _audio_queue(spark, sf_dir):
    taste = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS track_id", "p_retailprice AS score")
    sold = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_partkey").alias("track_id")).agg(F.max(F.col("l_shipdate").cast("timestamp")).alias("fetched_at"))
    features = sold.where("track_id % 3 > 0").withColumn("found", F.col("track_id") % 3 == 1)
    return audio_queue(taste, features, as_of=AS_OF)


def _pool(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").where("p_size < 40").selectExpr("cast(p_partkey AS bigint) AS track_id", "p_brand AS source", "cast(p_size AS double) AS score", "element_at(array('fresh', 'played', 'liked', 'skipped', 'expired'), p_size % 5 + 1) AS status", "timestamp'2024-02-01' AS expires_at", "IF(p_size % 3 = 0, timestamp'2023-12-01', NULL) AS status_changed_at", "IF(p_size % 4 > 0, p_name, NULL) AS track_name", "p_type AS source_detail")


POOL = "SELECT p_partkey::BIGINT AS track_id, p_brand AS source, p_size::DOUBLE AS score, ['fresh', 'played', 'liked', 'skipped', 'expired'][p_size % 5 + 1] AS status, TIMESTAMP '2024-02-01' AS expires_at, CASE WHEN p_size % 3 = 0 THEN TIMESTAMP '2023-12-01' END AS status_changed_at, CASE WHEN p_size % 4 > 0 THEN p_name END AS track_name, p_type AS source_detail FROM part WHERE p_size < 40"


def _found(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'R'").selectExpr("cast(l_partkey AS bigint) AS track_id", "concat('s', l_suppkey % 5) AS source", "cast(l_quantity AS double) AS score", "concat('found ', l_partkey) AS track_name", "concat('from s', l_suppkey % 5) AS source_detail")


FOUND = "SELECT l_partkey::BIGINT AS track_id, 's' || (l_suppkey % 5) AS source, l_quantity::DOUBLE AS score, 'found ' || l_partkey AS track_name, 'from s' || (l_suppkey % 5) AS source_detail FROM lineitem WHERE l_returnflag = 'R'"


def _outcomes(spark, sf_dir):
    kind = F.when(F.col("classification") == "completed", "played").when(F.col("classification") == "replayed", "liked").otherwise("skipped")
    return play_events(spark, sf_dir).where("classification <> 'abandoned'").select(F.col("track_id").cast("long").alias("track_id"), F.col("ended_at").alias("at"), kind.alias("status"))


JOBS = {
    "i02_audio_queue": (
        _audio_queue,
        f"""SELECT p_partkey AS track_id, p_retailprice AS score FROM part LEFT JOIN (SELECT l_partkey, max(l_shipdate)::TIMESTAMP AS fetched_at FROM lineitem WHERE l_partkey % 3 > 0 GROUP BY l_partkey) f ON l_partkey = p_partkey
 WHERE l_partkey IS NULL OR (l_partkey % 3 = 2 AND fetched_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) ORDER BY score DESC, track_id LIMIT 50""",
    ),
    "e01_track_signals": (
        _signals,
        """SELECT p_partkey AS track_id, CASE WHEN p_size % 4 = 0 AND p_size >= 10 THEN upper(p_name) ELSE p_name END AS track_name, p_size < 10 AS liked, p_size % 4 = 0 AS top_short, p_size > 5 AS played FROM part WHERE p_size < 10 OR p_size % 4 = 0 OR p_size > 5""",
    ),
    "c03_backfill": (
        lambda s, d: r.backfill_recent(_recent(s, d), polls(s, d)),
        POLLS_SQL
        + """, r0 AS (SELECT user_id, ((props->>'$.k')::INT % 3)::VARCHAR AS track_id, ts + INTERVAL 3 MINUTE AS played_at FROM events WHERE event_type = 'purchase'),
 r1 AS (SELECT *, least(200000, coalesce((epoch_us(played_at) - epoch_us(lag(played_at) OVER (PARTITION BY user_id ORDER BY played_at, track_id))) // 1000, 200000)) AS listened_ms FROM r0)
 SELECT user_id, track_id, played_at, listened_ms::BIGINT AS listened_ms, CASE WHEN listened_ms / 200000 >= 0.8 THEN 'completed' ELSE 'abandoned' END AS classification FROM r1 WHERE NOT EXISTS (SELECT 1 FROM polls p WHERE p.user_id = r1.user_id AND p.track_id = r1.track_id
 AND floor(epoch(observed_at)) BETWEEN floor(epoch(played_at)) - listened_ms // 1000 - 30 AND floor(epoch(played_at)) + 30)""",
    ),
    "c11_session_feedback": (
        lambda s, d: r.session_feedback(_sessions(s, d), _session_tracks(s, d), play_events(s, d)),
        EVENTS_SQL
        + """, st AS (SELECT event_id AS session_id, user_id, ended_at AS invoked_at, p AS position, ((event_id + p * 2) % 100)::VARCHAR AS track_id FROM play_events, range(40) t(p) WHERE event_id % 50 = 0),
 e AS (SELECT st.session_id, classification, position < 5 AND classification <> 'replayed' AS early, row_number() OVER (PARTITION BY st.session_id ORDER BY ended_at, event_id) AS i FROM st JOIN play_events e USING (user_id, track_id) WHERE ended_at >= invoked_at)
 SELECT session_id, count(*) AS events, sum((classification = 'completed')::INT)::BIGINT AS completed, sum((classification = 'replayed')::INT)::BIGINT AS replayed, sum((classification = 'skipped')::INT)::BIGINT AS skipped, sum((classification = 'abandoned')::INT)::BIGINT AS abandoned,
 (max(i) - coalesce(max(CASE WHEN classification <> 'skipped' THEN i END), 0))::INT AS trailing_skips, max(i) - coalesce(max(CASE WHEN classification <> 'skipped' THEN i END), 0) >= 3 AS familiarity_shift, sum((early AND classification = 'skipped')::INT) >= 3 AND sum(early::INT) >= 5 AS context_reset FROM e GROUP BY session_id""",
    ),
    "e08_acoustic_profile": (_profile, f"{EVENTS_SQL}, {PROFILE} SELECT * FROM profile"),
    "e09_acoustic_fit": (
        lambda s, d: r.acoustic_fit(_features(s, d), _profile(s, d), NAMES),
        f"""{EVENTS_SQL}, {PROFILE}, z AS (SELECT track_id, mode, f.dimension, ((x - mean) / greatest(stddev, 0.05)) AS z FROM (SELECT track_id, unnest(['energy', 'valence']) AS dimension, unnest([energy, valence]) AS x FROM features) f JOIN profile p ON p.dimension = f.dimension)
 SELECT track_id, mode, round(greatest(0.7, least(1.4, 1.4 - 0.7 * sum(z * z) / 18)), 6) AS fit, max((round(z * z, 9), dimension))[2] AS dominant, max((round(z * z, 9), dimension, CASE WHEN round(z * z, 9) > 0 THEN z > 0 END))[3] AS above FROM z GROUP BY track_id, mode""",
    ),
    "e13_queue": (lambda s, d: r.generate_queue(plays(s, d), as_of=AS_OF, core=["brand#7"], min_plays=5, years_gone=0.25, skips=1), PLAYS_SQL + _queue_sql()),
    "e16_pool_slots": (lambda s, d: r.allocate_pool(_scored(s, d)), "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY is_editorial ORDER BY score DESC, track_id)::INT AS rank FROM (SELECT p_partkey AS track_id, p_type = 'ECONOMY' AS is_editorial, p_retailprice - 950 AS score FROM part)) WHERE rank <= CASE WHEN is_editorial THEN 35 ELSE 15 END AND score >= 0"),
    "e17_pool_upsert": (
        lambda s, d: r.pool_upsert(_pool(s, d), _found(s, d), now="2024-03-01"),
        f"""WITH pool AS ({POOL}), n AS (SELECT track_id, max((score, source, track_name, source_detail)) AS n FROM ({FOUND}) GROUP BY track_id)
 SELECT coalesce(pool.track_id, n.track_id) AS track_id, CASE WHEN n IS NOT NULL AND (score IS NULL OR n[1] > score) THEN n[2] ELSE source END AS source, greatest(score, n[1]) AS score,
 CASE WHEN n IS NULL OR status IN ('liked', 'skipped') THEN status ELSE 'fresh' END AS status, CASE WHEN n IS NULL OR status IN ('liked', 'skipped') THEN expires_at ELSE TIMESTAMP '2024-03-22' END AS expires_at,
 status_changed_at, coalesce(track_name, n[3]) AS track_name, CASE WHEN n IS NOT NULL AND (score IS NULL OR n[1] > score) THEN n[4] ELSE source_detail END AS source_detail FROM pool FULL JOIN n ON pool.track_id = n.track_id""",
    ),
    "e17_pool_mark": (
        lambda s, d: r.pool_mark(_pool(s, d), _outcomes(s, d)),
        f"""{EVENTS_SQL}, pool AS ({POOL}), o AS (SELECT track_id::BIGINT AS track_id, max((ended_at, CASE classification WHEN 'completed' THEN 'played' WHEN 'replayed' THEN 'liked' ELSE 'skipped' END)) AS o FROM play_events WHERE classification <> 'abandoned' GROUP BY 1)
 SELECT track_id, source, score, coalesce(o[2], status) AS status, expires_at, coalesce(o[1], status_changed_at) AS status_changed_at, track_name, source_detail FROM pool LEFT JOIN o USING (track_id)""",
    ),
}
