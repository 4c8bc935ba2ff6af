"""Queries over days, weeks, open lookups and ratings by tag, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapedeck.operators import dashboards as b
from tapedeck.operators import events as e
from tapedeck.operators import graph as g
from tapedeck.operators import history as h
from tapedeck.plans.events import AFFINITY, LINKED, OUTCOMES, RATE, _linked
from tapedeck.plans.explain import TASTE, _taste
from tapedeck.plans.periods import NODES
from tapedeck.plans.versions import SEASONAL, _seasonal
from tapedeck.sources.bridge import EVENTS_SQL, PLAYS_SQL, play_events, plays, snapshots

AS_OF = "2024-01-20 15:00:00"


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tracks(spark, sf_dir):
    """What sessions held: a third of their tracks came from fresh sources."""
    k = F.col("track_id").cast("int")
    outcome = F.when(k % 4 == 0, "skipped").when(k % 4 < 3, "completed")
    return play_events(spark, sf_dir).where("session_id is not null").select("session_id", "track_id").distinct().select("session_id", "track_id", F.when(k % 3 == 0, "fresh:radio").otherwise("familiar").alias("source"), outcome.alias("outcome"))


def _sessions(spark, sf_dir):
    return _table(spark, sf_dir, "events").where("event_type = 'signup'").select("user_id", F.concat(F.lit("s"), F.col("user_id") % 20).alias("session_id"), F.col("ts").cast("timestamp").alias("invoked_at"))


def _artists(spark, sf_dir):
    return _table(spark, sf_dir, "nation").where("n_nationkey % 3 > 0").selectExpr("cast(n_nationkey AS string) AS artist_id", "n_name AS artist_name")


HELD = f"""{EVENTS_SQL}, tracks AS (SELECT DISTINCT session_id, track_id, CASE WHEN track_id::INT % 3 = 0 THEN 'fresh:radio' ELSE 'familiar' END AS source, CASE WHEN track_id::INT % 4 = 0 THEN 'skipped' WHEN track_id::INT % 4 < 3 THEN 'completed' END AS outcome FROM play_events WHERE session_id IS NOT NULL),
 marked AS (SELECT *, coalesce(session_id IS NOT NULL AND track_id::INT % 3 = 0, false) AS fresh FROM play_events)"""
STATS = f"count(*) AS events, {OUTCOMES}, sum(fresh::INT)::BIGINT AS fresh_plays FROM marked"
NAMED = f"{HELD}, taste AS (SELECT {TASTE} FROM part WHERE p_partkey % 4 < 3), artists AS (SELECT n_nationkey::VARCHAR AS artist_id, n_name AS artist_name FROM nation WHERE n_nationkey % 3 > 0)"


def _linked_all(spark, sf_dir):
    more = snapshots(spark, sf_dir).select("snapshot_id", F.when(F.col("snapshot_id") % 2 == 0, "Speaker").otherwise("Smartphone").alias("device_type"), (F.dayofweek("captured_at") - 1).alias("day_of_week"), F.when(F.col("snapshot_id") % 3 == 0, "focus").alias("calendar_category"))
    return _linked(spark, sf_dir).join(more, "snapshot_id", "left")


ALL_AFFINITY = (
    AFFINITY.replace("s.snapshot_id, daylight_phase, weather_condition, location_label", "s.snapshot_id, daylight_phase, weather_condition, location_label, CASE WHEN s.snapshot_id % 2 = 0 THEN 'Speaker' WHEN s.snapshot_id IS NOT NULL THEN 'Smartphone' END AS device_type, dayofweek(s.captured_at)::VARCHAR AS day_of_week, CASE WHEN s.snapshot_id % 3 = 0 THEN 'focus' END AS calendar_category")
    .replace("['daylight_phase', 'weather_condition', 'location_label']", str(list(e.ALL_DIMENSIONS)))
    .replace("[daylight_phase, weather_condition, location_label]", "[" + ", ".join(e.ALL_DIMENSIONS) + "]")
)


def _around(spark, sf_dir):
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    rows = _table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_id") % 4 > 0, day + F.expr("INTERVAL '11:30' HOUR TO MINUTE")).alias("sunrise"), (day + F.expr("INTERVAL 22 HOURS")).alias("sunset"), (F.col("event_id") % 100).cast("int").alias("weather_code"))
    return e.add_context_columns(rows).select("event_id", "daylight_phase", "condition")


AROUND = """WITH a AS (SELECT event_id, floor(epoch(ts)) AS t, epoch(date_trunc('day', ts)) + 41400 AS rise, epoch(date_trunc('day', ts)) + 79200 AS fall, hour(ts - INTERVAL 5 HOUR) AS h, event_id % 100 AS c FROM events)
 SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CASE WHEN h < 6 THEN 'night' WHEN h < 8 THEN 'pre_dawn' WHEN h < 11 THEN 'morning' WHEN h < 17 THEN 'midday' WHEN h < 19 THEN 'golden_hour' WHEN h < 20 THEN 'dusk' ELSE 'night' END
 WHEN t < rise - 3600 THEN 'night' WHEN t < rise THEN 'pre_dawn' WHEN t < rise + 10800 THEN 'morning' WHEN t < fall - 3600 THEN 'midday' WHEN t < fall THEN 'golden_hour' WHEN t < fall + 1800 THEN 'dusk' ELSE 'night' END AS daylight_phase,
 CASE WHEN c = 0 THEN 'clear' WHEN c <= 3 THEN 'partly_cloudy' WHEN c <= 48 THEN 'fog' WHEN c <= 57 THEN 'overcast' WHEN c <= 67 THEN 'rain' WHEN c <= 77 THEN 'snow' WHEN c <= 82 THEN 'rain' WHEN c <= 86 THEN 'snow' WHEN c >= 95 THEN 'thunderstorm' ELSE 'overcast' END AS condition FROM a"""


def _lyrics(spark, sf_dir):
    return _table(spark, sf_dir, "part").selectExpr("concat('spotify:track:', p_partkey) AS uri", "CASE WHEN p_size % 5 > 0 THEN 'ok' ELSE 'not_found' END AS status", "p_size % 7 = 0 AS instrumental", "repeat('la ', p_size) AS lyrics")


def _analyses(spark, sf_dir):
    return _table(spark, sf_dir, "part").where("p_partkey % 3 > 0").selectExpr("concat('spotify:track:', p_partkey) AS uri", "element_at(array('ok', 'pending', 'parse_error', 'refused'), cast(p_partkey % 4 + 1 AS int)) AS status")


def _embedded(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").selectExpr("concat('spotify:track:', l_partkey) AS uri", "CASE WHEN l_linenumber % 2 = 0 THEN 'lyrics' ELSE 'analysis' END AS kind").where("substr(uri, -1) IN ('1', '2', '3') OR (kind = 'lyrics' AND substr(uri, -1) IN ('4', '5'))")


LOOKED_UP = """lyrics AS (SELECT 'spotify:track:' || p_partkey AS uri, CASE WHEN p_size % 5 > 0 THEN 'ok' ELSE 'not_found' END AS status, p_size % 7 = 0 AS instrumental, 3 * p_size AS long FROM part),
 analyses AS (SELECT 'spotify:track:' || p_partkey AS uri, ['ok', 'pending', 'parse_error', 'refused'][p_partkey % 4 + 1] AS status FROM part WHERE p_partkey % 3 > 0)"""


def _stages(spark, sf_dir):
    return {"lyrics": _lyrics(spark, sf_dir), "analysis": _analyses(spark, sf_dir)}


def _credits(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").selectExpr("concat('spotify:track:', l_partkey) AS uri", "concat('Person ', l_suppkey) AS person", "l_returnflag AS role")


def _tagged(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id")
    return docs.select("doc_id", "n_chars", "quality", "toxic", F.array("lang", "source", F.when(F.col("n_chars") > 500, "long")).alias("tags"))


_DASH = f"""{HELD}, spans(span, since) AS (VALUES ('today', TIMESTAMP '2024-01-20 05:00:00'), ('week', TIMESTAMP '2024-01-14 05:00:00')),
 ev AS (SELECT user_id, span, count(*) AS tracks, floor(sum(duration_listened_ms) / 60000 + 0.5)::BIGINT AS minutes, {OUTCOMES}, sum(fresh::INT)::BIGINT AS fresh_played, sum((fresh AND classification = 'completed')::INT)::BIGINT AS fresh_completed, sum((fresh AND classification = 'skipped')::INT)::BIGINT AS fresh_skipped
 FROM marked JOIN spans ON ended_at >= since AND ended_at < TIMESTAMP '{AS_OF}' GROUP BY ALL),
 held AS (SELECT session_id, count(*) AS n, sum((outcome IS NOT DISTINCT FROM 'completed')::INT) AS done, sum((outcome IS NOT DISTINCT FROM 'skipped')::INT) AS gone FROM tracks GROUP BY 1),
 se AS (SELECT user_id, span, count(*) AS sessions, sum(n)::BIGINT AS session_tracks, sum(done)::BIGINT AS session_completed, sum(gone)::BIGINT AS session_skipped
 FROM (SELECT user_id, 's' || (user_id % 20) AS session_id, ts AS invoked_at FROM events WHERE event_type = 'signup') JOIN held USING (session_id) JOIN spans ON invoked_at >= since AND invoked_at < TIMESTAMP '{AS_OF}' GROUP BY ALL)
 SELECT user_id, span, COLUMNS(* EXCLUDE (user_id, span)) FROM (SELECT user_id, span, """
_DASH_COLUMNS = ("tracks", "minutes", *e.OUTCOMES, "fresh_played", "fresh_completed", "fresh_skipped", "sessions", "session_tracks", "session_completed", "session_skipped")
DASHBOARD = _DASH + ", ".join(f"coalesce({c}, 0) AS {c}" for c in _DASH_COLUMNS) + ", CASE WHEN tracks > 0 THEN round(skipped / tracks, 6) END AS skip_rate FROM ev FULL JOIN se USING (user_id, span))"

JOBS = {
    "c05_context_columns": (_around, AROUND),
    "e06_all_dimensions": (lambda s, d: e.context_affinity(_linked_all(s, d), e.ALL_DIMENSIONS), f"{EVENTS_SQL}, {ALL_AFFINITY} SELECT * FROM affinities"),
    "f08_node_picks": (
        lambda s, d: g.node_encodings(h.graph_nodes(plays(s, d)), picks=("brand#7", "nobody", "brand#3", "brand#5")).select("akey", "label"),
        f"{PLAYS_SQL} SELECT akey, row_number() OVER (ORDER BY akey IN ('brand#7', 'brand#3') DESC, plays * active_years DESC, akey) <= 8 AS label FROM {NODES}",
    ),
    "f09_graph_seasons": (lambda s, d: g.graph_stats(plays(s, d), _seasonal(s, d)), f"{PLAYS_SQL} SELECT count(*) AS plays, count(DISTINCT artist_name) AS artists, count(DISTINCT uri) AS tracks, min(ts)::DATE AS first_day, (SELECT count(*) FROM ({SEASONAL})) AS seasons FROM plays"),
    "h12_mean_by_tag": (lambda s, d: b.mean_by_tag(_tagged(s, d), "tags", "quality"), "SELECT tag, count(*) AS n, round(avg(quality), 6) AS mean FROM (SELECT doc_id, quality, unnest(list_distinct([lang, source, CASE WHEN n_chars > 500 THEN 'long' END])) AS tag FROM documents JOIN labels USING (doc_id)) WHERE tag IS NOT NULL AND quality IS NOT NULL GROUP BY 1 HAVING count(*) >= 2"),
    "h12_high_low": (
        lambda s, d: b.high_low(_tagged(s, d), ("n_chars", "toxic"), "quality", high=1, low=0),
        "SELECT n_high, n_low, unnest(['n_chars', 'toxic']) AS feature, round(unnest([hn, ht]), 6) AS high, round(unnest([ln, lt]), 6) AS low, round(unnest([hn - ln, ht - lt]), 6) AS difference FROM (SELECT count(*) FILTER (quality >= 1) AS n_high, count(*) FILTER (quality <= 0) AS n_low, avg(n_chars) FILTER (quality >= 1) AS hn, avg(toxic) FILTER (quality >= 1) AS ht, avg(n_chars) FILTER (quality <= 0) AS ln, avg(toxic) FILTER (quality <= 0) AS lt FROM documents JOIN labels USING (doc_id))",
    ),
    "i03_analysis_queue": (lambda s, d: b.analysis_queue(_lyrics(s, d), _analyses(s, d)), f"WITH {LOOKED_UP} SELECT uri FROM lyrics LEFT JOIN analyses a USING (uri) WHERE lyrics.status = 'ok' AND NOT instrumental AND long > 50 AND (a.status IS NULL OR a.status IN ('parse_error', 'pending'))"),
    "i03_embedding_queue": (
        lambda s, d: b.embedding_queue(_analyses(s, d), _lyrics(s, d), _embedded(s, d)).withColumn("missing", F.array_join("missing", ",")),
        f"""WITH {LOOKED_UP}, have AS (SELECT DISTINCT 'spotify:track:' || l_partkey AS uri, CASE WHEN l_linenumber % 2 = 0 THEN 'lyrics' ELSE 'analysis' END AS kind FROM lineitem WHERE l_partkey % 10 IN (1, 2, 3) OR (l_linenumber % 2 = 0 AND l_partkey % 10 IN (4, 5)))
 SELECT uri, string_agg(kind, ',' ORDER BY kind DESC) AS missing FROM (SELECT uri, unnest(['lyrics', 'analysis']) AS kind FROM analyses a JOIN lyrics l USING (uri) WHERE a.status = 'ok' AND l.status = 'ok') ANTI JOIN have USING (uri, kind) GROUP BY 1""",
    ),
    "i05_stage_coverage": (
        lambda s, d: b.stage_coverage(plays(s, d), _stages(s, d)),
        f"""{PLAYS_SQL}, {LOOKED_UP}, n AS (SELECT uri, count(*) AS n, l.status AS l, a.status AS a FROM plays LEFT JOIN lyrics l USING (uri) LEFT JOIN analyses a USING (uri) GROUP BY ALL)
 SELECT *, round(recordings / sum(recordings) OVER (PARTITION BY stage), 6) AS share FROM (SELECT stage, coalesce(status, 'none') AS status, count(*) AS recordings, sum(n)::BIGINT AS plays FROM (SELECT n, unnest(['lyrics', 'analysis']) AS stage, unnest([l, a]) AS status FROM n) GROUP BY ALL)""",
    ),
    "i06_credits_by_track": (lambda s, d: b.credits_by_track(_credits(s, d)), "SELECT 'spotify:track:' || l_partkey AS uri, string_agg(DISTINCT 'Person ' || l_suppkey || ' (' || l_returnflag || ')', ', ' ORDER BY 'Person ' || l_suppkey || ' (' || l_returnflag || ')') AS credits FROM lineitem GROUP BY 1"),
    "i06_top_played_status": (lambda s, d: b.top_played_status(plays(s, d), _stages(s, d)), f"{PLAYS_SQL}, {LOOKED_UP} SELECT uri, plays, coalesce(l.status, 'none') AS lyrics, coalesce(a.status, 'none') AS analysis FROM (SELECT uri, count(*) AS plays FROM plays GROUP BY 1 ORDER BY plays DESC, uri LIMIT 20) LEFT JOIN lyrics l USING (uri) LEFT JOIN analyses a USING (uri)"),
    "j01_period_stats": (lambda s, d: b.period_stats(play_events(s, d), _tracks(s, d)), f"{HELD} SELECT *, {RATE}, round(fresh_plays / events, 6) AS fresh_share FROM (SELECT {STATS})"),
    "j01_period_stats_by_listener": (lambda s, d: b.period_stats(play_events(s, d), _tracks(s, d), by=("user_id",)), f"{HELD} SELECT *, {RATE}, round(fresh_plays / events, 6) AS fresh_share FROM (SELECT user_id, {STATS} GROUP BY 1)"),
    "j02_top_lists_by_listener": (
        lambda s, d: b.top_lists(play_events(s, d), _taste(s, d), _artists(s, d), as_of=AS_OF, hours=24 * 14, n=3, by=("user_id",)),
        f"""{NAMED}, x AS (SELECT user_id, list, id, count(*) AS plays, row_number() OVER (PARTITION BY user_id, list ORDER BY count(*) DESC, id)::INT AS rank FROM (SELECT user_id, unnest(['track', 'artist']) AS list, unnest([track_id, artist_ids[1]]) AS id FROM play_events WHERE ended_at < TIMESTAMP '{AS_OF}' AND ended_at >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY) GROUP BY user_id, list, id QUALIFY rank <= 3)
 SELECT user_id, list, rank, id, coalesce(CASE list WHEN 'track' THEN track_name ELSE artist_name END, CASE list WHEN 'track' THEN id ELSE 'Unknown artist' END) AS name, plays FROM x LEFT JOIN taste ON track_id = id AND list = 'track' LEFT JOIN artists ON artist_id = id AND list = 'artist'""",
    ),
    "j02_context_counts": (lambda s, d: b.context_counts(_linked(s, d), e.DIMENSIONS), f"{EVENTS_SQL}, {LINKED} SELECT dimension, bucket, count(*) AS events FROM (SELECT unnest(['daylight_phase', 'weather_condition', 'location_label']) AS dimension, unnest([daylight_phase, weather_condition, location_label]) AS bucket FROM linked) WHERE bucket IS NOT NULL GROUP BY ALL"),
    "j03_dashboard": (lambda s, d: b.dashboard(play_events(s, d), _sessions(s, d), _tracks(s, d), as_of=AS_OF, by=("user_id",)), DASHBOARD),
    "j04_recent_named": (
        lambda s, d: b.recent_named(play_events(s, d), _taste(s, d), _artists(s, d), _tracks(s, d), n=100),
        f"""{NAMED} SELECT event_id, ended_at, e.track_id, classification, e.session_id, score::DOUBLE AS score, track_name, primary_artist_id, artist_name, source AS session_source FROM (SELECT * FROM play_events ORDER BY ended_at DESC, event_id DESC LIMIT 100) e
 LEFT JOIN taste t ON t.track_id = e.track_id LEFT JOIN artists ON artist_id = primary_artist_id LEFT JOIN tracks s ON s.session_id = e.session_id AND s.track_id = e.track_id""",
    ),
    "j09_affinity_buckets": (lambda s, d: b.affinity_buckets(e.context_affinity(_linked(s, d)), plays(s, d)), f"{EVENTS_SQL}, {AFFINITY} SELECT dimension, bucket, sum(sample_size)::BIGINT AS samples, false AS from_plays FROM affinities GROUP BY ALL"),
    "j09_buckets_of_plays": (
        lambda s, d: b.affinity_buckets(e.context_affinity(_linked(s, d), least=2**62), plays(s, d)),
        f"""{PLAYS_SQL} SELECT dimension, bucket, count(*) AS samples, true AS from_plays FROM (SELECT unnest(['daylight_phase', 'day_of_week']) AS dimension, unnest([CASE WHEN local_hour < 5 THEN 'night' WHEN local_hour < 7 THEN 'dawn' WHEN local_hour < 10 THEN 'morning' WHEN local_hour < 17 THEN 'day' WHEN local_hour < 20 THEN 'evening' ELSE 'dusk' END, ['Sun', 'Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat'][dayofweek(ts) + 1]]) AS bucket FROM plays) GROUP BY ALL""",
    ),
}
