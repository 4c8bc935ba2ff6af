"""Queries over polls and classified listens, with their SQL."""

from __future__ import annotations

from tapedeck.operators import events as e
from tapedeck.operators import recommend as r
from tapedeck.sources.bridge import EVENTS_SQL, POLLS_SQL, play_events, polls, snapshots

AS_OF = "2024-01-31"
OUTCOMES = ", ".join(f"sum((classification = '{o}')::INT)::BIGINT AS {o}" for o in e.OUTCOMES)
RATE = "CASE WHEN events > abandoned THEN round(skipped / (events - abandoned), 6) END AS skip_rate"
LINKED = "linked AS (SELECT e.*, s.snapshot_id, daylight_phase, weather_condition, location_label FROM play_events e ASOF LEFT JOIN snapshots s ON s.captured_at <= e.ended_at)"
AFFINITY = f"""{LINKED}, long AS (SELECT track_id, classification IN ('completed', 'replayed') AS done, unnest(['daylight_phase', 'weather_condition', 'location_label']) AS dimension, unnest([daylight_phase, weather_condition, location_label]) AS bucket FROM linked),
 affinities AS (SELECT track_id, dimension, bucket, round(greatest(0.5, least(2.0, 1 + ((n / of_track) / (in_bucket / (SELECT count(*) FROM linked)) - 1) * least(1.0, n / 10))), 6) AS affinity, n AS sample_size
 FROM (SELECT track_id, dimension, bucket, count(*) AS n FROM long WHERE done AND bucket IS NOT NULL GROUP BY ALL) JOIN (SELECT dimension, bucket, count(*) AS in_bucket FROM long GROUP BY ALL) USING (dimension, bucket)
 JOIN (SELECT track_id, count(*) AS of_track FROM linked WHERE classification IN ('completed', 'replayed') GROUP BY ALL) USING (track_id)) """
TRACKS = f"SELECT track_id, count(*) AS play_count, {OUTCOMES}, max(ended_at) AS last_played FROM play_events GROUP BY track_id"
TRACK_TASTE = f"SELECT * EXCLUDE (abandoned, d), floor((log2(1 + play_count) * 0.5 - skipped * 1.5 + completed * 0.3 + replayed * 2 + CASE WHEN d < 30 THEN 2 * (1 - d / 30) ELSE 0 END) * 100 + 0.5) / 100 AS score FROM (SELECT *, (epoch(TIMESTAMP '{AS_OF}') - floor(epoch(last_played))) / 86400 AS d FROM ({TRACKS}))"
ARTISTS = "SELECT artist_id, count(*) AS plays, count(DISTINCT track_id) AS tracks FROM (SELECT track_id, unnest(list_distinct(artist_ids)) AS artist_id FROM play_events) GROUP BY artist_id"
DERIVED = """, a AS (SELECT *, lag(observed_at) OVER w AS was, lag(is_playing) OVER w AS p_on, lag(track_id) OVER w AS p_track, lag(progress_ms) OVER w AS p_progress, lead(observed_at) OVER w AS ended_at, lead(track_id) OVER w AS n_track, lead(progress_ms) OVER w AS n_progress FROM polls WINDOW w AS (PARTITION BY user_id ORDER BY observed_at, poll_id)),
 b AS (SELECT *, sum(CASE WHEN is_playing AND p_on AND p_track = track_id AND progress_ms >= p_progress - 5000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY observed_at, poll_id) AS segment FROM a),
 c AS (SELECT user_id, min(track_id) AS track_id, min(observed_at) AS started_at, arg_max(ended_at, observed_at) AS ended_at, arg_max(progress_ms, observed_at) AS progress_ms, arg_max({'d': duration_ms}, observed_at).d AS duration_ms, arg_max(n_track, observed_at) AS n_track, arg_max(n_progress, observed_at) AS n_progress, max(observed_at) AS last_at FROM b WHERE is_playing GROUP BY user_id, segment),
 d AS (SELECT c.* EXCLUDE (ended_at), x.ended_at, (epoch_us(x.ended_at) - epoch_us(started_at)) // 1000 AS duration_listened_ms FROM c JOIN a x ON x.user_id = c.user_id AND x.observed_at = last_at WHERE x.ended_at IS NOT NULL),
 f AS (SELECT *, CASE WHEN n_track = track_id AND n_progress < progress_ms - 5000 THEN 'replayed' WHEN (CASE WHEN duration_ms > 0 THEN progress_ms / duration_ms >= 0.8 ELSE duration_listened_ms > 60000 END) THEN 'completed' ELSE 'abandoned' END AS classification FROM d WHERE duration_listened_ms >= 5000),
 g AS (SELECT *, lead(track_id) OVER (PARTITION BY user_id ORDER BY ended_at, started_at) AS follows FROM f)
 SELECT user_id, track_id, started_at, ended_at, duration_listened_ms, duration_ms::BIGINT AS track_duration_ms, classification, hour(started_at - INTERVAL 5 HOURS)::INT AS hour_of_day, dayofweek(started_at - INTERVAL 5 HOURS)::INT AS day_of_week FROM g"""


def _linked(spark, sf_dir):
    return e.as_of_join(play_events(spark, sf_dir), snapshots(spark, sf_dir), left_ts="ended_at", right_ts="captured_at", take=["snapshot_id", *e.DIMENSIONS])


def _track_taste(spark, sf_dir):
    return e.track_taste(e.track_play_stats(play_events(spark, sf_dir)), as_of=AS_OF)


JOBS = {
    "c01_segments": (lambda s, d: e.derive_play_events(polls(s, d), reconcile=False), POLLS_SQL + DERIVED),
    "c02_reconciled": (lambda s, d: e.derive_play_events(polls(s, d)), POLLS_SQL + DERIVED + " WHERE classification <> 'abandoned' OR follows IS NULL OR follows <> track_id"),
    "c04_link_context": (lambda s, d: _linked(s, d).select("event_id", "snapshot_id", "daylight_phase"), f"{EVENTS_SQL}, {LINKED} SELECT event_id, snapshot_id, daylight_phase FROM linked"),
    "e02_track_play_stats": (lambda s, d: e.track_play_stats(play_events(s, d)), f"{EVENTS_SQL} SELECT * EXCLUDE (abandoned) FROM ({TRACKS})"),
    "e03_artist_play_stats": (lambda s, d: e.artist_play_stats(play_events(s, d)), EVENTS_SQL + ARTISTS),
    "e04_artist_taste": (lambda s, d: e.artist_taste(e.artist_play_stats(play_events(s, d))), f"{EVENTS_SQL} SELECT *, floor((log2(1 + plays) * 0.5 + least(tracks, 10) * 0.3) * 100 + 0.5) / 100 AS score FROM ({ARTISTS})"),
    "j11_top_artists_by_taste": (lambda s, d: r.top_by_taste(e.artist_taste(e.artist_play_stats(play_events(s, d))), "artist_id"), f"{EVENTS_SQL} SELECT *, floor((log2(1 + plays) * 0.5 + least(tracks, 10) * 0.3) * 100 + 0.5) / 100 AS score FROM ({ARTISTS}) ORDER BY score DESC, artist_id LIMIT 30"),
    "e05_track_taste": (_track_taste, f"{EVENTS_SQL} {TRACK_TASTE}"),
    "e06_context_affinity": (lambda s, d: e.context_affinity(_linked(s, d)), f"{EVENTS_SQL}, {AFFINITY} SELECT * FROM affinities"),
    "e07_top_affinities": (lambda s, d: e.top_affinities(e.context_affinity(_linked(s, d))), f"{EVENTS_SQL}, {AFFINITY} SELECT *, row_number() OVER (PARTITION BY dimension, bucket ORDER BY affinity DESC, sample_size DESC, track_id)::INT AS rank FROM affinities WHERE sample_size >= 5 AND abs(affinity - 1) > 0.1 QUALIFY rank <= 5"),
    "j01_event_stats": (lambda s, d: e.event_stats(play_events(s, d)), f"{EVENTS_SQL} SELECT *, {RATE} FROM (SELECT count(*) AS events, {OUTCOMES} FROM play_events)"),
    "j02_daily_summary": (lambda s, d: e.daily_summary(play_events(s, d), as_of="2024-01-20"), f"{EVENTS_SQL} SELECT count(*) AS events, {OUTCOMES}, floor(sum(duration_listened_ms) / 60000)::BIGINT AS minutes, count(DISTINCT track_id) AS tracks FROM play_events WHERE ended_at >= TIMESTAMP '2024-01-19' AND ended_at < TIMESTAMP '2024-01-20'"),
    "j05_session_performance": (lambda s, d: e.session_performance(play_events(s, d)), f"{EVENTS_SQL} SELECT *, {RATE}, round((completed + replayed) / events, 6) AS success FROM (SELECT session_id, count(*) AS events, {OUTCOMES} FROM play_events WHERE session_id IS NOT NULL GROUP BY 1)"),
    "j06_calibration": (lambda s, d: e.calibration(play_events(s, d), _track_taste(s, d)), f"{EVENTS_SQL} SELECT *, {RATE} FROM (SELECT CASE WHEN score >= 10 THEN 'high' WHEN score >= 5 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'none' END AS tier, count(*) AS events, {OUTCOMES} FROM play_events JOIN (SELECT track_id, score FROM ({TRACK_TASTE})) USING (track_id) GROUP BY 1)"),
    "j01_top_tracks": (lambda s, d: e.top_tracks(play_events(s, d)), f"{EVENTS_SQL} SELECT track_id, count(*) AS plays FROM play_events WHERE classification IN ('completed', 'replayed') GROUP BY 1 ORDER BY plays DESC, track_id LIMIT 10"),
    "j03_by_listener": (lambda s, d: e.event_stats(play_events(s, d), ("user_id",)), f"{EVENTS_SQL} SELECT *, {RATE} FROM (SELECT user_id, count(*) AS events, {OUTCOMES} FROM play_events GROUP BY 1)"),
    "j04_recent_history": (lambda s, d: e.recent_history(play_events(s, d), _track_taste(s, d)), f"{EVENTS_SQL} SELECT event_id, ended_at, track_id, classification, session_id, score FROM play_events LEFT JOIN (SELECT track_id, score FROM ({TRACK_TASTE})) USING (track_id) ORDER BY ended_at DESC, event_id DESC LIMIT 50"),
    "j09_context_maturity": (lambda s, d: e.context_maturity(e.context_affinity(_linked(s, d))), f"{EVENTS_SQL}, {AFFINITY} SELECT dimension, count(DISTINCT bucket) AS buckets, count(DISTINCT CASE WHEN sample_size >= 5 THEN bucket END) AS trained, round(avg(sample_size), 6) AS mean_samples FROM affinities GROUP BY 1"),
}
