"""Queries over whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

from tapedeck.operators import history as h
from tapedeck.operators.sessions import sessionize
from tapedeck.plans import dashboards, details, events, explain, feeds, library, periods, planning, queues, recommend, versions
from tapedeck.sources.bridge import PLAYS_SQL, plays, short_plays

AS_OF = "2001-11-05"


def _of(job, **how):
    return lambda spark, sf_dir: job(plays(spark, sf_dir), **how)


_YEARS = f"(epoch(TIMESTAMP '{AS_OF}') - floor(epoch(ts))) / (365.25 * 86400)"
_AFFINITY = f"round(sum(least(minutes, 7.0) * exp(-({_YEARS}) / 3) * CASE WHEN reason_end = 'trackdone' THEN 1.5 ELSE 1.0 END), 2) AS affinity"

JOBS = {
    "d02_period_stats": (_of(h.period_stats), "SELECT year, count(*) AS plays, floor(sum(minutes) / 60 * 10 + 0.5) / 10 AS hours, count(DISTINCT (tkey, akey)) AS songs, count(DISTINCT akey) AS artists FROM plays GROUP BY year"),
    "d02_period_rollup": (
        _of(h.period_rollup),
        "SELECT year, month, CASE WHEN grouping(year) = 1 THEN 'all' WHEN grouping(month) = 1 THEN 'year' ELSE 'month' END AS level, count(*) AS plays, floor(sum(minutes) / 60 * 10 + 0.5) / 10 AS hours, count(DISTINCT (tkey, akey)) AS songs, count(DISTINCT akey) AS artists FROM plays GROUP BY ROLLUP (year, month)",
    ),
    "d03_top_songs": (_of(h.top_songs), "SELECT tkey, akey, count(*) AS plays, sum(minutes) AS minutes FROM plays GROUP BY ALL ORDER BY plays DESC, tkey, akey LIMIT 20"),
    "d04_top_artists": (_of(h.top_artists), "SELECT akey, count(*) AS plays, sum(minutes) AS minutes FROM plays GROUP BY ALL ORDER BY plays DESC, akey LIMIT 20"),
    "d01_load_plays": (
        lambda spark, sf_dir: h.load_plays(plays(spark, sf_dir), year=1995, artist="BRAND#7", ios_only=True, limit=200).select("ts", "uri", "user_id", "artist_name", "platform"),
        "SELECT ts, uri, user_id, artist_name, platform FROM plays WHERE year = 1995 AND akey = 'brand#7' AND platform = 'iOS' ORDER BY ts DESC, uri, user_id LIMIT 200",
    ),
    "d02_period_stats_by_listener": (_of(h.period_stats, by=("user_id", "year", "month")), "SELECT user_id, year, month, count(*) AS plays, floor(sum(minutes) / 60 * 10 + 0.5) / 10 AS hours, count(DISTINCT (tkey, akey)) AS songs, count(DISTINCT akey) AS artists FROM plays GROUP BY ALL"),
    "d03_top_songs_by_listener": (_of(h.top_songs, limit=3, by=("user_id",)), "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY plays DESC, tkey, akey)::INT AS rank FROM (SELECT user_id, tkey, akey, count(*) AS plays, sum(minutes) AS minutes FROM plays GROUP BY ALL) QUALIFY rank <= 3"),
    "d04_top_artists_by_year": (_of(h.top_artists, limit=5, by=("year",)), "SELECT *, row_number() OVER (PARTITION BY year ORDER BY plays DESC, akey)::INT AS rank FROM (SELECT year, akey, count(*) AS plays, sum(minutes) AS minutes FROM plays GROUP BY ALL) QUALIFY rank <= 5"),
    "d05_monthly_top": (_of(h.monthly_top), "SELECT * FROM (SELECT year, month, tkey, akey, count(*) AS plays, row_number() OVER (PARTITION BY year, month ORDER BY count(*) DESC, tkey, akey)::INT AS rank FROM plays GROUP BY year, month, tkey, akey) WHERE rank <= 5"),
    "d06_lost_favorites": (
        _of(h.lost_favorites, as_of=AS_OF, min_plays=5, years_gone=0.25),
        f"""SELECT s.tkey, s.akey, plays, last_played, uri, m.year AS peak_year, m.month AS peak_month, m.n AS peak_plays
 FROM (SELECT tkey, akey, sum(n)::BIGINT AS plays, max(last) AS last_played, max((n, uri))[2] AS uri FROM (SELECT tkey, akey, uri, count(*) AS n, max(ts) AS last FROM plays GROUP BY ALL) GROUP BY ALL) s
 JOIN (SELECT tkey, akey, year, month, count(*) AS n, row_number() OVER (PARTITION BY tkey, akey ORDER BY count(*) DESC, year DESC, month DESC) AS k FROM plays GROUP BY tkey, akey, year, month) m ON s.tkey = m.tkey AND s.akey = m.akey AND k = 1
 WHERE plays >= 5 AND last_played < TIMESTAMP '{AS_OF}' + INTERVAL 1 DAY - to_seconds(0.25 * 365.25 * 86400) ORDER BY plays DESC, s.tkey, s.akey LIMIT 50""",
    ),
    "d07_artist_affinity": (_of(h.artist_affinity, as_of=AS_OF), f"SELECT akey, count(*) AS plays, {_AFFINITY} FROM plays GROUP BY akey"),
    "d08_track_affinity": (_of(h.track_affinity, as_of=AS_OF), f"SELECT uri, count(*) AS plays, {_AFFINITY} FROM plays GROUP BY uri"),
    "d10_skip_penalized": (_of(h.skip_penalized, as_of="1995-06-01", days=90, least=1, under_ms=200_000), "SELECT uri, count(*) AS skips FROM plays WHERE ts >= TIMESTAMP '1995-06-01' - INTERVAL 90 DAY AND reason_end = 'fwdbtn' AND ms_played < 200000 GROUP BY uri"),
    "d17_lifetime_totals": (_of(h.lifetime_totals), "SELECT count(*) AS plays, count(DISTINCT (track_name, artist_name)) AS songs, count(DISTINCT artist_name) AS artists, min(ts) AS first_play, max(ts) AS last_play FROM plays"),
    "d20_skip_rate_by_quarter": (_of(h.skip_rate_by_quarter), "SELECT year, quarter(ts)::INT AS quarter, count(*) AS plays, round(avg(CASE WHEN reason_end = 'fwdbtn' THEN 1 ELSE 0 END), 6) AS skip_rate FROM plays GROUP BY ALL"),
    "d21_discovery_by_year": (_of(h.discovery_by_year), "SELECT year, count(*) AS new_songs FROM (SELECT tkey, akey, min(year) AS year FROM plays GROUP BY ALL) GROUP BY year"),
    "d22_concentration": (_of(h.concentration_by_year), "SELECT year, round(sum(CASE WHEN k <= 100 THEN n ELSE 0 END) / sum(n), 6) AS share FROM (SELECT year, tkey, akey, count(*) AS n, row_number() OVER (PARTITION BY year ORDER BY count(*) DESC, tkey, akey) AS k FROM plays GROUP BY year, tkey, akey) GROUP BY year"),
    "d23_hourly": (_of(h.hourly), "SELECT local_hour, count(*) AS plays FROM plays GROUP BY ALL"),
    "d23_day_of_week": (_of(h.day_of_week), "SELECT dayofweek(ts)::INT AS day, count(*) AS plays FROM plays GROUP BY ALL"),
    "d27_never_stale_core": (_of(h.never_stale_core, top=10, years=3), "SELECT akey, count(*) AS years_in_top FROM (SELECT year, akey, row_number() OVER (PARTITION BY year ORDER BY count(*) DESC, akey) AS k FROM plays GROUP BY year, akey) WHERE k <= 10 GROUP BY akey HAVING count(*) >= 3"),
    "d30_skip_report": (_of(h.skip_report), "SELECT tkey, akey, count(*) AS plays, sum(CASE WHEN reason_end = 'fwdbtn' THEN 1 ELSE 0 END)::BIGINT AS skips, round(sum(CASE WHEN reason_end = 'fwdbtn' THEN 1 ELSE 0 END) / count(*), 6) AS skip_rate FROM plays GROUP BY ALL HAVING count(*) >= 20"),
    "f01_graph_nodes": (_of(h.graph_nodes), "SELECT akey, sum(n)::BIGINT AS plays, max((n, year))[2] AS peak_year, sum(CASE WHEN n >= 5 THEN 1 ELSE 0 END)::BIGINT AS active_years FROM (SELECT akey, year, count(*) AS n FROM plays GROUP BY ALL) GROUP BY akey HAVING sum(n) >= 300"),
}
SHORT_SQL = "WITH p AS (SELECT event_id AS play_id, ts, user_id, value / 60 AS minutes FROM events) "
SHORT = {
    "c06_sessions": (
        lambda spark, sf_dir: sessionize(short_plays(spark, sf_dir), gap_minutes=720),
        """SELECT user_id, session::BIGINT AS session, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS plays, round(sum(minutes), 4) AS minutes FROM (
 SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, play_id ROWS UNBOUNDED PRECEDING) AS session FROM (
 SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, play_id)) <= 720 * 60000000::BIGINT THEN 0 ELSE 1 END AS new FROM p)) GROUP BY user_id, session""",
    ),
}
WHOLE = {name: (job, PLAYS_SQL + sql) for name, (job, sql) in JOBS.items()} | {name: (job, SHORT_SQL + sql) for name, (job, sql) in SHORT.items()} | events.JOBS | periods.JOBS | library.JOBS | recommend.JOBS | planning.JOBS | feeds.JOBS | explain.JOBS | details.JOBS | queues.JOBS | versions.JOBS | dashboards.JOBS
QUERIES = {name: job for name, (job, _) in WHOLE.items()}
SQL = {name: sql for name, (_, sql) in WHOLE.items() if sql}
