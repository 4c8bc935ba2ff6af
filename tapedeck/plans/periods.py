"""Queries over dates, windows, the graph and ripples, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapedeck.operators import graph as g
from tapedeck.operators import history as h
from tapedeck.operators import periods as p
from tapedeck.operators import ripples as r
from tapedeck.sources.bridge import NAMED_SQL, PLAYS_SQL, named_plays, plays

AS_OF, END = "2001-11-05", "TIMESTAMP '2001-11-05'"
SKIP = "CASE WHEN reason_end = 'fwdbtn' THEN 1 ELSE 0 END"
LOCAL = "(ts - INTERVAL 5 HOURS)"
ERAS = {"early": [1995, 1996, 1997], "middle": [1998, 1999], "late": [2000, 2001]}
URIS = "(SELECT tkey, akey, max((n, uri))[2] AS uri FROM (SELECT tkey, akey, uri, count(*) AS n FROM plays GROUP BY ALL) GROUP BY ALL)"
NODES = "(SELECT akey, sum(n)::BIGINT AS plays, max((n, year))[2] AS peak_year, sum(CASE WHEN n >= 5 THEN 1 ELSE 0 END)::BIGINT AS active_years FROM (SELECT akey, year, count(*) AS n FROM plays GROUP BY ALL) GROUP BY akey HAVING sum(n) >= 300)"
DAYS = f"((epoch({END}) - floor(epoch(ts))) / 86400)"
RIPPLES = f"""(SELECT *, floor(weighted / (lifetime + 3) * 100 + 0.5) / 100 AS score FROM (SELECT uri, artist_name, count(*) AS lifetime, sum(CASE WHEN {DAYS} <= 3 THEN 3.0::DOUBLE WHEN {DAYS} <= 7 THEN 2 WHEN {DAYS} <= 14 THEN 1 ELSE 0 END) AS weighted,
 sum(({DAYS} <= 14)::INT)::BIGINT AS in_window, min(ts) AS first_play, max(ts) AS last_play, max(CASE WHEN {DAYS} > 14 THEN ts END) AS last_before FROM plays WHERE {DAYS} >= 0 GROUP BY ALL) WHERE in_window > 0 ORDER BY score DESC, last_play DESC, uri LIMIT 10)"""
BEFORE = f"plays WHERE floor(epoch(ts)) < epoch({END}) - 14 * 86400"
FAMILIAR = f""", ac AS (SELECT artist_name, count(*) AS n FROM {BEFORE} GROUP BY 1), tc AS (SELECT uri, count(*) AS n FROM {BEFORE} GROUP BY 1), k AS (SELECT r.*, coalesce(ac.n, 0) AS artist_before, coalesce(tc.n, 0) AS track_before FROM {RIPPLES} r LEFT JOIN ac USING (artist_name) LEFT JOIN tc USING (uri)),
 fam AS (SELECT *, floor((SELECT count(*) FROM ac WHERE n <= artist_before) / (SELECT count(*) FROM ac) * 100 * 0.625 + (SELECT count(*) FROM tc WHERE n <= track_before) / (SELECT count(*) FROM tc) * 100 * 0.375 + 0.5) AS familiarity FROM k) """
CO = """(SELECT least(a.artist_name, b.artist_name) AS artist_a, greatest(a.artist_name, b.artist_name) AS artist_b, count(*) AS session_co FROM plays a JOIN plays b ON a.user_id = b.user_id AND year(a.ts) = year(b.ts) AND a.artist_name <> b.artist_name
 AND (a.ts, a.play_id) < (b.ts, b.play_id) AND epoch_us(b.ts) - epoch_us(a.ts) <= 43200 * 1000000::BIGINT GROUP BY ALL)"""
LISTS = """(SELECT least(a.artist, b.artist) AS artist_a, greatest(a.artist, b.artist) AS artist_b, count(*) AS playlist_co, sum((a.w = 3)::INT)::BIGINT AS seasonal_co FROM lists a JOIN lists b ON a.user_id = b.user_id AND a.w = b.w AND a.artist <> b.artist AND a.uri < b.uri GROUP BY ALL)"""
LISTS_WITH = ", lists AS (SELECT DISTINCT user_id, dayofweek(ts) AS w, uri, artist_name AS artist FROM plays WHERE reason_end = 'trackdone') "
EDGES = f"(SELECT artist_a, artist_b, session_co, round(ln(session_co) + 2 * ln(coalesce(playlist_co + 0.5 * seasonal_co, 0) + 1), 6) AS weight FROM {CO} LEFT JOIN {LISTS} USING (artist_a, artist_b) WHERE session_co >= 3)"


def _of(job, **how):
    return lambda spark, sf_dir: job(plays(spark, sf_dir), **how)


def _co(spark, sf_dir):
    return g.session_cooccurrence(named_plays(spark, sf_dir), window_seconds=43200)


def _lists(spark, sf_dir):
    """What a listener heard to its end on a weekday stands for a playlist; those of Wednesdays for seasonal ones."""
    p = named_plays(spark, sf_dir).where("reason_end = 'trackdone'").selectExpr("concat(user_id, '/', dayofweek(ts) - 1) AS playlist_id", "dayofweek(ts) = 4 AS seasonal", "uri AS track_id", "artist_name")
    return g.playlist_cooccurrence(p.distinct())


def _edges(spark, sf_dir):
    return g.edge_weights(_co(spark, sf_dir), _lists(spark, sf_dir))


def _familiar(spark, sf_dir):
    heard = plays(spark, sf_dir)
    return r.familiarity(heard, r.ripple_scores(heard, as_of=AS_OF), as_of=AS_OF)


def _peaks(spark, sf_dir):
    """Every recording with its peak year."""
    years = plays(spark, sf_dir).groupBy("uri", "year").agg(F.count("*").alias("n"))
    return years.groupBy("uri").agg(F.max_by("year", F.struct("n", "year")).alias("peak_year"))


LONG = {
    "d09_skip_counts": (_of(p.skip_counts, as_of=AS_OF), f"SELECT uri, count(*) AS skips FROM plays WHERE ts >= {END} - INTERVAL 90 DAY AND ts < {END} AND reason_end = 'fwdbtn' GROUP BY uri"),
    "d11_on_this_day": (
        _of(p.on_this_day, month=7, day=4),
        f"""SELECT t.tkey, t.akey, uri, plays, peak[2] AS peak_year, peak[1] AS peak_plays, years FROM (SELECT tkey, akey, sum(n)::BIGINT AS plays, max((n, y)) AS peak, string_agg(y::VARCHAR, ',' ORDER BY y) AS years FROM
 (SELECT tkey, akey, year({LOCAL})::INT AS y, count(*) AS n FROM plays WHERE month({LOCAL}) = 7 AND day({LOCAL}) = 4 GROUP BY ALL) GROUP BY ALL ORDER BY plays DESC, tkey, akey LIMIT 25) t JOIN {URIS} u ON u.tkey = t.tkey AND u.akey = t.akey""",
    ),
    "d12_date_range": (_of(p.date_range, start="1999-03-01", end="1999-05-31"), f"SELECT tkey, akey, sum(n)::BIGINT AS plays, sum(m) AS minutes, max((n, uri))[2] AS uri FROM (SELECT tkey, akey, uri, count(*) AS n, sum(minutes) AS m FROM plays WHERE {LOCAL}::DATE BETWEEN DATE '1999-03-01' AND DATE '1999-05-31' GROUP BY ALL) GROUP BY ALL ORDER BY plays DESC, tkey, akey LIMIT 25"),
    "d13_daily_breakdown": (
        _of(p.daily_breakdown, start="1994-12-25", end="1995-02-10"),
        f"""SELECT c.day, coalesce(plays, 0)::BIGINT AS plays, coalesce(minutes, 0) AS minutes, top_song FROM (SELECT unnest(generate_series(TIMESTAMP '1994-12-25', TIMESTAMP '1995-02-10', INTERVAL 1 DAY))::DATE AS day) c LEFT JOIN
 (SELECT day, sum(n) AS plays, sum(m) AS minutes, max(CASE WHEN k = 1 THEN tkey END) AS top_song FROM (SELECT {LOCAL}::DATE AS day, tkey, akey, count(*) AS n, sum(minutes) AS m, row_number() OVER (PARTITION BY {LOCAL}::DATE ORDER BY count(*) DESC, tkey, akey) AS k FROM plays GROUP BY {LOCAL}::DATE, tkey, akey) GROUP BY day) d ON d.day = c.day""",
    ),
    "d14_search": (_of(p.search, q="Ring"), "SELECT * FROM (SELECT 'song' AS kind, tkey AS name, akey AS artist, count(*) AS plays FROM plays WHERE tkey LIKE '%ring%' GROUP BY ALL UNION ALL SELECT 'artist', akey, NULL, count(*) FROM plays WHERE akey LIKE '%ring%' GROUP BY ALL) ORDER BY plays DESC, kind, name, artist LIMIT 20"),
    "d15_track_details": (
        _of(p.track_details),
        f"""SELECT s.*, uri, m.ym AS peak_month, round((SELECT sum({SKIP}) / count(*) FROM plays), 6) AS overall_skip_rate FROM (SELECT tkey, akey, count(*) AS plays, sum(minutes) AS minutes, min(ts) AS first_play, max(ts) AS last_play, round(sum({SKIP}) / count(*), 6) AS skip_rate, round(sum(CASE WHEN reason_end = 'trackdone' THEN 1 ELSE 0 END) / count(*), 6) AS completion_rate FROM plays GROUP BY ALL) s
 JOIN {URIS} u ON u.tkey = s.tkey AND u.akey = s.akey JOIN (SELECT tkey, akey, (max((n, ym))[2])::INT AS ym FROM (SELECT tkey, akey, year * 100 + month AS ym, count(*) AS n FROM plays GROUP BY ALL) GROUP BY ALL) m ON m.tkey = s.tkey AND m.akey = s.akey""",
    ),
    "d16_artist_details": (_of(p.artist_details), "SELECT a.*, songs, top_song FROM (SELECT akey, count(*) AS plays, sum(minutes) AS minutes, count(DISTINCT album_name) AS albums, min(ts) AS first_play, max(ts) AS last_play FROM plays GROUP BY ALL) a JOIN (SELECT akey, count(*) AS songs, max((n, tkey))[2] AS top_song FROM (SELECT akey, tkey, count(*) AS n FROM plays GROUP BY ALL) GROUP BY ALL) b ON a.akey = b.akey"),
    "d18_week_top": (_of(p.week_top, as_of=AS_OF), f"SELECT tkey, akey, count(*) AS plays, round(sum({SKIP}) / count(*), 6) AS skip_rate FROM plays WHERE ts >= {END} - INTERVAL 7 DAY AND ts < {END} GROUP BY ALL ORDER BY plays DESC, tkey, akey LIMIT 5"),
    "d18_artist_deltas": (
        _of(p.artist_deltas, as_of="2001-06-05"),
        """SELECT akey, plays, plays - prior AS delta, floor(m / 60 * 10 + 0.5) / 10 AS hours_delta, CASE WHEN plays > prior THEN 'rising' WHEN plays < prior THEN 'falling' ELSE 'steady' END AS trend FROM (SELECT akey, sum((ts >= c)::INT)::BIGINT AS plays, sum((ts < c)::INT)::BIGINT AS prior, sum(CASE WHEN ts >= c THEN minutes ELSE -minutes END) AS m
 FROM (SELECT *, TIMESTAMP '2001-06-05' - INTERVAL 30 DAY AS c FROM plays WHERE ts >= TIMESTAMP '2001-06-05' - INTERVAL 60 DAY AND ts < TIMESTAMP '2001-06-05') GROUP BY akey) WHERE plays > 0 ORDER BY plays DESC, akey LIMIT 50""",
    ),
    "d18_skip_rate_wow": (_of(p.skip_rate_wow, as_of="1995-06-05"), f"SELECT round(avg(CASE WHEN ts >= TIMESTAMP '1995-05-29' THEN {SKIP} END), 6) AS this_week, round(avg(CASE WHEN ts < TIMESTAMP '1995-05-29' THEN {SKIP} END), 6) AS last_week FROM plays WHERE ts >= TIMESTAMP '1995-05-22' AND ts < TIMESTAMP '1995-06-05'"),
    "d19_new_entries": (_of(p.new_entries, year=1995, month=6), "SELECT tkey, akey, count(*) AS plays FROM plays GROUP BY ALL HAVING min(year * 100 + month) = 199506"),
    "d23_daylight_bands": (_of(p.daylight_bands), "SELECT CASE WHEN local_hour < 6 THEN 'night' WHEN local_hour < 12 THEN 'morning' WHEN local_hour < 18 THEN 'afternoon' ELSE 'evening' END AS band, count(*) AS plays FROM plays GROUP BY 1"),
    "d23_by_month": (_of(p.listening_by_month), "SELECT year, month, count(*) AS plays, sum(minutes) AS minutes FROM plays GROUP BY ALL"),
    "d23_heatmap": (_of(p.heatmap), f"SELECT {LOCAL}::DATE AS day, count(*) AS plays FROM plays GROUP BY 1"),
    "d24_rolling_windows": (
        _of(p.rolling_windows, as_of="2001-06-05"),
        "SELECT days, plays, prior, (CASE WHEN prior > 0 THEN floor((plays - prior) / prior * 100 + 0.5) WHEN plays > 0 THEN 100 ELSE 0 END)::DOUBLE AS change FROM (SELECT d::INT AS days, sum((ts >= e - to_days(d::INT))::INT)::BIGINT AS plays, sum((ts < e - to_days(d::INT) AND ts >= e - to_days(2 * d::INT))::INT)::BIGINT AS prior FROM (SELECT ts, TIMESTAMP '2001-06-05' AS e, unnest([7, 30]) AS d FROM plays WHERE ts < TIMESTAMP '2001-06-05') GROUP BY 1)",
    ),
    "d25_adjusted_artists": (
        _of(p.top_artists_adjusted),
        "SELECT akey, sum(n)::BIGINT AS plays, sum(least(n, 2 * median))::BIGINT AS adjusted, -(max((n, -year))[2]) AS peak_year FROM (SELECT *, list_sort(list(n) OVER (PARTITION BY akey))[(count(*) OVER (PARTITION BY akey)) // 2 + 1] AS median FROM (SELECT akey, year, count(*) AS n FROM plays GROUP BY ALL)) GROUP BY akey ORDER BY adjusted DESC, akey LIMIT 12",
    ),
    "d28_obsessions": (_of(p.obsessions), "SELECT user_id, year, month, top[1] AS plays, top[2] AS tkey, top[3] AS akey, total FROM (SELECT user_id, year, month, max((n, tkey, akey)) AS top, sum(n)::BIGINT AS total FROM (SELECT user_id, year, month, tkey, akey, count(*) AS n FROM plays GROUP BY ALL) GROUP BY ALL) WHERE top[1] > 0.5 * total AND total > 1"),
    "d28_binges": (_of(p.binges, least=3, by=()), "SELECT uri, max(n) AS most FROM (SELECT uri, count(*) OVER (PARTITION BY uri ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW) AS n FROM plays) GROUP BY uri HAVING max(n) >= 3"),
    "d28_binges_by_listener": (_of(p.binges, least=2, days=60), "SELECT user_id, uri, max(n) AS most FROM (SELECT user_id, uri, count(*) OVER (PARTITION BY user_id, uri ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 5184000 PRECEDING AND CURRENT ROW) AS n FROM plays) GROUP BY user_id, uri HAVING max(n) >= 2"),
    "d29_era_rollup": (
        _of(p.era_rollup, eras=ERAS),
        f"""SELECT e.*, top_song FROM (SELECT era, count(*) AS plays, floor(sum(minutes) / 60 * 10 + 0.5) / 10 AS hours, count(DISTINCT akey) AS artists, round(sum({SKIP}) / count(*), 6) AS skip_rate FROM k GROUP BY era) e JOIN (SELECT era, max((n, tkey, akey))[2] AS top_song FROM (SELECT era, tkey, akey, count(*) AS n FROM k GROUP BY ALL) GROUP BY era) t ON e.era = t.era""",
    ),
    "f02_top_track_per_artist": (_of(g.top_track_per_artist), "SELECT artist_name, replace(uri, 'spotify:track:', '') AS track_id, n AS plays FROM (SELECT artist_name, uri, count(*) AS n, row_number() OVER (PARTITION BY artist_name ORDER BY count(*) DESC, max(ts) DESC, uri) AS k FROM plays GROUP BY artist_name, uri) WHERE k = 1"),
    "f08_node_encodings": (
        lambda s, d: g.node_encodings(h.graph_nodes(plays(s, d))),
        f"""SELECT akey, round(3 + 21 * CASE WHEN max(sqrt(plays)) OVER () > min(sqrt(plays)) OVER () THEN (sqrt(plays) - min(sqrt(plays)) OVER ()) / (max(sqrt(plays)) OVER () - min(sqrt(plays)) OVER ()) ELSE 1 END, 4) AS radius,
 round(0.4 + 0.6 * CASE WHEN max(active_years) OVER () > min(active_years) OVER () THEN (active_years - min(active_years) OVER ()) / (max(active_years) OVER () - min(active_years) OVER ()) ELSE 1 END::DOUBLE, 4) AS opacity, row_number() OVER (ORDER BY plays * active_years DESC, akey) <= 8 AS label FROM {NODES}""",
    ),
    "f07_era_buckets": (
        lambda s, d: g.era_buckets(_peaks(s, d)),
        """SELECT i AS bucket, start_year, end_year FROM (WITH RECURSIVE y AS (SELECT list(year ORDER BY year) AS ys FROM (SELECT uri, max((n, year))[2] AS year FROM (SELECT uri, year, count(*) AS n FROM plays GROUP BY ALL) GROUP BY uri)),
 b AS (SELECT 0 AS i, ys[1] AS start_year, greatest(ys[len(ys) * 1 // 5 + 1], ys[1]) AS end_year, ys FROM y UNION ALL SELECT i + 1, end_year + 1, greatest(CASE WHEN i < 3 THEN ys[len(ys) * (i + 2) // 5 + 1] ELSE ys[len(ys)] END, end_year + 1), ys FROM b WHERE i < 4) SELECT * FROM b)""",
    ),
    "f09_graph_stats": (_of(g.graph_stats), "SELECT count(*) AS plays, count(DISTINCT artist_name) AS artists, count(DISTINCT uri) AS tracks, min(ts)::DATE AS first_day FROM plays"),
    "g01_ripple_scores": (_of(r.ripple_scores, as_of=AS_OF), f"SELECT * FROM {RIPPLES}"),
    "g02_familiarity": (_familiar, FAMILIAR + "SELECT * FROM fam"),
    "g03_split_ripples": (lambda s, d: r.split_ripples(_familiar(s, d), as_of=AS_OF).select("uri", "wave", "score"), FAMILIAR + f"SELECT uri, score, CASE WHEN floor(epoch(first_play)) >= epoch({END}) - 21 * 86400 THEN 'new arrival' ELSE 'returning' END AS wave FROM fam"),
    "g04_ripple_facts": (
        lambda s, d: r.ripple_facts(_familiar(s, d), as_of=AS_OF).select("uri", "fact", "relationship"),
        FAMILIAR
        + f"""SELECT uri, CASE WHEN artist_before = 0 THEN 'first time hearing ' || artist_name WHEN track_before <= 2 THEN 'new from ' || artist_name WHEN gap > 365 THEN 'returning after ' || floor(gap / 365)::BIGINT || CASE WHEN floor(gap / 365) = 1 THEN ' year' ELSE ' years' END
 WHEN rate > 0 AND in_window >= 5 * rate THEN in_window || ' plays this week, ' || track_before || ' before' ELSE in_window || ' plays in the last two weeks' END AS fact, CASE WHEN artist_before = 0 THEN 'brand new' WHEN artist_before < 50 THEN 'trace history' ELSE 'established' END AS relationship
 FROM (SELECT *, (epoch({END}) - floor(epoch(last_before))) / 86400 AS gap, CASE WHEN track_before > 0 THEN track_before / greatest(1, (epoch({END}) - 14 * 86400 - floor(epoch(first_play))) / (7 * 86400)) ELSE 0 END AS rate FROM fam)""",
    ),
}


NAMED = {
    "d26_companions": (
        lambda s, d: p.companions(named_plays(s, d), gap_minutes=720),
        """, ss AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, play_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, play_id)) <= 720 * 60000000::BIGINT THEN 0 ELSE 1 END AS new FROM plays)), hd AS (SELECT DISTINCT user_id, session, artist_name FROM ss)
 SELECT a.artist_name, b.artist_name AS companion, count(*) AS sessions, row_number() OVER (PARTITION BY a.artist_name ORDER BY count(*) DESC, b.artist_name)::INT AS rank FROM hd a JOIN hd b ON a.user_id = b.user_id AND a.session = b.session AND a.artist_name <> b.artist_name
 WHERE a.artist_name IN (SELECT artist_name FROM plays GROUP BY 1 ORDER BY count(*) DESC, artist_name LIMIT 12) GROUP BY a.artist_name, b.artist_name QUALIFY rank <= 5""",
    ),
    "f03_session_cooccurrence": (_co, f"SELECT * FROM {CO}"),
    "f04_playlist_cooccurrence": (_lists, f"{LISTS_WITH} SELECT * FROM {LISTS}"),
    "f05_edge_weights": (_edges, f"{LISTS_WITH} SELECT * FROM {EDGES}"),
    "f06_top_neighbors": (
        lambda s, d: g.top_neighbors(_edges(s, d)),
        f"{LISTS_WITH}, e AS {EDGES} SELECT DISTINCT artist_a, artist_b, floor(weight / (SELECT max(weight) FROM e) * 100 + 0.5) / 100 AS weight FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, artist_a, artist_b) AS k FROM (SELECT *, unnest([artist_a, artist_b]) AS node FROM e)) WHERE k <= 3",
    ),
}
ERA_CTE = ", k AS (SELECT *, CASE " + " ".join(f"WHEN year IN ({', '.join(map(str, ys))}) THEN '{e}'" for e, ys in ERAS.items()) + " END AS era FROM plays WHERE year BETWEEN 1995 AND 2001) "
JOBS = {n: (job, PLAYS_SQL + (ERA_CTE if n.startswith("d29") else "") + sql) for n, (job, sql) in LONG.items()} | {n: (job, NAMED_SQL + sql) for n, (job, sql) in NAMED.items()}
