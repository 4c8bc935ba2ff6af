"""Queries over totals, series and nested lists, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapedeck.operators import details as d
from tapedeck.operators import history as h
from tapedeck.operators import periods as p
from tapedeck.plans.periods import ERAS, LOCAL, SKIP
from tapedeck.sources.bridge import NAMED_SQL, PLAYS_SQL, named_plays, plays

AS_OF = "1995-09-01"
TOTALS = "count(*) AS plays, floor(sum(minutes) * 10 + 0.5) / 10 AS minutes, count(DISTINCT (tkey, akey)) AS songs, count(DISTINCT artist_name) AS artists"
ERA = "CASE " + " ".join(f"WHEN {{}} IN ({', '.join(map(str, years))}) THEN '{name}'" for name, years in ERAS.items()) + " END"


def _of(job, **how):
    return lambda spark, sf_dir: job(plays(spark, sf_dir), **how)


def _text(array: str, *fields: str):
    """An array of structs as text, so that results compare as values."""
    return F.array_join(F.transform(array, lambda x: F.concat_ws(":", *[F.date_format(x[f], "yyyy-MM-dd HH:mm:ss") if f == "last_play" else x[f].cast("string") for f in fields])), "|").alias(array)


def _profiles(spark, sf_dir):
    named = named_plays(spark, sf_dir)
    rows = named.withColumns({"track_name": F.col("uri"), "year": F.dayofmonth("ts")})
    out = d.artist_profiles(rows, p.companions(named, gap_minutes=720), core_top=3, core_years=3, tracks=3)
    return out.select("akey", _text("years", "year", "plays"), "years_in_top", "core", _text("tracks", "track", "plays", "last_play"), _text("companions", "artist", "sessions"))


def _adjusted(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 3 > 0").selectExpr("p_partkey AS artist_id", "p_brand AS artist_name")
    return d.adjusted_artist_series(plays(spark, sf_dir), parts).withColumn("plays_by_year", _text("plays_by_year", "year", "plays"))


def _eras(spark, sf_dir):
    rows = d.era_details(plays(spark, sf_dir), ERAS)
    return rows.select("era", "plays", "hours", "tracks", "artists", "skip_rate", "top_song.track", "top_song.artist", F.col("top_song.plays").alias("top_plays"), F.array_join(F.transform("top_artists", lambda x: F.concat_ws(":", x.artist, x.plays.cast("string"), F.round(x.hours * 10).cast("long").cast("string"))), "|").alias("top_artists"), _text("years", "year", "plays"))


def _tracks(spark, sf_dir):
    return d.track_series(plays(spark, sf_dir), ERAS).withColumn("months", _text("months", "month", "plays"))


def _majority(spark, sf_dir):
    years = plays(spark, sf_dir).groupBy("user_id").agg(F.sort_array(F.collect_set("year")).alias("years"))
    return years.select("user_id", d.majority_era("years", ERAS).alias("era"))


SKIPS = """songs AS (SELECT {by}tkey, akey, count(*) AS plays, sum((reason_end = 'fwdbtn')::INT)::BIGINT AS skips FROM plays WHERE ts < TIMESTAMP '{as_of}'{since} GROUP BY ALL),
 kinds AS (SELECT {by}'overall' AS kind, 0 AS rank, NULL::VARCHAR AS tkey, NULL::VARCHAR AS akey, sum(plays)::BIGINT AS plays, sum(skips)::BIGINT AS skips FROM songs {group} UNION ALL
  SELECT {by}'skipped', (row_number() OVER ({part}ORDER BY skips / plays DESC, plays DESC, tkey, akey))::INT AS rank, tkey, akey, plays, skips FROM songs WHERE plays >= {least} AND skips > 0 QUALIFY rank <= 15 UNION ALL
  SELECT {by}'champion', (row_number() OVER ({part}ORDER BY plays DESC, tkey, akey))::INT AS rank, tkey, akey, plays, skips FROM songs WHERE plays >= {least} AND skips = 0 QUALIFY rank <= 10) SELECT *, floor(skips / plays * 100 * 10 + 0.5) / 10 AS skip_rate FROM kinds"""

LONG = {
    "d11_day_totals": (_of(d.on_this_day_totals, month=7, day=4), f"SELECT {TOTALS}, array_to_string(list_sort(list(DISTINCT year({LOCAL}))), ',') AS years FROM plays WHERE month({LOCAL}) = 7 AND day({LOCAL}) = 4"),
    "d12_range_totals": (
        _of(d.date_range_totals, start="1990-01-01", end="1995-03-31", as_of="1995-03-15"),
        f"""SELECT s AS effective_start, DATE '1995-03-15' AS effective_end, (DATE '1995-03-15' - s + 1)::INT AS days_in_range, t.* FROM (SELECT min(ts - INTERVAL 5 HOURS)::DATE AS s FROM plays), (SELECT count(DISTINCT {LOCAL}::DATE) AS days_with_plays, {TOTALS} FROM plays WHERE {LOCAL}::DATE <= DATE '1995-03-15') t""",
    ),
    "d12_range_totals_by_listener": (
        _of(d.date_range_totals, start="1995-02-01", end="1995-06-30", as_of="1995-06-15", by=("user_id",)),
        f"""SELECT user_id, CASE WHEN s <= DATE '1995-06-15' THEN greatest(s, DATE '1995-02-01') ELSE DATE '1995-02-01' END AS effective_start, CASE WHEN s <= DATE '1995-06-15' THEN DATE '1995-06-15' ELSE DATE '1995-06-30' END AS effective_end, CASE WHEN s <= DATE '1995-06-15' THEN (DATE '1995-06-15' - greatest(s, DATE '1995-02-01') + 1)::INT ELSE 0 END AS days_in_range,
 coalesce(days_with_plays, 0) AS days_with_plays, coalesce(plays, 0) AS plays, coalesce(minutes, 0) AS minutes, coalesce(songs, 0) AS songs, coalesce(artists, 0) AS artists FROM (SELECT user_id, min({LOCAL})::DATE AS s FROM plays GROUP BY 1) LEFT JOIN
 (SELECT user_id, count(DISTINCT {LOCAL}::DATE) AS days_with_plays, {TOTALS} FROM plays WHERE {LOCAL}::DATE BETWEEN DATE '1995-02-01' AND DATE '1995-06-15' GROUP BY 1) USING (user_id)""",
    ),
    "d12_range_artists": (_of(d.date_range_artists, start="1999-03-01", end="1999-05-31"), f"SELECT akey, count(*) AS plays, sum(minutes) AS minutes FROM plays WHERE {LOCAL}::DATE BETWEEN DATE '1999-03-01' AND DATE '1999-05-31' GROUP BY 1 ORDER BY plays DESC, akey LIMIT 25"),
    "d15_track_series": (
        _tracks,
        f"""SELECT tkey, akey, string_agg(month || ':' || n, '|' ORDER BY month) AS months, {ERA.replace('{}', 'min(year)')} AS era, floor(sum(done) / sum(n) * 100 * 10 + 0.5) / 10 AS completion, (SELECT floor(sum((reason_end = 'trackdone')::INT) / count(*) * 100 * 10 + 0.5) / 10 FROM plays) AS overall_completion
 FROM (SELECT tkey, akey, year, format('{{:04d}}-{{:02d}}', year, month) AS month, count(*) AS n, sum((reason_end = 'trackdone')::INT) AS done FROM plays GROUP BY ALL) GROUP BY tkey, akey""",
    ),
    "d25_adjusted_series": (
        _adjusted,
        """, years AS (SELECT akey, year, count(*) AS n FROM plays GROUP BY ALL), span AS (SELECT min(year) AS lo, max(year) AS hi FROM plays), a AS (SELECT akey, list_sort(list(n)) AS c, sum(n)::BIGINT AS plays, (-max((n, -year))[2])::INT AS peak_year FROM years GROUP BY akey),
 top AS (SELECT akey, plays, list_sum(list_transform(c, lambda x: least(x, 2 * c[len(c) // 2 + 1])))::BIGINT AS adjusted, peak_year FROM a ORDER BY adjusted DESC, akey LIMIT 12),
 ids AS (SELECT translate(p_brand, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS akey, min(p_partkey) AS artist_id FROM part WHERE p_partkey % 3 > 0 GROUP BY 1),
 grid AS (SELECT top.*, artist_id, unnest(range(lo, hi + 1)) AS y FROM top LEFT JOIN ids USING (akey), span)
 SELECT g.akey, plays, adjusted, peak_year, artist_id, string_agg(y || ':' || coalesce(n, 0), '|' ORDER BY y) AS plays_by_year FROM grid g LEFT JOIN years ON years.akey = g.akey AND year = y GROUP BY ALL""",
    ),
    "d29_era_details": (
        _eras,
        f""", rows AS (SELECT *, {ERA.replace('{}', 'year')} AS era FROM plays), e AS (SELECT * FROM rows WHERE era IS NOT NULL),
 songs AS (SELECT era, tkey, akey, count(*) AS n FROM e GROUP BY era, tkey, akey QUALIFY row_number() OVER (PARTITION BY era ORDER BY n DESC, tkey, akey) = 1),
 best AS (SELECT era, akey, count(*) AS n, floor(sum(minutes) / 60 * 10 + 0.5)::BIGINT AS h, row_number() OVER (PARTITION BY era ORDER BY count(*) DESC, akey) AS k FROM e GROUP BY era, akey QUALIFY k <= 8)
 SELECT t.era, plays, hours, tracks, artists, skip_rate, tkey AS track, akey AS artist, n AS top_plays, top_artists, years FROM (SELECT era, count(*) AS plays, floor(sum(minutes) / 60 * 10 + 0.5) / 10 AS hours, count(DISTINCT uri) AS tracks, count(DISTINCT akey) AS artists, floor(sum({SKIP}) / count(*) * 100 * 10 + 0.5) / 10 AS skip_rate FROM e GROUP BY era) t
 JOIN songs USING (era) JOIN (SELECT era, string_agg(akey || ':' || n || ':' || h, '|' ORDER BY k) AS top_artists FROM best GROUP BY era) USING (era) JOIN (SELECT era, string_agg(year || ':' || n, '|' ORDER BY year) AS years FROM (SELECT era, year, count(*) AS n FROM e GROUP BY ALL) GROUP BY era) USING (era)""",
    ),
    "d29_majority_era": (_majority, f"SELECT user_id, (SELECT e FROM (SELECT {ERA.replace('{}', 'y')} AS e, y FROM (SELECT unnest(years) AS y)) WHERE e IS NOT NULL GROUP BY e ORDER BY count(*) DESC, min(y) LIMIT 1) AS era FROM (SELECT user_id, list(DISTINCT year) AS years FROM plays GROUP BY 1)"),
    "d30_skip_overview": (_of(d.skip_overview, as_of=AS_OF, period="all", least=10), ", " + SKIPS.format(by="", part="", group="", as_of=AS_OF, since="", least=10)),
    "d30_skip_overview_by_listener": (
        _of(d.skip_overview, as_of=AS_OF, period="year", least=2, by=("user_id",)),
        ", " + SKIPS.format(by="user_id, ", part="PARTITION BY user_id ", group="GROUP BY user_id", as_of=AS_OF, since=f" AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY", least=2),
    ),
    "d30_current_penalties": (
        _of(d.current_penalties, as_of=AS_OF, days=90, least=1, under_ms=200_000),
        f"SELECT uri, max((ts, track_name, artist_name))[2] AS track_name, max((ts, track_name, artist_name))[3] AS artist_name, count(*) AS skips FROM plays WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY AND reason_end = 'fwdbtn' AND ms_played < 200000 GROUP BY uri",
    ),
}
PROFILES = """, sess AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, play_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, play_id)) <= 720 * 60000000::BIGINT THEN 0 ELSE 1 END AS new FROM plays)),
 heard AS (SELECT DISTINCT user_id, session, artist_name FROM sess), most AS (SELECT artist_name FROM plays GROUP BY 1 ORDER BY count(*) DESC, artist_name LIMIT 12),
 near AS (SELECT lower(a.artist_name) AS akey, b.artist_name AS companion, count(*) AS n FROM heard a JOIN most USING (artist_name) JOIN heard b ON a.user_id = b.user_id AND a.session = b.session AND a.artist_name <> b.artist_name GROUP BY a.artist_name, b.artist_name QUALIFY row_number() OVER (PARTITION BY a.artist_name ORDER BY n DESC, companion) <= 5),
 r AS (SELECT lower(artist_name) AS akey, uri AS tkey, day(ts) AS year, ts FROM plays), y AS (SELECT akey, year, count(*) AS n, row_number() OVER (PARTITION BY year ORDER BY count(*) DESC, akey) AS k FROM r GROUP BY akey, year),
 t AS (SELECT akey, tkey, count(*) AS n, max(ts) AS last, row_number() OVER (PARTITION BY akey ORDER BY count(*) DESC, tkey) AS k FROM r GROUP BY akey, tkey QUALIFY k <= 3)
 SELECT y.akey, years, years_in_top, years_in_top >= 3 AS core, tracks, companions FROM (SELECT akey, string_agg(year || ':' || n, '|' ORDER BY year) AS years, sum((k <= 3)::INT)::BIGINT AS years_in_top FROM y GROUP BY akey) y
 JOIN (SELECT akey, string_agg(tkey || ':' || n || ':' || strftime(last, '%Y-%m-%d %H:%M:%S'), '|' ORDER BY k) AS tracks FROM t GROUP BY akey) USING (akey) LEFT JOIN (SELECT akey, string_agg(companion || ':' || n, '|' ORDER BY n DESC, companion) AS companions FROM near GROUP BY akey) USING (akey)"""
JOBS = {name: (job, PLAYS_SQL + sql) for name, (job, sql) in LONG.items()} | {"d16_artist_profiles": (_profiles, NAMED_SQL + PROFILES)}


def _each(job, **how):
    return _of(job, by=("user_id",), **how)


_RANK = "row_number() OVER (PARTITION BY user_id ORDER BY plays DESC, tkey, akey)::INT AS rank"
LISTENERS = {
    "d05_monthly_top_by_listener": (_each(h.monthly_top, n=2), "SELECT * FROM (SELECT user_id, year, month, tkey, akey, count(*) AS plays, row_number() OVER (PARTITION BY user_id, year, month ORDER BY count(*) DESC, tkey, akey)::INT AS rank FROM plays GROUP BY user_id, year, month, tkey, akey) WHERE rank <= 2"),
    "d06_lost_favorites_by_listener": (
        _each(h.lost_favorites, as_of="2001-11-05", min_plays=2, years_gone=0.25, limit=3),
        f""", u AS (SELECT user_id, tkey, akey, uri, year, month, count(*) AS n, max(ts) AS last FROM plays GROUP BY ALL), m AS (SELECT user_id, tkey, akey, max((n, year, month)) AS peak FROM (SELECT user_id, tkey, akey, year, month, sum(n)::BIGINT AS n FROM u GROUP BY ALL) GROUP BY ALL),
 s AS (SELECT user_id, tkey, akey, sum(n)::BIGINT AS plays, max(last) AS last_played, max((n, uri))[2] AS uri FROM (SELECT user_id, tkey, akey, uri, sum(n) AS n, max(last) AS last FROM u GROUP BY ALL) GROUP BY ALL)
 SELECT user_id, tkey, akey, plays, last_played, uri, peak[2] AS peak_year, peak[3] AS peak_month, peak[1] AS peak_plays, {_RANK} FROM s JOIN m USING (user_id, tkey, akey) WHERE plays >= 2 AND last_played < TIMESTAMP '2001-11-06' - to_seconds(0.25 * 365.25 * 86400) QUALIFY rank <= 3""",
    ),
    "d10_skip_penalized_by_listener": (_each(h.skip_penalized, as_of="1995-06-01", days=3000, least=1, under_ms=200_000), "SELECT user_id, uri, count(*) AS skips FROM plays WHERE ts >= TIMESTAMP '1995-06-01' - INTERVAL 3000 DAY AND reason_end = 'fwdbtn' AND ms_played < 200000 GROUP BY ALL"),
    "d17_lifetime_totals_by_listener": (_each(h.lifetime_totals), "SELECT user_id, count(*) AS plays, count(DISTINCT (track_name, artist_name)) AS songs, count(DISTINCT artist_name) AS artists, min(ts) AS first_play, max(ts) AS last_play FROM plays GROUP BY 1"),
    "d21_discovery_by_listener": (_each(h.discovery_by_year), "SELECT user_id, year, count(*) AS new_songs FROM (SELECT user_id, tkey, akey, min(year) AS year FROM plays GROUP BY ALL) GROUP BY ALL"),
    "d22_concentration_by_listener": (_each(h.concentration_by_year, k=3), "SELECT user_id, year, round(sum(CASE WHEN k <= 3 THEN n ELSE 0 END) / sum(n), 6) AS share FROM (SELECT user_id, year, tkey, akey, count(*) AS n, row_number() OVER (PARTITION BY user_id, year ORDER BY count(*) DESC, tkey, akey) AS k FROM plays GROUP BY user_id, year, tkey, akey) GROUP BY user_id, year"),
    "d27_never_stale_core_by_listener": (_each(h.never_stale_core, top=2, years=3), "SELECT user_id, akey, count(*) AS years_in_top FROM (SELECT user_id, year, akey, row_number() OVER (PARTITION BY user_id, year ORDER BY count(*) DESC, akey) AS k FROM plays GROUP BY user_id, year, akey) WHERE k <= 2 GROUP BY user_id, akey HAVING count(*) >= 3"),
    "d16_artist_details_by_listener": (_each(p.artist_details), "SELECT a.*, songs, top_song FROM (SELECT user_id, akey, count(*) AS plays, sum(minutes) AS minutes, count(DISTINCT album_name) AS albums, min(ts) AS first_play, max(ts) AS last_play FROM plays GROUP BY ALL) a JOIN (SELECT user_id, akey, count(*) AS songs, max((n, tkey))[2] AS top_song FROM (SELECT user_id, akey, tkey, count(*) AS n FROM plays GROUP BY ALL) GROUP BY ALL) b ON a.akey = b.akey AND a.user_id = b.user_id"),
}
JOBS |= {name: (job, PLAYS_SQL + sql) for name, (job, sql) in LISTENERS.items()}
