"""Queries over what sessions picked and why, marked passages and artists by name, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tapedeck.operators import acoustics as ac
from tapedeck.operators import events as e
from tapedeck.operators import explain as x
from tapedeck.operators import loved as lo
from tapedeck.plans import recommend
from tapedeck.plans.planning import MODES, _pick
from tapedeck.sources.bridge import EVENTS_SQL, PLAYS_SQL, play_events, plays

NAMES = recommend.NAMES
KEPT = ("sleeping", "unwinding")


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sessions(spark, sf_dir):
    """Each order stands for a session, its items for the tracks."""
    o = _table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("session_id"), _pick(MODES, (F.col("o_orderkey") % 6).cast("int")).alias("mode"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderkey") % 10000).alias("snapshot_id"), F.col("o_orderdate").cast("timestamp").alias("invoked_at"))


def _session_tracks(spark, sf_dir):
    source = F.when(F.col("l_returnflag") == "R", "familiar").otherwise(F.concat(F.lit("fresh:"), F.col("l_suppkey") % 5))
    outcome = _pick(("completed", "skipped", None, "replayed"), F.col("l_linenumber") % 4)
    return _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), (F.col("l_linenumber") - 1).alias("position"), F.col("l_partkey").cast("string").alias("track_id"), source.alias("source"), outcome.alias("outcome"))


TASTE = """cast(p_partkey AS string) AS track_id, CASE WHEN p_partkey % 9 > 0 THEN p_name END AS track_name, cast(p_size % 30 AS string) AS primary_artist_id, p_size / 4 AS score, p_size % 4 = 0 AS in_liked_songs, p_size % 5 = 0 AS in_top_tracks_short, p_size % 6 = 0 AS in_top_tracks_medium,
 p_size % 7 = 0 AS in_top_tracks_long, p_size % 3 AS seasonal_playlist_count, p_partkey % 5 = 0 AS current_season_present, p_size % 13 AS play_count, p_partkey % 6 AS complete_count"""
POOL = "cast(p_partkey AS string) AS track_id, CASE WHEN p_partkey % 8 > 1 THEN concat('New ', p_name) WHEN p_partkey % 8 = 1 THEN '' END AS track_name, CASE WHEN p_size % 3 = 0 THEN concat('from ', p_brand) WHEN p_size % 3 = 1 THEN '' END AS source_detail, CASE WHEN p_size % 11 > 0 THEN p_size / 5 END AS score"
SNAPSHOTS = "event_id AS snapshot_id, CASE event_id % 3 WHEN 0 THEN 'rain' WHEN 1 THEN 'overcast' ELSE 'clear' END AS weather_condition, CASE WHEN event_id % 2 = 0 THEN 'night' ELSE 'midday' END AS daylight_phase"
SEEN = "cast(event_id % 1500 AS string) AS track_id, CASE WHEN event_id % 4 > 0 THEN concat('Seen ', event_id % 1500, ' ', event_type) END AS track_name"
FEATURES = "cast(p_partkey AS string) AS track_id, CASE WHEN p_partkey % 10 > 0 THEN p_size / 50 END AS energy, (p_partkey % 7) / 7 AS valence"


def _taste(spark, sf_dir):
    return _table(spark, sf_dir, "part").where("p_partkey % 4 < 3").selectExpr(*_split(TASTE))


def _split(columns: str) -> list[str]:
    """The columns of a select list, each of which ends in its name."""
    return re.findall(r"\s*(.+? AS [a-z_]+)(?:,|$)", columns.replace("\n", " "))


def _pool(spark, sf_dir):
    return _table(spark, sf_dir, "part").where("p_partkey % 5 < 4").selectExpr(*_split(POOL))


def _centroids(spark, sf_dir):
    fixed = ac.curated(spark).where(F.col("mode").isin(*KEPT) & F.col("dimension").isin(*NAMES))
    return ac.centroids(recommend._profile(spark, sf_dir), _sessions(spark, sf_dir), fixed)


def _explained(spark, sf_dir):
    tracks = _session_tracks(spark, sf_dir)
    fits = ac.mode_fits(tracks, _table(spark, sf_dir, "part").selectExpr(*_split(FEATURES)), _centroids(spark, sf_dir), NAMES)
    around, seen = (_table(spark, sf_dir, "events").selectExpr(*_split(c)) for c in (SNAPSHOTS, SEEN))
    rows = x.session_explain(_sessions(spark, sf_dir), tracks, _taste(spark, sf_dir), _pool(spark, sf_dir), around, seen, fits)
    return rows.withColumn("reasons", F.array_join("reasons", "; "))


def _wins(spark, sf_dir):
    artists = _table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey AS string) AS artist_id", "n_name AS artist_name")
    return x.agent_wins(_sessions(spark, sf_dir), _session_tracks(spark, sf_dir), _taste(spark, sf_dir), artists, _pool(spark, sf_dir))


def _signals(spark, sf_dir):
    heard = play_events(spark, sf_dir)
    return x.signal_effectiveness(heard, _taste(spark, sf_dir), heard.where("duration_listened_ms % 3 = 0").selectExpr("session_id", "track_id", "concat(IF(user_id % 2 = 0, 'fresh:', 'old:'), user_id % 3) AS source"))


def _lyrics(spark, sf_dir):
    return _table(spark, sf_dir, "documents").selectExpr("concat('spotify:track:', doc_id) AS uri", "IF(doc_id % 11 = 0, 'missing', 'ok') AS status", "doc_id % 13 = 0 AS instrumental", "text AS lyrics_plain")


def _passages(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").where("doc_id % 3 > 0").select("doc_id", "text", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 4).cast("int"))).alias("i"))
    return docs.selectExpr("concat('spotify:track:', doc_id) AS uri", "i AS passage_index", "i * 5 AS start_line", "i * 5 + 3 AS end_line", "substring(text, i * 20 + 1, 20) AS passage_text")


def _highlights(spark, sf_dir):
    rows = lo.highlight_tracks(plays(spark, sf_dir), _lyrics(spark, sf_dir), _passages(spark, sf_dir), least_chars=400)
    told = F.transform("passages", lambda p: F.concat_ws(":", p.start_line.cast("string"), p.end_line.cast("string"), p.text))
    return rows.select("uri", "track_name", "artist_name", "plays", F.sha2("lyrics_plain", 256).alias("lyrics_sha256"), F.array_join(told, "|").alias("passages"))


def _by_name(spark, sf_dir):
    tracks = _table(spark, sf_dir, "part").selectExpr("cast(p_partkey AS string) AS track_id", """IF(p_partkey % 17 = 0, '["', concat('["', p_size, '", "', p_partkey % 31, '"]')) AS artist_ids""")
    return lo.artist_taste_by_name(plays(spark, sf_dir), tracks, e.artist_taste(e.artist_play_stats(play_events(spark, sf_dir))))


_MODES = "[" + ", ".join(f"'{m}'" for m in MODES) + "]"
SESSIONS = f"""sessions AS (SELECT o_orderkey AS session_id, {_MODES}[o_orderkey % 6 + 1] AS mode, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 10000 END AS snapshot_id, o_orderdate::TIMESTAMP AS invoked_at FROM orders),
 session_tracks AS (SELECT l_orderkey AS session_id, l_linenumber - 1 AS position, l_partkey::VARCHAR AS track_id, CASE WHEN l_returnflag = 'R' THEN 'familiar' ELSE 'fresh:' || (l_suppkey % 5) END AS source, ['completed', 'skipped', NULL, 'replayed'][l_linenumber % 4 + 1] AS outcome FROM lineitem),
 taste AS (SELECT {TASTE} FROM part WHERE p_partkey % 4 < 3), pool AS (SELECT {POOL} FROM part WHERE p_partkey % 5 < 4)"""
_FIXED = ", ".join(f"('{m}', '{f}', {mean}::DOUBLE, {spread}::DOUBLE)" for m in KEPT for f, (mean, spread) in zip(ac.FEATURES, ac.CURATED[m], strict=True) if f in NAMES)
CENTROIDS = f"""{EVENTS_SQL}, {recommend.PROFILE}, {SESSIONS}, curated(mode, dimension, mean, stddev) AS (VALUES {_FIXED}), trained AS (SELECT mode FROM profile GROUP BY mode HAVING min(sample_size) >= 10), modes AS (SELECT DISTINCT mode FROM sessions),
 centroids AS (SELECT * FROM curated WHERE mode IN (SELECT mode FROM modes) UNION ALL SELECT m.mode, dimension, mean, stddev FROM modes m JOIN profile p ON p.mode = CASE WHEN m.mode IN (SELECT mode FROM trained) THEN m.mode ELSE 'overall' END
  WHERE m.mode NOT IN (SELECT mode FROM curated) AND p.mode IN (SELECT mode FROM trained)) """
EXPLAINED = CENTROIDS + f""", f AS (SELECT * FROM (SELECT {FEATURES} FROM part) WHERE energy IS NOT NULL), cut AS (SELECT track_id, c.mode, c.dimension, (CASE c.dimension WHEN 'energy' THEN energy ELSE valence END - mean) / greatest(stddev, 0.05) AS z FROM f, centroids c),
 fits AS (SELECT track_id, mode, greatest(0.7, least(1.4, 1.4 - 0.7 * sum(z * z) / 18)) AS fit, max((round(z * z, 9), dimension, z > 0)) AS most FROM cut GROUP BY ALL),
 seen AS (SELECT track_id, min(track_name) AS seen FROM (SELECT {SEEN} FROM events) WHERE track_name IS NOT NULL GROUP BY 1), around AS (SELECT {SNAPSHOTS} FROM events),
 signals AS (SELECT track_id, list_filter([CASE WHEN in_top_tracks_short THEN 'In your current top tracks' END, CASE WHEN in_top_tracks_medium THEN 'In your medium-term top tracks' END, CASE WHEN in_top_tracks_long THEN 'In your long-term top tracks' END, CASE WHEN in_liked_songs THEN 'In your liked songs' END,
  CASE WHEN current_season_present THEN 'In your current season playlist' WHEN seasonal_playlist_count > 0 THEN 'In ' || seasonal_playlist_count || ' seasonal playlist(s)' END, CASE WHEN play_count > 3 THEN 'Played ' || play_count || ' times' END, CASE WHEN complete_count > 2 THEN 'Completed ' || complete_count || ' times (low skip)' END], lambda r: r IS NOT NULL) AS told FROM taste)
 SELECT session_id, (position + 1)::INT AS position, st.track_id, coalesce(nullif(coalesce(t.track_name, CASE WHEN st.source <> 'familiar' THEN p.track_name END), ''), seen, st.track_id) AS track_name, st.source, outcome, t.score, floor(round(fit, 6) * 100 + 0.5) / 100 AS acoustic_fit,
 CASE WHEN most[1] > 0 AND (fit > 1.1 OR fit < 0.9) THEN CASE WHEN most[3] THEN 'High ' ELSE 'Low ' END || most[2] || CASE WHEN fit > 1.1 THEN ' match for ' ELSE ' for ' END || s.mode END AS acoustic_note,
 array_to_string(list_filter(list_concat(CASE WHEN st.source <> 'familiar' THEN [CASE WHEN p.source_detail <> '' THEN 'Discovery: ' || p.source_detail ELSE 'Fresh discovery' END, 'Predicted fit score: ' || coalesce(p.score::DECIMAL(18, 1)::VARCHAR, '?')] WHEN t.track_id IS NULL THEN ['Familiar track'] WHEN len(told) = 0 THEN ['Matches your taste profile'] ELSE told END,
  [CASE WHEN weather_condition <> 'clear' THEN 'Weather bias: ' || weather_condition END, CASE WHEN daylight_phase = 'night' AND s.mode = 'unwinding' THEN 'Night unwinding: comfort pick' END]), lambda r: r IS NOT NULL), '; ') AS reasons
 FROM session_tracks st JOIN sessions s USING (session_id) LEFT JOIN taste t ON t.track_id = st.track_id LEFT JOIN signals g ON g.track_id = st.track_id LEFT JOIN pool p ON p.track_id = st.track_id LEFT JOIN seen ON seen.track_id = st.track_id LEFT JOIN around a ON a.snapshot_id = s.snapshot_id LEFT JOIN fits ON fits.track_id = st.track_id AND fits.mode = s.mode"""
HEARD = "heard AS (SELECT uri, max((ts, track_name, artist_name))[2] AS track_name, max((ts, track_name, artist_name))[3] AS artist_name, count(*) AS plays, min(ts) AS first_play FROM plays GROUP BY uri)"
PASSAGES = "passages AS (SELECT 'spotify:track:' || doc_id AS uri, i, substring(text, i * 20 + 1, 20) AS passage_text FROM (SELECT *, unnest(range(0, doc_id % 4 + 1)) AS i FROM documents WHERE doc_id % 3 > 0))"
_SIGNALS = " UNION ALL ".join(f"SELECT '{label}' AS signal, count(*) AS has_signal, coalesce(sum(good), 0)::BIGINT AS satisfied FROM e JOIN taste USING (track_id) WHERE {on}" for label, on in x.SIGNALS)

JOBS = {
    "e09_centroids": (_centroids, CENTROIDS + "SELECT * FROM centroids"),
    "j10_session_explain": (_explained, EXPLAINED),
    "j07_agent_wins": (
        _wins,
        f"WITH {SESSIONS}"
        + """ SELECT session_id, position, st.track_id, st.source, outcome, coalesce(t.track_name, p.track_name) AS track_name, coalesce(n_name, '') AS artist_name, t.score, in_liked_songs, in_top_tracks_short, in_top_tracks_medium, play_count, complete_count, mode, invoked_at
 FROM session_tracks st JOIN sessions USING (session_id) LEFT JOIN taste t ON t.track_id = st.track_id LEFT JOIN pool p ON p.track_id = st.track_id LEFT JOIN nation ON n_nationkey::VARCHAR = primary_artist_id WHERE outcome IN ('completed', 'replayed') ORDER BY invoked_at DESC, session_id, position LIMIT 25""",
    ),
    "j06_signal_effectiveness": (
        _signals,
        f"""{EVENTS_SQL}, {SESSIONS}, e AS (SELECT *, (classification IN ('completed', 'replayed'))::INT AS good FROM play_events WHERE session_id IS NOT NULL), new AS (SELECT DISTINCT session_id, track_id FROM play_events WHERE duration_listened_ms % 3 = 0 AND user_id % 2 = 0)
 {_SIGNALS} UNION ALL SELECT 'Fresh Discovery', count(*), coalesce(sum(good), 0)::BIGINT FROM e JOIN new USING (session_id, track_id)""",
    ),
    "j09_acoustic_maturity": (lambda s, d: ac.acoustic_maturity(recommend._profile(s, d)), f"{EVENTS_SQL}, {recommend.PROFILE} SELECT mode, count(*) AS dimensions, min(sample_size) AS min_samples, floor(avg(sample_size) + 0.5)::BIGINT AS avg_samples, max(sample_size) AS max_samples FROM profile GROUP BY mode"),
    "i07_highlight_tracks": (
        _highlights,
        f"""{PLAYS_SQL}, {HEARD}, {PASSAGES}, marks AS (SELECT uri, string_agg((i * 5) || ':' || (i * 5 + 3) || ':' || passage_text, '|' ORDER BY i) AS passages FROM passages GROUP BY uri)
 SELECT h.uri, track_name, artist_name, plays, sha256(text) AS lyrics_sha256, coalesce(passages, '') AS passages FROM heard h JOIN documents ON h.uri = 'spotify:track:' || doc_id LEFT JOIN marks m ON m.uri = h.uri WHERE doc_id % 11 > 0 AND doc_id % 13 > 0 AND length(text) > 400 ORDER BY plays DESC, h.uri LIMIT 50""",
    ),
    "i07_loved_passages": (
        lambda s, d: lo.loved_passages(plays(s, d), _passages(s, d)),
        f"""{PLAYS_SQL}, {HEARD}, {PASSAGES}, h AS (SELECT * EXCLUDE (i) FROM heard JOIN passages USING (uri) WHERE i = 0), best AS (SELECT *, 'showcase' AS part, row_number() OVER (ORDER BY plays DESC, uri)::INT AS rank FROM h QUALIFY rank <= 5)
 SELECT * FROM best UNION ALL SELECT *, 'depth', row_number() OVER (ORDER BY first_play, uri)::INT AS rank FROM h WHERE uri NOT IN (SELECT uri FROM best) QUALIFY rank <= 30""",
    ),
    "h10_artist_taste_by_name": (
        _by_name,
        EVENTS_SQL
        + """, artists AS (SELECT artist_id, floor((log2(1 + count(*)) * 0.5 + least(count(DISTINCT track_id), 10) * 0.3) * 100 + 0.5) / 100 AS score FROM (SELECT track_id, unnest(list_distinct(artist_ids)) AS artist_id FROM play_events) GROUP BY 1),
 heard AS (SELECT DISTINCT p_partkey, p_brand, p_size FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE p_partkey % 17 > 0)
 SELECT p_brand AS artist_name, max(score) AS score FROM heard JOIN artists ON artist_id IN (p_size::VARCHAR, (p_partkey % 31)::VARCHAR) GROUP BY 1""",
    ),
}
