"""Queries over catalog matches, seasons and versions of songs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapedeck.operators import covers as v
from tapedeck.operators import lyrics as ly
from tapedeck.operators import matching as m
from tapedeck.sources.bridge import PLAYS_SQL, plays


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _matched(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    catalog = part.selectExpr("CASE WHEN p_partkey % 10 = 0 THEN concat('I', p_partkey) END AS isrc", "concat('spotify:track:', p_partkey) AS uri", "concat(p_name, ' ', p_partkey div 8) AS track", "concat(p_brand, ' ', p_partkey div 40) AS artist", "p_size * 40000 AS duration_ms")
    tracks = part.selectExpr(
        "p_partkey AS key", "CASE WHEN p_partkey % 5 = 0 THEN concat('I', p_partkey) END AS isrc", "concat(p_partkey div 8, ': ', upper(p_name)) AS track",
        "CASE WHEN p_partkey % 7 <> 0 THEN concat(p_partkey div 40, ' & ', p_brand) END AS artist", "p_size * 40000 + CASE WHEN p_partkey % 3 = 0 THEN 10000000 ELSE 1000 END AS duration_ms")
    return m.match_catalog(tracks, catalog)


MATCHED = """WITH p AS (SELECT *, array_to_string(list_sort(regexp_extract_all(lower(p_name || ' ' || p_partkey // 8), '[a-z0-9]+')), ' ') AS t, array_to_string(list_sort(regexp_extract_all(lower(p_brand || ' ' || p_partkey // 40), '[a-z0-9]+')), ' ') AS a FROM part),
 tracks AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 5 = 0 THEN 'I' || p_partkey END AS isrc, (p_partkey // 8) || ': ' || upper(p_name) AS track, CASE WHEN p_partkey % 7 <> 0 THEN (p_partkey // 40) || ' & ' || p_brand END AS artist, p_size * 40000 + CASE WHEN p_partkey % 3 = 0 THEN 10000000 ELSE 1000 END AS duration_ms FROM part),
 scored AS (SELECT x.p_partkey AS key, 'spotify:track:' || y.p_partkey AS uri, CASE WHEN x.p_partkey % 3 <> 0 AND x.p_size = y.p_size THEN 1.0 ELSE 0.9 END AS confidence FROM p x JOIN p y USING (t, a) WHERE x.p_partkey % 7 <> 0 AND x.p_partkey % 10 <> 0),
 best AS (SELECT key, max((confidence, uri)) AS b FROM scored GROUP BY key),
 found AS (SELECT key, b[2] AS uri, b[1]::DOUBLE AS confidence FROM best UNION ALL SELECT p_partkey, 'spotify:track:' || p_partkey, 1.0 FROM part WHERE p_partkey % 10 = 0)
 SELECT tracks.*, uri, confidence, CASE WHEN confidence >= 0.9 THEN 'matched' WHEN confidence >= 0.7 THEN 'review' ELSE 'unmatched' END AS status FROM tracks LEFT JOIN found USING (key)"""

NAMES = ("Winter blues", "wynter nights", "Late autumn 2019", "summmer 17", "brrr", "Spring 2021 show ideas", "rainfall", "fall in line")


def _seasonal(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("o_orderkey") % len(NAMES) + 1).cast("int"))
    lists = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("playlist_id"), (F.col("o_custkey") % 3).cast("string").alias("owner_id"), name.alias("name"))
    known = lists.where("playlist_id % 5 = 0").select("playlist_id", (2010 + F.col("playlist_id") % 15).cast("int").alias("year"))
    return m.detect_seasonal(lists, year=2024, month=1, known=known, owner="1", without=("show ideas",))


SEASONAL = f"""SELECT *, season = 'winter' AND year = 2024 AS is_current FROM (SELECT playlist_id, owner_id, name,
 CASE WHEN name ILIKE '%wynter%' OR name ILIKE '%summmer%' THEN 'summer' WHEN name ILIKE '%winter%' OR name ILIKE '%brrr%' THEN 'winter' ELSE 'fall' END AS season,
 CASE WHEN name LIKE '%2019' THEN 2019 WHEN name LIKE '% 17' THEN 2017 WHEN playlist_id % 5 = 0 THEN 2010 + playlist_id % 15 ELSE 2024 END::INT AS year
 FROM (SELECT o_orderkey AS playlist_id, (o_custkey % 3)::VARCHAR AS owner_id, {list(NAMES)}[o_orderkey % {len(NAMES)} + 1] AS name FROM orders) WHERE owner_id = '1' AND name NOT LIKE '%show ideas' AND name <> 'rainfall')"""


def _catalog(spark, sf_dir):
    """Recordings of a few hundred copies of the same names; two in nine are marked as versions, a third belongs to a work."""
    return _table(spark, sf_dir, "part").selectExpr(
        "concat('spotify:track:', p_partkey) AS uri", "concat(p_name, ' ', p_partkey div 40, CASE WHEN p_size % 9 = 0 THEN ' (Live at Home)' WHEN p_size % 9 = 1 THEN ' - Remix 2' ELSE '' END) AS track",
        "concat('Brand ', p_partkey % 5) AS artist", "CASE WHEN p_size % 3 = 0 THEN p_partkey div 4 END AS work_id")


def _found(spark, sf_dir):
    catalog = _catalog(spark, sf_dir)
    return v.find_versions(catalog.where(SEEDS), catalog)


#: Recordings that are looked for: those with a work.
SEEDS = "work_id IS NOT NULL"
FOUND = """WITH r AS (SELECT 'spotify:track:' || p_partkey AS uri, p_partkey, p_name || ' ' || p_partkey // 40 AS title, p_partkey % 5 AS artist, p_size % 9 < 2 AS marked, CASE WHEN p_size % 3 = 0 THEN p_partkey // 4 END AS work_id FROM part),
 ways AS (SELECT x.uri AS seed, y.uri AS candidate, 0 AS way FROM r x JOIN r y ON x.work_id = y.work_id WHERE x.uri <> y.uri
 UNION SELECT x.uri, y.uri, CASE WHEN x.artist <> y.artist THEN 1 ELSE 2 END FROM r x JOIN r y USING (title) WHERE x.work_id IS NOT NULL AND x.uri <> y.uri AND (x.artist <> y.artist OR y.marked)),
 found AS (SELECT seed, candidate, ['mb_work', 'spotify_search', 'spotify_artist_search'][min(way) + 1] AS match_method, bool_or(way = 0) AS found_via_mb_work, bool_or(way = 1) AS found_via_spotify_search, bool_or(way = 2) AS found_via_spotify_artist_search FROM ways GROUP BY 1, 2)"""

_FEATURES = {
    "acousticness": "(p_partkey % 7) / 7", "danceability": "(p_partkey % 11) / 11", "energy": "p_size / 50", "instrumentalness": "(p_partkey % 3) / 2", "liveness": "(p_size % 6) / 5",
    "loudness": "(p_partkey % 80 - 70) * 1.0", "speechiness": "(p_size % 4) / 10", "tempo": "(p_partkey % 290) * 1.0", "valence": "CASE WHEN p_partkey % 13 <> 0 THEN (p_size % 5) / 5 END"}


def _features(spark, sf_dir):
    return _table(spark, sf_dir, "part").selectExpr("concat('spotify:track:', p_partkey) AS uri", *[f"CAST({e} AS double) AS {n}" for n, e in _FEATURES.items()])


def _audio(spark, sf_dir):
    return v.version_audio(_found(spark, sf_dir), _features(spark, sf_dir))


_SCALED = {**_FEATURES, "loudness": f"({_FEATURES['loudness']} + 60) / 60", "tempo": f"({_FEATURES['tempo']}) / 250"}
AUDIO = FOUND + ", f AS (SELECT 'spotify:track:' || p_partkey AS uri, [" + ", ".join(f"greatest(0.0, least(1.0, ({e})::DOUBLE))" for e in _SCALED.values()) + "] AS f FROM part WHERE p_partkey % 13 <> 0),"
AUDIO += """ heard AS (SELECT found.*, x.f AS x, y.f AS y, round(sqrt(list_sum([(q - p) ** 2 for p, q in list_zip(x.f, y.f)])), 4) AS audio_distance FROM found LEFT JOIN f x ON x.uri = seed LEFT JOIN f y ON y.uri = candidate)"""
AUDIO = AUDIO.replace("list_sum([(q - p) ** 2 for p, q in list_zip(x.f, y.f)])", "list_sum(list_transform(list_zip(x.f, y.f), lambda p: (p[2] - p[1]) ** 2))").replace("round(sqrt", "CASE WHEN x.f IS NOT NULL AND y.f IS NOT NULL THEN round(sqrt").replace(", 4) AS audio_distance", ", 4) END AS audio_distance")
_BUCKET = "CASE WHEN audio_distance >= 0.7 THEN 'different_sonic_world' ELSE 'alternate_version' END AS audio_bucket, audio_distance IS NULL AS no_audio_data"


def _credits(spark, sf_dir):
    role = "element_at(array('composer', 'producer', 'lyricist', 'writer'), l_linenumber % 4 + 1) AS role"
    return _table(spark, sf_dir, "lineitem").selectExpr("concat('spotify:track:', l_partkey) AS uri", "concat('Person ', l_suppkey % 50) AS person", role)


def _status(spark, sf_dir, least):
    return _table(spark, sf_dir, "part").where(f"p_size > {least}").selectExpr("concat('spotify:track:', p_partkey) AS uri", "CASE WHEN p_size % 2 = 0 THEN 'ok' ELSE 'not_found' END AS status")


def _enriched(spark, sf_dir):
    pairs = v.writers_in_common(_found(spark, sf_dir), _credits(spark, sf_dir)).withColumn("shared_writers", F.array_join("shared_writers", ", "))
    return v.covers_enriched(pairs, plays(spark, sf_dir).where("year = 1995"), _status(spark, sf_dir, 20), _status(spark, sf_dir, 35))


ENRICHED = (
    PLAYS_SQL
    + ", "
    + FOUND.removeprefix("WITH ")
    + """, c AS (SELECT DISTINCT 'spotify:track:' || l_partkey AS uri, 'Person ' || (l_suppkey % 50) AS person FROM lineitem WHERE l_linenumber % 4 <> 1),
 shared AS (SELECT seed, candidate, string_agg(DISTINCT x.person, ', ' ORDER BY x.person) AS shared_writers FROM found JOIN c x ON x.uri = seed JOIN c y ON y.uri = candidate AND x.person = y.person GROUP BY 1, 2),
 n AS (SELECT uri AS candidate, count(*) AS n FROM plays WHERE year = 1995 GROUP BY 1), s AS (SELECT 'spotify:track:' || p_partkey AS candidate, p_size, CASE WHEN p_size % 2 = 0 THEN 'ok' ELSE 'not_found' END AS status FROM part)
 SELECT found.*, shared_writers, coalesce(n, 0) AS candidate_play_count, n IS NOT NULL AS in_library, CASE WHEN p_size > 20 THEN status END AS candidate_lyrics_status, CASE WHEN p_size > 35 THEN status END AS candidate_credits_status
 FROM found LEFT JOIN shared USING (seed, candidate) LEFT JOIN n USING (candidate) LEFT JOIN s USING (candidate)"""
)


def _summary(spark, sf_dir):
    audio = _audio(spark, sf_dir)
    return v.cover_seed_summary(_catalog(spark, sf_dir), _found(spark, sf_dir), audio.where("found_via_mb_work OR audio_bucket = 'different_sonic_world'"))


def _twins(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings").where("embedding is not null")
    ratings = vectors.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 4 != 0, F.col("label") % 5).alias("rating"))
    return v.twin_concordance(ly.knn_table(vectors, id="vec_id", vector="embedding", k=5), ratings, seed=7)


JOBS = {
    "b07_match_catalog": (_matched, MATCHED),
    "b12_seasonal": (_seasonal, SEASONAL),
    "h04_versions_found": (_found, FOUND + " SELECT * FROM found"),
    "h05_version_audio": (
        lambda s, d: _audio(s, d).withColumns({f"{n}_delta": F.col("audio_feature_deltas")[n] for n in ("loudness", "tempo", "valence")}).drop("audio_feature_deltas"),
        AUDIO + f" SELECT seed, candidate, match_method, found_via_mb_work, found_via_spotify_search, found_via_spotify_artist_search, audio_distance, {_BUCKET}, " + ", ".join(f"CASE WHEN audio_distance IS NOT NULL THEN round(y[{i}] - x[{i}], 4) END AS {n}_delta" for n, i in (("loudness", 6), ("tempo", 8), ("valence", 9))) + " FROM heard",
    ),
    "h06_covers_enriched": (_enriched, ENRICHED),
    "h06_cover_seeds": (
        _summary,
        AUDIO + f""", b AS (SELECT *, {_BUCKET} FROM heard) SELECT uri AS seed, CASE WHEN work_id IS NULL THEN 'spotify_only' ELSE 'both' END AS search_method, count(candidate) AS candidates_found,
 count(*) FILTER (candidate IS NOT NULL AND (found_via_mb_work OR audio_bucket = 'different_sonic_world')) AS candidates_kept, count(*) FILTER (no_audio_data AND candidate IS NOT NULL AND found_via_mb_work) AS candidates_no_audio_data FROM r LEFT JOIN b ON seed = uri GROUP BY ALL""",
    ),
    "h08_twin_concordance": (
        _twins,
        """WITH k AS (SELECT q.vec_id AS query, v.vec_id AS match FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id) <= 5),
 r AS (SELECT vec_id AS id, label % 5 AS rating, md5(vec_id || '/7') AS h FROM embeddings WHERE vec_id % 4 <> 0), n AS (SELECT rating, lead(rating) OVER (PARTITION BY h[1] ORDER BY h) AS b FROM r)
 SELECT * FROM (SELECT count(*) AS pairs, round(avg(abs(x.rating - y.rating)), 6) AS mean_difference FROM k JOIN r x ON x.id = query JOIN r y ON y.id = match), (SELECT count(*) AS random_pairs, round(avg(abs(rating - b)), 6) AS random_difference FROM n WHERE b IS NOT NULL)""",
    ),
}
