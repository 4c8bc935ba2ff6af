"""Queries over lyrics, vectors, ratings, matching and coverage, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapedeck.operators import coverage as c
from tapedeck.operators import lyrics as ly
from tapedeck.operators import matching as m
from tapedeck.sources.bridge import PLAYS_SQL, plays

FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _next(df, id):
    return df.select(F.col(id).alias("a"), (F.col(id) + 1).alias("b"))


def _jaccard(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return ly.jaccard_pairs(_next(docs, "doc_id"), ly.shingles(docs, "doc_id", "text"), id="doc_id", least=0.05)


def _catalog(spark, sf_dir):
    return _table(spark, sf_dir, "part").selectExpr("p_partkey AS uri", "CASE WHEN p_size % 9 = 0 THEN concat(p_name, ' (Live at Home)') WHEN p_size % 9 = 1 THEN concat(p_name, ' - Remastered 2009') ELSE p_name END AS track", "p_brand AS artist")


CATALOG = f"(SELECT p_partkey AS uri, {FOLD.format('p_name')} AS title, {FOLD.format('p_brand')} AS artist, p_size % 9 AS m FROM part)"


def _features(spark, sf_dir):
    return _table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size / 50 AS energy", "(p_partkey % 7) / 7 AS valence", "(p_partkey % 11) / 11 AS tempo")


def _vectors(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").where("embedding is not null")


def _rated(spark, sf_dir):
    return _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "n_chars", "quality", "toxic")


RATED = "(SELECT doc_id, lang, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id))"


def _known(spark, sf_dir):
    return _table(spark, sf_dir, "part").where("p_size < 40").selectExpr("concat('spotify:track:', p_partkey) AS uri", "CASE WHEN p_size < 30 THEN 'ok' ELSE 'error' END AS status")


KNOWN = "known AS (SELECT 'spotify:track:' || p_partkey AS uri, CASE WHEN p_size < 30 THEN 'ok' ELSE 'error' END AS status FROM part WHERE p_size < 40)"


def _scores(spark, sf_dir):
    return _table(spark, sf_dir, "part").selectExpr("concat('spotify:track:', p_partkey) AS uri", "p_retailprice AS score")


def _pool(spark, sf_dir):
    return _table(spark, sf_dir, "part").selectExpr("p_brand AS source", "element_at(array('fresh', 'played', 'liked', 'skipped', 'expired'), p_size % 5 + 1) AS status", "p_retailprice AS score")


def _credits(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").selectExpr("concat('spotify:track:', l_partkey) AS uri", "l_suppkey AS person", "l_returnflag AS role")


def _cities(spark, sf_dir):
    places = _table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey AS bigint) AS ip", "n_name AS city")
    return m.city_stats(plays(spark, sf_dir).withColumn("ip", (F.col("user_id") % 50).cast("long")), places)


def _merged(spark, sf_dir):
    p = plays(spark, sf_dir).select("ts", "uri")
    return m.merge_recent_plays(p.where("ts < timestamp'2000-01-01'"), p.where("ts >= timestamp'1999-01-01'"))


JOBS = {
    "b02_merge_recent": (_merged, PLAYS_SQL + "SELECT ts, uri FROM plays WHERE ts < TIMESTAMP '2000-01-01' UNION ALL SELECT DISTINCT ts, uri FROM plays WHERE ts >= TIMESTAMP '2000-01-01'"),
    "b05_match_key": (
        lambda s, d: _table(s, d, "part").select("p_partkey", m.match_cache_key(F.when(F.col("p_size") > 25, F.col("p_partkey").cast("string")), F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("key")),
        "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'apple:' || p_partkey ELSE 'text:' || sha1(p_name || '|' || p_brand || '|' || p_type) END AS key FROM part",
    ),
    "b11_cities": (_cities, PLAYS_SQL + "SELECT n_name AS city, count(*) AS plays, count(DISTINCT ts::DATE) AS days, round(sum(minutes) / 60, 4) AS hours, min(ts) AS first_seen, max(ts) AS last_seen FROM plays JOIN nation ON n_nationkey = user_id % 50 WHERE platform = 'iOS' GROUP BY 1"),
    "h02_shingle_jaccard": (
        _jaccard,
        f"""WITH w AS (SELECT doc_id, list_filter(string_split(regexp_replace({FOLD.format('text')}, '[^a-z0-9_]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) ELSE [] END AS s FROM w)
 SELECT *, jaccard >= 0.05 AS passes FROM (SELECT x.doc_id AS a, y.doc_id AS b, len(list_intersect(x.s, y.s)) AS n, CASE WHEN len(x.s) + len(y.s) = 0 THEN 1 ELSE round(n / (len(x.s) + len(y.s) - n), 6) END AS jaccard FROM s x JOIN s y ON y.doc_id = x.doc_id + 1)""".replace("SELECT *, jaccard", "SELECT a, b, jaccard, jaccard"),
    ),
    "h04_cover_candidates": (
        lambda s, d: ly.cover_candidates(_catalog(s, d).where("uri % 100 = 0"), _catalog(s, d)),
        f"SELECT a.uri AS seed, b.uri AS candidate, a.artist <> b.artist AS by_title, a.artist = b.artist AS by_version FROM {CATALOG} a JOIN {CATALOG} b ON a.title = b.title AND a.uri <> b.uri WHERE a.uri % 100 = 0 AND (a.artist <> b.artist OR (b.m < 2 AND least(a.m, 2) <> b.m))",
    ),
    "h05_audio_distance": (
        lambda s, d: ly.audio_distance(_next(_features(s, d), "p_partkey"), _features(s, d), ["energy", "valence", "tempo"], id="p_partkey"),
        """WITH f AS (SELECT p_partkey, p_size / 50 AS e, (p_partkey % 7) / 7 AS v, (p_partkey % 11) / 11 AS t FROM part)
 SELECT a, b, distance, CASE WHEN distance IS NULL THEN 'no data' WHEN distance >= 0.7 THEN 'far' ELSE 'near' END AS bucket FROM (SELECT x.p_partkey AS a, x.p_partkey + 1 AS b, round(sqrt(((x.e - y.e) ** 2 + (x.v - y.v) ** 2 + (x.t - y.t) ** 2) / 3), 6) AS distance FROM f x LEFT JOIN f y ON y.p_partkey = x.p_partkey + 1)""",
    ),
    "h07_nearest": (
        lambda s, d: ly.nearest(_vectors(s, d), _vectors(s, d).where("vec_id % 100 = 0"), id="vec_id", vector="embedding"),
        """SELECT query, match, cosine, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, match)::INT AS rank FROM (SELECT q.vec_id AS query, v.vec_id AS match, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS cosine
 FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0) QUALIFY rank <= 10""",
    ),
    "h08_knn_table": (
        lambda s, d: ly.knn_table(_vectors(s, d), id="vec_id", vector="embedding", k=5),
        """SELECT query, match, cosine, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, match)::INT AS rank FROM (SELECT q.vec_id AS query, v.vec_id AS match, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS cosine
 FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id) QUALIFY rank <= 5""",
    ),
    "h09_hybrid_rank": (
        lambda s, d: ly.hybrid_rank(_table(s, d, "part").selectExpr("p_partkey", "p_retailprice AS taste", "cast(p_size AS double) AS similarity"), id="p_partkey", a="taste", b="similarity"),
        "SELECT p_partkey, p_retailprice AS taste, p_size::DOUBLE AS similarity, round(((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER () + (p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER ()) / 2, 6) AS hybrid FROM part",
    ),
    "h11_spearman": (
        lambda s, d: ly.spearman(_rated(s, d), "n_chars", "quality"),
        f"SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM (SELECT rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS rx, rank() OVER (ORDER BY quality) + (count(*) OVER (PARTITION BY quality) - 1) / 2 AS ry FROM {RATED})",
    ),
    "h12_feature_correlations": (lambda s, d: ly.feature_correlations(_rated(s, d), ["n_chars", "toxic"], "quality"), f"SELECT unnest(['n_chars', 'toxic']) AS feature, unnest([round(corr(n_chars, quality), 6), round(corr(toxic, quality), 6)]) AS r FROM {RATED}"),
    "h12_mean_by_language": (lambda s, d: ly.mean_by(_rated(s, d), "lang", "quality"), f"SELECT lang, count(*) AS n, round(avg(quality), 6) AS mean FROM {RATED} GROUP BY lang"),
    "h13_topk_eval": (
        lambda s, d: ly.topk_eval(_rated(s, d), id="doc_id", rank="n_chars", rating="quality", k=100),
        f"SELECT * FROM (SELECT round(avg(quality), 6) AS top_mean FROM (SELECT * FROM {RATED} ORDER BY n_chars, doc_id LIMIT 100)), (SELECT round(avg(quality), 6) AS bottom_mean FROM (SELECT * FROM {RATED} ORDER BY n_chars DESC, doc_id DESC LIMIT 100))",
    ),
    "h14_stratified_sample": (
        lambda s, d: ly.stratified_sample(_rated(s, d).select("doc_id", "quality"), id="doc_id", stratum="quality", sizes={0: 20, 1: 30}, seed=7),
        f"SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || '/7'), doc_id)::INT AS pick FROM {RATED} QUALIFY pick <= CASE quality WHEN 0 THEN 20 ELSE 30 END",
    ),
    "h15_embedding_inputs": (lambda s, d: ly.embedding_inputs(_table(s, d, "documents"), id="doc_id", text="text", most=2**31 - 1).drop("input"), "SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents"),
    "i01_lookup_queue": (lambda s, d: c.missing(plays(s, d), _known(s, d), retry=("error",)), f"{PLAYS_SQL}, {KNOWN} SELECT uri, count(*) AS plays FROM plays WHERE uri NOT IN (SELECT uri FROM known WHERE status = 'ok') GROUP BY uri"),
    "i03_seed_queue": (lambda s, d: c.seed_queue(plays(s, d), _known(s, d)), f"{PLAYS_SQL}, {KNOWN} SELECT uri, count(*) AS completed FROM plays WHERE reason_end = 'trackdone' AND uri NOT IN (SELECT uri FROM known) GROUP BY uri HAVING count(*) >= 2"),
    "i04_obsession_tier": (lambda s, d: c.obsession_tier(plays(s, d), _scores(s, d), _known(s, d), least=40), f"{PLAYS_SQL}, {KNOWN} SELECT uri FROM (SELECT uri FROM (SELECT 'spotify:track:' || p_partkey AS uri FROM part ORDER BY p_retailprice DESC, uri LIMIT 500) UNION SELECT uri FROM plays GROUP BY uri HAVING count(*) >= 40) WHERE uri IN (SELECT uri FROM known WHERE status = 'ok')"),
    "i05_coverage": (lambda s, d: c.coverage_report(plays(s, d), _known(s, d)), f"{PLAYS_SQL}, {KNOWN} SELECT coalesce(status, 'none') AS status, count(*) AS recordings, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT DISTINCT uri FROM plays) p LEFT JOIN known USING (uri) GROUP BY 1"),
    "i06_top_credits": (lambda s, d: c.top_credits(plays(s, d), _credits(s, d)), PLAYS_SQL + "SELECT person, role, sum(n)::BIGINT AS plays FROM (SELECT DISTINCT 'spotify:track:' || l_partkey AS uri, l_suppkey AS person, l_returnflag AS role FROM lineitem) JOIN (SELECT uri, count(*) AS n FROM plays GROUP BY uri) USING (uri) GROUP BY ALL"),
    "j08_pool_by_source": (lambda s, d: c.pool_by_source(_pool(s, d)), "SELECT p_brand AS source, count(*) AS total, " + ", ".join(f"sum((p_size % 5 = {i})::INT)::BIGINT AS {k}" for i, k in enumerate(("fresh", "played", "liked", "skipped", "expired"))) + ", round(avg(p_retailprice), 6) AS mean_score FROM part GROUP BY 1"),
    "h06_shared_writers": (
        lambda s, d: ly.shared_writers(_table(s, d, "part").selectExpr("concat('spotify:track:', p_partkey) AS a", "concat('spotify:track:', p_partkey + 1) AS b"), _credits(s, d)),
        """WITH c AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS person FROM lineitem), n AS (SELECT x.p, count(*) AS n FROM c x JOIN c y ON y.p = x.p + 1 AND x.person = y.person GROUP BY 1)
 SELECT 'spotify:track:' || p_partkey AS a, 'spotify:track:' || (p_partkey + 1) AS b, coalesce(n, 0) AS shared FROM part LEFT JOIN n ON p = p_partkey""",
    ),
    "h09_centroid": (
        lambda s, d: ly.centroid_similarity(_vectors(s, d), _vectors(s, d).where("label = 3"), id="vec_id", vector="embedding"),
        """WITH m AS (SELECT list(x ORDER BY i) AS c FROM (SELECT i, avg(x) AS x FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label = 3) GROUP BY i))
 SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], c), 6) AS similarity FROM embeddings, m""",
    ),
    "h13_topk_overlap": (lambda s, d: ly.topk_overlap(_rated(s, d), id="doc_id", a="n_chars", b="quality", k=200), f"SELECT count(*) AS \"both\" FROM (SELECT doc_id FROM {RATED} ORDER BY n_chars, doc_id LIMIT 200) JOIN (SELECT doc_id FROM {RATED} ORDER BY quality, doc_id LIMIT 200) USING (doc_id)"),
}
