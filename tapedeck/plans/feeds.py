"""Queries over pages, similar lyrics and communities, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapedeck.operators import analysis as an
from tapedeck.operators import feeds as f
from tapedeck.operators.communities import communities
from tapedeck.operators.similar import similar_lyrics
from tapedeck.plans import periods

#: Titles of pages stand in their head; the test pages' own wording, by language.
PATTERNS = (
    ("en", r"^(.+?)\s+(?:of|and)\s+(.+?)\s+the\s"),
    ("en", r"^(.+?)\s+(?:the|of|to)\s+(.+)$"),
    ("de", r"^(.+?)\s+(?:der|die|und)\s+(.+)$"),
    ("fr", r"^(.+?)\s+(?:la|le|de)\s+(.+)$"),
)


def _pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.regexp_extract("url", r"://[^/]+/([a-z]{2})/", 1).alias("source"), "html")


def _items(spark, sf_dir):
    return f.feed_items(_pages(spark, sf_dir), markup="html", block="<head>")


def _seeds(spark, sf_dir):
    items = _items(spark, sf_dir)
    return f.artist_seeds(items, order=("page_id",), separator="the", series=("of the", "and"))


ITEMS = r"""WITH blocks AS (SELECT page_id, regexp_extract(url, '://[^/]+/([a-z]{2})/', 1) AS source, unnest(string_split(html, '<head>')[2:]) AS block FROM pages),
 items AS (SELECT page_id, source, replace(replace(replace(replace(replace(trim(regexp_extract(block, '(?s)<title>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</title>', 1), E' \t\r\n'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', '''') AS title
  FROM blocks WHERE regexp_matches(block, '(?s)<title>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</title>')) """
_TRIED = " ".join(f"WHEN source = '{of}' AND regexp_matches(title, '{p}') THEN {{'artist': trim(regexp_extract(title, '{p}', 1)), 'track': trim(regexp_extract(title, '{p}', 2))}}" for of, p in PATTERNS)

SIMILAR = """WITH w AS (SELECT doc_id, list_filter(string_split(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT doc_id, list_sort(list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)])) AS s FROM w WHERE len(w) >= 5),
 c AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY s) AS a FROM s),
 long AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM c WHERE doc_id = a),
 pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS n, y.n AS m, count(*) AS k FROM long x JOIN long y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL)
 SELECT a, b, round(k / (n + m - k), 6) AS jaccard, false AS same FROM pairs WHERE k / (n + m - k) >= 0.8 UNION ALL SELECT a, doc_id, 1.0, true FROM c WHERE doc_id <> a"""


#: An analysis of each document as JSON, six of seven of them broken in some way.
RAW = """CASE doc_id % 7 WHEN 5 THEN '{"subject_paragraph": ' WHEN 6 THEN '["no object"]' ELSE concat('{"subject_paragraph": ', CASE WHEN doc_id % 7 = 4 THEN '12' ELSE concat('"', source, ' of ', lang, '"') END, ', "subject_tags": ', CASE WHEN doc_id % 7 = 2 THEN '"home"' ELSE '["home", "road"]' END,
 ', "listener_feel_generic": ', CASE WHEN doc_id % 7 = 3 THEN 'null' ELSE '{"primary_emotion": "calm"}' END, CASE WHEN doc_id % 7 = 1 THEN '' ELSE concat(', "tones": ["warm", "', source, '"]') END, ', "language": "', lang, '"', CASE WHEN doc_id % 14 = 8 THEN '' ELSE ', "narrative_pov": "first"' END, '}') END"""


def _analyses(spark, sf_dir):
    rows = an.validate_analysis(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", f"{RAW} AS raw"), "raw")
    return rows.select("doc_id", "valid", F.array_join("reasons", "; ").alias("reasons"), F.array_join("analysis.tones", " ").alias("tones"), F.col("analysis.language").alias("language"))


def _analysis_texts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "source", f"{RAW} AS raw")
    return rows.select("doc_id", F.sha2(an.analysis_text(F.col("source"), F.get_json_object("raw", "$.tones"), F.get_json_object("raw", "$.listener_feel_generic")), 256).alias("sha256"))


_SHAPE = ", ".join(f"CASE WHEN {c} THEN NULL ELSE '$.{n}: {k}' END" for n, k in an.SHAPE for c in ["coalesce(json_type(raw, '$." + n + "') " + {"string": "= 'VARCHAR'", "array": "= 'ARRAY'", "object": "IN ('OBJECT', 'ARRAY')"}[k] + ", false)"])


def _edges(spark, sf_dir):
    return periods.JOBS["f06_top_neighbors"][0](spark, sf_dir)


JOBS = {
    "e19_feed_titles": (lambda s, d: f.extract_feed_titles(_items(s, d), list(PATTERNS)), ITEMS + f"SELECT page_id, source, 0 AS item, title, x.artist AS artist, x.track AS track FROM (SELECT *, CASE {_TRIED} END AS x FROM items) WHERE x IS NOT NULL"),
    "e19_artist_seeds": (
        _seeds,
        ITEMS
        + r""", named AS (SELECT *, trim(regexp_extract(title, '^(.+?)\s+the\s+(.+)$', 1)) AS f, regexp_extract(title, '^(.+?)\s+the\s+(.+)$', 2) AS more FROM items WHERE regexp_matches(title, '^(.+?)\s+the\s+(.+)$')),
 artists AS (SELECT source, page_id, more, CASE WHEN regexp_matches(f, '(?i)^(of the|and)') THEN trim(regexp_extract(more, '^(.+?)(?:\s+on\s+|\s*[-–—]\s*)', 1)) ELSE f END AS artist FROM named)
 SELECT source, page_id, artist, more FROM artists WHERE length(artist) >= 2 QUALIFY row_number() OVER (PARTITION BY source, lower(artist) ORDER BY page_id) = 1""",
    ),
    "h03_similar_lyrics": (lambda s, d: similar_lyrics(s.read.parquet(f"{d}/documents.parquet"), id="doc_id", text="text"), SIMILAR),
    "h16_validate_analysis": (
        _analyses,
        f"""WITH r AS (SELECT doc_id, {RAW} AS raw FROM documents), t AS (SELECT doc_id, raw, json_valid(raw) AND CASE WHEN json_valid(raw) THEN json_type(raw) = 'OBJECT' ELSE false END AS whole FROM r),
 v AS (SELECT doc_id, raw, whole, CASE WHEN whole THEN list_filter([{_SHAPE}], lambda x: x IS NOT NULL) ELSE ['$: object'] END AS reasons FROM t)
 SELECT doc_id, len(reasons) = 0 AS valid, array_to_string(reasons, '; ') AS reasons, CASE WHEN len(reasons) = 0 THEN (raw->>'$.tones[0]') || ' ' || (raw->>'$.tones[1]') END AS tones, CASE WHEN len(reasons) = 0 THEN raw->>'$.language' END AS language FROM v""",
    ),
    "h15_analysis_text": (
        _analysis_texts,
        "SELECT doc_id, sha256(trim(source || ' ' || CASE WHEN doc_id % 7 IN (1, 5, 6) THEN '' ELSE 'warm ' || source END || ' ' || CASE WHEN doc_id % 7 IN (3, 5, 6) THEN '' ELSE 'calm' END)) AS sha256 FROM documents",
    ),
    "f10_communities": (lambda s, d: communities(_edges(s, d)), None),
}
