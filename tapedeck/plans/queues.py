"""Queries over queues of each mode, with their SQL."""

from __future__ import annotations

import math

from tapedeck.operators import queues as q
from tapedeck.sources.bridge import PLAYS_SQL, plays

AS_OF = "2001-11-05"
_YEARS = f"(epoch(TIMESTAMP '{AS_OF}') - floor(epoch(ts))) / (365.25 * 86400)"
WAYS = {
    "e13_queue_morning": {"minutes": 120, "mode": "morning", "core": ["brand#7"], "seed": "Brand#3"},
    "e13_queue_era": {"minutes": 90, "mode": "era", "familiarity": 0.9, "years": [1996, 1997], "seed": "spotify:track:17"},
    "e13_queue_rediscover_by_listener": {"minutes": 42, "mode": "rediscover", "min_plays": 2, "years_gone": 0.25, "skips": 1, "by": ("user_id",)},
}


def _sql(*, minutes, mode, familiarity=0.5, seed=None, years=(0,), core=("",), skips=3, min_plays=20, years_gone=2, by=()) -> str:
    target, b = math.ceil(minutes / q.TRACK_MINUTES), "".join(f"{c}, " for c in by)
    part = f"PARTITION BY {', '.join(by)} " if by else ""
    on = "".join(f"x.{c} = y.{c} AND " for c in by)
    core, weight = ", ".join(f"'{c}'" for c in core), f"(1 + ({familiarity}::DOUBLE - 0.5) * 2 * log2(n) * 0.05)" if familiarity > 0.5 else "1"
    reason = f"CASE WHEN akey IN ({core}) THEN 'never-stale core' ELSE 'high recent affinity' END"
    score = f"floor(affinity * CASE WHEN akey IN ({core}) THEN {q.CORE_BOOST}::DOUBLE ELSE 1 END * {weight} * 100 + 0.5) / 100"
    if mode == "era":
        reason = f"replace({reason}, 'high recent affinity', 'era match')"
    if mode == "morning":
        score, reason = f"{score} * (1 + morning * 0.1::DOUBLE)", f"CASE WHEN morning > 0 THEN 'morning pattern' ELSE {reason} END"
    hit = "false"
    if seed:
        hit = f"akey = (SELECT max(akey) FROM plays WHERE uri = '{seed}')" if ":" in seed else f"akey = '{seed.lower()}'"
    n_lost = int(target * q.LOST_SHARE + 0.5) if mode == "rediscover" else 0
    top = f"QUALIFY row_number() OVER ({part}ORDER BY score DESC, uri)"
    return f""", tracks AS (SELECT {b}uri, count(*) AS n, round(sum(least(minutes, 7.0) * exp(-({_YEARS}) / 3) * CASE WHEN reason_end = 'trackdone' THEN 1.5 ELSE 1.0 END), 2) AS affinity, max(akey) AS akey, avg(minutes) AS minutes,
  sum((ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND reason_end = 'fwdbtn' AND ms_played < 30000)::INT) AS early, sum((local_hour BETWEEN 6 AND 10)::INT) AS morning, bool_or(year IN ({', '.join(map(str, years))})) AS in_era FROM plays GROUP BY ALL),
 pool AS (SELECT * FROM (SELECT * FROM tracks QUALIFY row_number() OVER ({part}ORDER BY affinity DESC, uri) <= {8 * target}) WHERE (early < {skips} OR uri = '{seed}') AND ({mode != 'era'} OR in_era)),
 scored AS (SELECT {b}uri, akey, ({score}) * CASE WHEN {hit} THEN {q.SEED_BOOST}::DOUBLE ELSE 1 END AS score, CASE WHEN {hit} THEN replace({reason}, 'high recent affinity', 'seed companion') ELSE {reason} END AS reason, minutes FROM pool),
 songs AS (SELECT {b}tkey, akey, sum(n)::BIGINT AS plays, max(last) AS last, max((n, uri))[2] AS uri FROM (SELECT {b}tkey, akey, uri, count(*) AS n, max(ts) AS last FROM plays GROUP BY ALL) GROUP BY ALL),
 gone AS (SELECT {b}uri, akey, plays::DOUBLE AS score, 'lost favorite, last heard ' || strftime(last, '%Y-%m') AS reason, {q.TRACK_MINUTES}::DOUBLE AS minutes FROM songs WHERE {n_lost} > 0 AND plays >= {min_plays} AND last < TIMESTAMP '{AS_OF}' + INTERVAL 1 DAY - to_seconds({years_gone} * 365.25 * 86400)
  QUALIFY row_number() OVER ({part}ORDER BY plays DESC, tkey, akey) <= {target}),
 lost0 AS (SELECT * FROM gone x WHERE NOT EXISTS (SELECT 1 FROM tracks y WHERE {on}x.uri = y.uri AND early >= {skips})),
 regular AS (SELECT * FROM (SELECT * FROM scored x WHERE NOT EXISTS (SELECT 1 FROM lost0 y WHERE {on}x.uri = y.uri) QUALIFY row_number() OVER (PARTITION BY {b}akey ORDER BY score DESC, uri) <= {q.PER_ARTIST}) {top} <= {target - n_lost}),
 lost AS (SELECT * FROM (SELECT * FROM lost0 x QUALIFY row_number() OVER (PARTITION BY {b}akey ORDER BY score DESC, uri) + (SELECT count(*) FROM regular y WHERE {on}x.akey = y.akey) <= {q.PER_ARTIST}) {top} <= {n_lost}),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY {b}kind ORDER BY score DESC, uri) - 1 AS i, sum((kind = 'liked')::INT) OVER ({part}) AS n, sum((kind = 'lost')::INT) OVER ({part}) AS m FROM (SELECT *, 'liked' AS kind FROM regular UNION ALL SELECT *, 'lost' FROM lost))
 SELECT {b}(CASE WHEN kind = 'lost' THEN least((i + 1) * 3, n + i) WHEN i < 3 THEN i ELSE i + least(m, (i - 3) // 2 + 1) END)::INT AS position, uri, akey, kind, reason, round(score, 4) AS score, minutes FROM ranked"""


def _of(**how):
    return lambda spark, sf_dir: q.smart_queue(plays(spark, sf_dir), as_of=AS_OF, **how).selectExpr(*how.get("by", ()), "position", "uri", "akey", "kind", "reason", "round(score, 4) AS score", "minutes")


JOBS = {name: (_of(**how), PLAYS_SQL + _sql(**how)) for name, how in WAYS.items()}
