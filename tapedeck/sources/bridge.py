"""The plays table from the star-schema tables: `lineitem` for many years, `events` for one month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A play for each line item; recordings are parts, songs are part name and brand."""
    item, part, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part", "orders"))
    seconds = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 613) % 86400
    ts = F.timestamp_seconds(F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) + seconds)
    # parts come last: their names are not shuffled with every line item
    p = item.select("l_orderkey", "l_partkey", ts.alias("ts"), "l_quantity", "l_returnflag", "l_linestatus")
    p = p.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    p = p.select(
        "ts",
        F.col("o_custkey").alias("user_id"),
        F.concat(F.lit("spotify:track:"), F.col("l_partkey").cast("string")).alias("uri"),
        F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("track_name"),
        F.col("p_brand").alias("artist_name"),
        F.col("p_type").alias("album_name"),
        (F.col("l_quantity").cast("double") / 8).alias("minutes"),
        F.floor(F.col("l_quantity").cast("double") * 7500).alias("ms_played"),
        F.when(F.col("l_returnflag") == "R", "fwdbtn").when(F.col("l_returnflag") == "A", "trackdone").otherwise("endplay").alias("reason_end"),
        F.when(F.col("l_linestatus") == "O", "iOS").otherwise("macOS").alias("platform"),
    )
    return p.withColumns({"year": F.year("ts"), "month": F.month("ts"), "hour": F.hour("ts")}).withColumn("local_hour", (F.col("hour") + 19) % 24)


#: The same table in DuckDB, to stand before a query.
PLAYS_SQL = """WITH plays AS (SELECT *, year(ts)::INT AS year, month(ts)::INT AS month, hour(ts)::INT AS hour, ((hour(ts) + 19) % 24)::INT AS local_hour,
 translate(track_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS tkey, translate(artist_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS akey FROM (
 SELECT l_shipdate::TIMESTAMP + to_seconds((l_orderkey * 7919 + l_linenumber * 613) % 86400) AS ts, o_custkey AS user_id, 'spotify:track:' || l_partkey AS uri,
 CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_name END AS track_name, p_brand AS artist_name, p_type AS album_name,
 l_quantity::DOUBLE / 8 AS minutes, floor(l_quantity::DOUBLE * 7500)::BIGINT AS ms_played,
 CASE l_returnflag WHEN 'R' THEN 'fwdbtn' WHEN 'A' THEN 'trackdone' ELSE 'endplay' END AS reason_end, CASE l_linestatus WHEN 'O' THEN 'iOS' ELSE 'macOS' END AS platform
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)) """


def short_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A play for each event of one month."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("play_id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", (F.col("value") / 60).alias("minutes"))


def _k(divisor: int):
    return F.get_json_object("props", "$.k").cast("int") % divisor


def named_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """short_plays with names and reasons."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("play_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        F.concat(F.lit("spotify:track:"), _k(100)).alias("uri"),
        F.concat(F.lit("Artist "), _k(25)).alias("artist_name"),
        F.when(F.col("event_type") == "purchase", "trackdone").when(F.col("event_type") == "error", "fwdbtn").otherwise("endplay").alias("reason_end"),
        (F.col("value") / 60).alias("minutes"),
    )


NAMED_SQL = """WITH plays AS (SELECT event_id AS play_id, ts, user_id, 'spotify:track:' || k AS uri, 'Artist ' || (k % 25) AS artist_name,
 CASE event_type WHEN 'purchase' THEN 'trackdone' WHEN 'error' THEN 'fwdbtn' ELSE 'endplay' END AS reason_end, value / 60 AS minutes FROM (SELECT *, (props->>'$.k')::INT AS k FROM events)) """


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A poll of a listener's player for each event."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("poll_id"),
        F.col("ts").cast("timestamp").alias("observed_at"),
        "user_id",
        (F.col("event_type") != "error").alias("is_playing"),
        _k(3).cast("string").alias("track_id"),
        F.floor(F.col("value") * 1000).alias("progress_ms"),
        F.when(F.col("event_id") % 10 != 0, 20_000).cast("long").alias("duration_ms"),
    )


POLLS_SQL = """WITH polls AS (SELECT event_id AS poll_id, ts AS observed_at, user_id, event_type <> 'error' AS is_playing, ((props->>'$.k')::INT % 3)::VARCHAR AS track_id,
 floor(value * 1000)::BIGINT AS progress_ms, CASE WHEN event_id % 10 <> 0 THEN 20000 END AS duration_ms FROM events) """


def play_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classified listen for each event; its session names an agent's session or is null."""
    kinds = F.create_map(*[F.lit(v) for kv in _KINDS.items() for v in kv])
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("event_id"),
        F.col("ts").cast("timestamp").alias("ended_at"),
        "user_id",
        _k(100).cast("string").alias("track_id"),
        F.array(_k(25).cast("string"), _k(7).cast("string")).alias("artist_ids"),
        kinds[F.col("event_type")].alias("classification"),
        F.floor(F.col("value") * 1000).alias("duration_listened_ms"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("s"), (F.col("user_id") % 20).cast("string"))).alias("session_id"),
    )


_KINDS = {"purchase": "completed", "click": "abandoned", "signup": "replayed", "error": "skipped", "view": "abandoned"}
EVENTS_SQL = """WITH play_events AS (SELECT event_id, ts AS ended_at, user_id, k::VARCHAR AS track_id, [(k % 25)::VARCHAR, (k % 7)::VARCHAR] AS artist_ids,
 CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'replayed' WHEN 'error' THEN 'skipped' ELSE 'abandoned' END AS classification,
 floor(value * 1000)::BIGINT AS duration_listened_ms, CASE WHEN event_id % 3 = 0 THEN 's' || (user_id % 20) END AS session_id FROM (SELECT *, (props->>'$.k')::INT AS k FROM events)),
 snapshots AS (SELECT event_id AS snapshot_id, ts AS captured_at, ['night', 'morning', 'midday'][k % 3 + 1] AS daylight_phase, CASE WHEN k % 5 > 0 THEN ['clear', 'rain', 'snow', 'fog'][k % 5] END AS weather_condition,
 'place ' || (k % 4) AS location_label FROM (SELECT *, (props->>'$.k')::INT AS k FROM events WHERE event_type = 'signup')) """


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was around at the time of each sign-up."""
    return (
        spark.read.parquet(f"{sf_dir}/events.parquet")
        .where("event_type = 'signup'")
        .select(
            F.col("event_id").alias("snapshot_id"),
            F.col("ts").cast("timestamp").alias("captured_at"),
            F.element_at(F.array(*map(F.lit, ("night", "morning", "midday"))), _k(3) + 1).alias("daylight_phase"),
            F.when(_k(5) > 0, F.get(F.array(*map(F.lit, ("clear", "rain", "snow", "fog"))), _k(5) - 1)).alias("weather_condition"),
            F.concat(F.lit("place "), _k(4)).alias("location_label"),
        )
    )
