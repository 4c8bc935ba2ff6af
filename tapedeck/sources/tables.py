"""Reading exports, and merging new rows into stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

HISTORY = "ts string, platform string, ms_played long, conn_country string, master_metadata_track_name string, master_metadata_album_artist_name string, master_metadata_album_album_name string, spotify_track_uri string, episode_name string, audiobook_title string, reason_start string, reason_end string, shuffle boolean, offline boolean"


def read_streaming_history(spark: SparkSession, path: str) -> DataFrame:
    """The music of a streaming-history export (JSON arrays) as plays; episodes and audiobooks are left out."""
    raw = spark.read.schema(HISTORY).json(path, multiLine=True)
    music = raw.where("spotify_track_uri is not null and episode_name is null and audiobook_title is null")
    ts = F.to_timestamp("ts")
    platform = F.when(F.lower("platform").rlike("ios|iphone|ipad"), "iOS").when(F.lower("platform").rlike("android"), "Android").when(F.lower("platform").rlike("os ?x|mac"), "macOS").when(F.lower("platform").contains("windows"), "Windows").when(F.lower("platform").contains("web"), "web").otherwise(F.col("platform"))
    return music.select(
        ts.alias("ts"),
        platform.alias("platform"),
        F.coalesce("ms_played", F.lit(0)).alias("ms_played"),
        "conn_country",
        F.col("master_metadata_track_name").alias("track_name"),
        F.col("master_metadata_album_artist_name").alias("artist_name"),
        F.col("master_metadata_album_album_name").alias("album_name"),
        F.col("spotify_track_uri").alias("uri"),
        F.coalesce("reason_start", F.lit("")).alias("reason_start"),
        F.coalesce("reason_end", F.lit("")).alias("reason_end"),
        F.coalesce("shuffle", F.lit(False)).alias("shuffle"),
        F.coalesce("offline", F.lit(False)).alias("offline"),
        F.year(ts).alias("year"),
        F.month(ts).alias("month"),
        F.hour(ts).alias("hour"),
        ((F.hour(ts) + 19) % 24).alias("local_hour"),
        (F.coalesce("ms_played", F.lit(0)) / 60000).alias("minutes"),
    )


PLAYS = "ts timestamp, platform string, ms_played long, conn_country string, track_name string, artist_name string, album_name string, uri string, reason_start string, reason_end string, shuffle boolean, offline boolean, hour int, local_hour int, minutes double, year int, month int"


def read_plays(spark: SparkSession, path: str, *, format: str = "parquet") -> DataFrame:
    """Stored plays, as Parquet or as JSON lines, in folders of years and months, so that filters on these skip folders."""
    if format == "parquet":
        return spark.read.parquet(path)
    return spark.read.schema(PLAYS).format(format).load(path)


def write_plays(plays: DataFrame, path: str, *, format: str = "parquet", months_only: bool = False, expect: int | None = None) -> None:
    """Writes plays in folders of years and months, over all that is there or, with months_only, over the months that plays has.

    With `expect` the rows are first written beside path, where they are counted, and copied from there if they are as many; if
    not, ValueError is raised and path stays as it was. The folder beside is removed either way."""

    def write(df: DataFrame, to: str, mode: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("year", "month").format(format).save(to)

    mode = "dynamic" if months_only else "static"
    if expect is None:
        write(plays, path, mode)
        return
    spark, beside, written = plays.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}.staged", Observation("written")
    try:
        write(plays.observe(written, F.count(F.lit(1)).alias("rows")), beside, "static")
        if (rows := written.get["rows"]) != expect:
            raise ValueError(f"{rows} rows were written for {path}, {expect} were expected")
        # with no rows there are no folders to tell years and months from
        staged = spark.read.schema(plays.schema).format(format).load(beside) if rows else plays.limit(0)
        write(staged.select(*plays.columns), path, mode)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(beside)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


ACTIVITY = ("Event Type", "Container Artist Name", "End Reason Type", "Event End Timestamp", "Media Type", "Play Duration Milliseconds", "Song Name", "Album Name")


def _csv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, mode="DROPMALFORMED")
    if lost := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"{path} has no column {', '.join(lost)}")
    return df.select(*columns)


def read_apple_activity(spark: SparkSession, path: str) -> DataFrame:
    """Ended plays of audio that took 30 s or came to their natural end; raises where a column isn't there."""
    df = _csv(spark, path, ACTIVITY)
    ms = F.col("Play Duration Milliseconds").cast("long")
    kept = df.where((F.col("Event Type") == "PLAY_END") & (F.col("Media Type") == "AUDIO") & ((ms >= 30_000) | (F.col("End Reason Type") == "NATURAL_END_OF_TRACK")))
    return kept.select(F.to_timestamp("Event End Timestamp").alias("ts"), F.col("Song Name").alias("track_name"), F.col("Container Artist Name").alias("artist_name"), F.col("Album Name").alias("album_name"), ms.alias("ms_played"), F.col("End Reason Type").alias("reason_end"))


def read_apple_daily_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Different (day, song, track id); the song is what follows the first dash of a description."""
    df = _csv(spark, path, ("Date Played", "Track Identifier", "Track Description"))
    d = F.col("Track Description")
    song = F.coalesce(*[F.when(d.contains(dash), F.substring(d, F.locate(dash, d) + len(dash), 10**6)) for dash in (" — ", " – ", " - ")], d)
    return df.select(F.to_date("Date Played", "yyyyMMdd").alias("day"), F.trim(song).alias("song"), F.col("Track Identifier").alias("track_id")).distinct()


def read_apple_library(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema("Title string, Artist string, Album string, `Purchased Track Identifier` long").json(path, multiLine=True)
    return df.select(F.col("Title").alias("title"), F.col("Artist").alias("artist"), F.col("Album").alias("album"), F.col("Purchased Track Identifier").cast("string").alias("track_id"))


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], rules: dict[str, str] | None = None) -> DataFrame:
    """target with the rows of updates, of which each key has one. `rules` by column: overwrite (the default), keep (an
    old value stays if the new one is null or empty), max, or terminal:a,b (an old value that is one of these stays)."""
    old, new = target.alias("old"), updates.alias("new")

    def merged(c: str) -> Column:
        o, n, rule = F.col(f"old.`{c}`"), F.col(f"new.`{c}`"), (rules or {}).get(c, "overwrite")
        if rule == "keep":
            return F.coalesce(F.when(n.cast("string") != "", n), o)
        if rule == "max":
            return F.greatest(o, n)
        if rule.startswith("terminal:"):
            return F.when(o.isin(*rule.removeprefix("terminal:").split(",")), o).otherwise(F.coalesce(n, o))
        return F.when(F.col("new._here"), n).otherwise(o)

    joined = old.join(updates.withColumn("_here", F.lit(True)).alias("new"), keys, "full_outer")
    return joined.select(*keys, *[(merged(c) if c in updates.columns else F.col(f"old.`{c}`")).alias(c) for c in target.columns if c not in keys])


def insert_missing(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """target and those rows of new whose key it doesn't have."""
    return target.unionByName(new.dropDuplicates(keys).join(target, keys, "left_anti"), allowMissingColumns=True)


def replace_children(target: DataFrame, new: DataFrame, parents: list[str]) -> DataFrame:
    """target, in which the rows of every parent that new names are those of new."""
    return target.join(new.select(*parents).distinct(), parents, "left_anti").unionByName(new)


def prune(df: DataFrame, ts: str, *, as_of: str, days: int) -> DataFrame:
    return df.where(F.col(ts) >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def publish(df: DataFrame, path: str, as_of: str, *, format: str = "parquet") -> None:
    """Writes df as the snapshot of a day, over that day's earlier one."""
    df.write.mode("overwrite").format(format).save(f"{path}/as_of={as_of}")


def latest(spark: SparkSession, path: str, *, format: str = "parquet") -> DataFrame:
    """The latest snapshot; the other days' folders are left out when the join's days are known."""
    df = spark.read.format(format).load(path)
    newest = df.agg(F.max("as_of").alias("as_of"))
    return df.join(F.broadcast(newest), "as_of")
