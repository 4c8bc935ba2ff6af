"""Lyrics worth marking, marked passages, and artists' scores by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapedeck.sources.shared import cut

PASSAGES = "array<struct<passage_index:int,start_line:int,end_line:int,text:string>>"


def _heard(plays: DataFrame) -> DataFrame:
    """Each recording with its plays and first play."""
    return plays.groupBy("uri").agg(F.count("*").alias("plays"), F.min("ts").alias("first_play"))


def _named(few: DataFrame, plays: DataFrame) -> DataFrame:
    """A list of recordings with the latest names of each; plays of others go before anything is shuffled."""
    names = F.max_by(F.struct("track_name", "artist_name"), F.struct("ts", "track_name", "artist_name"))
    latest = plays.join(F.broadcast(few.select("uri")), "uri", "left_semi").groupBy("uri").agg(names.alias("latest"))
    return few.join(latest, "uri").select(*few.columns, "latest.*")


def highlight_tracks(plays: DataFrame, lyrics: DataFrame, passages: DataFrame, *, top: int = 50, least_chars: int = 100) -> DataFrame:
    """The most played recordings that have sung lyrics of more than so many characters, each with its passages in order.

    lyrics: uri, status, instrumental, lyrics_plain, one row a recording (of more, any counts). passages: uri, passage_index,
    start_line, end_line, passage_text. Recordings without passages have an empty array; ties by uri."""
    sung = lyrics.where((F.col("status") == "ok") & ~F.coalesce("instrumental", F.lit(False)) & (F.length("lyrics_plain") > least_chars)).dropDuplicates(["uri"]).select("uri", "lyrics_plain")
    # the texts join once the list is made
    best = cut(_heard(plays).select("uri", "plays").join(sung.select("uri"), "uri", "left_semi").orderBy(F.desc("plays"), "uri").limit(top))
    few = F.broadcast(best.select("uri"))
    marks = passages.join(few, "uri", "left_semi").groupBy("uri").agg(F.sort_array(F.collect_list(F.struct("passage_index", "start_line", "end_line", F.col("passage_text").alias("text")))).alias("passages"))
    best = _named(best, plays).select("uri", "plays", "track_name", "artist_name")
    return best.join(sung.join(few, "uri", "left_semi"), "uri").join(marks, "uri", "left").withColumn("passages", F.coalesce(F.col("passages").cast(PASSAGES), F.array().cast(PASSAGES)))


def loved_passages(plays: DataFrame, passages: DataFrame, *, showcase: int = 5, depth: int = 30) -> DataFrame:
    """First passages of the most played recordings (part `showcase`), then of those heard earliest among the others (`depth`), with
    their rank in the part. Recordings that were never played have no row; ties by uri."""
    first = passages.where("passage_index = 0").dropDuplicates(["uri"]).select("uri", "passage_text")
    heard = _heard(plays).join(first.select("uri"), "uri", "left_semi")
    best = heard.orderBy(F.desc("plays"), "uri").limit(showcase)
    # of the earliest, as many are in the showcase at most
    early = heard.orderBy("first_play", "uri").limit(showcase + depth).join(F.broadcast(best.select("uri")), "uri", "left_anti").orderBy("first_play", "uri").limit(depth)
    parts = [best.select(F.lit("showcase").alias("part"), "*", (-F.col("plays")).alias("key")), early.select(F.lit("depth").alias("part"), "*", F.unix_micros("first_play").alias("key"))]
    both = parts[0].unionByName(parts[1])
    ranked = cut(both.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("key", "uri"))).drop("key"))
    named = _named(ranked, plays).select("part", "uri", "plays", "first_play", "track_name", "artist_name", "rank")
    return first.join(F.broadcast(named), "uri")


def artist_taste_by_name(plays: DataFrame, tracks: DataFrame, artists: DataFrame) -> DataFrame:
    """Each artist name that stands in plays with the best score of any artist credited on its recordings.

    plays: uri, artist_name. tracks: track_id, artist_ids (a JSON list of ids; broken ones name nobody). artists: artist_id, score.
    Names without a scored artist have no row."""
    credited = tracks.select("track_id", F.explode(F.from_json("artist_ids", "array<string>")).alias("artist_id")).distinct()
    best = credited.join(artists.select("artist_id", "score"), "artist_id").groupBy("track_id").agg(F.max("score").alias("score"))
    names = plays.where("artist_name is not null").select(F.regexp_replace("uri", "^spotify:track:", "").alias("track_id"), "artist_name").distinct()
    return names.join(best, "track_id").groupBy("artist_name").agg(F.max("score").alias("score"))
