"""Listening-history aggregations over `plays`: a song is a folded (track, artist) pair, a recording is a uri."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapedeck.functions.columns import fold, is_skip, js_round

SONG = ["tkey", "akey"]


def keyed(plays: DataFrame) -> DataFrame:
    return plays.withColumns({"tkey": fold(F.col("track_name")), "akey": fold(F.col("artist_name"))})


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join by keys of which nulls are equal, so that plays without a listener or a name stay a group of their own."""
    r = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return left.join(r, on, how).drop(*[f"_{k}" for k in keys])


def _latest(c: str):
    return F.max_by(c, F.struct("ts", c)).alias(c)


def load_plays(plays: DataFrame, *, year: int | None = None, month: int | None = None, artist: str | None = None, ios_only: bool = False, limit: int | None = None) -> DataFrame:
    """Plays of a year, a month, an artist (folded) or the phone only, newest first; a filter that is None holds for all."""
    for c, v in (("year", year), ("month", month)):
        if v is not None:
            plays = plays.where(F.col(c) == v)
    if artist is not None:
        plays = plays.where(fold(F.col("artist_name")) == fold(F.lit(artist)))
    if ios_only:
        plays = plays.where("platform = 'iOS'")
    # with a limit, a top list of each part; without one, a sort over ranges
    plays = plays.orderBy(F.desc("ts"), "uri", "user_id")
    return plays if limit is None else plays.limit(limit)


def period_stats(plays: DataFrame, by: tuple[str, ...] = ("year",)) -> DataFrame:
    """Plays, hours, songs and artists of each year, or of other keys, such as ("user_id", "year", "month")."""
    # songs, then artists, then keys: distinct counts in one step would shuffle each play once for each of them
    songs = keyed(plays).groupBy(*by, *SONG).agg(F.count("*").alias("n"), F.sum("minutes").alias("m"))
    named = F.col("tkey").isNotNull() & F.col("akey").isNotNull()
    artists = songs.groupBy(*by, "akey").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum(named.cast("int")).alias("songs"))
    return artists.groupBy(*by).agg(F.sum("n").alias("plays"), js_round(F.sum("m") / 60, 1).alias("hours"), F.sum("songs").alias("songs"), F.count("akey").alias("artists"))


def period_rollup(plays: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """period_stats of each month, each year and all time in one scan: level is "month", "year" or "all", with null year or month where they are summed up.

    Null years and months are groups of their own at their level. With `by`, levels of each key."""
    stats = keyed(plays).select(*by, "year", "month", "minutes", *SONG)
    sets = [[*by, "year", "month"], [*by, "year"], [*by]]
    columns = [F.col(c) for c in (*by, "year", "month")]
    level = F.when(F.grouping("year") == 1, "all").when(F.grouping("month") == 1, "year").otherwise("month")
    return stats.groupingSets(sets, *columns).agg(level.alias("level"), F.count("*").alias("plays"), js_round(F.sum("minutes") / 60, 1).alias("hours"), F.countDistinct(*SONG).alias("songs"), F.countDistinct("akey").alias("artists"))


def _first(counts: DataFrame, limit: int, by: tuple[str, ...], keys: list[str]) -> DataFrame:
    """The most played of all, or of each group, with its rank."""
    order = [F.desc("plays"), *keys]
    if not by:
        return counts.orderBy(*order).limit(limit)
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= limit)


def top_songs(plays: DataFrame, limit: int = 20, by: tuple[str, ...] = ()) -> DataFrame:
    return _first(keyed(plays).groupBy(*by, *SONG).agg(F.count("*").alias("plays"), F.sum("minutes").alias("minutes")), limit, by, SONG)


def top_artists(plays: DataFrame, limit: int = 20, by: tuple[str, ...] = ()) -> DataFrame:
    return _first(keyed(plays).groupBy(*by, "akey").agg(F.count("*").alias("plays"), F.sum("minutes").alias("minutes")), limit, by, ["akey"])


def monthly_top(plays: DataFrame, n: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    counts = keyed(plays).groupBy(*by, "year", "month", *SONG).agg(F.count("*").alias("plays"))
    rank = F.row_number().over(Window.partitionBy(*by, "year", "month").orderBy(F.desc("plays"), *SONG))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def _cutoff(as_of: str, years_gone: float):
    return F.lit(as_of).cast("timestamp") + F.expr("INTERVAL 1 DAY") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(years_gone * 365.25 * 86400))


def lost_favorites(plays: DataFrame, *, as_of: str, min_plays: int, years_gone: float, limit: int = 50, by: tuple[str, ...] = ()) -> DataFrame:
    """Songs once played often whose last play on any recording lies more than years_gone before the end of as_of; with `by`, those of each
    key, with their rank."""
    cutoff = _cutoff(as_of, years_gone)
    # a song's plays meet in one task: all that follows is counted there, and plays are shuffled once
    by_uri = keyed(plays).repartition(*by, *SONG).groupBy(*by, *SONG, "uri", "year", "month").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    months = by_uri.withColumn("of_month", F.sum("n").over(Window.partitionBy(*by, *SONG, "year", "month")))
    uris = months.groupBy(*by, *SONG, "uri").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.max(F.struct("of_month", "year", "month")).alias("peak"))
    songs = uris.groupBy(*by, *SONG).agg(F.sum("n").alias("plays"), F.max("last").alias("last_played"), F.max_by("uri", F.struct("n", "uri")).alias("uri"), F.max("peak").alias("peak"))
    out = songs.where((F.col("plays") >= min_plays) & (F.col("last_played") < cutoff)).select(*by, *SONG, "plays", "last_played", "uri", F.col("peak.year").alias("peak_year"), F.col("peak.month").alias("peak_month"), F.col("peak.of_month").alias("peak_plays"))
    return _first(out, limit, by, SONG)


def _weight(as_of: str):
    """What a play adds to its recording's affinity."""
    years = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("ts")) / (365.25 * 86400)
    return F.least("minutes", F.lit(7.0)) * F.exp(-years / 3) * F.when(F.col("reason_end") == "trackdone", 1.5).otherwise(1.0)


def _affinity(as_of: str):
    return F.round(F.sum(_weight(as_of)), 2).alias("affinity")


def artist_affinity(plays: DataFrame, *, as_of: str, by: tuple[str, ...] = ()) -> DataFrame:
    return keyed(plays).groupBy(*by, "akey").agg(F.count("*").alias("plays"), _affinity(as_of))


def track_affinity(plays: DataFrame, *, as_of: str, by: tuple[str, ...] = ()) -> DataFrame:
    return plays.groupBy(*by, "uri").agg(F.count("*").alias("plays"), _affinity(as_of))


def early_skip(as_of: str, days: int = 30, under_ms: int = 30_000):
    return (F.col("ts") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))) & is_skip(F.col("reason_end")) & (F.col("ms_played") < under_ms)


def skip_penalized(plays: DataFrame, *, as_of: str, days: int = 30, least: int = 3, under_ms: int = 30_000, by: tuple[str, ...] = ()) -> DataFrame:
    recent = plays.where(early_skip(as_of, days, under_ms))
    return recent.groupBy(*by, "uri").agg(F.count("*").alias("skips")).where(F.col("skips") >= least)


def lifetime_totals(plays: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return plays.groupBy(*by).agg(F.count("*").alias("plays"), F.countDistinct("track_name", "artist_name").alias("songs"), F.countDistinct("artist_name").alias("artists"), F.min("ts").alias("first_play"), F.max("ts").alias("last_play"))


def skip_rate_by_quarter(plays: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return plays.groupBy(*by, "year", F.quarter("ts").alias("quarter")).agg(F.count("*").alias("plays"), F.round(F.avg(is_skip(F.col("reason_end")).cast("int")), 6).alias("skip_rate"))


def discovery_by_year(plays: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return keyed(plays).groupBy(*by, *SONG).agg(F.min("year").alias("year")).groupBy(*by, "year").agg(F.count("*").alias("new_songs"))


def concentration_by_year(plays: DataFrame, k: int = 100, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of each year's plays that its k most played songs take."""
    years = [*by, "year"]
    counts = keyed(plays).groupBy(*years, *SONG).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*years).orderBy(F.desc("n"), *SONG))
    # a limit of rank alone is met before the shuffle, so no year is sorted whole
    top = counts.withColumn("rank", rank).where(F.col("rank") <= k).groupBy(*years).agg(F.sum("n").alias("top"))
    # counts of songs are summed up, not plays
    totals = counts.groupBy(*years).agg(F.sum("n").alias("n"))
    return same(totals, top, years).select(*years, F.round(F.col("top") / F.col("n"), 6).alias("share"))


def hourly(plays: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return plays.groupBy(*by, "local_hour").agg(F.count("*").alias("plays"))


def day_of_week(plays: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return plays.groupBy(*by, (F.dayofweek("ts") - 1).alias("day")).agg(F.count("*").alias("plays"))


def never_stale_core(plays: DataFrame, top: int = 50, years: int = 8, by: tuple[str, ...] = ()) -> DataFrame:
    """Artists among the year's most played in so many years."""
    counts = keyed(plays).groupBy(*by, "year", "akey").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*by, "year").orderBy(F.desc("n"), "akey"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top).groupBy(*by, "akey").agg(F.count("*").alias("years_in_top")).where(F.col("years_in_top") >= years)


def skip_report(plays: DataFrame, min_plays: int = 20, by: tuple[str, ...] = ()) -> DataFrame:
    songs = keyed(plays).groupBy(*by, *SONG).agg(F.count("*").alias("plays"), F.sum(is_skip(F.col("reason_end")).cast("int")).alias("skips"))
    return songs.where(F.col("plays") >= min_plays).withColumn("skip_rate", F.round(F.col("skips") / F.col("plays"), 6))


def graph_nodes(plays: DataFrame, min_plays: int = 300, by: tuple[str, ...] = ()) -> DataFrame:
    """Artists with enough plays: total, peak year (ties to the latest) and years of five plays or more."""
    years = keyed(plays).groupBy(*by, "akey", "year").agg(F.count("*").alias("n"))
    out = years.groupBy(*by, "akey").agg(F.sum("n").alias("plays"), F.max(F.struct("n", "year")).alias("peak"), F.sum((F.col("n") >= 5).cast("int")).alias("active_years"))
    return out.where(F.col("plays") >= min_plays).select(*by, "akey", "plays", F.col("peak.year").alias("peak_year"), "active_years")
