"""Totals, series and nested lists behind the views of a day, a range of days, a song, an artist and an era."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapedeck.functions.columns import fold, is_skip, js_round, local_time
from tapedeck.operators.history import SONG, _first, keyed, same
from tapedeck.operators.periods import top_artists_adjusted
from tapedeck.sources.shared import cut


def _totals() -> list[Column]:
    return [F.count("*").alias("plays"), js_round(F.sum("minutes"), 1).alias("minutes"), F.countDistinct(*SONG).alias("songs"), F.countDistinct("artist_name").alias("artists")]


def _rank(by: list[str], *order) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def _inside(plays: DataFrame, start: str, end: str) -> DataFrame:
    """Plays of the local days start to end; as bounds of ts itself, so that they reach the scan."""
    hours = F.expr("INTERVAL 5 HOURS")
    return plays.where((F.col("ts") >= F.lit(start).cast("timestamp") + hours) & (F.col("ts") < F.lit(end).cast("timestamp") + F.expr("INTERVAL 1 DAY") + hours))


def on_this_day_totals(plays: DataFrame, *, month: int, day: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Plays, minutes, songs and artists of a calendar day over all years, with the years in order. Without `by`, one row (zeros, null minutes)."""
    local = local_time(F.col("ts"))
    heard = keyed(plays).where((F.month(local) == month) & (F.dayofmonth(local) == day))
    return heard.groupBy(*by).agg(*_totals(), F.concat_ws(",", F.sort_array(F.collect_set(F.year(local)))).alias("years"))


def date_range_totals(plays: DataFrame, *, start: str, end: str, as_of: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Totals of the local days from start to end, cut to those from the first play to as_of; for each key of `by` that has plays at all.

    A range that lies outside keeps its dates and has zeros; without plays there is no row. Raises where a date isn't one or start is after end."""
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    if first > last:
        raise ValueError(f"start {start} is after end {end}")
    keys = list(by) or ["_all"]
    rows = plays if by else plays.withColumn("_all", F.lit(1))
    since = rows.groupBy(*keys).agg(F.min("ts").alias("since")).where("since is not null").select(*keys, local_time(F.col("since")).cast("date").alias("since"))
    inside = keyed(_inside(rows, start, min(end, as_of))).withColumn("_day", local_time(F.col("ts")).cast("date"))
    totals = inside.groupBy(*keys).agg(F.countDistinct("_day").alias("days_with_plays"), *_totals())
    a, b = F.greatest("since", F.lit(start).cast("date")), F.least(F.lit(end).cast("date"), F.lit(as_of).cast("date"))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("days_with_plays", "plays")] + [F.coalesce("minutes", F.lit(0.0)).alias("minutes")] + [F.coalesce(c, F.lit(0)).alias(c) for c in ("songs", "artists")]
    out = same(since, totals, keys, "left").withColumns({"a": a, "b": b})
    whole = F.col("a") <= F.col("b")
    return out.select(*by, F.when(whole, F.col("a")).otherwise(F.lit(start).cast("date")).alias("effective_start"), F.when(whole, F.col("b")).otherwise(F.lit(end).cast("date")).alias("effective_end"), F.when(whole, F.datediff("b", "a") + 1).otherwise(0).alias("days_in_range"), *counts)


def date_range_artists(plays: DataFrame, *, start: str, end: str, limit: int = 25, by: tuple[str, ...] = ()) -> DataFrame:
    """Artists most played in the local days from start to end; with `by` of each key, with their rank."""
    return _first(keyed(_inside(plays, start, end)).groupBy(*by, "akey").agg(F.count("*").alias("plays"), F.sum("minutes").alias("minutes")), limit, by, ["akey"])


def era_of_year(year: Column, eras: dict[str, list[int]]) -> Column:
    """The first era that names the year, or null."""
    return F.coalesce(*[F.when(year.isin(*years), name) for name, years in eras.items()], F.lit(None))


def majority_era(years: Column, eras: dict[str, list[int]]) -> Column:
    """The era that most of the years of an array lie in; of equals the one that comes first in the array, null if none does."""
    named = F.filter(F.transform(years, lambda y: era_of_year(y, eras)), lambda e: e.isNotNull())
    best = F.array_max(F.transform(F.array_distinct(named), lambda e: F.struct(F.size(F.filter(named, lambda x: x == e)).alias("n"), (-F.array_position(named, e)).alias("at"))))
    return F.get(named, (-best["at"] - 1).cast("int"))


def track_series(plays: DataFrame, eras: dict[str, list[int]], by: tuple[str, ...] = ()) -> DataFrame:
    """For every song its plays of each month in order, the era of its first year and its completion rate beside everybody's, in percent."""
    done = F.sum((F.col("reason_end") == "trackdone").cast("int"))
    months = keyed(plays).groupBy(*by, *SONG, "year", "month").agg(F.count("*").alias("n"), F.coalesce(done, F.lit(0)).alias("done"))
    series = F.sort_array(F.collect_list(F.struct(F.format_string("%04d-%02d", "year", "month").alias("month"), F.col("n").alias("plays"))))
    songs = months.groupBy(*by, *SONG).agg(series.alias("months"), F.min("year").alias("y"), F.sum("n").alias("n"), F.sum("done").alias("done"))
    overall = songs.agg((F.sum("done") / F.sum("n")).alias("all"))
    out = songs.join(F.broadcast(overall), how="cross")
    return out.select(*by, *SONG, "months", era_of_year(F.col("y"), eras).alias("era"), js_round(F.col("done") / F.col("n") * 100, 1).alias("completion"), js_round(F.col("all") * 100, 1).alias("overall_completion"))


def artist_profiles(plays: DataFrame, companions: DataFrame | None = None, *, tracks: int = 10, core_top: int = 50, core_years: int = 8, by: tuple[str, ...] = ()) -> DataFrame:
    """For every artist: plays of each year, the most played songs with their last play, years among the year's most played and whether
    these make a core artist, and companions (artist_name, companion, sessions; at most a few each), each list in order."""
    rows = keyed(plays).groupBy(*by, "akey", "tkey", "year").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    years = rows.groupBy(*by, "akey", "year").agg(F.sum("n").alias("n"))
    top = years.withColumn("k", _rank([*by, "year"], F.desc("n"), "akey"))
    yearly = top.groupBy(*by, "akey").agg(F.sort_array(F.collect_list(F.struct("year", F.col("n").alias("plays")))).alias("years"), F.sum((F.col("k") <= core_top).cast("int")).alias("years_in_top"))
    songs = rows.groupBy(*by, "akey", "tkey").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    best = songs.withColumn("k", _rank([*by, "akey"], F.desc("n"), "tkey")).where(F.col("k") <= tracks)
    lists = best.groupBy(*by, "akey").agg(F.sort_array(F.collect_list(F.struct("k", F.col("tkey").alias("track"), F.col("n").alias("plays"), F.col("last").alias("last_play")))).alias("tracks"))
    out = same(yearly, lists, [*by, "akey"]).withColumn("core", F.col("years_in_top") >= core_years)
    if companions is not None:
        near = companions.select(*by, fold(F.col("artist_name")).alias("akey"), F.struct((-F.col("sessions")).alias("k"), F.col("companion").alias("artist"), "sessions").alias("c"))
        out = same(out, near.groupBy(*by, "akey").agg(F.sort_array(F.collect_list("c")).alias("companions")), [*by, "akey"], "left")
    return out


def adjusted_artist_series(plays: DataFrame, artists: DataFrame, n: int = 12) -> DataFrame:
    """top_artists_adjusted with the artist's id and its plays of every year of the whole history, zeros included.

    artists: artist_id, artist_name; of several of a folded name the smallest id counts, null without one."""
    top = top_artists_adjusted(plays, n)
    # n artists, and one row of years
    few = F.broadcast(top.select("akey"))
    counts = keyed(plays).join(few, "akey", "left_semi").groupBy("akey", "year").agg(F.count("*").alias("n")).groupBy("akey").agg(F.map_from_entries(F.collect_list(F.struct("year", "n"))).alias("of"))
    ids = artists.select(fold(F.col("artist_name")).alias("akey"), "artist_id").join(few, "akey", "left_semi").groupBy("akey").agg(F.min("artist_id").alias("artist_id"))
    span = plays.agg(F.sequence(F.min("year"), F.max("year")).alias("span"))
    filled = F.transform("span", lambda y: F.struct(y.alias("year"), F.coalesce(F.col("of")[y], F.lit(0)).alias("plays")))
    return top.join(counts, "akey").join(ids, "akey", "left").join(F.broadcast(span), how="cross").select(*top.columns, "artist_id", filled.alias("plays_by_year"))


def era_details(plays: DataFrame, eras: dict[str, list[int]], *, artists: int = 8, by: tuple[str, ...] = ()) -> DataFrame:
    """Each era, a set of years, with its totals, skip rate in percent, top song, most played artists and plays of each year, lists in order.

    A year may stand in several eras; eras without plays have no row."""
    names = F.array_compact(F.array(*[F.when(F.col("year").isin(*ys), e) for e, ys in eras.items()]))
    keys = [*by, "era"]
    rows = keyed(plays).select(*by, F.explode(names).alias("era"), "year", "uri", "minutes", *SONG, is_skip(F.col("reason_end")).cast("int").alias("skip"))
    # plays are read and joined once, all else comes from these counts
    cells = cut(rows.groupBy(*keys, *SONG, "uri", "year").agg(F.count("*").alias("n"), F.sum("minutes").alias("m"), F.sum("skip").alias("skips")))
    totals = cells.groupBy(*keys).agg(F.sum("n").alias("plays"), js_round(F.sum("m") / 60, 1).alias("hours"), F.countDistinct("uri").alias("tracks"), F.countDistinct("akey").alias("artists"), js_round(F.sum("skips") / F.sum("n") * 100, 1).alias("skip_rate"))
    songs = cells.groupBy(*keys, *SONG).agg(F.sum("n").alias("n"))
    top = songs.withColumn("k", _rank(keys, F.desc("n"), *SONG)).where("k = 1").select(*keys, F.struct(F.col("tkey").alias("track"), F.col("akey").alias("artist"), F.col("n").alias("plays")).alias("top_song"))
    by_artist = cells.groupBy(*keys, "akey").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).withColumn("k", _rank(keys, F.desc("n"), "akey")).where(F.col("k") <= artists)
    lists = by_artist.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", F.col("akey").alias("artist"), F.col("n").alias("plays"), js_round(F.col("m") / 60, 1).alias("hours")))).alias("top_artists"))
    years = cells.groupBy(*keys, "year").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("year", F.col("n").alias("plays")))).alias("years"))
    return same(same(same(totals, top, keys), lists, keys), years, keys)


PERIODS = {"month": 30, "quarter": 90, "year": 365, "all": None}


def skip_overview(plays: DataFrame, *, as_of: str, period: str = "quarter", artist: str | None = None, least: int = 5, worst: int = 15, best: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """How much is skipped in a period up to as_of: rows of kind `overall` (no song, rank 0), `skipped` (songs by skip rate, then plays) and
    `champion` (songs never skipped, by plays), both among songs played often enough; rates in percent. Without plays, no rows."""
    days = PERIODS[period]
    rows = plays.where(F.col("ts") < F.lit(as_of).cast("timestamp"))
    if days is not None:
        rows = rows.where(F.col("ts") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))
    if artist is not None:
        rows = rows.where(F.col("artist_name") == artist)
    songs = keyed(rows).groupBy(*by, *SONG).agg(F.count("*").alias("plays"), F.sum(is_skip(F.col("reason_end")).cast("long")).alias("skips"))
    rate = F.col("skips") / F.col("plays")
    overall = songs.groupBy(*by).agg(F.sum("plays").alias("plays"), F.sum("skips").alias("skips")).where("plays > 0")
    often = songs.where(F.col("plays") >= least)
    orders = {"skipped": ("skips > 0", [F.desc(rate), F.desc("plays"), *SONG], worst), "champion": ("skips = 0", [F.desc("plays"), *SONG], best)}
    out = overall.select(*by, F.lit("overall").alias("kind"), F.lit(0).alias("rank"), *[F.lit(None).cast("string").alias(c) for c in SONG], "plays", "skips")
    for kind, (which, order, n) in orders.items():
        some = often.where(which)
        some = some if by else some.orderBy(*order).limit(n)
        # without keys these are n rows
        out = out.unionByName(some.withColumn("rank", _rank([*by] or [F.lit(1)], *order)).where(F.col("rank") <= n).select(*by, F.lit(kind).alias("kind"), "rank", *SONG, "plays", "skips"))
    return out.withColumn("skip_rate", js_round(rate * 100, 1))


def current_penalties(plays: DataFrame, *, as_of: str, days: int = 30, least: int = 3, under_ms: int = 30_000, by: tuple[str, ...] = ()) -> DataFrame:
    """Recordings kept out of queues for having been skipped so often and so early of late, with their latest names."""
    recent = plays.where((F.col("ts") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))) & is_skip(F.col("reason_end")) & (F.col("ms_played") < under_ms))
    names = F.max_by(F.struct("track_name", "artist_name"), F.struct("ts", "track_name", "artist_name")).alias("latest")
    return recent.groupBy(*by, "uri").agg(F.count("*").alias("skips"), names).where(F.col("skips") >= least).select(*by, "uri", "latest.*", "skips")
