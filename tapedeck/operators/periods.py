"""Dates, rolling windows, details of one song or artist, obsessions and eras over `plays`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapedeck.functions.columns import fold, is_skip, js_round, local_time
from tapedeck.operators.history import SONG, _first, keyed
from tapedeck.sources.shared import cut

def _skipped():
    return F.sum(is_skip(F.col("reason_end")).cast("int"))


def _at(as_of: str, days: int = 0):
    return F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))


def _between(as_of: str, first: int, last: int):
    """Whether ts lies from `first` to `last` (excluded) days before as_of."""
    return (F.col("ts") >= _at(as_of, first)) & (F.col("ts") < _at(as_of, last))


def skip_counts(plays: DataFrame, *, as_of: str, days: int = 90, by: tuple[str, ...] = ()) -> DataFrame:
    return plays.where(_between(as_of, days, 0) & is_skip(F.col("reason_end"))).groupBy(*by, "uri").agg(F.count("*").alias("skips"))


def canonical_uris(plays: DataFrame) -> DataFrame:
    """The most played recording of each song."""
    return keyed(plays).groupBy(*SONG, "uri").agg(F.count("*").alias("n")).groupBy(*SONG).agg(F.max_by("uri", F.struct("n", "uri")).alias("uri"))


def on_this_day(plays: DataFrame, *, month: int, day: int, limit: int = 25) -> DataFrame:
    """Songs most played on a calendar day of any year, with their lifetime recording, best year (ties to the latest) and years."""
    local = local_time(F.col("ts"))
    years = keyed(plays).where((F.month(local) == month) & (F.dayofmonth(local) == day)).groupBy(*SONG, F.year(local).alias("y")).agg(F.count("*").alias("n"))
    songs = years.groupBy(*SONG).agg(F.sum("n").alias("plays"), F.max(F.struct("n", "y")).alias("peak"), F.concat_ws(",", F.sort_array(F.collect_set("y"))).alias("years"))
    top = songs.orderBy(F.desc("plays"), *SONG).limit(limit)
    # at most `limit` songs
    uris = canonical_uris(keyed(plays).join(F.broadcast(top.select(*SONG)), SONG, "left_semi"))
    return top.join(uris, SONG).select(*SONG, "uri", "plays", F.col("peak.y").alias("peak_year"), F.col("peak.n").alias("peak_plays"), "years")


def date_range(plays: DataFrame, *, start: str, end: str, limit: int = 25) -> DataFrame:
    """Top songs of the local days start to end (both included), with their recording most played in them."""
    if start > end:
        raise ValueError(f"start {start} is after end {end}")
    inside = plays.where(local_time(F.col("ts")).cast("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    uris = keyed(inside).groupBy(*SONG, "uri").agg(F.count("*").alias("n"), F.sum("minutes").alias("m"))
    songs = uris.groupBy(*SONG).agg(F.sum("n").alias("plays"), F.sum("m").alias("minutes"), F.max_by("uri", F.struct("n", "uri")).alias("uri"))
    return songs.orderBy(F.desc("plays"), *SONG).limit(limit)


def daily_breakdown(plays: DataFrame, *, start: str, end: str) -> DataFrame:
    """Every local day from start to end, with plays, minutes and its top song; days without plays have zeros."""
    day = local_time(F.col("ts")).cast("date")
    songs = keyed(plays).withColumn("day", day).where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).groupBy("day", *SONG).agg(F.count("*").alias("n"), F.sum("minutes").alias("m"))
    rank = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("n"), *SONG))
    days = songs.withColumn("k", rank).groupBy("day").agg(F.sum("n").alias("plays"), F.sum("m").alias("minutes"), F.max(F.when(F.col("k") == 1, F.col("tkey"))).alias("top_song"))
    calendar = plays.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    return calendar.join(days, "day", "left").select("day", F.coalesce("plays", F.lit(0)).alias("plays"), F.coalesce("minutes", F.lit(0.0)).alias("minutes"), "top_song")


def search(plays: DataFrame, q: str, limit: int = 20) -> DataFrame:
    """Songs and artists whose folded name holds q, by plays."""
    k = keyed(plays)
    pattern = fold(F.lit(f"%{q}%"))
    songs = k.where(F.like("tkey", pattern)).groupBy(*SONG).agg(F.count("*").alias("plays")).select(F.lit("song").alias("kind"), F.col("tkey").alias("name"), F.col("akey").alias("artist"), "plays")
    artists = k.where(F.like("akey", pattern)).groupBy("akey").agg(F.count("*").alias("plays")).select(F.lit("artist").alias("kind"), F.col("akey").alias("name"), F.lit(None).cast("string").alias("artist"), "plays")
    return songs.unionByName(artists).orderBy(F.desc("plays"), "kind", "name", "artist").limit(limit)


def track_details(plays: DataFrame, min_plays: int = 1) -> DataFrame:
    """For every song: totals, first and last play, recording, best month and skip and completion rates beside everybody's."""
    # a song's plays meet in one task: all that follows is counted there, and plays are read and shuffled once
    cells = keyed(plays).repartition(*SONG).groupBy(*SONG, "uri", "year", "month").agg(F.count("*").alias("n"), F.sum("minutes").alias("m"), F.min("ts").alias("first"), F.max("ts").alias("last"), _skipped().alias("s"), F.sum((F.col("reason_end") == "trackdone").cast("int")).alias("d"))
    months = cells.withColumn("of_month", F.sum("n").over(Window.partitionBy(*SONG, "year", "month")))
    by_uri = months.groupBy(*SONG, "uri").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("s").alias("s"), F.sum("d").alias("d"), F.max(F.struct("of_month", "year", "month")).alias("peak"))
    songs = cut(by_uri.groupBy(*SONG).agg(F.sum("n").alias("plays"), F.sum("m").alias("minutes"), F.min("first").alias("first_play"), F.max("last").alias("last_play"), F.max_by("uri", F.struct("n", "uri")).alias("uri"), F.sum("s").alias("s"), F.sum("d").alias("d"), F.max("peak").alias("peak")))
    overall = songs.agg(F.sum("s").alias("all_s"), F.sum("plays").alias("all_n"))
    named = F.col("tkey").isNotNull() & F.col("akey").isNotNull()
    out = songs.where(named & (F.col("plays") >= min_plays)).join(F.broadcast(overall), how="cross")
    return out.select(*SONG, "plays", "minutes", "first_play", "last_play", "uri", (F.col("peak.year") * 100 + F.col("peak.month")).alias("peak_month"), F.round(F.col("s") / F.col("plays"), 6).alias("skip_rate"), F.round(F.col("d") / F.col("plays"), 6).alias("completion_rate"), F.round(F.col("all_s") / F.col("all_n"), 6).alias("overall_skip_rate"))


def artist_details(plays: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """For every artist: totals, different songs and albums, first and last play and most played song."""
    # with keys, a key's plays of an artist meet in one task and are shuffled once; without, counts of them are
    k = keyed(plays).repartition(*by, "akey") if by else keyed(plays)
    cells = k.groupBy(*by, "akey", "tkey", "album_name").agg(F.count("*").alias("n"), F.sum("minutes").alias("m"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    song = Window.partitionBy(*by, "akey", "tkey")
    cells = cells.withColumns({"of_song": F.sum("n").over(song), "one": (F.row_number().over(song.orderBy("album_name")) == 1).cast("int")})
    sums = [F.sum("n").alias("n"), F.sum("m").alias("m"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("one").alias("songs"), F.max(F.struct("of_song", "tkey")).alias("top")]
    albums = cells.groupBy(*by, "akey", "album_name").agg(*sums)
    out = albums.groupBy(*by, "akey").agg(F.sum("n").alias("plays"), F.sum("m").alias("minutes"), F.count("album_name").alias("albums"), F.min("first").alias("first_play"), F.max("last").alias("last_play"), F.sum("songs").alias("songs"), F.max("top").alias("top"))
    return out.select(*by, "akey", "plays", "minutes", "albums", "first_play", "last_play", "songs", F.col("top.tkey").alias("top_song"))


def week_top(plays: DataFrame, *, as_of: str, n: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    week = keyed(plays).where(_between(as_of, 7, 0)).groupBy(*by, *SONG).agg(F.count("*").alias("plays"), F.round(_skipped() / F.count("*"), 6).alias("skip_rate"))
    return _first(week, n, by, SONG)


def artist_deltas(plays: DataFrame, *, as_of: str, top: int = 50, by: tuple[str, ...] = ()) -> DataFrame:
    """The most played artists of 30 days, with the change against the 30 days before and whether they rise or fall."""
    now = F.col("ts") >= _at(as_of, 30)
    a = keyed(plays).where(_between(as_of, 60, 0)).groupBy(*by, "akey").agg(F.sum(now.cast("int")).alias("plays"), F.sum((~now).cast("int")).alias("prior"), js_round((F.sum(F.when(now, F.col("minutes")).otherwise(-F.col("minutes")))) / 60, 1).alias("hours_delta"))
    a = _first(a.where("plays > 0"), top, by, ["akey"])
    delta = F.col("plays") - F.col("prior")
    return a.select(*by, "akey", "plays", delta.alias("delta"), "hours_delta", F.when(delta > 0, "rising").when(delta < 0, "falling").otherwise("steady").alias("trend"))


def skip_rate_wow(plays: DataFrame, *, as_of: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Skip rates of the last week and the one before."""
    now, skip = F.col("ts") >= _at(as_of, 7), is_skip(F.col("reason_end")).cast("int")
    return plays.where(_between(as_of, 14, 0)).groupBy(*by).agg(F.round(F.avg(F.when(now, skip)), 6).alias("this_week"), F.round(F.avg(F.when(~now, skip)), 6).alias("last_week"))


def new_entries(plays: DataFrame, *, year: int, month: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Songs first heard in that month."""
    songs = keyed(plays).groupBy(*by, *SONG).agg(F.min(F.col("year") * 100 + F.col("month")).alias("first"), F.count("*").alias("plays"))
    return songs.where(F.col("first") == year * 100 + month).drop("first")


def daylight_bands(plays: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    h = F.col("local_hour")
    band = F.when(h < 6, "night").when(h < 12, "morning").when(h < 18, "afternoon").otherwise("evening")
    return plays.groupBy(*by, band.alias("band")).agg(F.count("*").alias("plays"))


def listening_by_month(plays: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return plays.groupBy(*by, "year", "month").agg(F.count("*").alias("plays"), F.sum("minutes").alias("minutes"))


def heatmap(plays: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return plays.groupBy(*by, local_time(F.col("ts")).cast("date").alias("day")).agg(F.count("*").alias("plays"))


def rolling_windows(plays: DataFrame, *, as_of: str) -> DataFrame:
    """Plays of the last 7 and 30 days against as many days before; from nothing the change is 100 %, or 0."""
    def count(first: int, last: int):
        return F.sum(_between(as_of, first, last).cast("int"))

    one = plays.where(_between(as_of, 60, 0)).agg(F.array(*[F.struct(F.lit(d).alias("days"), F.coalesce(count(d, 0), F.lit(0)).alias("plays"), F.coalesce(count(2 * d, d), F.lit(0)).alias("prior")) for d in (7, 30)]).alias("w"))
    change = F.when(F.col("prior") > 0, js_round((F.col("plays") - F.col("prior")) / F.col("prior") * 100)).when(F.col("plays") > 0, 100).otherwise(0)
    return one.select(F.explode("w").alias("w")).select("w.*").withColumn("change", change.cast("double"))


def top_artists_adjusted(plays: DataFrame, n: int = 12) -> DataFrame:
    """Artists by plays of which each year counts at most twice the artist's (upper) median year; ties of the best year to the earliest."""
    years = keyed(plays).groupBy("akey", "year").agg(F.count("*").alias("n"))
    a = years.groupBy("akey").agg(F.sort_array(F.collect_list("n")).alias("counts"), F.sum("n").alias("plays"), F.max(F.struct(F.col("n"), -F.col("year"))).alias("peak"))
    cap = F.element_at("counts", F.expr("int(size(counts) div 2 + 1)")) * 2
    capped = F.aggregate("counts", F.lit(0).cast("long"), lambda total, c: total + F.least(c, F.col("cap")))
    a = a.withColumn("cap", cap).select("akey", "plays", capped.alias("adjusted"), (-F.col("peak.col2")).alias("peak_year"))
    return a.orderBy(F.desc("adjusted"), "akey").limit(n)


def companions(plays: DataFrame, *, gap_minutes: int = 30, n: int = 12, k: int = 5) -> DataFrame:
    """For the n most played artists, the k others that stand in most of their sessions."""
    order = Window.partitionBy("user_id").orderBy("ts", "play_id")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order))
    p = plays.withColumn("new", F.coalesce(gap > gap_minutes * 60_000_000, F.lit(True)).cast("int"))
    p = p.withColumn("session", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    heard = p.select("user_id", "session", "artist_name").distinct()
    top = plays.groupBy("artist_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "artist_name").limit(n).select("artist_name")
    # n artists at most; the other side of a session holds each artist once
    pairs = heard.join(F.broadcast(top), "artist_name").join(heard.withColumnRenamed("artist_name", "companion"), ["user_id", "session"]).where("artist_name <> companion")
    counts = pairs.groupBy("artist_name", "companion").agg(F.count("*").alias("sessions"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("artist_name").orderBy(F.desc("sessions"), "companion"))).where(F.col("rank") <= k)


def obsessions(plays: DataFrame, share: float = 0.5) -> DataFrame:
    """Months of a listener in which one song takes more than such a share of the plays."""
    songs = keyed(plays).groupBy("user_id", "year", "month", *SONG).agg(F.count("*").alias("plays"))
    months = songs.groupBy("user_id", "year", "month").agg(F.sum("plays").alias("total"), F.max(F.struct("plays", *SONG)).alias("top"))
    return months.where((F.col("top.plays") > share * F.col("total")) & (F.col("total") > 1)).select("user_id", "year", "month", "top.*", "total")


def binges(plays: DataFrame, *, least: int = 30, days: int = 7, by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Recordings that a listener plays so often within some days: the most within any such stretch."""
    back = Window.partitionBy(*by, "uri").orderBy(F.unix_timestamp("ts")).rangeBetween(-days * 86400, 0)
    # stretches of too few plays go first: nearly all recordings have no others
    return plays.select(*by, "uri", F.count("*").over(back).alias("n")).where(F.col("n") >= least).groupBy(*by, "uri").agg(F.max("n").alias("most"))


def era_rollup(plays: DataFrame, eras: dict[str, list[int]]) -> DataFrame:
    """Plays, hours, artists, skip rate and top song of each era, a set of years."""
    names = F.create_map(*[x for e, ys in eras.items() for y in ys for x in (F.lit(y), F.lit(e))])
    k = keyed(plays).withColumn("era", names[F.col("year")]).where("era is not null")
    songs = k.groupBy("era", *SONG).agg(F.count("*").alias("n"))
    tops = songs.groupBy("era").agg(F.max_by("tkey", F.struct("n", *SONG)).alias("top_song"))
    return k.groupBy("era").agg(F.count("*").alias("plays"), js_round(F.sum("minutes") / 60, 1).alias("hours"), F.countDistinct("akey").alias("artists"), F.round(_skipped() / F.count("*"), 6).alias("skip_rate")).join(tops, "era")
