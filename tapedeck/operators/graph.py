"""The co-listening graph of artists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_track_per_artist(plays: DataFrame) -> DataFrame:
    """Each artist's most played recording; ties to the latest play, then the smallest uri."""
    tracks = plays.groupBy("artist_name", "uri").agg(F.count("*").alias("plays"), F.max("ts").alias("last_play"))
    rank = F.row_number().over(Window.partitionBy("artist_name").orderBy(F.desc("plays"), F.desc("last_play"), "uri"))
    return tracks.withColumn("k", rank).where("k = 1").select("artist_name", F.regexp_replace("uri", "^spotify:track:", "").alias("track_id"), "plays")


def session_cooccurrence(plays: DataFrame, nodes: DataFrame | None = None, *, window_seconds: int = 1800, by: tuple[str, ...] = ("user_id",), split_years: bool = True) -> DataFrame:
    """How often plays of two artists lie at most window_seconds apart; each pair of plays counts once, and only within a year.

    Time is cut into slots as long as the window: a play meets those of its own slot and of the one before.
    """
    if nodes is not None:
        plays = plays.join(nodes.select("artist_name").distinct(), "artist_name", "left_semi")
    micros = window_seconds * 1_000_000
    p = plays.select(*by, "artist_name", "play_id", F.unix_micros("ts").alias("t"), (F.year("ts") if split_years else F.lit(0)).alias("y")).withColumn("slot", F.expr(f"t div {micros}"))
    later = p.select(*by, F.col("artist_name").alias("other"), F.col("play_id").alias("later_id"), F.col("t").alias("later_t"), "y", F.explode(F.array("slot", F.col("slot") - 1)).alias("slot"))
    after = (F.struct("t", "play_id") < F.struct(F.col("later_t"), F.col("later_id"))) & (F.col("later_t") - F.col("t") <= micros) & (F.col("artist_name") != F.col("other"))
    pairs = p.join(later, [*by, "y", "slot"]).where(after)
    return pairs.groupBy(F.least("artist_name", "other").alias("artist_a"), F.greatest("artist_name", "other").alias("artist_b")).agg(F.count("*").alias("session_co"))


def playlist_cooccurrence(tracks: DataFrame) -> DataFrame:
    """Pairs of tracks of two artists in one playlist (playlist_id, track_id, artist_name, seasonal), in all and in seasonal ones.

    Counted from each playlist's tracks by artist, so that a long playlist meets as rows of artists, not of tracks.
    """
    a = tracks.select("playlist_id", "seasonal", F.col("artist_name").alias("artist_a"), F.col("track_id").alias("track_a"))
    b = tracks.select("playlist_id", F.col("artist_name").alias("artist_b"), F.col("track_id").alias("track_b"))
    pairs = a.join(b, "playlist_id").where("artist_a <> artist_b and track_a < track_b")
    return pairs.groupBy(F.least("artist_a", "artist_b").alias("artist_a"), F.greatest("artist_a", "artist_b").alias("artist_b")).agg(F.count("*").alias("playlist_co"), F.sum(F.col("seasonal").cast("int")).alias("seasonal_co"))


def edge_weights(sessions: DataFrame, playlists: DataFrame, least: int = 3) -> DataFrame:
    """ln(sessions) + 2 ln(playlists + 1) of pairs with enough sessions; a seasonal playlist counts as 1.5."""
    lists = F.coalesce(F.col("playlist_co") + 0.5 * F.col("seasonal_co"), F.lit(0.0))
    e = sessions.where(F.col("session_co") >= least).join(playlists, ["artist_a", "artist_b"], "left")
    return e.select("artist_a", "artist_b", "session_co", F.round(F.log(F.col("session_co")) + 2 * F.log(lists + 1), 6).alias("weight"))


def top_neighbors(edges: DataFrame, k: int = 3) -> DataFrame:
    """The edges among the k heaviest of either end, with weights as shares of the heaviest of all."""
    ends = edges.select(F.explode(F.array("artist_a", "artist_b")).alias("node"), "artist_a", "artist_b", "weight")
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("weight"), "artist_a", "artist_b"))
    heaviest = edges.agg(F.max("weight").alias("heaviest"))
    return ends.withColumn("k", rank).where(F.col("k") <= k).select("artist_a", "artist_b", "weight").distinct().join(F.broadcast(heaviest), how="cross").select("artist_a", "artist_b", (F.floor(F.col("weight") / F.col("heaviest") * 100 + 0.5) / 100).alias("weight"))


def era_buckets(nodes: DataFrame, n: int = 5) -> DataFrame:
    """bucket, start_year, end_year: n runs of years that hold about as many peak years each; none overlap."""
    years = nodes.groupBy("peak_year").count()
    upto = Window.orderBy("peak_year").rowsBetween(Window.unboundedPreceding, 0)
    # one row a year
    ranked = years.withColumn("upto", F.sum("count").over(upto))
    total = ranked.agg(F.max("upto").alias("total"), F.min("peak_year").alias("low"), F.max("peak_year").alias("high"))
    cuts = [F.min(F.when(F.col("upto") > F.expr(f"total * {i} div {n}"), F.col("peak_year"))).alias(f"c{i}") for i in range(1, n)]
    one = ranked.join(F.broadcast(total), how="cross").groupBy("low", "high").agg(*cuts)
    start, rows = F.col("low"), []
    for i in range(1, n):
        end = F.greatest(F.col(f"c{i}"), start)
        rows.append(F.struct(F.lit(i - 1).alias("bucket"), start.alias("start_year"), end.alias("end_year")))
        start = end + 1
    rows.append(F.struct(F.lit(n - 1).alias("bucket"), start.alias("start_year"), F.greatest(start, F.col("high")).alias("end_year")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def node_encodings(nodes: DataFrame, labelled: int = 8, picks: tuple[str, ...] = (), most_picks: int = 2) -> DataFrame:
    """Radius (3 to 24, by the root of plays), opacity (0.4 to 1, by active years) and whether a node has a label: the first
    `most_picks` of the artists in `picks` (akey) that are nodes, and of the others those with most plays x active years."""
    span = nodes.agg(F.min(F.sqrt("plays")).alias("p0"), F.max(F.sqrt("plays")).alias("p1"), F.min("active_years").alias("y0"), F.max("active_years").alias("y1"))
    n = nodes.join(F.broadcast(span), how="cross")

    def share(x, low: str, high: str):
        return F.when(F.col(high) > F.col(low), (x - F.col(low)) / (F.col(high) - F.col(low))).otherwise(1.0)

    order = [F.desc(F.col("plays") * F.col("active_years")), F.col("akey")]
    if picks:
        place = F.array_position(F.array(*map(F.lit, picks)), F.col("akey"))
        picked = nodes.where(F.col("akey").isin(*picks)).orderBy(place).limit(most_picks).select("akey", F.lit(True).alias("picked"))
        nodes = nodes.join(F.broadcast(picked), "akey", "left")
        order = [F.asc_nulls_last("picked"), *order]
    best = nodes.orderBy(*order).limit(labelled).select("akey", F.lit(True).alias("label"))
    out = n.select("akey", F.round(3 + 21 * share(F.sqrt("plays"), "p0", "p1"), 4).alias("radius"), F.round(0.4 + 0.6 * share(F.col("active_years"), "y0", "y1"), 4).alias("opacity"))
    return out.join(F.broadcast(best), "akey", "left").withColumn("label", F.coalesce("label", F.lit(False)))


def graph_stats(plays: DataFrame, seasonal: DataFrame | None = None) -> DataFrame:
    """What the graph stands on: plays, artists, recordings and the first day; with seasonal playlists (playlist_id), how many."""
    out = plays.agg(F.count("*").alias("plays"), F.countDistinct("artist_name").alias("artists"), F.countDistinct("uri").alias("tracks"), F.min("ts").cast("date").alias("first_day"))
    if seasonal is not None:
        out = out.join(F.broadcast(seasonal.agg(F.countDistinct("playlist_id").alias("seasons"))), how="cross")
    return out
