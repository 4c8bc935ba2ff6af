"""Queues for a mode, a seed and a wish for the known or the new, of one history or of each listener's."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapedeck.functions.columns import fold, js_round
from tapedeck.operators.history import SONG, _affinity, _cutoff, _weight, early_skip, keyed, lost_favorites, same

#: Length of a track where none is known, share of lost favourites, most tracks of an artist, boosts.
TRACK_MINUTES, LOST_SHARE, PER_ARTIST, CORE_BOOST, SEED_BOOST = 3.5, 0.3, 3, 1.15, 1.3
#: Tasks that keys are dealt over where a task holds all of a key's plays, so that each stays small.
PARTS = 600
MODES = ("default", "morning", "era", "rediscover")


def smart_queue(
    plays: DataFrame, *, as_of: str, minutes: float, mode: str = "default", familiarity: float = 0.5, seed: str | None = None, years: list[int] = (), core: list[str] = (),
    skips: int = 3, min_plays: int = 20, years_gone: float = 2, by: tuple[str, ...] = (),
) -> DataFrame:
    """position (from 0), uri, akey, kind, reason, score and minutes of a queue of about so many minutes; with `by` one for each key.

    Of the eight times as many recordings of most affinity those skipped early `skips` times in 30 days go, but for the seed; the rest are
    weighed by core artists (folded names), familiarity (0: new, 1: known), in mode `morning` by plays from 6 to 10 o'clock, in mode `era` only
    those played in `years` stay, and a seed (a uri, or an artist's name) lifts its artist. At most three of an artist are taken. In mode
    `rediscover`, or with familiarity below 0.3, 30 % are lost favourites, one at every third place. Ties by uri; no plays, no rows."""
    if mode not in MODES:
        raise ValueError(f"mode {mode} is none of {', '.join(MODES)}")
    target = math.ceil(minutes / TRACK_MINUTES)
    part = [*by] or [F.lit(1)]

    def first(df: DataFrame, n: int) -> DataFrame:
        order = (F.desc("score"), "uri")
        return df.orderBy(*order).limit(n) if not by else df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= n).drop("_k")

    n_lost = int(target * LOST_SHARE + 0.5) if mode == "rediscover" or familiarity < 0.3 else 0
    early, in_morning, in_era = F.coalesce(early_skip(as_of), F.lit(False)).cast("int"), F.col("local_hour").between(6, 10).cast("int"), F.col("year").isin(*years)
    kept = F.coalesce(F.col("early"), F.lit(0)) < skips
    stays = kept | (F.col("uri") == seed) if seed else kept
    stays = stays & F.col("in_era") if mode == "era" else stays
    of_uri = seed is not None and seed.startswith("spotify:track:")

    def weighed(pool: DataFrame) -> DataFrame:
        """score and reason of recordings with their affinity and, if a uri is the seed, `wanted`."""
        of_core = F.col("akey").isin(*core)
        known = F.log2(F.greatest("n", F.lit(1)))
        weight = 1 + (familiarity - 0.5) * 2 * known * 0.05 if familiarity > 0.5 else 1 + (0.5 - familiarity) * 2 * (1 / (1 + known * 0.3))
        pool = pool.withColumns({"score": js_round(F.col("affinity") * F.when(of_core, CORE_BOOST).otherwise(1.0) * weight, 2), "reason": F.when(of_core, "never-stale core").otherwise("high recent affinity")})
        plain = F.col("reason") == "high recent affinity"
        if mode == "era":
            pool = pool.withColumn("reason", F.when(plain, "era match").otherwise(F.col("reason")))
        if mode == "morning":
            pool = pool.withColumns({"score": F.col("score") * (1 + F.col("morning") * 0.1), "reason": F.when(F.col("morning") > 0, "morning pattern").otherwise(F.col("reason"))})
        if seed:
            hit = F.coalesce(F.col("akey") == (F.col("wanted") if of_uri else fold(F.lit(seed))), F.lit(False))
            pool = pool.withColumns({"score": F.col("score") * F.when(hit, SEED_BOOST).otherwise(1.0), "reason": F.when(hit & plain, "seed companion").otherwise(F.col("reason"))})
        return pool

    columns = [*by, "uri", "akey", "score", "reason", "minutes"]
    order = (F.desc("score"), "uri")
    of_artist = Window.partitionBy(*by, "akey").orderBy(*order)
    since = F.concat(F.lit("lost favorite, last heard "), F.date_format("last_played", "yyyy-MM"))
    if by and n_lost:
        # a key's plays meet in one task, and rows of songs and of recordings are told by windows there: nothing is shuffled again or joined
        cells = keyed(plays).repartition(PARTS, *by).groupBy(*by, *SONG, "uri").agg(
            F.count("*").alias("n"), F.max("ts").alias("last"), F.sum(_weight(as_of)).alias("affinity"), F.sum("minutes").alias("m"), F.count("minutes").alias("timed"),
            F.sum(early).alias("early"), F.sum(in_morning).alias("morning"), F.max(in_era).alias("in_era"),
        )
        song, recording = Window.partitionBy(*by, *SONG), Window.partitionBy(*by, "uri")
        cells = cells.withColumns({"plays": F.sum("n").over(song), "last_played": F.max("last").over(song), "of_song": F.row_number().over(song.orderBy(F.desc("n"), F.desc("uri")))})
        left = F.coalesce((F.col("of_song") == 1) & (F.col("plays") >= min_plays) & (F.col("last_played") < _cutoff(as_of, years_gone)), F.lit(False))
        cells = cells.withColumn("left", left).withColumn("gone", F.col("left") & (F.row_number().over(Window.partitionBy(*by, "left").orderBy(F.desc("plays"), *SONG)) <= target))
        sums = {c: F.sum(c).over(recording) for c in ("n", "early", "morning")} | {"affinity": F.round(F.sum("affinity").over(recording), 2), "minutes": F.try_divide(F.sum("m").over(recording), F.sum("timed").over(recording))}
        firsts = {"name": F.max("akey").over(recording), "in_era": F.max("in_era").over(recording), "any_gone": F.max("gone").over(recording), "one": F.row_number().over(recording.orderBy(*SONG)) == 1}
        if of_uri:
            firsts["wanted"] = F.max(F.when(F.col("uri") == seed, F.col("akey"))).over(Window.partitionBy(*by))
        cells = cells.withColumns(sums | firsts)
        cells = cells.withColumn("k", F.row_number().over(Window.partitionBy(*by, "one").orderBy(F.desc("affinity"), "uri")))
        liked = F.col("one") & (F.col("k") <= 8 * target) & stays & ~(F.col("any_gone") & kept)
        cells = cells.withColumn("kind", F.when(F.col("gone") & kept, "lost").when(liked, "liked")).where("kind is not null")
        is_lost = F.col("kind") == "lost"
        cells = weighed(cells.withColumn("akey", F.when(is_lost, F.col("akey")).otherwise(F.col("name"))))
        both = cells.select(*by, "uri", "akey", "kind", F.when(is_lost, F.col("plays").cast("double")).otherwise(F.col("score")).alias("score"), F.when(is_lost, since).otherwise(F.col("reason")).alias("reason"), F.when(is_lost, TRACK_MINUTES).otherwise(F.col("minutes")).alias("minutes"))
        place = F.row_number().over(Window.partitionBy(*by, "kind").orderBy(*order))
        both = both.withColumn("k", F.row_number().over(Window.partitionBy(*by, "akey", "kind").orderBy(*order))).where(is_lost | (F.col("k") <= PER_ARTIST))
        both = both.withColumn("place", place).where(is_lost | (F.col("place") <= target - n_lost))
        both = both.withColumn("taken", F.sum((~is_lost).cast("int")).over(Window.partitionBy(*by, "akey"))).where(~is_lost | (F.col("k") + F.col("taken") <= PER_ARTIST))
        both = both.withColumn("place", place).where(~is_lost | (F.col("place") <= n_lost)).select(*columns, "kind")
    else:
        # one scan tells all that a recording is weighed by
        tracks = plays.groupBy(*by, "uri").agg(
            F.count("*").alias("n"), _affinity(as_of), F.max(fold(F.col("artist_name"))).alias("akey"), F.avg("minutes").alias("minutes"), F.sum(early).alias("early"), F.sum(in_morning).alias("morning"), F.max(in_era).alias("in_era"),
        )
        pool = first(tracks.withColumn("score", F.col("affinity")), 8 * target).where(stays)
        if of_uri:
            of = plays.where(F.col("uri") == seed).groupBy(*by).agg(F.max(fold(F.col("artist_name"))).alias("wanted"))
            # one row, or one a key that has played the seed
            pool = same(pool, of, [*by], "left") if by else pool.join(F.broadcast(of), how="cross")
        pool = weighed(pool)
        if n_lost:
            gone = lost_favorites(plays, as_of=as_of, min_plays=min_plays, years_gone=years_gone, limit=target)
            gone = gone.select("uri", "akey", F.col("plays").cast("double").alias("score"), since.alias("reason"), F.lit(TRACK_MINUTES).alias("minutes"))
            gone = same(gone, tracks.where(~kept).select("uri"), ["uri"], "left_anti")
            pool = same(pool, gone.select("uri"), ["uri"], "left_anti")
        regular = first(pool.select(*columns).withColumn("k", F.row_number().over(of_artist)).where(F.col("k") <= PER_ARTIST).drop("k"), target - n_lost)
        both = regular.withColumn("kind", F.lit("liked"))
        if n_lost:
            taken = regular.groupBy("akey").agg(F.count("*").alias("taken"))
            gone = same(gone, taken, ["akey"], "left").withColumn("k", F.row_number().over(of_artist) + F.coalesce("taken", F.lit(0))).where(F.col("k") <= PER_ARTIST)
            both = both.unionByName(first(gone.select(*columns), n_lost).withColumn("kind", F.lit("lost")))
    whole = Window.partitionBy(*part)
    i, n = F.row_number().over(Window.partitionBy(*part, "kind").orderBy(F.desc("score"), "uri")) - 1, F.sum((F.col("kind") == "liked").cast("int")).over(whole)
    ranked = both.withColumns({"i": i, "n": n, "m": F.count("*").over(whole) - n})
    place = F.when(F.col("kind") == "lost", F.least((F.col("i") + 1) * 3, F.col("n") + F.col("i"))).when(F.col("i") < 3, F.col("i")).otherwise(F.col("i") + F.least(F.col("m"), F.floor((F.col("i") - 3) / 2) + 1))
    return ranked.select(*by, place.cast("int").alias("position"), "uri", "akey", "kind", "reason", "score", "minutes")
