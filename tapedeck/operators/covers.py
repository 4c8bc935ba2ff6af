"""Cover versions from first candidates to a table of versions with all that is known of them, and a summary of each seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapedeck.functions.columns import fold
from tapedeck.operators.lyrics import title_key

# Features in the order of a recording's vector, those whose range isn't 0 to 1 (offset, width), the words
# that mark a version, the roles that count as writing, and names of the ways in which candidates are found.
FEATURES = ("acousticness", "danceability", "energy", "instrumentalness", "liveness", "loudness", "speechiness", "tempo", "valence")
RANGES = {"tempo": (0, 250), "loudness": (60, 60)}
VERSION = r"\b(remix|live|acoustic|demo|version|edit|mix|session|remaster|radio|medley)\b"
WRITING = ("composer", "lyricist", "writer")
WAYS = ("mb_work", "spotify_search", "spotify_artist_search")


def find_versions(seeds: DataFrame, catalog: DataFrame) -> DataFrame:
    """Recordings of the catalog that may be versions of a seed: seed, candidate, match_method, found_via_mb_work,
    found_via_spotify_search, found_via_spotify_artist_search (booleans); both tables have uri, track, artist, work_id.

    By work: the same work_id. By title: the same base title by another artist. By artist: the same artist and base
    title with a word that marks a version. match_method is the first of these that holds. The three ways are one join
    each on keys that both sides have, so no recordings meet that share nothing; a null or empty key meets nothing, and
    a recording isn't its own version.
    """
    def side(df: DataFrame, uri: str) -> DataFrame:
        title, artist = F.nullif(title_key(F.col("track")), F.lit("")), fold(F.col("artist"))
        return df.select(F.col("uri").alias(uri), F.col("work_id"), title.alias("title"), artist.alias("by"), fold(F.col("track")).rlike(VERSION).alias("marked"))

    s, c = side(seeds, "seed").drop("marked"), side(catalog, "candidate")
    by_work = s.select("seed", "work_id").join(c.select("candidate", "work_id"), "work_id").select("seed", "candidate", F.lit(0).alias("way"))
    by_title = s.select("seed", "title", F.col("by").alias("of")).join(c, "title").where("by <> of").select("seed", "candidate", F.lit(1).alias("way"))
    by_artist = s.select("seed", "title", "by").join(c.where("marked"), ["title", "by"]).select("seed", "candidate", F.lit(2).alias("way"))
    found = by_work.unionByName(by_title).unionByName(by_artist).where("seed <> candidate")
    method = F.element_at(F.array(*map(F.lit, WAYS)), F.min("way") + 1)
    return found.groupBy("seed", "candidate").agg(method.alias("match_method"), *[F.max(F.col("way") == i).alias(f"found_via_{w}") for i, w in enumerate(WAYS)])


def scaled(name: str, c: Column) -> Column:
    """A feature brought to 0 to 1."""
    low, width = RANGES.get(name, (0, 1))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (c.cast("double") + low) / width))


def version_audio(pairs: DataFrame, features: DataFrame, *, far: float = 0.7, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """pairs (seed, candidate, ...) with audio_distance (of the scaled features), audio_bucket, no_audio_data and
    audio_feature_deltas, a map of what the candidate has more of each feature.

    A side without features, or with a null among them, has no distance: null, alternate_version, true and a null map.
    """
    whole = features.dropna(subset=list(names)).select("uri", F.array(*[scaled(n, F.col(n)) for n in names]).alias("f"))
    out = pairs.join(whole.select(F.col("uri").alias("seed"), F.col("f").alias("x")), "seed", "left").join(whole.select(F.col("uri").alias("candidate"), F.col("f").alias("y")), "candidate", "left")
    off = F.zip_with("x", "y", lambda p, q: q - p)
    distance = F.round(F.sqrt(F.aggregate(off, F.lit(0.0), lambda t, d: t + d * d)), 4)
    known = F.col("x").isNotNull() & F.col("y").isNotNull()
    out = out.withColumn("audio_distance", F.when(known, distance)).withColumn("audio_bucket", F.when(F.col("audio_distance") >= far, "different_sonic_world").otherwise("alternate_version"))
    deltas = F.map_from_arrays(F.array(*map(F.lit, names)), F.transform(off, lambda d: F.round(d, 4)))
    return out.withColumn("no_audio_data", ~known).withColumn("audio_feature_deltas", F.when(known, deltas)).select(*pairs.columns, "audio_distance", "audio_bucket", "no_audio_data", "audio_feature_deltas")


def writers_in_common(pairs: DataFrame, credits: DataFrame, *, roles: tuple[str, ...] = WRITING) -> DataFrame:
    """pairs (seed, candidate, ...) with shared_writers: the sorted names (uri, person, role) credited on both for writing,
    in whatever of the roles; null where there are none."""
    c = credits.where(F.col("role").isin(*roles) & F.col("person").isNotNull()).select("uri", "person").distinct()
    both = pairs.select("seed", "candidate").distinct().join(c.withColumnRenamed("uri", "seed"), "seed").join(c.withColumnRenamed("uri", "candidate"), ["candidate", "person"])
    names = both.groupBy("seed", "candidate").agg(F.array_sort(F.collect_set("person")).alias("shared_writers"))
    return pairs.join(names, ["seed", "candidate"], "left")


def covers_enriched(versions: DataFrame, plays: DataFrame, lyrics: DataFrame, credit_status: DataFrame) -> DataFrame:
    """versions (seed, candidate, ...) with candidate_play_count, in_library, candidate_lyrics_status and
    candidate_credits_status. Plays are counted once for each candidate, before they meet its seeds; of several statuses
    (uri, status) of a recording the greatest stands."""
    counts = plays.join(versions.select(F.col("candidate").alias("uri")).distinct(), "uri", "left_semi").groupBy(F.col("uri").alias("candidate")).agg(F.count("*").alias("n"))

    def status(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.col("uri").alias("candidate")).agg(F.max("status").alias(name))

    out = versions.join(counts, "candidate", "left").join(status(lyrics, "candidate_lyrics_status"), "candidate", "left").join(status(credit_status, "candidate_credits_status"), "candidate", "left")
    return out.select(*versions.columns, F.coalesce("n", F.lit(0)).alias("candidate_play_count"), F.col("n").isNotNull().alias("in_library"), "candidate_lyrics_status", "candidate_credits_status")


def cover_seed_summary(seeds: DataFrame, candidates: DataFrame, kept: DataFrame) -> DataFrame:
    """A row for each seed (uri, work_id): search_method (both if it has a work, else spotify_only), candidates_found (pairs
    in `candidates`), candidates_kept and candidates_no_audio_data (in `kept`, which has no_audio_data)."""
    found = candidates.groupBy("seed").agg(F.count("*").alias("found"))
    good = kept.groupBy("seed").agg(F.count("*").alias("kept"), F.sum(F.col("no_audio_data").cast("int")).alias("silent"))
    out = seeds.select(F.col("uri").alias("seed"), F.when(F.col("work_id").isNull(), "spotify_only").otherwise("both").alias("search_method"))
    return out.join(found, "seed", "left").join(good, "seed", "left").select("seed", "search_method", *[F.coalesce(c, F.lit(0)).alias(n) for c, n in (("found", "candidates_found"), ("kept", "candidates_kept"), ("silent", "candidates_no_audio_data"))])


def twin_concordance(neighbours: DataFrame, ratings: DataFrame, *, seed: int = 0, digits: int = 1) -> DataFrame:
    """Whether near vectors have like ratings: pairs, mean_difference of the ratings (id, rating) of neighbours (query, match)
    that are both rated; random_pairs and random_difference over chance pairs of rated ids: each id and the one of the next
    higher hash of id and seed, within those that have the same first `digits` hexadecimal digits. One row; the means are null without pairs."""
    r = ratings.where("rating is not null").groupBy("id").agg(F.max("rating").alias("rating"))
    twins = neighbours.join(r.select(F.col("id").alias("query"), F.col("rating").alias("a")), "query").join(r.select(F.col("id").alias("match"), F.col("rating").alias("b")), "match")
    hashed = r.withColumn("h", F.md5(F.concat_ws("/", F.col("id").cast("string"), F.lit(str(seed))))).withColumn("part", F.substring("h", 1, digits))
    nxt = hashed.select("rating", F.lead("rating").over(Window.partitionBy("part").orderBy("h")).alias("b"))
    a = twins.agg(F.count("*").alias("pairs"), F.round(F.avg(F.abs(F.col("a") - F.col("b"))), 6).alias("mean_difference"))
    b = nxt.where("b is not null").agg(F.count("*").alias("random_pairs"), F.round(F.avg(F.abs(F.col("rating") - F.col("b"))), 6).alias("random_difference"))
    return a.join(F.broadcast(b), how="cross")
