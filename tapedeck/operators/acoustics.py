"""Which centroid each mode's tracks are measured against, and how far the profiles have come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapedeck.operators.recommend import LEAST_SAMPLES, acoustic_fit

#: Features and, for modes whose hours tell little, the wanted (mean, spread) of each.
FEATURES = ("energy", "acousticness", "danceability", "valence", "tempo", "loudness", "instrumentalness", "speechiness", "liveness")
CURATED = {
    "sleeping": ((0.25, 0.12), (0.60, 0.20), (0.40, 0.12), (0.30, 0.15), (90, 15), (-12, 3), (0.15, 0.20), (0.04, 0.03), (0.12, 0.10)),
    "waking_up": ((0.78, 0.10), (0.10, 0.10), (0.72, 0.10), (0.65, 0.15), (120, 15), (-5.5, 2), (0.02, 0.05), (0.06, 0.05), (0.18, 0.12)),
    "unwinding": ((0.40, 0.12), (0.45, 0.18), (0.50, 0.12), (0.42, 0.15), (105, 15), (-9, 2.5), (0.08, 0.12), (0.05, 0.04), (0.14, 0.10)),
    "driving": ((0.75, 0.12), (0.12, 0.10), (0.68, 0.12), (0.55, 0.18), (118, 18), (-6, 2.5), (0.02, 0.05), (0.06, 0.05), (0.18, 0.12)),
    "brainstorming": ((0.45, 0.12), (0.38, 0.18), (0.45, 0.12), (0.35, 0.15), (105, 18), (-9, 2.5), (0.20, 0.20), (0.04, 0.03), (0.12, 0.10)),
}


def curated(spark: SparkSession) -> DataFrame:
    rows = [(mode, f, float(m), float(s)) for mode, of in CURATED.items() for f, (m, s) in zip(FEATURES, of, strict=True)]
    return spark.createDataFrame(rows, "mode string, dimension string, mean double, stddev double")


def centroids(profile: DataFrame, modes: DataFrame, overrides: DataFrame | None = None, *, least: int = LEAST_SAMPLES) -> DataFrame:
    """Each mode's centroid: the curated one; else its own, if learned from enough samples; else the overall one, if that is.

    modes: a column mode, of which null and repeated rows count once or not at all. Modes without any usable centroid have no rows."""
    c = ["dimension", "mean", "stddev"]
    trained = profile.groupBy("mode").agg(F.min("sample_size").alias("n")).where(F.col("n") >= least).select("mode")
    learned = profile.join(trained, "mode", "left_semi").select(F.struct(F.lit(False).alias("fixed"), "mode").alias("of"), *c)
    of, known = modes.select("mode").where("mode is not null").distinct(), trained.withColumn("own", F.lit(True))
    if overrides is None:
        of = of.withColumn("fixed", F.lit(False))
    else:
        learned = learned.unionByName(overrides.select(F.struct(F.lit(True).alias("fixed"), "mode").alias("of"), *c))
        of = of.join(overrides.select("mode", F.lit(True).alias("fixed")).distinct(), "mode", "left").withColumn("fixed", F.coalesce("fixed", F.lit(False)))
    source = F.when(F.col("fixed") | F.col("own"), F.col("mode")).otherwise("overall")
    return of.join(known, "mode", "left").select("mode", F.struct("fixed", source.alias("mode")).alias("of")).join(learned, "of").select("mode", *c)


def mode_fits(tracks: DataFrame, features: DataFrame, centroid: DataFrame, names: list[str]) -> DataFrame:
    """One row for each of `tracks` (track_id) with all features: `fits`, a map from mode to fit, dominant feature and whether it lies above."""
    known = features.dropDuplicates(["track_id"]).join(tracks.select("track_id").distinct(), "track_id", "left_semi").dropna(subset=names)
    fit = acoustic_fit(known, centroid, names)
    # a handful of modes
    return fit.groupBy("track_id").agg(F.map_from_entries(F.collect_list(F.struct("mode", F.struct("fit", "dominant", "above")))).alias("fits"))


def acoustic_maturity(profile: DataFrame) -> DataFrame:
    """For each mode its features and the least, mean (halves up) and most samples of one."""
    return profile.groupBy("mode").agg(F.count("*").alias("dimensions"), F.min("sample_size").alias("min_samples"), F.floor(F.avg("sample_size") + 0.5).alias("avg_samples"), F.max("sample_size").alias("max_samples"))
