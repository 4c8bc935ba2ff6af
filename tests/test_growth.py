"""How much jobs shuffle: rows that grow with pairs, or that are shuffled again and again, make them fail on larger tables."""

from pyspark.sql import functions as F

from tapedeck.operators import details as d
from tapedeck.operators import history as h
from tapedeck.operators import loved as lo
from tapedeck.operators import lyrics as ly
from tapedeck.operators import periods as pe
from tapedeck.operators import planning as pl
from tapedeck.operators import queues as q
from tapedeck.operators import recommend as rec
from tapedeck.operators import ripples as r
from tapedeck.sources.bridge import plays

SF = "/root/testdata/sf0.001"


def shuffled(spark, df):
    """Rows that stages write to shuffles until df is made."""

    def stages():
        store, gateway = spark._jsc.sc().statusStore(), spark.sparkContext._gateway
        found = store.stageList(None, False, False, gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    df.write.format("noop").mode("overwrite").save()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for k, n in stages().items() if k not in before)


def test_pairs_of_covers_are_not_shuffled(spark):
    catalog = spark.range(2000).selectExpr("id AS uri", "concat('Song ', id % 4) AS track", "concat('Artist ', id % 50) AS artist")
    twice = catalog.unionByName(spark.createDataFrame([(0, "Song 1", "Artist 9"), (7, "Song 0 (live)", "Artist 0"), (4, "Song 0 - demo", "Artist 0")], "uri long, track string, artist string"))
    got = ly.cover_candidates(catalog.where("uri < 200"), catalog)
    assert got.count() == 200 * 480 and shuffled(spark, got) < 10_000
    many = {(r.seed, r.candidate): (r.by_title, r.by_version) for r in ly.cover_candidates(twice.where("uri < 20"), twice).collect()}
    assert len(many) == ly.cover_candidates(twice.where("uri < 20"), twice).count()
    assert many[0, 7] == (False, True) and many[0, 4] == (True, True) and many[1, 0] == (True, False) and (0, 100) not in many and many[8, 4] == (True, False)


def test_names_of_parts_are_joined_last(spark):
    """What is joined first is shuffled with every line item."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plays(spark, SF)._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join" in line]
        assert len(joins) == 2 and "p_partkey" in joins[0] and "o_orderkey" in joins[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def some_plays(spark):
    return spark.range(3000).repartition(3).selectExpr("id % 40 AS user_id", "cast(2000 + id % 3 as int) AS year", "cast(1 + id % 12 as int) AS month", "CASE WHEN id % 11 > 0 THEN concat('Song ', id) END AS track_name", "CASE WHEN id % 13 > 0 THEN concat('Artist ', id % 900) END AS artist_name", "concat('u', id) AS uri", "0.5 AS minutes", "CASE WHEN id % 4 = 0 THEN 'fwdbtn' ELSE 'endplay' END AS reason_end").withColumn("minutes", F.col("minutes").cast("double"))


def test_plays_are_not_shuffled_for_each_distinct_count(spark):
    p, by = some_plays(spark), ("user_id", "year", "month")
    got = h.period_stats(p, by)
    want = h.keyed(p).groupBy(*by).agg(F.count("*").alias("plays"), F.floor(F.sum("minutes") / 60 * 10 + 0.5).alias("tenths"), F.countDistinct("tkey", "akey").alias("songs"), F.countDistinct("akey").alias("artists"))
    columns = (*by, "plays", "songs", "artists")
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    # the range's own 3000, then songs, artists and keys
    assert shuffled(spark, got) <= 4 * 3000


def test_eras_read_plays_once(spark):
    got = d.era_details(some_plays(spark), {"a": [2000, 2001], "b": [2001, 2002]})
    assert {r.era: (r.plays, r.tracks, r.skip_rate) for r in got.collect()} == {"a": (2000, 2000, 25.0), "b": (2000, 2000, 25.0)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan


def test_familiarity_reads_plays_once(spark):
    p = some_plays(spark).withColumn("ts", F.lit("2001-01-01").cast("timestamp"))
    got = r.familiarity(p, spark.createDataFrame([("u1", "Artist 1"), ("new", "Nobody")], "uri string, artist_name string"), as_of="2001-11-05")
    assert {x.uri: (x.track_before, x.artist_before) for x in got.collect()} == {"u1": (1, 4), "new": (0, 0)}
    assert "Range" not in got._jdf.queryExecution().executedPlan().toString()


def more_plays(spark):
    """some_plays, of which a sixth of the songs is heard twice, with what queues and details look at."""
    p = some_plays(spark).withColumns({"ts": F.timestamp_seconds(F.col("month") * 2_600_000 + F.regexp_extract("uri", "[0-9]+", 0).cast("long")), "reason_end": F.lit("trackdone"), "album_name": F.lit("L"), "ms_played": F.lit(200_000).cast("long"), "local_hour": F.lit(7)})
    return p.unionByName(p.where("minute(ts) % 6 = 0"))


def test_lost_favorites_shuffle_plays_once(spark):
    p = more_plays(spark)
    got = h.lost_favorites(p, as_of="2001-11-05", min_plays=2, years_gone=0.25, by=("user_id",))
    assert got.count() and {r.plays for r in got.collect()} == {2} and {r.peak_plays for r in got.collect()} == {2}
    # twice the range's own, the plays, and songs that are left
    assert shuffled(spark, got) <= 2 * 3000 + 2 * p.count()


def test_queues_of_listeners_shuffle_plays_once(spark):
    p = more_plays(spark)
    got = q.smart_queue(p, as_of="2001-11-05", minutes=42, mode="rediscover", min_plays=2, years_gone=0.25, by=("user_id",))
    assert {r.kind for r in got.collect()} == {"liked", "lost"}
    assert shuffled(spark, got) <= 2 * 3000 + p.count()


def test_details_of_artists_shuffle_plays_once(spark):
    p = more_plays(spark)
    got = pe.artist_details(p, by=("user_id",))
    assert sum(r.plays for r in got.collect()) == p.count()
    assert shuffled(spark, got) <= 2 * 3000 + p.count()


def test_details_and_queues_read_plays_once(spark):
    p = more_plays(spark)
    for got in (pe.track_details(p), rec.generate_queue(p, as_of="2001-11-05", min_plays=2, years_gone=0.25)):
        assert got.count() and "Range" not in got._jdf.queryExecution().executedPlan().toString()


def test_names_of_recordings_wait_for_the_list(spark):
    p = more_plays(spark)
    passages = p.select("uri").distinct().selectExpr("uri", "0 AS passage_index", "uri AS passage_text")
    got = lo.loved_passages(p, passages)
    assert got.count() == 35 and "album" not in "".join(got.columns) and all(r.track_name is None or r.track_name.startswith("Song") for r in got.collect())
    assert "track_name" not in lo._heard(p)._jdf.queryExecution().optimizedPlan().toString()


def test_stretches_are_sifted_before_they_are_counted(spark):
    got = pe.binges(more_plays(spark), least=2, days=7)
    assert got.count() and {r.most for r in got.collect()} == {2}
    assert got._jdf.queryExecution().optimizedPlan().nodeName() == "Aggregate"


def test_fits_are_not_shuffled_for_each_mode(spark):
    features = spark.range(0, 500, 1, 1).selectExpr("cast(id AS string) AS track_id", "id / 500 AS energy", "IF(id % 3 = 0, NULL, 0.5D) AS valence")
    profile = spark.createDataFrame([(f"m{i}", d, 0.5, 0.01) for i in range(9) for d in ("energy", "valence")], "mode string, dimension string, mean double, stddev double")
    got = rec.acoustic_fit(features.unionByName(features.limit(1)), profile, ["energy", "valence"])
    assert got.count() == 9 * 500 and {r.dominant for r in got.where("track_id = '499'").collect()} == {"energy"}
    assert shuffled(spark, got) <= 600


def test_what_speaks_for_tracks_is_not_shuffled(spark):
    """Tracks and snapshots of a listener are shuffled, and not what comes of each two of them; the rows are those of a join."""
    k = "cast(id % 4 AS long) AS user_id"
    snapshots = spark.range(240).selectExpr(k, "id AS snapshot_id", "'driving' AS mode", "IF(id % 3 = 0, NULL, 'night') AS daylight_phase", "'rain' AS weather_condition", "20D AS weather_temp_f", "'home' AS location_label", "'Smartphone' AS device_type", "id % 2 = 0 AS is_in_motion", "'car' AS bluetooth_context", "'focus' AS calendar_category", "3 AS day_of_week")
    tracks = spark.range(320).selectExpr("IF(id % 40 = 39, NULL, cast(id % 4 AS long)) AS user_id", "concat('t', id div 4) AS track_id", "id % 9 AS play_count", "id % 2 AS skip_count", "id % 5 AS complete_count", "cast(id % 24 AS int) AS last_played_hour", "cast(id % 3 AS int) AS seasonal_playlist_count", "id % 2 = 0 AS current_season_present")
    known = [("t1", "weather_condition", "rain", 1.02, 9), ("t2", "weather_condition", "rain", 1.5, 9), ("t2", "weather_condition", "rain", 1.02, 11), ("t3", "location_label", "home", 0.7, 5), ("t3", "location_label", "home", 1.01, 50), ("t5", "day_of_week", "3", 1.3, 4), ("t4", "calendar_category", "focus", None, 9), ("t6", "location_label", None, 2.0, 9)]
    affinities = spark.createDataFrame(known, "track_id string, dimension string, bucket string, affinity double, sample_size int")
    twice = tracks.unionByName(tracks.where("track_id = 't2'").withColumn("complete_count", F.lit(7).cast("long"))), snapshots.unionByName(snapshots.where("snapshot_id = 0").withColumn("mode", F.lit("sleeping")))
    got = pl.context_biases(*twice, affinities)
    want = None
    for u in range(4):
        one = pl.context_biases(*[df.where(F.col("user_id") == u).drop("user_id") for df in twice], affinities, by=()).withColumn("user_id", F.lit(u).cast("long"))
        want = one if want is None else want.unionByName(one)
    rows = sorted(map(repr, got.collect()))
    assert len(rows) > 60 * 320 and len(set(rows)) == len(rows) and rows == sorted(map(repr, want.select(*got.columns).collect()))
    at = {(r.track_id, r.bucket): (r.multiplier, r.reason) for r in got.where("snapshot_id = 2").collect()}
    assert at["t2", "rain"] == (1.5, "learned from 11 plays") and at["t3", "home"] == (0.7, "learned from 5 plays") and at["t4", "focus"][0] == 1.15 and ("t5", "3") not in at
    # each snapshot, each track twice, affinities, and buckets of snapshots in what is summed up
    assert shuffled(spark, pl.context_multiplier(got)) < 240 + 2 * 330 + 50
    assert shuffled(spark, pl.bias_summary(got)) < 240 + 2 * 330 + 50 + 4 * 240 * 8
