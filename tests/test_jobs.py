import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tapedeck.operators import graph, matching, ripples
from tapedeck.sources import tables
from tapedeck.streaming import plays as streams


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_exports_are_read(spark, tmp_path):
    plays = [{"ts": "2024-03-01T10:00:00Z", "platform": "iPhone OS 17", "ms_played": 60000, "master_metadata_track_name": "A", "spotify_track_uri": "spotify:track:a"}, {"ts": "2024-03-01T11:00:00Z", "episode_name": "talk", "spotify_track_uri": "spotify:track:b"}, {"ts": "2024-03-01T12:00:00Z"}]
    (tmp_path / "h.json").write_text(json.dumps(plays))
    got = tables.read_streaming_history(spark, str(tmp_path / "h.json"))
    assert rows(got, "track_name", "platform", "minutes", "hour", "local_hour", "shuffle") == [("A", "iOS", 1.0, 10, 5, False)]
    tables.write_plays(got, str(tmp_path / "plays"))
    assert spark.read.parquet(str(tmp_path / "plays")).where("year = 2024 and month = 3").count() == 1
    head = "Event Type,Container Artist Name,End Reason Type,Event End Timestamp,Media Type,Play Duration Milliseconds,Song Name,Album Name\n"
    (tmp_path / "a.csv").write_text(head + 'PLAY_END,X,SKIP,2024-01-01T00:00:00Z,AUDIO,31000,"One, ""two""",L\nPLAY_END,X,SKIP,2024-01-01T00:00:00Z,AUDIO,10,S,L\nPLAY_END,X,NATURAL_END_OF_TRACK,2024-01-01T00:00:00Z,AUDIO,10,T,L\nPLAY_START,X,SKIP,2024-01-01T00:00:00Z,AUDIO,90000,U,L\n')
    assert rows(tables.read_apple_activity(spark, str(tmp_path / "a.csv")), "track_name") == [('One, "two"',), ("T",)]
    (tmp_path / "bad.csv").write_text("Event Type,Song Name\nPLAY_END,A\n")
    with pytest.raises(ValueError, match="Album Name"):
        tables.read_apple_activity(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "d.csv").write_text("Date Played,Track Identifier,Track Description\n20240102,7,Some One - A Song - Live\n20240102,7,Some One - A Song - Live\n")
    assert [r[1:] for r in rows(tables.read_apple_daily_tracks(spark, str(tmp_path / "d.csv")))] == [("A Song - Live", "7")]


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", 3, "liked"), (2, "b", 5, "new")], "id int, name string, score int, status string")
    new = spark.createDataFrame([(1, "", 9, "new"), (3, "c", 1, "new")], old.schema)
    got = tables.upsert(old, new, ["id"], {"name": "keep", "score": "max", "status": "terminal:liked,skipped"})
    assert rows(got) == [(1, "a", 9, "liked"), (2, "b", 5, "new"), (3, "c", 1, "new")]
    assert rows(tables.insert_missing(old, new, ["id"]), "id", "score") == [(1, 3), (2, 5), (3, 1)]
    assert rows(tables.replace_children(old, new, ["id"]), "id", "score") == [(1, 9), (2, 5), (3, 1)]


def test_track_ids_are_recovered(spark):
    day = datetime(2024, 1, 2).date()
    events = spark.createDataFrame([(i, day, s, "L") for i, s in enumerate(("exact", "before", "two", "two by album", "nowhere"))], "event_id int, day date, song string, album string")
    before = datetime(2024, 1, 1).date()
    daily = spark.createDataFrame([(day, "exact", "1"), (before, "exact", "9"), (before, "before", "2"), (day, "two", "3"), (day, "two", "4"), (day, "two by album", "5"), (day, "two by album", "6")], "day date, song string, track_id string")
    library = spark.createDataFrame([("5", "L"), ("6", "M")], "track_id string, album string")
    got = matching.recover_track_ids(events, daily, library)
    assert rows(got, "song", "track_id", "found") == [("before", "2", "resolved"), ("exact", "1", "resolved"), ("nowhere", None, "none"), ("two by album", "5", "resolved"), ("two", None, "ambiguous")]


def test_matches_are_scored(spark):
    pairs = spark.createDataFrame([("Blue Moon", "X Y", 1000, "moon blue", "y x", 2000), ("Blue Moon", "X", None, "Else", "Q", 5)], "track string, artist string, duration_ms int, other_track string, other_artist string, other_duration_ms int")
    first, second = (r.confidence for r in matching.score_matches(pairs).collect())
    assert abs(first - 1) < 1e-9 and second < 0.5


def test_submissions_names_and_facts(spark):
    s = spark.createDataFrame([("spotify:track:" + "a" * 22, "x", None), ("https://open.spotify.com/track/" + "B" * 22 + "?si=1", "x", "n"), ("nope", "x", "n"), ("c" * 22, "x" * 81, "n")], "track string, submitter_name string, note string")
    assert [r.rejected for r in matching.validate_submissions(s).collect()] == [None, None, "track", "submitter_name"]
    artists = spark.createDataFrame([("A", "1"), ("a", "1"), ("B", "2"), ("b", "3")], "artist_name string, artist_id string")
    names = spark.createDataFrame([("A",), ("B",), ("C & D",)], "artist_name string")
    assert rows(matching.resolve_artist_ids(names, artists)) == [("A", "1", "resolved", "artist:1"), ("B", None, "ambiguous", "name:b"), ("C & D", None, "unresolved", "name:c-d")]
    p = spark.createDataFrame([(1, '["1"]', "Earth, Wind"), (2, '["2","3"]', "X, Y"), (3, '["4","5"]', "Z")], "observed_at int, artist_ids string, artist_name string")
    assert rows(matching.artist_names_from_polls(p)) == [("1", "Earth, Wind"), ("2", "X"), ("3", "Y")]
    f = spark.createDataFrame([("good one",), ("so hot!",), ("these vibes",), ("w " * 13,), ('a "b"',)], "f string")
    assert [r.reason for r in ripples.validate_facts(f, "f").collect()] == [None, "bad trailing punctuation", "blocked phrase", "too many words", "contains quotation marks"]
    lists = spark.createDataFrame([("Summer 2023",), ("fall 19",), ("winter",), ("x",)], "name string")
    assert rows(matching.detect_seasonal(lists, year=2024), "name", "season", "year") == [("Summer 2023", "summer", 2023), ("fall 19", "fall", 2019), ("winter", "winter", 2024)]


def test_pairs_of_plays_count_once_within_the_window(spark):
    at = [(1, "A", "2023-12-31 23:50:00"), (2, "B", "2023-12-31 23:55:00"), (3, "B", "2024-01-01 00:01:00"), (4, "A", "2024-01-01 00:31:00"), (5, "A", "2024-01-01 00:31:01")]
    p = spark.createDataFrame(at, "play_id int, artist_name string, ts string").withColumns({"ts": F.to_timestamp("ts"), "user_id": F.lit(1)})
    assert rows(graph.session_cooccurrence(p)) == [("A", "B", 2)]
    assert rows(graph.session_cooccurrence(p, split_years=False)) == [("A", "B", 3)]


def run(spark, tmp_path, df, name, mode="append"):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
    return spark.table(name)


def test_streams_agree_with_batches(spark, tmp_path):
    at = [("2024-01-01 10:00:00", "a"), ("2024-01-01 10:00:00", "a"), ("2024-01-01 10:20:00", "b"), ("2024-01-01 12:00:00", "c"), ("2024-01-09 00:00:00", "d")]
    p = spark.createDataFrame([(i, *x, 1, 2.0, "fwdbtn" if i == 3 else "trackdone") for i, x in enumerate(at)], "play_id int, ts string, uri string, user_id int, minutes double, reason_end string").withColumn("ts", F.to_timestamp("ts"))
    p.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(p.schema).parquet(str(tmp_path / "in"))
    assert rows(run(spark, tmp_path, streams.stream_plays(stream), "deduped"), "uri") == [("a",), ("b",), ("c",), ("d",)]
    once = run(spark, tmp_path, streams.stream_rolling(stream, "1 day", "1 day"), "rolling", "complete")
    assert rows(once, "plays", "skip_rate") == [(1, 0.0), (4, 0.25)]
    assert rows(run(spark, tmp_path, streams.stream_sessions(stream), "sessions", "complete"), "plays", "minutes") == [(1, 2.0), (1, 2.0), (3, 6.0)]


def test_events_of_a_stream_of_polls_are_those_of_the_table(spark, tmp_path):
    from tapedeck.operators.events import derive_play_events
    from tapedeck.sources.bridge import polls
    from tapedeck.streaming.events import stream_play_events

    p = polls(spark, "/root/testdata/sf0.001")
    days = [r[0] for r in p.select(F.to_date("observed_at")).distinct().orderBy(F.to_date("observed_at")).collect()]
    for i, (a, b) in enumerate([(0, 10), (10, 20), (20, 99)]):
        p.where(F.to_date("observed_at").isin(days[a:b])).coalesce(1).write.mode("append").parquet(str(tmp_path / "polls"))
    late = spark.createDataFrame([(10**9, datetime(2024, 6, 1), 10**6, False)], "poll_id long, observed_at timestamp, user_id long, is_playing boolean")
    p.limit(0).unionByName(late, allowMissingColumns=True).coalesce(1).write.mode("append").parquet(str(tmp_path / "polls"))
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "polls"))
    got = run(spark, tmp_path, stream_play_events(stream), "derived")
    columns = got.columns
    want = rows(derive_play_events(p), *columns)
    assert want and rows(got, *columns) == want


def test_the_pool(spark):
    from tapedeck.operators import recommend

    c = spark.createDataFrame([("1", "A", "X", 1), ("1", "A", "X", 2), ("2", "a", "x", 3), ("3", "B", "Y", 4), ("4", "C", "Z", 5), ("5", "D", "Z", 6)], "track_id string, track_name string, artist_name string, arrival int")
    known = spark.createDataFrame([("5",)], "track_id string")
    pool = spark.createDataFrame([("9", "c", "z", "fresh", 1.0, datetime(2024, 1, 1)), ("8", "q", "z", "fresh", 2.0, datetime(2025, 1, 1)), ("7", "r", "z", "liked", 3.0, datetime(2024, 1, 1))], "track_id string, track_name string, artist_name string, status string, score double, expires_at timestamp")
    assert rows(recommend.new_candidates(c, known, pool), "track_id") == [("1",), ("3",)]
    assert rows(recommend.pool_expire(pool, as_of="2024-06-01"), "track_id", "status") == [("7", "liked"), ("8", "fresh"), ("9", "expired")]
    assert rows(recommend.pool_top(recommend.pool_expire(pool, as_of="2024-06-01")), "track_id") == [("8",)]
    s = spark.createDataFrame([("1", "notified"), ("2", "notified"), ("3", "new"), ("x", "notified")], "track_id string, status string")
    catalog = spark.createDataFrame([("1", "X"), ("2", None), ("3", "Y")], "track_id string, artist_name string")
    assert rows(recommend.promote_submissions(s, catalog), "track_id", "status", "score") == [("1", "added_to_pool", 0.7), ("2", "rejected", None), ("3", "new", None), ("x", "rejected", None)]


def test_daylight_and_weather(spark):
    from tapedeck.operators.events import add_context_columns

    t = [(h, code) for h, code in ((4, 0), (6, 2), (8, 45), (12, 55), (18, 61), (19, 75), (23, 99))]
    df = spark.createDataFrame([(datetime(2024, 6, 1, h, 10), datetime(2024, 6, 1, 7), datetime(2024, 6, 1, 19), c) for h, c in t], "at timestamp, sunrise timestamp, sunset timestamp, weather_code int")
    got = [(r.daylight_phase, r.condition) for r in add_context_columns(df).orderBy("at").collect()]
    assert got == [("night", "clear"), ("pre_dawn", "partly_cloudy"), ("morning", "fog"), ("midday", "overcast"), ("golden_hour", "rain"), ("dusk", "snow"), ("night", "thunderstorm")]
