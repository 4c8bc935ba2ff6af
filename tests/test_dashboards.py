from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tapedeck.operators import dashboards as b
from tapedeck.operators import graph
from tapedeck.operators.events import add_context_columns

EVENTS = "user_id int, ended_at timestamp, track_id string, artist_ids array<string>, classification string, duration_listened_ms long, session_id string, artist_name string"


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


@pytest.fixture(scope="module")
def events(spark):
    at = lambda d, h: datetime(2024, 7, d, h)
    return spark.createDataFrame(
        [
            (1, at(10, 5), "a", ["x", "y"], "completed", 90_000, "s", "Own"),
            (1, at(10, 3), "a", ["x"], "skipped", 1_000, "s", "Own"),
            (1, at(9, 12), "b", [], "abandoned", 30_000, None, None),
            (None, at(10, 5), None, None, "completed", None, "s", None),
            (2, at(1, 5), "b", ["z"], "replayed", 5, "s", " "),
            (2, at(10, 23), "b", ["z"], "replayed", 5, "s", " "),
        ],
        EVENTS,
    )


HELD = "session_id string, track_id string, source string, outcome string"


def test_fresh_plays_count_once_whatever_the_session_repeats(spark, events):
    held = spark.createDataFrame([("s", "a", "fresh:radio", "completed"), ("s", "a", "fresh:more", None), ("s", "b", "familiar", "skipped"), (None, "b", "fresh:x", None)], HELD)
    got = b.period_stats(events, held).first()
    assert (got.events, got.fresh_plays, got.fresh_share, got.skip_rate) == (6, 2, round(2 / 6, 6), 0.2)
    assert rows(b.period_stats(events, held, by=("user_id",)), "user_id", "events", "fresh_plays") == [(1, 3, 2), (2, 2, 0), (None, 1, 0)]
    empty = b.period_stats(events.limit(0), held).first()
    assert empty.events == 0 and empty.fresh_plays == 0 and empty.fresh_share is None


def test_days_begin_at_local_midnight(spark, events):
    held = spark.createDataFrame([("s", "a", "fresh:radio", "completed"), ("s", "b", "familiar", None)], HELD)
    sessions = spark.createDataFrame([(1, "s", datetime(2024, 7, 10, 4)), (3, "s", datetime(2024, 7, 5, 4)), (1, "none", datetime(2024, 7, 10, 4)), (1, "s", datetime(2024, 7, 11))], "user_id int, session_id string, invoked_at timestamp")
    got = b.dashboard(events, sessions, held, as_of="2024-07-10 20:00:00", by=("user_id",))
    c = ("user_id", "span", "tracks", "minutes", "skipped", "fresh_played", "sessions", "session_tracks", "session_completed", "skip_rate")
    assert rows(got, *c) == sorted([(1, "today", 1, 2, 0, 1, 1, 2, 1, 0.0), (1, "week", 3, 2, 1, 2, 1, 2, 1, 0.333333), (3, "week", 0, 0, 0, 0, 1, 2, 1, None), (None, "today", 1, 0, 0, 0, 0, 0, 0, 0.0), (None, "week", 1, 0, 0, 0, 0, 0, 0, 0.0)], key=repr)
    assert b.dashboard(events.limit(0), sessions.limit(0), held, as_of="2024-07-10").count() == 0


def test_names_fall_back(spark, events):
    tracks = spark.createDataFrame([("a", "Song"), ("a", None), ("b", " ")], "track_id string, track_name string")
    artists = spark.createDataFrame([("x", ""), ("q", "Q")], "artist_id string, artist_name string")
    got = b.top_lists(events, tracks, artists, as_of="2024-07-11", hours=24 * 30)
    assert rows(got, "list", "rank", "id", "name", "plays") == [("artist", 1, "x", "Own", 2), ("artist", 2, "z", "Unknown artist", 2), ("track", 1, "b", "b", 3), ("track", 2, "a", "Song", 2)]
    assert b.top_lists(events, tracks, artists, as_of="2024-01-01").count() == 0


def test_queues_and_coverage(spark):
    lyrics = spark.createDataFrame([("a", "ok", False, "x" * 60), ("b", "ok", None, "x" * 60), ("c", "ok", True, "x" * 60), ("d", "ok", False, "x"), ("e", "error", False, "x" * 60), ("f", "ok", False, None), ("g", "ok", False, "x" * 60)], "uri string, status string, instrumental boolean, lyrics string")
    done = spark.createDataFrame([("a", "ok"), ("b", "pending"), ("c", "ok"), ("e", "ok")], "uri string, status string")
    assert rows(b.analysis_queue(lyrics, done)) == [("b",), ("g",)]
    have = spark.createDataFrame([("a", "lyrics"), ("a", "lyrics"), ("c", "lyrics"), ("c", "analysis"), ("b", None)], "uri string, kind string")
    assert rows(b.embedding_queue(done, lyrics, have)) == [("a", ["analysis"])]
    assert rows(b.embedding_queue(done, lyrics, have.limit(0))) == [("a", ["lyrics", "analysis"]), ("c", ["lyrics", "analysis"])]
    plays = spark.createDataFrame([("a",), ("a",), ("z",), ("e",)], "uri string")
    got = b.stage_coverage(plays, {"lyrics": lyrics, "analysis": done})
    assert rows(got.where("stage = 'lyrics'"), "status", "recordings", "plays", "share") == [("error", 1, 1, 0.333333), ("none", 1, 1, 0.333333), ("ok", 1, 2, 0.333333)]
    assert rows(b.top_played_status(plays, {"lyrics": lyrics}, n=2)) == [("a", 2, "ok"), ("e", 1, "error")]
    credits = spark.createDataFrame([("a", "Z", "w"), ("a", "B", "w"), ("a", "B", "w"), ("a", None, "w")], "uri string, person string, role string")
    assert rows(b.credits_by_track(credits)) == [("a", "B (w), Z (w)")]


def test_ratings_by_tag_and_side(spark):
    df = spark.createDataFrame([(["a", "a", "b"], 5, 1.0), (["a", None], 1, None), (None, 3, 2.0), (["b"], None, 9.0)], "tags array<string>, r int, f double")
    assert rows(b.mean_by_tag(df, "tags", "r", least=1)) == [("a", 2, 3.0), ("b", 1, 5.0)]
    assert rows(b.high_low(df, ("f",), "r")) == [(1, 1, "f", 1.0, None, None)]


def test_buckets_from_plays_only_without_affinities(spark):
    a = spark.createDataFrame([("weather", "rain", 3), ("weather", "rain", 4)], "dimension string, bucket string, sample_size int")
    plays = spark.createDataFrame([(datetime(2024, 7, 7, 12), 5)], "ts timestamp, local_hour int")
    assert rows(b.affinity_buckets(a, plays)) == [("weather", "rain", 7, False)]
    assert rows(b.affinity_buckets(a.limit(0), plays)) == [("day_of_week", "Sun", 1, True), ("daylight_phase", "dawn", 1, True)]


def test_daylight_by_local_hour_and_picked_labels(spark):
    df = spark.createDataFrame([(datetime(2024, 7, 1, h), None, datetime(2024, 7, 1, 23), 0) for h in (5, 11, 13, 16, 22, 23)] + [(None, None, None, None)], "at timestamp, sunrise timestamp, sunset timestamp, weather_code int")
    got = [r.daylight_phase for r in add_context_columns(df).orderBy(F.asc_nulls_last("at")).collect()][:6]
    assert got == ["night", "pre_dawn", "morning", "midday", "golden_hour", "dusk"]
    nodes = spark.createDataFrame([(n, 100 - i, 1) for i, n in enumerate("abcdef")], "akey string, plays int, active_years int")
    got = graph.node_encodings(nodes, 3, picks=("zz", "f", "e", "d")).where("label").select("akey")
    assert rows(got) == [("a",), ("e",), ("f",)]
    assert rows(graph.node_encodings(nodes, 3).where("label").select("akey")) == [("a",), ("b",), ("c",)]
