import math

from tapedeck.operators import acoustics as ac
from tapedeck.operators import explain as x
from tapedeck.operators import loved as lo

TASTE = "track_id string, track_name string, primary_artist_id string, score double, in_liked_songs boolean, in_top_tracks_short boolean, in_top_tracks_medium boolean, in_top_tracks_long boolean, seasonal_playlist_count int, current_season_present boolean, play_count long, complete_count long"
TRACKS = "session_id long, position int, track_id string, source string, outcome string"


def profile(spark, rows):
    return spark.createDataFrame(rows, "mode string, dimension string, mean double, stddev double, sample_size long")


def test_centroids_fall_back_from_curated_to_own_to_overall(spark):
    p = profile(spark, [("overall", "energy", 0.5, 0.1, 40), ("driving", "energy", 0.9, 0.1, 12), ("working", "energy", 0.1, 0.1, 9), ("sleeping", "energy", 0.8, 0.1, 99)])
    modes = spark.createDataFrame([("driving",), ("working",), ("sleeping",), ("discover",), (None,), ("driving",)], "mode string")
    got = {(r.mode, r.dimension): r["mean"] for r in ac.centroids(p, modes, ac.curated(spark).where("dimension = 'energy'")).collect()}
    assert got == {("driving", "energy"): 0.75, ("working", "energy"): 0.5, ("sleeping", "energy"): 0.25, ("discover", "energy"): 0.5}
    assert {r.mode: r["mean"] for r in ac.centroids(p, modes).collect()} == {"driving": 0.9, "working": 0.5, "sleeping": 0.8, "discover": 0.5}
    untrained = profile(spark, [("overall", "energy", 0.5, 0.1, 9)])
    assert ac.centroids(untrained, modes).collect() == [] and ac.centroids(p.limit(0), modes.limit(0)).collect() == []


def explained(spark, sessions, tracks, taste=(), pool=(), around=(), seen=(), features=(), centroid=()):
    f = spark.createDataFrame(list(features), "track_id string, energy double, valence double")
    c = spark.createDataFrame(list(centroid), "mode string, dimension string, mean double, stddev double")
    t = spark.createDataFrame(tracks, TRACKS)
    rows = x.session_explain(
        spark.createDataFrame(sessions, "session_id long, mode string, snapshot_id long"), t, spark.createDataFrame(list(taste), TASTE),
        spark.createDataFrame(list(pool), "track_id string, track_name string, source_detail string, score double"),
        spark.createDataFrame(list(around), "snapshot_id long, weather_condition string, daylight_phase string"),
        spark.createDataFrame(list(seen), "track_id string, track_name string"), ac.mode_fits(t, f, c, ["energy", "valence"]),
    )
    return {(r.session_id, r.position): r for r in rows.collect()}


def test_reasons_names_and_notes(spark):
    got = explained(
        spark,
        [(1, "unwinding", 7), (2, "driving", None), (3, "odd", 8)],
        [(1, 0, "a", "familiar", "completed"), (1, 1, "b", "familiar", None), (1, 2, "c", "fresh:x", None), (2, 0, "c", "familiar", None), (2, 1, "d", None, None), (2, 2, "d", "familiar", None), (3, 0, "a", "fresh:y", None), (9, 0, "a", "familiar", None)],
        taste=[("a", "Song A", "1", 4.5, True, True, True, True, 2, False, 4, 3), ("b", None, "1", 0.0, False, None, False, False, None, None, 3, 2)],
        pool=[("c", "Fresh C", "a blog", 2.25), ("a", "Other A", "", None)],
        around=[(7, "rain", "night"), (8, "clear", "night")],
        seen=[("d", "Seen D2"), ("d", "Seen D1"), ("d", None), ("b", "Seen B")],
        features=[("a", 0.5, 0.5), ("c", 0.9, 0.5), ("d", None, 0.5)],
        centroid=[("unwinding", "energy", 0.5, 0.1), ("unwinding", "valence", 0.5, 0.1), ("driving", "energy", 0.1, 0.1)],
    )
    mood = ["Weather bias: rain", "Night unwinding: comfort pick"]
    assert len(got) == 7
    a = got[1, 1]
    assert (a.track_name, a.score, a.acoustic_fit, a.acoustic_note) == ("Song A", 4.5, 1.4, None), "on the mean no feature stands out"
    assert a.reasons == ["In your current top tracks", "In your medium-term top tracks", "In your long-term top tracks", "In your liked songs", "In 2 seasonal playlist(s)", "Played 4 times", "Completed 3 times (low skip)", *mood]
    assert (got[1, 2].track_name, got[1, 2].reasons) == ("Seen B", ["Matches your taste profile", *mood])
    c = got[1, 3]
    assert (c.track_name, c.reasons, c.score) == ("Fresh C", ["Discovery: a blog", "Predicted fit score: 2.3", *mood], None)
    assert c.acoustic_fit == math.floor((1.4 - 0.7 * 16 / 18) * 100 + 0.5) / 100 and c.acoustic_note == "High energy for unwinding"
    assert (got[2, 1].track_name, got[2, 1].reasons, got[2, 1].acoustic_fit, got[2, 1].acoustic_note) == ("c", ["Familiar track"], 0.7, "High energy for driving")
    assert (got[2, 2].track_name, got[2, 2].reasons, got[2, 2].acoustic_fit) == ("Seen D1", ["Fresh discovery", "Predicted fit score: ?"], None)
    assert got[2, 3].reasons == ["Familiar track"]
    assert (got[3, 1].track_name, got[3, 1].reasons, got[3, 1].acoustic_fit) == ("Song A", ["Fresh discovery", "Predicted fit score: ?"], None)


def test_explanations_of_nothing_and_of_repeated_rows(spark):
    assert explained(spark, [], []) == {}
    row = ("a", "Song A", "1", 4.5, True, True, True, True, 2, False, 4, 3)
    assert len(explained(spark, [(1, "driving", 7)] * 2, [(1, 0, "a", "familiar", None)], taste=[row, row], pool=[("a", "p", "", 1.0)] * 2, around=[(7, "rain", "night")] * 2, features=[("a", 0.5, 0.5)] * 2, centroid=[("driving", "energy", 0.1, 0.1)])) == 1


def test_wins_and_signals(spark):
    taste = spark.createDataFrame([("a", None, "1", 4.5, True, None, False, False, 1, False, 10, 3)], TASTE)
    tracks = spark.createDataFrame([(1, 0, "a", "familiar", "completed"), (2, 0, "c", "fresh:x", "replayed"), (2, 1, "a", "familiar", "skipped"), (2, 2, "d", "fresh:x", None)], TRACKS)
    sessions = spark.createDataFrame([(1, "driving", "2024-01-01"), (2, "working", "2024-01-02")], "session_id long, mode string, invoked_at string")
    artists, pool = spark.createDataFrame([("1", "Ann")], "artist_id string, artist_name string"), spark.createDataFrame([("c", "Fresh C"), ("a", "Pool A")], "track_id string, track_name string")
    got = sorted(x.agent_wins(sessions, tracks, taste, artists, pool).collect(), key=lambda r: r.session_id)
    assert [(r.track_name, r.artist_name, r.score, r.mode) for r in got] == [("Pool A", "Ann", 4.5, "driving"), ("Fresh C", "", None, "working")]
    assert [r.session_id for r in x.agent_wins(sessions, tracks, taste, artists, pool, n=1).collect()] == [2]
    events = spark.createDataFrame([(1, "a", "completed"), (1, "a", "skipped"), (None, "a", "completed"), (2, "c", "replayed"), (2, "a", "odd"), (2, "d", "abandoned")], "session_id long, track_id string, classification string")
    signals = {r.signal: (r.has_signal, r.satisfied) for r in x.signal_effectiveness(events, taste, tracks).collect()}
    assert signals == {"Liked Songs": (2, 1), "Top Tracks (Short)": (0, 0), "Top Tracks (Medium)": (0, 0), "Seasonal Playlist": (2, 1), "High Play Count (10+)": (2, 1), "Fresh Discovery": (2, 1)}
    assert {tuple(r)[1:] for r in x.signal_effectiveness(events.limit(0), taste, tracks).collect()} == {(0, 0)}


PLAYS = "ts timestamp, uri string, track_name string, artist_name string"
MARKS = "uri string, passage_index int, start_line int, end_line int, passage_text string"


def plays(spark, counts):
    rows = [(day, uri, f"{uri} {i}", "Ann") for uri, n, start in counts for i, day in enumerate(range(start, start + n))]
    return spark.createDataFrame(rows, "day int, uri string, track_name string, artist_name string").selectExpr("timestamp_seconds(day * 86400) AS ts", "uri", "track_name", "artist_name")


def test_highlights_hold_nested_passages_in_order(spark):
    p = plays(spark, [("a", 3, 5), ("b", 3, 1), ("c", 9, 1), ("d", 8, 1), ("e", 1, 1)])
    lyrics = spark.createDataFrame([("a", "ok", False, "x" * 101), ("b", "ok", None, "x" * 200), ("c", "ok", True, "x" * 200), ("d", "missing", False, "x" * 200), ("e", "ok", False, "x" * 100), ("z", "ok", False, "x" * 200), ("a", "ok", False, "x" * 101)], "uri string, status string, instrumental boolean, lyrics_plain string")
    marks = spark.createDataFrame([("a", 1, 9, 9, "second"), ("a", 0, 2, 3, "first"), ("c", 0, 1, 1, "no")], MARKS)
    got = {r.uri: r for r in lo.highlight_tracks(p, lyrics, marks).collect()}
    assert set(got) == {"a", "b"} and got["a"].track_name == "a 2" and got["a"].plays == 3
    assert [(m.start_line, m.end_line, m.text) for m in got["a"].passages] == [(2, 3, "first"), (9, 9, "second")] and got["b"].passages == []
    assert lo.highlight_tracks(p, lyrics, marks, top=1).collect()[0].uri == "a"
    assert lo.highlight_tracks(p.limit(0), lyrics, marks).collect() == []


def test_the_showcase_is_not_repeated(spark):
    p = plays(spark, [("a", 3, 5), ("b", 3, 1), ("c", 9, 0), ("d", 2, 2), ("e", 1, 9)])
    marks = spark.createDataFrame([(u, i, 0, 0, f"{u}{i}") for u in "abcdez" for i in (0, 1) if u != "e" or i], MARKS)
    got = sorted((r.part, r["rank"], r.uri, r.passage_text) for r in lo.loved_passages(p, marks, showcase=2, depth=1).collect())
    assert got == [("depth", 1, "b", "b0"), ("showcase", 1, "c", "c0"), ("showcase", 2, "a", "a0")]
    assert [r.uri for r in sorted(lo.loved_passages(p, marks, showcase=2).where("part = 'depth'").collect(), key=lambda r: r["rank"])] == ["b", "d"]
    assert lo.loved_passages(p, marks.limit(0)).collect() == []


def test_artists_by_name(spark):
    p = spark.createDataFrame([("spotify:track:1", "Ann"), ("spotify:track:2", "Ann"), ("spotify:track:3", "Bob"), ("spotify:track:1", None)], "uri string, artist_name string")
    tracks = spark.createDataFrame([("1", '["x", "y"]'), ("2", '["z"]'), ("3", '["x'), ("4", None)], "track_id string, artist_ids string")
    artists = spark.createDataFrame([("x", 1.0), ("y", 3.0), ("z", 2.0)], "artist_id string, score double")
    assert [tuple(r) for r in lo.artist_taste_by_name(p, tracks, artists).collect()] == [("Ann", 3.0)]
