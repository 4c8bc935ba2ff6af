import math
import random
from collections import Counter

import pytest

from tapedeck.operators import planning as p

SNAPSHOT = "snapshot_id long, mode string, daylight_phase string, weather_condition string, weather_temp_f double, location_label string, device_type string, is_in_motion boolean, bluetooth_context string, calendar_category string, day_of_week int"
TRACK = "track_id string, play_count long, skip_count long, complete_count long, last_played_hour int, seasonal_playlist_count int, current_season_present boolean"


def biases(spark, snapshots, tracks, affinities=()):
    a = spark.createDataFrame(list(affinities), "track_id string, dimension string, bucket string, affinity double, sample_size int")
    return p.context_biases(spark.createDataFrame(tracks, TRACK), spark.createDataFrame(snapshots, SNAPSHOT), a, by=())


def test_rules_learned_affinities_and_clamp(spark):
    snapshots = [
        (1, "unwinding", "night", "rain", 30.0, "home", "Speaker", None, None, None, 3),
        (2, "driving", "midday", None, 85.0, "road", "Smartphone", True, "car", "workout", 5),
        (3, None, None, None, None, None, None, None, None, None, None),
    ]
    tracks = [("calm", 20, 1, 9, 12, 1, True), ("never", 0, 0, 0, None, 0, None)]
    learned = [("calm", "weather_condition", "rain", 0.7, 5), ("calm", "daylight_phase", "night", 1.9, 4), ("calm", "location_label", "home", 1.5, 9), ("calm", "day_of_week", "3", 1.04, 9), ("never", "location_label", "road", 1.8, 50), ("never", "location_label", "home", 1.8, 3)]
    b = biases(spark, snapshots, tracks, learned)
    got = {(r.snapshot_id, r.track_id, r.bucket): (round(r.multiplier, 6), r.learned) for r in b.collect()}
    assert got == {
        (1, "calm", "night"): (1.15, False), (1, "calm", "night_work_penalty"): (0.9, False), (1, "calm", "rain"): (0.7, True), (1, "calm", "cold"): (1.1, False), (1, "calm", "Speaker"): (1.0, False), (1, "calm", "home"): (1.5, True),
        (1, "never", "Speaker"): (1.0, False),
        (2, "calm", "hot_midday"): (1.15, False), (2, "calm", "mobile_moving"): (1.1, False), (2, "calm", "mobile_moving_familiar"): (1.1, False), (2, "calm", "car"): (1.15, False), (2, "calm", "workout"): (1.1, False),
        (2, "never", "mobile_moving"): (1.1, False), (2, "never", "car"): (1.15, False), (2, "never", "road"): (1.8, True),
    }
    times = {(r.snapshot_id, r.track_id): r.multiplier for r in p.context_multiplier(b, by=()).collect()}
    assert times[1, "calm"] == round(1.15 * 0.9 * 0.7 * 1.1 * 1.5, 6) and times[2, "never"] == 2.0
    summary = {(r.snapshot_id, r.bucket): (r.tracks, r.mean) for r in p.bias_summary(b).collect()}
    assert summary[1, "Speaker"] == (2, 1.0) and summary[2, "car"] == (2, 1.15)


def test_tracks_meet_snapshots_by_keys_only(spark):
    plan = biases(spark, [(1, "driving", "night", "rain", 1.0, "a", "b", True, "car", "focus", 1)], [("t", 1, 0, 0, 1, 1, True)])._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def planned(spark, requests, candidates, seed=0, parts=None):
    r = spark.createDataFrame(requests, "request_id long, mode string, n_tracks int")
    c = spark.createDataFrame(candidates, "request_id long, track_id string, artist_id string, score double, source string")
    c = c.repartition(parts) if parts else c
    return sorted(tuple(x) for x in p.plan_sessions(r, c, seed=seed).collect())


def some(request, familiar=30, fresh=12):
    return [(request, f"f{i}", f"a{i % 6}", 1.0 + i, "familiar") for i in range(familiar)] + [(request, f"n{i}", f"a{i % 5}", 2.0, "fresh:blog") for i in range(fresh)]


def test_plans_are_whole_and_reproducible(spark):
    requests = [(i, ("unwinding", "discover", "driving", "brainstorming")[i % 4], 1 + i % 20) for i in range(40)]
    candidates = [c for i in range(40) for c in some(i)]
    rows = planned(spark, requests, candidates)
    assert rows == planned(spark, requests, candidates[::-1], parts=13)
    assert rows != planned(spark, requests, candidates, seed=1)
    of = {}
    for r in rows:
        of.setdefault(r[0], []).append(r)
    for i, mode, n in requests:
        assert [r[1] for r in of[i]] == list(range(n)) and len({r[2] for r in of[i]}) == n
        if mode == "discover":
            assert [r[4] for r in of[i]] == ["fresh:blog"] * min(n, 12) + ["familiar"] * max(0, n - 12)
        else:
            assert of[i][0][4] == "familiar"  # the arc begins at 0


def test_ends_and_awkward_candidates(spark):
    requests = [(1, "unwinding", 9), (2, "discover", 3), (3, "driving", 4), (4, "driving", 0), (5, None, 3)]
    candidates = [(1, "a", "x", 1.0, "familiar"), (1, "b", None, None, "familiar"), (1, "b", None, 3.0, "familiar"), (1, "c", None, -4.0, "fresh:s"), (2, "a", "x", 1.0, "familiar"), (4, "a", "x", 1.0, "familiar"), (5, "a", "x", 1.0, "familiar")]
    rows = planned(spark, requests, candidates)
    assert Counter(r[0] for r in rows) == {1: 3, 2: 1, 5: 1}
    assert {r[2] for r in rows if r[0] == 1} == {"a", "b", "c"}
    assert planned(spark, [], candidates) == [] and planned(spark, requests, []) == []


def test_first_picks_follow_scores_and_fresh_follows_the_arc(spark):
    n = 4000
    rows = planned(spark, [(i, "brainstorming", 5) for i in range(n)], [c for i in range(n) for c in [(i, "low", "a", 1.0, "familiar"), (i, "high", "b", 3.0, "familiar"), (i, "tiny", "c", 0.0, "familiar"), *((i, f"n{j}", "d", 1.0, "fresh:x") for j in range(6)), *((i, f"m{j}", "e", 0.1, "familiar") for j in range(6))]])
    first = Counter(r[2] for r in rows if r[1] == 0)
    weight = {"low": 1.0, "high": 3.0, "tiny": 0.1}
    for track, w in weight.items():
        share = w / 4.7
        assert abs(first[track] / n - share) < 4 * math.sqrt(share * (1 - share) / n)
    for place, want in ((1, 0.15), (2, 0.45), (3, 0.7), (4, 0.0)):
        got = sum(r[4] != "familiar" for r in rows if r[1] == place) / n
        assert abs(got - want) < 4 * math.sqrt(0.25 / n)


def test_the_last_artist_is_seldom_drawn_again(spark):
    n = 3000
    rows = planned(spark, [(i, "driving", 2) for i in range(n)], [c for i in range(n) for c in [(i, "a1", "a", 1.0, "familiar"), (i, "a2", "a", 1.0, "familiar"), (i, "b", "b", 1.0, "familiar")]])
    second = Counter((x[2], y[2]) for x, y in zip(rows[::2], rows[1::2], strict=True))
    after = sum(v for (x, _), v in second.items() if x == "a1")
    assert abs(second["a1", "a2"] / after - 0.1 / 1.1) < 0.04


@pytest.mark.parametrize("place, mode, want", [(0.0, "driving", 0.0), (0.125, "working", 0.04), (0.75, "brainstorming", 0.7), (0.75, "unwinding", 0.3), (0.95, "other", 0.1), (2.0, "driving", 0.0), (0.0, "discover", 1.0)])
def test_fresh_ratio(spark, place, mode, want):
    from pyspark.sql import functions as F

    assert abs(spark.range(1).select(p.fresh_ratio(F.lit(place), F.lit(mode)).alias("r")).first().r - want) < 1e-9


def test_candidates_without_recent_and_blocked(spark):
    r = random.Random(3)
    taste = [(u, f"t{i}", f"a{i % 3}", float(r.randint(-2, 9))) for u in (1, 2) for i in range(30)]
    events = [(u, f"t{r.randint(0, 29)}", i) for u in (1, 2) for i in range(60)]
    fresh = [(1, f"n{i}", "z", float(i), "blog") for i in range(9)] + [(1, events[59][1], "z", 99.0, "blog")]
    requests = [(10, 1, "driving", 5), (11, 2, "driving", None), (12, 3, "driving", 6)]
    c = p.session_candidates(
        spark.createDataFrame(requests, "request_id long, user_id long, mode string, snapshot_id long"), spark.createDataFrame(taste, "user_id long, track_id string, artist_id string, score double"), spark.createDataFrame(fresh, "user_id long, track_id string, artist_id string, score double, source string"),
        spark.createDataFrame(events, "user_id long, track_id string, started_at long"), blocked=spark.createDataFrame([(1, "n8")], "user_id long, track_id string"), multipliers=spark.createDataFrame([(1, 5, "t1", 2.0)], "user_id long, snapshot_id long, track_id string, multiplier double"),
        fit=spark.createDataFrame([("n7", "driving", 0.5)], "track_id string, mode string, fit double"), familiar=12, new=5, recent=4,
    )
    want = set()
    for request, u, _, snapshot in requests:
        last = {}
        for v, t, at in events:
            if v == u:
                last[t] = at
        gone = {t for t, _ in sorted(last.items(), key=lambda x: (-x[1], x[0]))[:4]} | ({"n8"} if u == 1 else set())
        for t, a, s in sorted([x[1:] for x in taste if x[0] == u and x[3] > 0], key=lambda x: (-x[2], x[0]))[:12]:
            if t not in gone:
                want.add((request, t, a, s * (2 if (u, snapshot, t) == (1, 5, "t1") else 1), "familiar"))
        for t, a, s, src in sorted([x[1:] for x in fresh if x[0] == u], key=lambda x: (-x[2], x[0]))[:5]:
            if t not in gone:
                want.add((request, t, a, s * (0.5 if t == "n7" else 1), f"fresh:{src}"))
    assert want and {tuple(x) for x in c.collect()} == want


def test_scores_of_candidates_reach_their_caps(spark):
    taste = spark.createDataFrame([("big", 40.0), ("small", 2.0), ("mid", 5.0)], "artist_id string, score double")
    seasonal = spark.createDataFrame([("big",), ("new",)], "artist_id string")
    rows = [(1, ["big", "small", "nobody"], "x", False), (2, ["big", "small"], "followed_artist_release", False), (3, ["nobody"], "x", False), (4, ["big", "big", "mid"], "x", True), (5, ["new", "big", "small"], "x", True), (6, ["small"], "x", True), (7, None, "x", True), (8, [], "x", False)]
    got = {r.candidate_id: r.score for r in p.score_candidates(spark.createDataFrame(rows, "candidate_id long, artist_ids array<string>, source string, is_editorial boolean"), taste, seasonal).collect()}
    assert got == {1: 26.4, 2: 27.9, 3: 0.0, 4: 4.5, 5: 7.2, 6: 0.6, 7: 5.0, 8: 0.0}


def test_sessions_are_drawn_without_a_group_for_each_request(spark):
    """A group of pandas rows for each request takes longer than the draw itself; null scores and artists count as before."""
    r = spark.createDataFrame([(1, "discover", 3), (2, "unwinding", 2)], "request_id long, mode string, n_tracks int")
    c = spark.createDataFrame([(1, "a", None, None, "familiar"), (1, "b", "x", float("nan"), "fresh:blog"), (1, "c", "x", 1.0, "fresh:blog"), (2, "d", None, 2.0, "familiar")], "request_id long, track_id string, artist_id string, score double, source string")
    got = p.plan_sessions(r, c)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan
    rows = sorted(tuple(x) for x in got.collect())
    assert [x[:2] for x in rows] == [(1, 0), (1, 1), (1, 2), (2, 0)] and {x[2] for x in rows[:2]} == {"b", "c"} and rows[2][2:5] == ("a", None, "familiar") and rows[3][2:5] == ("d", None, "familiar")
    assert p.chances(1, "r", 2)("t") == p.chance(1, "r", 2, "t")


def test_contexts_are_weighed_for_the_pool_only(spark):
    taste = spark.range(60).selectExpr("id % 2 AS user_id", "concat('t', id div 2) AS track_id", "'a' AS artist_id", "cast(id div 2 AS double) AS score", "id AS started_at")
    fresh = spark.createDataFrame([(0, "t1", "z", 5.0, "blog")], "user_id long, track_id string, artist_id string, score double, source string")
    how = {"blocked": taste.where("track_id = 't20'"), "familiar": 12, "new": 2, "recent": 3}
    kept = p.in_pool(taste, p.candidate_pool(taste, fresh, taste, **how))
    assert sorted((r.user_id, r.track_id) for r in kept.collect()) == sorted((u, f"t{i}") for u in (0, 1) for i in range(18, 27) if i != 20)
    requests = spark.createDataFrame([(7, 0, "driving", 5), (8, 1, "driving", 6)], "request_id long, user_id long, mode string, snapshot_id long")

    def candidates(tracks):
        times = tracks.selectExpr("user_id", "user_id + 5 AS snapshot_id", "track_id", "1 + started_at / 100D AS multiplier")
        return sorted(tuple(r) for r in p.session_candidates(requests, taste, fresh, taste, multipliers=times, **how).collect())

    assert candidates(kept) == candidates(taste) and (7, "t1", "z", 5.0, "fresh:blog") in candidates(kept)
