import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tapedeck.operators import details as d
from tapedeck.operators import history as h
from tapedeck.operators import periods as p

ERAS = {"early": [2020, 2021], "late": [2022]}
SCHEMA = "ts timestamp, user_id long, uri string, track_name string, artist_name string, album_name string, minutes double, ms_played long, reason_end string, platform string, year int, month int, hour int, local_hour int"


def play(ts, user=1, track="A", artist="X", uri="u", minutes=3.0, reason="trackdone", ms=180_000):
    return (ts, user, uri, track, artist, "L", minutes, ms, reason, "iOS", ts.year, ts.month, ts.hour, (ts.hour + 19) % 24)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def many(spark):
    r = random.Random(3)
    start = datetime(2020, 1, 1)
    rows = [play(start + timedelta(hours=r.randrange(26_000)), r.choice((1, 1, 2, None)), r.choice("AaBbCc"), r.choice("XxYZ"), r.choice("uvw"), r.randrange(40) / 8, r.choice(("fwdbtn", "trackdone", None)), r.randrange(60_000)) for _ in range(500)]
    return frame(spark, rows).cache()


AS_OF = "2022-12-20"
#: A day on which everybody of `many` has plays.
MONTH, DAY = 2, 14
JOBS = {
    "monthly_top": lambda x, **k: h.monthly_top(x, **k), "lost_favorites": lambda x, **k: h.lost_favorites(x, as_of=AS_OF, min_plays=2, years_gone=0.1, limit=4, **k), "artist_affinity": lambda x, **k: h.artist_affinity(x, as_of=AS_OF, **k),
    "track_affinity": lambda x, **k: h.track_affinity(x, as_of=AS_OF, **k), "skip_penalized": lambda x, **k: h.skip_penalized(x, as_of=AS_OF, days=900, **k), "lifetime_totals": lambda x, **k: h.lifetime_totals(x, **k),
    "skip_rate_by_quarter": lambda x, **k: h.skip_rate_by_quarter(x, **k), "discovery": lambda x, **k: h.discovery_by_year(x, **k), "concentration": lambda x, **k: h.concentration_by_year(x, 2, **k), "hourly": lambda x, **k: h.hourly(x, **k),
    "day_of_week": lambda x, **k: h.day_of_week(x, **k), "core": lambda x, **k: h.never_stale_core(x, top=2, years=2, **k), "skip_report": lambda x, **k: h.skip_report(x, 5, **k), "graph_nodes": lambda x, **k: h.graph_nodes(x, 10, **k),
    "skip_counts": lambda x, **k: p.skip_counts(x, as_of=AS_OF, days=900, **k), "new_entries": lambda x, **k: p.new_entries(x, year=2020, month=1, **k), "daylight": lambda x, **k: p.daylight_bands(x, **k), "by_month": lambda x, **k: p.listening_by_month(x, **k),
    "heatmap": lambda x, **k: p.heatmap(x, **k), "week_top": lambda x, **k: p.week_top(x, as_of=AS_OF, **k), "skip_wow": lambda x, **k: p.skip_rate_wow(x, as_of=AS_OF, **k), "artist_details": lambda x, **k: p.artist_details(x, **k),
    "artist_deltas": lambda x, **k: p.artist_deltas(x, as_of=AS_OF, **k), "day_totals": lambda x, **k: d.on_this_day_totals(x, month=MONTH, day=DAY, **k), "range_totals": lambda x, **k: d.date_range_totals(x, start="2020-02-01", end="2023-01-01", as_of=AS_OF, **k),
    "range_artists": lambda x, **k: d.date_range_artists(x, start="2020-02-01", end="2020-03-01", limit=2, **k), "skips": lambda x, **k: d.skip_overview(x, as_of=AS_OF, period="all", least=2, **k), "penalties": lambda x, **k: d.current_penalties(x, as_of=AS_OF, days=900, least=2, **k),
    "profiles": lambda x, **k: d.artist_profiles(x, core_top=1, core_years=2, **k), "eras": lambda x, **k: d.era_details(x, ERAS, artists=2, **k),
}


@pytest.mark.parametrize("name", sorted(JOBS))
def test_each_listener_gets_what_its_own_plays_give(many, name):
    job = JOBS[name]
    got = job(many, by=("user_id",)).collect()
    for user in (1, None):
        alone = job(many.where(F.col("user_id").eqNullSafe(user)))
        want = sorted(repr(tuple(r)) for r in alone.collect())
        assert want and sorted(repr(tuple(r[c] for c in alone.columns)) for r in got if r.user_id == user) == want
    assert job(many.limit(0), by=("user_id",)).collect() == []


def test_ranges_are_cut_to_the_history_and_to_today(spark):
    x = frame(spark, [play(datetime(2020, 3, 1, 4), 1), play(datetime(2020, 3, 5, 12), 1, "B"), play(datetime(2020, 3, 5, 13), 2, "b", "x"), play(datetime(2020, 3, 20), 1)])

    def totals(start, end, as_of="2020-03-10"):
        return [tuple(r) for r in d.date_range_totals(x, start=start, end=end, as_of=as_of).collect()]

    assert totals("2019-01-01", "2020-12-31") == [(date(2020, 2, 29), date(2020, 3, 10), 11, 2, 3, 9.0, 2, 2)], "4 h UTC is the evening before"
    assert totals("2020-03-06", "2020-03-06") == [(date(2020, 3, 6), date(2020, 3, 6), 1, 0, 0, 0.0, 0, 0)]
    assert totals("2019-01-01", "2019-02-01") == [(date(2019, 1, 1), date(2019, 2, 1), 0, 0, 0, 0.0, 0, 0)]
    assert totals("2020-04-01", "2020-05-01") == [(date(2020, 4, 1), date(2020, 5, 1), 0, 0, 0, 0.0, 0, 0)]
    assert d.date_range_totals(x.limit(0), start="2020-01-01", end="2020-01-02", as_of="2020-03-10").collect() == []
    for start, end in (("2020-02-01", "2020-01-01"), ("soon", "2020-01-01"), ("2020-01-01", "2020-02-30")):
        with pytest.raises(ValueError):
            totals(start, end)
    plan = d.date_range_artists(x, start="2020-01-01", end="2020-01-02")._jdf.queryExecution().optimizedPlan().toString()
    assert "cast(ts" not in plan and "ts#" in plan


def test_series_profiles_and_eras(spark):
    x = frame(spark, [play(datetime(2020, 3, 9)), play(datetime(2020, 3, 8)), play(datetime(2021, 11, 8), track="a", reason="fwdbtn"), play(datetime(2022, 1, 8), track="B", artist="x"), play(datetime(2022, 1, 9), track="C", artist="Y", reason=None), play(datetime(2024, 1, 9), track="C", artist="Y")])
    t = {r.tkey: r for r in d.track_series(x, ERAS).collect()}
    assert [tuple(m) for m in t["a"].months] == [("2020-03", 2), ("2021-11", 1)] and (t["a"].era, t["a"].completion, t["a"].overall_completion) == ("early", 66.7, 66.7) and t["c"].era == "late"
    near = spark.createDataFrame([("X", "Y", 1), ("X", "Z", 4)], "artist_name string, companion string, sessions long")
    a = {r.akey: r for r in d.artist_profiles(x, near, tracks=1, core_top=1, core_years=3).collect()}
    assert [tuple(y) for y in a["x"].years] == [(2020, 2), (2021, 1), (2022, 1)] and (a["x"].years_in_top, a["x"].core, a["y"].core) == (3, True, False)
    assert [(s.track, s.plays, s.last_play) for s in a["x"].tracks] == [("a", 3, datetime(2021, 11, 8))] and [(c.artist, c.sessions) for c in a["x"].companions] == [("Z", 4), ("Y", 1)] and a["y"].companions is None
    e = {r.era: r for r in d.era_details(x, ERAS | {"again": [2022], "never": [1999]}).collect()}
    assert set(e) == {"early", "late", "again"} and e["late"].plays == e["again"].plays == 2
    assert (e["early"].skip_rate, tuple(e["early"].top_song), [tuple(y) for y in e["early"].years]) == (33.3, ("a", "x", 3), [(2020, 2), (2021, 1)])
    s = d.adjusted_artist_series(x, spark.createDataFrame([(7, "x"), (3, "X")], "artist_id long, artist_name string"))
    assert [(r.akey, r.artist_id, [y.plays for y in r.plays_by_year]) for r in s.orderBy("akey").collect()] == [("x", 3, [2, 1, 1, 0, 0]), ("y", None, [0, 0, 1, 0, 1])]
    for empty in (d.track_series(x.limit(0), ERAS), d.artist_profiles(x.limit(0)), d.era_details(x.limit(0), ERAS), d.adjusted_artist_series(x.limit(0), spark.createDataFrame([], "artist_id long, artist_name string"))):
        assert empty.collect() == []


@pytest.mark.parametrize(("years", "era"), [([2020, 2022, 2021], "early"), ([2022, 2020], "late"), ([2020, 2022], "early"), ([1999, 2022], "late"), ([1999], None), ([], None), (None, None)])
def test_the_era_most_years_lie_in(spark, years, era):
    x = spark.createDataFrame([(years,)], "years array<int>")
    assert x.select(d.majority_era(F.col("years"), ERAS).alias("e")).collect()[0].e == era


def test_skips_of_periods_and_artists(spark):
    x = frame(spark, [play(datetime(2022, 12, n), track=t, reason=r, artist=a) for n, (t, r, a) in enumerate([("A", "fwdbtn", "X"), ("a", None, "X"), ("B", "trackdone", "X"), ("B", "trackdone", "X"), ("C", "fwdbtn", "Y")], 1)] + [play(datetime(2022, 1, 1), reason="fwdbtn")])
    got = [(r.kind, r["rank"], r.tkey, r.plays, r.skips, r.skip_rate) for r in d.skip_overview(x, as_of=AS_OF, least=2).collect()]
    assert sorted(got) == [("champion", 1, "b", 2, 0, 0.0), ("overall", 0, None, 5, 2, 40.0), ("skipped", 1, "a", 2, 1, 50.0)]
    assert [r.plays for r in d.skip_overview(x, as_of=AS_OF, period="year", artist="Y").collect()] == [1]
    assert d.skip_overview(x, as_of="2000-01-01").collect() == []
    with pytest.raises(KeyError):
        d.skip_overview(x, as_of=AS_OF, period="decade")
