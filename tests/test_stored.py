from datetime import datetime

import pytest

from tapedeck.sources import tables


def plays(spark, *days):
    rows = [(datetime(2024, m, d, 3), "iOS", 60_000, None, f"T{m}-{d}", "Ann", None, "u", "", "trackdone", False, None, 3, 22, 1.0, 2024, m) for m, d in days]
    return spark.createDataFrame(rows, tables.PLAYS)


def names(df):
    return sorted(r.track_name for r in df.collect())


@pytest.mark.parametrize("format", ["parquet", "json"])
def test_plays_come_back_and_months_are_replaced(spark, tmp_path, format):
    path = str(tmp_path / "plays")
    first = plays(spark, (1, 5), (1, 6), (2, 1))
    tables.write_plays(first, path, format=format, expect=3)
    got = tables.read_plays(spark, path, format=format)
    assert sorted(map(tuple, got.select(*first.columns).collect()), key=repr) == sorted(map(tuple, first.collect()), key=repr)
    filtered = got.where("year = 2024 and month = 2")
    assert "PartitionFilters: [isnotnull" in filtered._jdf.queryExecution().executedPlan().toString() and names(filtered) == ["T2-1"]
    tables.write_plays(plays(spark, (2, 7), (3, 1)), path, format=format, months_only=True)
    assert names(tables.read_plays(spark, path, format=format)) == ["T1-5", "T1-6", "T2-7", "T3-1"]
    tables.write_plays(plays(spark, (3, 9)), path, format=format, months_only=True, expect=1)
    assert names(tables.read_plays(spark, path, format=format)) == ["T1-5", "T1-6", "T2-7", "T3-9"]
    tables.write_plays(plays(spark, (4, 9)), path, format=format)
    assert names(tables.read_plays(spark, path, format=format)) == ["T4-9"]


def test_a_wrong_count_leaves_everything_as_it_was(spark, tmp_path):
    path = str(tmp_path / "plays")
    with pytest.raises(ValueError, match="2 rows were written .* 3 were expected"):
        tables.write_plays(plays(spark, (1, 5), (2, 1)), path, expect=3)
    assert list(tmp_path.iterdir()) == []
    tables.write_plays(plays(spark, (1, 5)), path)
    for months_only in (True, False):
        with pytest.raises(ValueError):
            tables.write_plays(plays(spark, (1, 6), (2, 1)), path, expect=1, months_only=months_only)
    tables.write_plays(plays(spark), path, expect=0, months_only=True)
    assert names(tables.read_plays(spark, path)) == ["T1-5"] and [p.name for p in tmp_path.iterdir()] == ["plays"]


def test_counts_after_a_shuffle_are_those_of_the_rows(spark, tmp_path):
    tables.write_plays(plays(spark, (1, 5), (1, 5), (1, 6)).distinct().repartition(7), str(tmp_path / "plays"), expect=2)
    assert names(tables.read_plays(spark, str(tmp_path / "plays"))) == ["T1-5", "T1-6"]


@pytest.mark.parametrize("format", ["parquet", "json"])
def test_snapshots(spark, tmp_path, format):
    path = str(tmp_path / "board")
    for day, rows in (("2024-01-09", ["a"]), ("2024-01-10", ["b", "c"]), ("2024-01-10", ["d"])):
        tables.publish(spark.createDataFrame([(r,) for r in rows], "track_name string"), path, day, format=format)
    got = tables.latest(spark, path, format=format)
    assert names(got) == ["d"] and str(got.collect()[0].as_of) == "2024-01-10"
