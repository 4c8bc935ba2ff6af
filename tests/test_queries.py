import duckdb
import pytest

from tapedeck.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "part", "orders", "events", "supplier", "documents", "embeddings", "labels", "pages", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 4) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_are_those_of_the_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in got.collect()]
    assert rows and sorted(rows, key=repr) == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)
