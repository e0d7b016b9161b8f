"""Queries and their SQL go by one rule where the test tables' small copies don't show a difference."""

import datetime

import duckdb
import pytest

from kerbside import plans


@pytest.fixture
def both(spark, tmp_path):
    """Rows of a query and of its SQL over events (id, user, value) and the nations."""

    def run(name, events):
        start = datetime.datetime(2024, 1, 1)
        rows = [(i, start + datetime.timedelta(seconds=i), u, "view", float(v), "{}") for i, u, v in events]
        spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
        spark.read.parquet("/root/testdata/sf0.001/nation.parquet").coalesce(1).write.parquet(f"{tmp_path}/nation.parquet")
        with duckdb.connect() as c:
            for t in ("events", "nation"):
                c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
            df = plans.QUERIES[name](spark, str(tmp_path))
            return sorted(map(tuple, df.collect())), sorted(c.sql(f"SELECT {', '.join(df.columns)} FROM ({plans.ORACLE_SQL[name]})").fetchall())

    return run


def test_headings_of_rows_whose_neighbours_coincide(both):
    """At the corner the rows before and behind are at one place, so that the chord is taken farther out."""
    got, want = both("heading_filled", [(k, 0, {49: 5.0, 51: 1.0}.get(k, 3.0)) for k in range(1, 61)])
    assert got == want
    assert dict(got)[50] != 0.0


def test_nearest_guides_by_distance_alone(both):
    """Of two guides whose distances differ in the last digits alone the nearer counts, not the smaller heading."""
    got, want = both("guide_headings", [(k, 100, 13.8 if k == 63 else 3.0) for k in range(1, 64)])
    assert got == want
