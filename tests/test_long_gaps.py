"""Ticks follow a track's span, however long it is between two rows."""

from kerbside.operators import sequences
from kerbside.plans import core_queries


def test_long_gaps_are_not_made_at_once(spark):
    """The first ticks of a gap of ten thousand million come without the others."""
    rows = spark.createDataFrame([("a", 0.0, 0.0), ("a", 5e11, 1e10)], "track_id string, t double, x double")
    got = sequences.resample(rows, ["track_id"], 50.0, values=("x",)).limit(3).collect()
    assert [(r.track_id, r.tick, r.x) for r in got] == [("a", 0, 0.0), ("a", 1, 1.0), ("a", 2, 2.0)]


def test_blocks_make_each_tick_once(spark, monkeypatch):
    """Blocks of three: none is missing or twice, where gaps end in a block or with it."""
    monkeypatch.setattr(sequences, "TICKS", 3)
    times = [0.0, 1.0, 2.5, 3.0, 9.0, 9.0, 18.0, 30.0, 30.5]
    rows = spark.createDataFrame([("a", t, 10.0 * t) for t in times] + [(None, 4.0, 40.0), (None, 15.0, 150.0)], "track_id string, t double, x double")
    got = sorted(((r.track_id or "", r.tick, round(r.x, 9)) for r in sequences.resample(rows, ["track_id"], 1.0, values=("x",)).collect()))
    assert got == [("", k, 10.0 * k) for k in range(4, 15)] + [("a", k, 10.0 * k) for k in range(31)]


def test_ticks_are_dealt_by_their_tracks(spark):
    """Few bytes make many ticks, so that partitions aren't merged by size."""
    df = core_queries.QUERIES["resample_interp"](spark, "/root/testdata/sf0.001")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("Exchange") == 2 and df.rdd.getNumPartitions() == 4, plan
