"""Groups handed to tasks many at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.operators import matching, sequences


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_whole_groups_are_whole(spark, batch):
    """Groups longer and shorter than a batch come whole and in order, null keys too."""
    rows = spark.range(200).select(F.when(F.col("id") % 7 > 0, F.floor(F.sqrt("id"))).alias("g"), (-F.col("id")).alias("o"))

    def run(table, starts):
        group, order = table["g"].to_pylist(), table["o"].to_numpy()
        ends = [*starts[1:], len(group)]
        assert all(len(set(group[a:b])) == 1 and (np.diff(order[a:b]) > 0).all() for a, b in zip(starts, ends, strict=True))
        return sequences.with_column(table, "o", np.repeat(np.diff([*starts, len(group)]), np.diff([*starts, len(group)])))

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r.g, r.o) for r in sequences.whole_groups(rows, ["g"], ["o"], run, rows.schema).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(r.g, r.n) for r in rows.groupBy("g").agg(F.count("o").alias("n")).collect()}


def test_few_rows_far_apart_are_one_task(spark, monkeypatch):
    """A track of few rows is not handled in stretches, however far apart its frames are."""
    monkeypatch.setattr(matching.long_tracks, "monotone", None)
    monkeypatch.setattr(matching.long_tracks, "progress", None)
    rows = spark.createDataFrame([(1, 0, 3.0), (1, 50_000, 1.0), (1, 900_000, 2.0)], "t long, f long, v double")
    assert [r.v for r in matching.monotone(rows, ["t"], "f", "v").orderBy("f").collect()] == [2.0, 2.0, 2.0]
    assert matching.progress(rows, ["t"], "f", "v", 3).count() == 3


def test_frames_are_matched_many_at_once(spark):
    """Contested, tied and lopsided frames get an assignment of most overlap, in few calls; big numbers stay what they are."""
    from kerbside.operators import evaluation
    from kerbside.operators.assignment import assign

    rng = np.random.default_rng(3)
    big = 1 << 60
    truth, found, want = [], [], {}
    for f in range(300):
        n, m = rng.integers(0, 6, 2)
        t, p = (np.column_stack([x := rng.integers(0, 60, k) * 1.0, np.zeros(k), x + 40.0, np.full(k, 30.0)]) for k in (n, m))
        truth += [(f, big + i, *map(float, b)) for i, b in enumerate(t)]
        found += [(f, big + i, 0.5, *map(float, b)) for i, b in enumerate(p)]
        over = evaluation._iou_matrix(t, p)
        if n:
            want[f] = over, sum(over[i, j] for i, j in assign(-over))
    box = "x1 double, y1 double, x2 double, y2 double"
    t = spark.createDataFrame(truth, f"frame long, track_id long, {box}")
    p = spark.createDataFrame(found, f"frame long, tracked_id long, confidence double, {box}")
    got: dict = {}
    for r in evaluation.frame_matches(t, p, 1e-9).collect():
        got.setdefault(r.frame, {})[r.track_id - big] = None if r.tracked_id is None else r.tracked_id - big
    assert set(got) == set(want)
    for f, (over, total) in want.items():
        assert set(got[f]) == set(range(len(over)))
        pairs = [(i, j) for i, j in got[f].items() if j is not None]
        assert len({j for _, j in pairs}) == len(pairs)
        assert sum(over[i, j] for i, j in pairs) == pytest.approx(total)


def test_reports_match_their_boxes_once(spark, tmp_path, monkeypatch):
    """A report makes its matches in one pass, whatever it tells of them."""
    from kerbside.operators import evaluation

    plain = evaluation.whole_groups

    def counted(rows, by, order, run, schema):
        def told(table, starts):
            with open(tmp_path / "boxes", "a") as f:
                f.write(f"{len(table)}\n")
            return run(table, starts)

        return plain(rows, by, order, told, schema)

    monkeypatch.setattr(evaluation, "whole_groups", counted)
    rows = [(f, i, i * 100.0, 0.0, i * 100.0 + 40, 30.0) for f in range(20) for i in range(3)]
    t = spark.createDataFrame(rows, "frame long, track_id long, x1 double, y1 double, x2 double, y2 double")
    p = t.withColumnRenamed("track_id", "tracked_id").withColumn("confidence", F.lit(0.5))
    assert evaluation.tracking_metrics(t, p)["n_truth"] == 60
    assert evaluation.detection_metrics(t, p)["ap"] == pytest.approx(1.0)
    assert sum(map(int, (tmp_path / "boxes").read_text().split())) == 2 * 120
