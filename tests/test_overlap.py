"""A camera tracked by overlap in pieces gives what one pass over its frames gives."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kerbside.operators import overlap, tracking
from kerbside.operators.evaluation import _iou_matrix

BOX = list(overlap.BOX)


def plain(camera, threshold, max_age):
    """Ids of rows in order, frame after frame."""
    last, ids, fresh, piece, before = {}, [], 1, 0, None
    for frame, now in camera.groupby("frame", sort=True):
        if before is not None and frame - before > max_age:
            piece, fresh, last = piece + 1, 1, {}
        before = frame
        last = {k: v for k, v in last.items() if frame - v[0] <= max_age}
        keys, boxes, got = list(last), now[BOX].to_numpy(float), {}
        if keys:
            over = _iou_matrix(np.array([last[k][1] for k in keys]), boxes)
            for flat in np.argsort(-over, axis=None, kind="stable"):
                i, j = divmod(int(flat), len(boxes))
                if over[i, j] < threshold:
                    break
                if j not in got and keys[i] not in got.values():
                    got[j] = keys[i]
        for j in range(len(boxes)):
            if j not in got:
                got[j], fresh = fresh, fresh + 1
            last[got[j]] = (int(frame), boxes[j])
            ids.append(f"{piece}-{got[j]}")
    return ids


@pytest.mark.parametrize("room,threshold", [(40, 0.3), (14, 0.3), (8, 0.1)])
def test_pieces_equal_one_pass(spark, room, threshold):
    """Sparse boxes, which are cut often, and crowds without a cut; places on a grid, so that overlaps tie; pauses within stretches and over their ends."""
    rng = np.random.default_rng(room)
    parts = []
    for c in ("a", "b", None):
        frame = np.sort(rng.choice(np.r_[-150:300, 340:390, 420:700], 900))
        x, y = rng.integers(0, room, (2, 900)) * 1.0
        parts.append(pd.DataFrame({"cctv_id": c, "frame": frame, "x1": x, "y1": y, "x2": x + rng.integers(2, 5, 900), "y2": y + 3.0}))
    rows = pd.concat([p.sort_values(["frame", *BOX], kind="stable") for p in parts], ignore_index=True)
    want = sum((plain(g, threshold, 5) for _, g in rows.fillna({"cctv_id": "none"}).groupby("cctv_id", sort=False)), [])
    df = spark.createDataFrame([tuple(None if v is None or v != v else v for v in r) for r in rows.astype(object).itertuples(index=False)], "cctv_id string, frame long, x1 double, y1 double, x2 double, y2 double")
    key = lambda r: (r.cctv_id or "none", r.frame, r.x1, r.y1, r.x2, r.y2, r.track_id)
    got = sorted(map(key, overlap.track(df, threshold, 5, "cctv_id", stretch=40).collect()))
    assert got == sorted(key(r) for r in rows.fillna({"cctv_id": "none"}).assign(track_id=want).itertuples())
    parted = df.withColumn("_chunk", F.floor(F.col("frame") / 40).cast("long"))
    cut = overlap.cuts(parted, "cctv_id", threshold, 5, 40, 40).count()
    assert cut > 20 if room == 40 else cut >= 0
    assert len({g[-1] for g in got}) < len(rows)


def test_a_camera_is_many_tasks(spark):
    """Frames without a pause are one group no more."""
    rows = spark.range(100_000).select(F.lit("cam").alias("cctv_id"), F.col("id").alias("frame"), (F.col("id") * 37 % 900.0).alias("x1"), F.lit(0.0).alias("y1"), (F.col("id") * 37 % 900.0 + 5.0).alias("x2"), F.lit(5.0).alias("y2"))
    parted = rows.withColumn("_chunk", F.floor(F.col("frame") / overlap.STRETCH).cast("long"))
    assert overlap.cuts(parted, "cctv_id", 0.3, 30, overlap.STRETCH, overlap.HEAD).count() == 5
    out = tracking.track_by_overlap(rows)
    assert out.count() == 100_000 and out.select("track_id").distinct().count() == 100_000
