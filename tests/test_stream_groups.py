"""A call of the keyed streams takes many tracks or cameras."""

import pandas as pd

from kerbside.operators import smoother, tracking
from kerbside.streaming import jobs


class Entries(dict):
    """A map state in memory, which counts what is written."""

    written = 0

    def iterator(self):
        return iter(list(self.items()))

    def updateValue(self, key, value):
        self.written += 1
        self[key] = value

    def removeKey(self, key):
        del self[key]


class Handle:
    def getValueState(self, name, schema):
        return None

    def getMapState(self, name, keys, values):
        return Entries()


def test_a_call_smooths_many_tracks():
    step = jobs._Smooth(10.0, smoother.Settings(), None, False)
    step.init(Handle())
    rows = pd.DataFrame([("c", str(t), f, float(f * (1 + t)), 0.0) for f in range(20) for t in range(50)], columns=["cctv_id", "track_id", "frame", "x", "y"])
    parts = [d for some in (rows[rows.frame < 9], rows[rows.frame >= 9]) for d in step.handleInputRows((7,), iter([some]), None)]
    assert len(parts) == 2 and step.track.written == 100
    got = pd.concat(parts).set_index(["track_id", "frame"])
    for t in (0, 49):
        want = list(smoother.smooth_rows(((f, float(f * (1 + t)), 0.0, None) for f in range(20)), 10.0, smoother.Smoother()))
        assert [(None if pd.isna(v) else v) for v in got.loc[str(t)].sort_index().speed_kmh] == [w[0] for w in want]


def test_a_call_tracks_many_cameras():
    step = jobs._Track(10.0, tracking.Settings(), None, False, None)
    step.init(Handle())
    rows = pd.DataFrame([(f"cam-{c}", f, float(f + c), 0.0, 0.9, "car") for f in range(20) for c in range(50)], columns=["cctv_id", "frame", "x", "y", "confidence", "kind"])
    parts = [d for some in (rows[rows.frame < 9], rows[rows.frame >= 9]) for d in step.handleInputRows((7,), iter([some]), None)]
    got = pd.concat(parts)
    assert len(parts) == 2 and len(got) == len(rows) and set(got.track_id) == {"0-1"}
    assert len(step.live) == len(step.camera) == 50 and step.live.written == 100
