"""Periodicity over every lag, against plain numpy."""

import numpy as np
import pytest

from clipwright.operators import series
from clipwright.plans.sequences import ORDER, confidence, frames, periodicity


def plain(values):
    """Lags 1..T/2-1 of the full autocorrelation over lag 0."""
    d = np.array(values) - np.mean(values)
    full = np.correlate(d, d, "full")
    mid = len(full) // 2
    return full[mid + 1 : mid + len(d) // 2].max() / full[mid] if full[mid] else 0.0


def test_given_events(spark, sf):
    clips = {}
    moving = series.kinematics(frames(spark, sf), "clip_id", ORDER, "value", confidence())
    for r in moving.orderBy("ts", "event_id").collect():
        clips.setdefault(r.clip_id, []).append(r.velocity**2)
    got = {r.clip_id: (r.n, r.periodicity) for r in periodicity(spark, sf).collect()}
    assert set(got) == set(clips)
    assert all(got[c][0] == len(v) and abs(got[c][1] - plain(v)) < 2e-6 for c, v in clips.items())


@pytest.mark.parametrize("block", [3, 7, 4096])
def test_periods_beyond_twelve_frames_and_edges(spark, block):
    rng = np.random.default_rng(3)
    clips = {1: [float(i % 20 == 0) for i in range(100)], 2: rng.normal(size=61).tolist(), 3: [1.0, 2.0, 3.0], 4: [1.0, 4.0, 2.0, 3.0], 5: [2.0] * 9, None: rng.normal(size=40).tolist()}
    rows = [(c, i, x) for c, v in clips.items() for i, x in enumerate(v)] + [(6, i, None if i % 2 else float(i)) for i in range(6)]
    got = {r.c: r.periodicity for r in series.periodicity(spark.createDataFrame(rows, "c int, i int, x double"), "c", ["i"], "x", block).collect()}
    assert set(got) == {1, 2, 4, 5, 6, None} and got[5] == 0 and got[1] > 0.7
    assert all(abs(got[c] - plain(clips[c])) < 1e-9 for c in (1, 2, 4, None))
    # Values -2, 0, 2 at 0, 2, 4: lag 1 meets nothing but nulls, lag 2 sums to 0.
    assert got[6] == 0
