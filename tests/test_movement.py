"""Movement profiles: hulls against a wrapping walk, classes and crossings on made tracks."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from motionspark.operators import movement

ROW = "tracklet_id string, frame_index long, x_m double, y_m double"
#: A room of 12 by 8 with a corner cut out.
ROOM = [(44, 34), (56, 34), (56, 42), (50, 42), (50, 38), (44, 38)]


def wrapped_area(points):
    """By wrapping a line around the points."""
    points = sorted(set(points))
    if len(points) < 3:
        return 0.0
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    at, out = points[0], []
    while True:
        out.append(at)
        best = points[0] if points[0] != at else points[1]
        for p in points:
            c = cross(at, best, p)
            if p != at and (c < 0 or (c == 0 and math.dist(at, p) > math.dist(at, best))):
                best = p
        at = best
        if at == out[0] or len(out) > len(points):
            break
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(out, [*out[1:], out[0]], strict=True))) / 2


def test_hull_areas(spark, monkeypatch):
    rng, rows, want = random.Random(3), [], {}
    for k in range(25):
        n = rng.choice([1, 2, 3, 5, 40, 300])
        points = [(float(rng.randrange(9)), float(rng.randrange(9))) for _ in range(n)] if k % 3 else [(float(i), 2.0 * i) for i in range(n)]
        want[f"t{k}"] = wrapped_area(points)
        rows += [(f"t{k}", i, *p) for i, p in enumerate(points)]
    rows += [("t1", 1000, None, 5.0), (None, 3, 1.0, 1.0)]
    rng.shuffle(rows)
    got = {r.tracklet_id: r.hull_m2 for r in movement.hull_areas(spark.createDataFrame(rows, ROW).repartition(7)).collect()}
    assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-9 for t in want)


def test_many_points_are_held_as_hulls():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(20_000, 2))
    parts = np.concatenate([movement.hull(points[i : i + 500]) for i in range(0, len(points), 500)])
    assert len(parts) < 1500
    assert movement.polygon_area(movement.hull(parts)) == pytest.approx(movement.polygon_area(movement.hull(points)))


def track(name, places):
    return [(name, i, float(x), float(y)) for i, (x, y) in enumerate(places)]


def test_classes_of_tracks(spark):
    sweep = [(50 + 2 * i / 300, 40.5 + math.sin(i * 0.1) + 1.5 * i / 300) for i in range(300)]
    rows = [*track("sweep", sweep), *track("stands", [(52, 40)] * 100), *track("runs", [(46 + 10 * i / 30, 36) for i in range(30)]), *track("once", [(50, 40)]), *track("out", [(0, 0), (1, 1), (52, 40), (53, 40)])]
    got = {r.tracklet_id: r for r in movement.profiles(spark.createDataFrame(rows, ROW), ROOM, 30.0).collect()}
    assert {t: r["class"] for t, r in got.items()} == {"sweep": "cleaning", "stands": "lingering", "runs": "lingering", "out": "lingering"}
    assert got["stands"].stillness == 1.0 and got["stands"].hull_m2 == 0 and not got["stands"].birth_crosses and got["out"].on_mat == 0.5
    assert got["runs"].speed_mps == pytest.approx(10.0, abs=0.01) and got["sweep"].duration_s == pytest.approx(9.97)


def test_crossings(spark):
    """Towards the lower edge it crosses, along it it does not; near a side's middle the last rows count."""
    down = [(46.0, 36 - 1.5 * i / 19) for i in range(20)]
    along = [(46 + 4 * i / 19, 34.3) for i in range(20)]
    turn = [*along, *[(50.0, 34.3 - 0.05 * i) for i in range(1, 8)]]
    slant = [(46 + 0.3 * i, 36 - 0.1 * i) for i in range(15)]
    got = {r.tracklet_id: r for r in movement.profiles(spark.createDataFrame([*track("down", down), *track("along", along), *track("turn", turn), *track("slant", slant)], ROW), ROOM, 30.0).collect()}
    flags = {t: (r.birth_crosses, r.death_crosses) for t, r in got.items()}
    assert flags["down"] == (False, True) or flags["down"] == (True, True)
    assert flags["along"] == (False, False) and flags["turn"] == (False, True) and flags["slant"][1] is False
    assert got["down"].death_edge == 0 and got["turn"].n_touches == 1 and got["along"].n_touches == 0


def test_no_rows(spark):
    assert movement.profiles(spark.createDataFrame([], ROW), ROOM, 30.0).count() == 0


def test_hulls_are_taken_once(spark):
    rows = spark.createDataFrame([("t", i, float(i % 7), float(i % 5)) for i in range(50)], ROW)
    got = movement.hull_areas(rows)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1  # not of each task's rows, a few a track, too
    assert [tuple(r) for r in got.collect()] == [("t", 24.0)]
