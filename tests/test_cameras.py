"""Quantiles against numpy, agreement of cameras, their relations and boundary vectors against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from motionspark.operators import cameras as C
from motionspark.operators.quantiles import exact_quantiles
from pyspark.sql import functions as F


def test_quantiles_of_hot_and_small_groups(spark):
    rng = random.Random(5)
    rows = [("hot", float(rng.randint(0, 700))) for _ in range(3000)] + [(None, rng.random()) for _ in range(40)] + [("one", 2.5), ("two", 1.0), ("two", 2.0), ("none", None)]
    rows += [("same", 4.0)] * 500
    points = {"low": 0.05, "q": 0.5, "high": 0.95, "top": 1.0}
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", points).collect()}
    assert set(got) == {"hot", None, "one", "two", "same"}
    for k, r in got.items():
        values = [v for key, v in rows if key == k]
        assert r["n"] == len(values)
        for name, p in points.items():
            assert r[name] == pytest.approx(np.quantile(values, p))
    assert exact_quantiles(df.limit(0), ["k"], "v", points).count() == 0


def test_quantiles_with_weights(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 5.0, 1), ("a", 1.0, 2), ("a", 9.0, 0)], "k string, v double, c long")
    r = exact_quantiles(df, ["k"], "v", {"m": 0.5, "q": 0.9}, F.col("c")).first()
    values = [1.0] * 5 + [5.0]
    assert (r["n"], r["m"], r["q"]) == (6, 1.0, pytest.approx(np.quantile(values, 0.9)))


def test_agreement_of_cameras(spark):
    eye = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    flat = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0]  # sends everything to infinity
    cams = spark.createDataFrame([(c, flat if c == "d" else eye, 100, 50) for c in "abcd"], "camera_id string, h array<double>, width int, height int")
    edges = spark.createDataFrame([("e", 0.0, 0.0, 10.0, 0.0), ("f", 5.0, 5.0, 5.0, 5.0)], "edge string, x1 double, y1 double, x2 double, y2 double")
    points = [("a", "e", 1.0, 1.0), ("a", "e", 12.0, 0.0), ("a", "e", -1.0, 0.0), ("b", "e", 5.0, 3.0), ("b", "e", 5.0, 3.0), ("b", "f", 5.0, 9.0), ("c", "f", 5.0, 6.0), ("d", "e", 1.0, 1.0), ("a", "gone", 1.0, 1.0)]
    errors = C.edge_errors(spark.createDataFrame(points, "camera_id string, edge string, u double, v double"), cams, edges)
    assert sorted((r.camera_id, r.edge, r.error_m) for r in errors.collect()) == [("a", "e", 1.0), ("a", "e", 2.0), ("b", "e", 3.0), ("b", "e", 3.0), ("b", "f", 4.0), ("c", "f", 1.0)]
    got = {(r.camera_a, r.camera_b): (r.shared_edges, r.n_samples, r.mean_m, r.p95_m, r.max_m) for r in C.pair_agreement(errors).collect()}
    assert got == {("a", "b"): (1, 4, 2.25, 3.0, 3.0), ("a", "c"): (0, 0, None, None, None), ("b", "c"): (1, 0, None, None, None)}


def test_relations_of_cameras(spark):
    boxes = [("a", 0.0, 0.0, 10.0, 10.0), ("b", 8.5, 0.0, 30.0, 10.0), ("c", 9.5, 9.5, 40.0, 40.0), ("d", 11.0, 11.5, 12.0, 12.0), ("e", 200.0, 0.0, 210.0, 1.0)]
    got = {(r.camera_a, r.camera_b): r.relation for r in C.relations(spark.createDataFrame(boxes, "camera_id string, x_min double, y_min double, x_max double, y_max double")).collect()}
    assert got[("a", "b")] == "overlap" and got[("a", "c")] == "adjacent"  # a corner of a 400th of either
    assert got[("a", "d")] == "adjacent" and got[("a", "e")] == "separated" and got[("c", "d")] == "overlap" and len(got) == 10


def plain_vectors(rows, n, margin):
    tracks = {}
    for cam, t, f, x, y in sorted(r for r in rows if r[3] is not None and r[4] is not None):
        tracks.setdefault((cam, t), []).append((x, y))
    box = {}
    for (cam, _), p in tracks.items():
        box.setdefault(cam, []).extend(p)
    out = set()
    for (cam, t), p in tracks.items():
        if len(p) < n:
            continue
        xs, ys = [q[0] for q in box[cam]], [q[1] for q in box[cam]]
        for side, part, at in (("entry", p[:n], p[0]), ("exit", p[-n:], p[-1])):
            if min(abs(at[0] - min(xs)), abs(at[0] - max(xs)), abs(at[1] - min(ys)), abs(at[1] - max(ys))) < margin:
                dx, dy = part[-1][0] - part[0][0], part[-1][1] - part[0][1]
                m = math.hypot(dx, dy)
                out.add((cam, t, side, round(at[0], 6), round(at[1], 6), round(dx / m, 6) if m > 0.01 else 0.0, round(dy / m, 6) if m > 0.01 else 0.0))
    return out


def test_boundary_vectors(spark):
    rng = random.Random(11)
    rows = []
    for cam in "ab":
        for t in range(40):
            x, y = rng.uniform(0, 10), rng.uniform(0, 10)
            for f in range(rng.randint(1, 12)):
                still = t % 7 == 0
                rows.append((cam, f"t{t}", f * 2, None if rng.random() < 0.05 else x, y))
                x, y = (x, y) if still else (min(10.0, max(0.0, x + rng.uniform(-1, 1))), min(10.0, max(0.0, y + rng.uniform(-1, 1))))
    df = spark.createDataFrame(rows, "camera_id string, tracklet_id string, frame_index long, x_m double, y_m double")
    got = {(r.camera_id, r.tracklet_id, r.side, round(r.x, 6), round(r.y, 6), round(r.dir_x, 6), round(r.dir_y, 6)) for r in C.boundary_vectors(df, C.extents(df)).collect()}
    want = plain_vectors(rows, 5, 1.0)
    assert got == want and {w[2] for w in want} == {"entry", "exit"} and any(w[5:] == (0.0, 0.0) for w in want)


def test_scores_of_corrections(spark):
    square = [(0, 0), (10, 0), (10, 10), (0, 10)]
    rows = [("c", "line", 0.0, 2.0, 0.0, 0.0, 0.0, 10.0), ("c", "line", 3.0, 2.0, 0.0, 0.0, 0.0, 10.0), ("c", "inside", 12.0, 5.0, None, None, None, None), ("c", "inside", 5.0, 5.0, None, None, None, None), ("c", "outside", 9.0, 5.0, None, None, None, None), ("e", "outside", 20.0, 5.0, None, None, None, None), ("c", "inside", None, 5.0, None, None, None, None)]
    df = spark.createDataFrame(rows, "camera_id string, kind string, x_m double, y_m double, lx1 double, ly1 double, lx2 double, ly2 double")
    candidates = {"same": [[1, 0, 0], [0, 1, 0]], "left": [[1, 0, -3], [0, 1, 0]]}
    got = {(r.camera_id, r.candidate): (round(r.cost, 6), r.inside_share, r.line_m) for r in C.correction_scores(df, square, candidates, (2.0, 1.0, 0.5, 10.0), ["camera_id"]).collect()}
    assert got == {("c", "same"): (18.0 + 4.0 + 0.5, 0.5, 1.5), ("c", "left"): (18.0 + 0.0 + 0.5 * 16 + 90.0, 1.0, 1.5), ("e", "same"): (0.0, 0.0, 0.0), ("e", "left"): (90.0, 0.0, 0.0)}
