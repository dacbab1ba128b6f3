"""Fits against numpy, carried labels, zones and merged segments against plain loops."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionspark.functions import geometry
from motionspark.operators import fits

PAIR = "key string, x double, y double, u double, v double"


def test_least_squares_against_numpy(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for k in "abc":
        p = rng.normal(1000, 3, (50, 2))
        q = p @ rng.normal(size=(2, 2)) + rng.normal(size=2) + rng.normal(0, 0.1, (50, 2))
        want[k] = np.linalg.lstsq(np.c_[p, np.ones(50)], q, rcond=None)[0].T.ravel()
        rows += [(k, *map(float, (*a, *b))) for a, b in zip(p, q, strict=True)]
    rows += [("line", float(i), 2.0 * i, 1.0, 1.0) for i in range(9)] + [("two", 0.0, 0.0, 1.0, 1.0), ("two", 1.0, 0.0, 1.0, 2.0), ("a", None, 0.0, 0.0, 0.0)]
    got = {r.key: r for r in fits.fit_affine(spark.createDataFrame(rows, PAIR).repartition(6), ["key"]).collect()}
    for k in "abc":
        assert np.allclose([got[k][c] for c in fits.FIT], want[k], rtol=1e-6, atol=1e-4) and got[k].n == 50
    assert got["line"].a is None and got["two"].a is None


def test_robust_fit_finds_the_inliers_under_any_dealing(spark):
    rng = random.Random(2)
    rows = []
    for k, (a, b, c, d) in {"p": (2.0, 0.5, -1.0, 3.0), "q": (0.5, 0.0, 0.0, 0.5)}.items():
        for i in range(60):
            x, y = rng.random() * 20, rng.random() * 20
            off = (0.0, 0.0) if i % 3 else (rng.random() * 50, rng.random() * 50)
            rows.append((k, x, y, a * x + b * y + 7 + off[0], c * x + d * y - 4 + off[1]))
    results = []
    for n in (1, 5):
        rng.shuffle(rows)
        results.append({r.key: r for r in fits.robust_affine(spark.createDataFrame(rows, PAIR).repartition(n), ["key"], 40, 0.1).collect()})
    for k, want in {"p": (2.0, 0.5, 7.0, -1.0, 3.0, -4.0), "q": (0.5, 0.0, 7.0, 0.0, 0.5, -4.0)}.items():
        assert np.allclose([results[0][k][c] for c in fits.FIT], want, atol=1e-6) and results[0][k].n >= 40
        assert results[0][k].n == results[1][k].n
    assert fits.robust_affine(spark.createDataFrame(rows[:2], PAIR), ["key"], 10).count() == 0


H = [[0.02, 0.001, -3.0], [0.0005, 0.03, -2.0], [0.00001, 0.0002, 1.0]]


def test_world_and_pixel_and_back(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([(rng.random() * 1900, rng.random() * 1000) for _ in range(50)], "u double, v double")
    x, y = geometry.homography(H, F.col("u"), F.col("v"))
    back = rows.withColumn("x", x).withColumn("y", y)
    u, v = geometry.world_to_pixel(H, F.col("x"), F.col("y"))
    assert all(abs(r.u - r.u2) < 1e-6 and abs(r.v - r.v2) < 1e-6 for r in back.withColumn("u2", u).withColumn("v2", v).collect())
    far = spark.createDataFrame([(1e9, 0.0), (None, 1.0)], "x double, y double").select(geometry.world_to_pixel([[1, 0, 0], [0, 1, 0], [0, 0, 1]], F.col("x"), F.col("y"))[0].alias("u"))
    assert [r.u for r in far.collect()] == [None, None]


def test_undistortion_undoes_the_lens(spark):
    camera, lens = [[1200.0, 0, 960], [0, 1180.0, 540], [0, 0, 1]], [-0.2, 0.05, 0.001, -0.0005]
    rng, rows = random.Random(4), []
    for _ in range(60):
        x, y = rng.uniform(-0.6, 0.6), rng.uniform(-0.4, 0.4)
        r2 = x * x + y * y
        s = 1 + lens[0] * r2 + lens[1] * r2 * r2
        dx, dy = x * s + 2 * lens[2] * x * y + lens[3] * (r2 + 2 * x * x), y * s + lens[2] * (r2 + 2 * y * y) + 2 * lens[3] * x * y
        rows.append((dx * 1200 + 960, dy * 1180 + 540, x * 1200 + 960, y * 1180 + 540))
    got = spark.createDataFrame(rows, "u double, v double, wu double, wv double").withColumn("p", geometry.undistort(camera, lens, F.col("u"), F.col("v")))
    assert all(abs(r.p.u - r.wu) < 1e-6 and abs(r.p.v - r.wv) < 1e-6 for r in got.collect())


def test_zones_against_a_plain_version(spark):
    rng = random.Random(5)
    points = [(i, i % 9, i // 9) for i in range(81)]
    cameras = ["c0", "c1", "c2", "c3"]
    score = {(p, c): rng.choice([0.2, 0.6, 0.7, 0.75, 0.8, 0.9]) for p, *_ in points for c in cameras}
    for least in (None, 2, 3):
        cover = {k: v > 0.7 for k, v in score.items()}
        low = least if least is not None else min(2, min(sum(cover[p, c] for c in cameras) for p, *_ in points))
        zone = {}
        for c in cameras:
            first = {p: max(cameras, key=lambda k, p=p: (score[p, k], -cameras.index(k))) for p, *_ in points}
            core = {p for p, *_ in points if first[p] == c or (cover[p, c] and sum(cover[p, o] for o in cameras if o != c) < low)}
            at = {p: (x, y) for p, x, y in points}
            for p, *_ in points:
                zone[p, c] = p in core or (cover[p, c] and any(math.dist(at[p], at[q]) <= 1.5 for q in core))
        for p, *_ in points:
            n = sum(zone[p, c] and cover[p, c] for c in cameras)
            for c in cameras:
                if n < low and not zone[p, c] and cover[p, c]:
                    zone[p, c], n = True, n + 1
        rows = spark.createDataFrame([(p, float(x), float(y), c, score[p, c]) for p, x, y in points for c in cameras], "point long, x double, y double, camera string, score double")
        got = {(r.point, r.camera): r.in_zone for r in fits.coverage_zones(rows, least, buffer_m=1.5).collect()}
        assert got == zone
    assert fits.coverage_zones(rows.limit(0)).count() == 0


def plain_merge(segments, degrees=10.0, offset=20.0):
    out, used, info = [], set(), []
    for i, x1, y1, x2, y2 in segments:
        dx, dy = x2 - x1, y2 - y1
        n = math.hypot(dx, dy)
        if n >= 1e-6:
            info.append((i, (x1, y1, x2, y2), math.degrees(math.atan2(dy, dx)) % 180, ((x1 + x2) / 2 * -dy + (y1 + y2) / 2 * dx) / n, n))
    for k, a in enumerate(info):
        if a[0] in used:
            continue
        group = [a]
        for b in info[k + 1 :]:
            t = abs(a[2] - b[2])
            if b[0] not in used and min(t, 180 - t) < degrees and abs(a[3] - b[3]) < offset:
                group.append(b)
                used.add(b[0])
        m = max(group, key=lambda g: (g[4], -g[0]))
        x1, y1, x2, y2 = m[1]
        ux, uy = (x2 - x1) / m[4], (y2 - y1) / m[4]
        t = [(g[1][j] - x1) * ux + (g[1][j + 1] - y1) * uy for g in group for j in (0, 2)]
        ends = m[1] if len(group) == 1 else (x1 + min(t) * ux, y1 + min(t) * uy, x1 + max(t) * ux, y1 + max(t) * uy)
        out.append((a[0], len(group), *ends))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_segments_along_a_line(spark, seed):
    rng, rows = random.Random(seed), []
    for i in range(60):
        a, c, t = rng.choice([0, 3, 45, 88, 177, 92]) + rng.random() * 4, rng.choice([5, 60, 200]) + rng.random() * 10, rng.random() * 100
        ux, uy, n = math.cos(math.radians(a)), math.sin(math.radians(a)), rng.choice([0.0, 5.0 + rng.random(), 40.0 + rng.random()])
        x, y = -uy * c + ux * t, ux * c + uy * t
        rows.append((i, x, y, x + n * ux, y + n * uy))
    got = fits.merged_segments(spark.createDataFrame([*rows, (99, None, 0.0, 1.0, 1.0)], "id long, x1 double, y1 double, x2 double, y2 double")).collect()
    want = plain_merge(rows)
    assert sorted((r.id, r.n) for r in got) == sorted(w[:2] for w in want)
    held = {w[0]: w[2:] for w in want}
    assert all(np.allclose([r.x1, r.y1, r.x2, r.y2], held[r.id]) for r in got)
