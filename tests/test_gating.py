"""Gates against plain versions, and the outcomes of votes case by case."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from motionspark.operators import gating, identity, preferences

COLUMNS = "id long, x1 long, y1 long, x2 long, y2 long, det_conf double, frame_w int, frame_h int, on_mat boolean, prior double, blur_var double, contrast_std double"


def plain_roi(x1, y1, x2, y2, w, h, pad):
    px, py = round(max(1, x2 - x1) * pad), round(max(1, y2 - y1) * pad)
    a, b, c, d = max(0, x1 - px), max(0, y1 - py), min(w - 1, x2 + px), min(h - 1, y2 + py)
    return a, b, c if c > a else min(w - 1, a + 1), d if d > b else min(h - 1, b + 1)


def plain_reason(r, pad=0.15):
    if r["det_conf"] is None or r["det_conf"] < 0.3:
        return "skip_det_conf_low"
    if r["x1"] is None:
        return "skip_roi_too_small"
    a, b, c, d = plain_roi(r["x1"], r["y1"], r["x2"], r["y2"], r["frame_w"], r["frame_h"], pad)
    w, h = max(1, c - a), max(1, d - b)
    if w < 10 or h < 10 or w * h < 200:
        return "skip_roi_too_small"
    if r["on_mat"] is False:
        return "skip_off_mat"
    if r["prior"] is not None and r["prior"] < 0.2:
        return "skip_low_prior"
    if r["blur_var"] is None or r["blur_var"] < 20:
        return "skip_blurry"
    return "skip_low_contrast" if r["contrast_std"] is None or r["contrast_std"] < 5 else "ok"


def test_the_first_failing_check_is_told(spark):
    rng = random.Random(3)
    maybe = lambda v: None if rng.random() < 0.08 else v
    rows = []
    for i in range(600):
        x, y = rng.randint(-20, 110), rng.randint(-20, 70)
        rows.append((i, maybe(x), y, x + rng.randint(-3, 40), y + rng.randint(-3, 30), maybe(rng.random()), 100, 60, maybe(rng.random() < 0.8), maybe(rng.random()), maybe(rng.random() * 100), maybe(rng.random() * 30)))
    df = spark.createDataFrame(rows, COLUMNS)
    out = gating.scannability(df, min_conf=0.3, min_side=10, min_area=200, require_on_mat=True, min_prior=0.2, min_blur=20.0, min_contrast=5.0).collect()
    names = [f.split()[0] for f in COLUMNS.split(", ")]
    plain = {r[0]: dict(zip(names, r, strict=True)) for r in rows}
    seen = set()
    for r in out:
        p = plain[r["id"]]
        assert r["reason"] == plain_reason(p), p
        assert r["scannable"] == (r["reason"] == "ok")
        seen.add(r["reason"])
        if r["reason"] == "skip_det_conf_low":
            assert tuple(r["roi"]) == (p["x1"], p["y1"], p["x2"], p["y2"]) and r["prior"] is None
        elif p["x1"] is None:
            assert r["roi"] is None and r["roi_area"] is None
        else:
            assert tuple(r["roi"]) == plain_roi(*(p[k] for k in ("x1", "y1", "x2", "y2")), 100, 60, 0.15)
        assert r["blur_var"] == (p["blur_var"] if r["reason"] in ("ok", "skip_blurry", "skip_low_contrast") else None)
        assert r["contrast_std"] == (p["contrast_std"] if r["reason"] in ("ok", "skip_low_contrast") else None)
    assert seen == {*gating.REASONS, "ok"}


def test_without_limits_everything_measured_passes(spark):
    df = spark.createDataFrame([(1, 5, 5, 6, 6, 0.0, 10, 10, False, 0.0, 0.0, 0.0)], COLUMNS)
    assert [r.reason for r in gating.scannability(df).collect()] == ["ok"]
    assert gating.scannability(df.limit(0)).count() == 0


def test_priors_come_from_the_nearest_node(spark):
    df = spark.createDataFrame([("a", 0, 0, 2, 2, 100, 60), ("a", 98, 58, 99, 59, 100, 60), ("a", 49, 0, 51, 2, 100, 60), ("b", 0, 0, 2, 2, 100, 60)], "camera_id string, x1 long, y1 long, x2 long, y2 long, frame_w int, frame_h int")
    grid = spark.createDataFrame([("a", 0, 0, -0.5), ("a", 2, 1, 1.5), ("a", 1, 0, 0.4)], "camera_id string, gx int, gy int, prior double")
    got = {(r.camera_id, r.x1): r.prior for r in gating.with_prior(df, grid, (3, 2), pad=0.0).collect()}
    assert got == {("a", 0): 0.0, ("a", 98): 1.0, ("a", 49): 0.4, ("b", 0): None}


def test_masks(spark):
    df = spark.createDataFrame([(50, (0.0, 0.0, 10.0, 10.0)), (0, (0.0, 0.0, 10.0, 10.0)), (5, (0.0, 0.0, 10.0, 10.0)), (165, (0.0, 0.0, 10.0, 10.0)), (220, (0.0, 0.0, 10.0, 10.0)), (50, None)], "a long, m struct<x1:double,y1:double,x2:double,y2:double>")
    box = F.struct(*(F.lit(float(v)).alias(k) for k, v in (("x1", 0), ("y1", 0), ("x2", 10), ("y2", 10))))
    got = [round(r.q, 6) for r in df.select(gating.mask_quality(F.col("a"), F.col("m"), box).alias("q")).collect()]
    assert got == [1.0, 0.0, 0.875, 0.875, 0.75, 0.0]
    gate = lambda c, q: spark.range(1).select(gating.mask_passes(F.lit(c).cast("double"), F.lit(q), 0.3, 0.5).alias("p")).first().p
    assert gate(0.3, 0.5) and not gate(0.29, 0.9) and not gate(0.9, 0.4) and not gate(None, 0.9)


def outcomes(spark, obs):
    rows = [(t, g, c, f, m) for t, g, c, f, m in obs]
    df = spark.createDataFrame(rows, "tracklet_id string, tag_id string, confidence double, frame_index long, roi_method string")
    return {r.tracklet_id: (r.event, r.top.tag_id, r.runner_up.tag_id if r.runner_up else None, r.lead) for r in identity.tag_events(identity.tag_votes(df, {"half": 0.5})).collect()}


def test_outcomes_of_votes(spark):
    got = outcomes(spark, [
        ("link", "1", 0.95, 1, None),
        ("weak single", "1", 0.8, 1, None),
        ("two", "1", 0.95, 1, None), ("two", "2", 0.9, 2, None),
        ("apart", "1", 0.95, 1, None), ("apart", "1", 0.9, 2, None), ("apart", "2", 0.95, 3, None),
        ("close", "1", 0.95, 1, None), ("close", "2", 0.85, 1, None),
        ("halved", "1", 0.95, 1, "half"), ("halved", "2", 0.95, 2, None),
        ("weak first", "3", 0.6, 1, None), ("weak first", "3", 0.6, 2, None), ("weak first", "1", 0.95, 1, None), ("weak first", "2", 0.95, 2, None),
        ("", "1", 0.95, 1, None), ("none", None, 0.95, 1, None), ("unread", "1", None, 1, None),
    ])
    assert got == {
        "link": (identity.LINKED, "1", None, None),
        "two": (identity.TWO_TAGS, "1", "2", 0.05),
        "apart": (identity.LINKED, "1", "2", 0.9),
        "close": (identity.NO_MARGIN, "1", "2", 0.1),
        "halved": (identity.LINKED, "2", "1", 0.475),
        "weak first": (identity.TWO_TAGS, "1", "2", 0.0),  # the first two that pass, though another weighs more
    }


def test_histograms_of_those_who_stand_alone(spark):
    rows = [("a", True, [1.0, 3.0], "x"), ("a", True, [0.5, 0.5], "y"), ("a", False, [9.0, 9.0], "x"), ("a", True, None, "x"), ("b", None, [1.0, 1.0], "x"), ("c", True, [0.0, 2.0], None)]
    df = spark.createDataFrame(rows, "p string, is_isolated boolean, hist array<double>, crop_method string")
    got = {r.p: (r.n_isolated_frames, r.crop_methods, [round(v, 6) for v in r.hist]) for r in identity.isolated_histograms(df, ["p"]).collect()}
    assert got == {"a": (2, '{"x":1,"y":1}', [0.3, 0.7]), "c": (1, '{"":1}', [0.0, 1.0])}


def test_ways_through_groups(spark):
    nodes = spark.createDataFrame([("A", "SINGLE"), ("B", "SINGLE"), ("C", "SINGLE"), ("G", "GROUP"), ("SOURCE", "SOURCE"), ("SINK", "SINK")], "node_id string, node_type string")
    edges = spark.createDataFrame([("e1", "MERGE", "A", "G"), ("e2", "CONTINUE", "B", "G"), ("e3", "SPLIT", "G", "C"), ("e4", "BIRTH", "SOURCE", "G"), ("e5", "CONTINUE", "G", "G"), ("e6", "SPLIT", "G", "gone"), ("e7", "CONTINUE", "A", "C")], "edge_id string, edge_type string, u string, v string")
    evidence = spark.createDataFrame([("A", "t1", "ping"), ("A", "t1", "hint"), ("A", "t1", "ping"), ("B", "t2", "ping"), ("C", "t1", "ping"), ("C", "t3", "ping"), ("gone", "t2", "ping"), ("G", "t1", "ping"), ("SOURCE", "t1", "ping"), (None, "t1", "ping")], "node_id string, tag_key string, source string")
    got = preferences.pair_preferences(nodes, edges, evidence).collect()
    assert [(r.pair_id, r.in_node_id, r.out_node_id, r.in_sources, r.out_sources) for r in got] == [("G|t1|e1|e3", "A", "C", ["hint", "ping"], ["ping"])]
