"""Keyed joins, endpoints, triggers and grids on small tables: nulls, ties, repeated keys, empty tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from motionspark.operators import contracts, endpoints, keyed, lookup, triggers

ROWS = "tracklet_id string, frame_index long, x_m double, y_m double, on_mat boolean"
SPANS = "tracklet_id string, start_frame long, end_frame long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_endpoints_take_the_first_row_that_counts(spark):
    r = spark.createDataFrame([("a", 0, None, 1.0, True), ("a", 1, 2.0, 2.0, False), ("a", 2, 3.0, 3.0, None), ("a", 9, 4.0, 4.0, True), ("b", 0, float("nan"), 0.0, True)], ROWS)
    s = spark.createDataFrame([("a", 0, 9), ("b", 0, 0), ("c", 0, 5)], SPANS)
    assert rows(endpoints.endpoint(r, s, 3)) == [("a", 2, 3.0, 3.0), ("b", None, None, None), ("c", None, None, None)]
    assert rows(endpoints.endpoint(r, s, 3, False)) == [("a", 9, 4.0, 4.0), ("b", None, None, None), ("c", None, None, None)]
    assert rows(endpoints.on_mat_near(r, s, 0, True)) == [("a", True), ("b", True), ("c", False)]
    assert rows(endpoints.on_mat_near(r.filter("frame_index = 2"), s, 5, True)) == [("a", False), ("b", False), ("c", False)]
    assert endpoints.endpoint(r.limit(0), s.limit(0), 3).count() == 0


def test_crossings_need_enough_rows(spark):
    r = spark.createDataFrame([("in", f, float(d)) for f, d in enumerate((12, 18, 24))] + [("few", 0, 1.0), ("out", 0, 30.0), ("out", 1, 20.0), ("out", 2, 2.0)], "tracklet_id string, frame_index long, border_px double")
    s = spark.createDataFrame([("in", 0, 2), ("few", 0, 2), ("out", 0, 2)], SPANS)
    verdict = lambda **k: {x["tracklet_id"]: x["crosses"] for x in endpoints.crossings(r, s, 5, 10, 40, 10, 3, **k).collect()}
    assert verdict(at_start=True) == {"in": True, "few": False, "out": False}
    assert verdict(at_start=True, both=True) == {"in": False, "few": False, "out": False}
    assert verdict(at_start=False, both=True) == {"in": False, "few": False, "out": True}


def test_births_nearby_against_all_pairs(spark):
    starts = [(f"t{i}", (i * 7) % 23, float((i * 13) % 40), float((i * 5) % 30)) for i in range(60)] + [("none", 3, None, 1.0)]
    got = {r["tracklet_id"]: r["n_births"] for r in endpoints.births_nearby(spark.createDataFrame(starts, "tracklet_id string, frame_index long, x double, y double"), 4, 6.0).collect()}
    near = lambda a, b: a[0] != b[0] and None not in (a[2], b[2]) and abs(a[1] - b[1]) <= 4 and ((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) ** 0.5 <= 6
    assert got == {a[0]: sum(near(a, b) for b in starts) for a in starts}
    assert sum(got.values()) > 0


def test_overlap_fires_once_and_restarts(spark):
    together, apart = {0, 1, 2, 5, 6, 9}, {3, 8}  # nobody is seen at 4 and 7, so 5 follows 3 and 8 follows 6
    data = [(0, f, t, 0.0 if t == "a" or f in together else 50.0) for f in sorted(together | apart) for t in ("a", "b")]
    b = spark.createDataFrame(data, "clip int, frame_index long, tracklet_id string, x1 double").selectExpr("*", "0D AS y1", "x1 + 10 AS x2", "10D AS y2")
    assert [(r["frame_index"], r["a_id"], r["b_id"]) for r in triggers.sustained_overlap(b, ["clip"], 0.5, 2, 7.0).orderBy("frame_index").collect()] == [(1, "a", "b"), (6, "a", "b")]
    assert triggers.sustained_overlap(b.limit(0), ["clip"], 0.5, 2, 7.0).count() == 0
    with pytest.raises(ValueError):
        triggers.sustained_overlap(b, ["clip"], 0, 2, 7.0)


def test_motion_jumps_ask_for_one_unit_and_growing_time(spark):
    r = spark.createDataFrame([("a", 0, 0.0, 0.0), ("a", 1, 0.0, 0.0), ("a", 2, 5.0, 0.0), ("b", 0, 0.0, 0.0), ("b", 1, None, 0.0), ("b", 2, 5.0, 0.0)], "tracklet_id string, frame_index long, x_m double, y_m double")
    r = r.selectExpr("*", "0D AS x_px", "0D AS y_px")
    jumps = lambda s: triggers.motion_jumps(r, "tracklet_id", "frame_index", s, {"metric": 2, "pixel": 2}, {"metric": 9, "pixel": 9})
    assert [tuple(x) for x in jumps(F.col("frame_index")).collect()] == [("a", 2, "metric", 5.0, 5.0, True, False)]
    assert jumps(F.lit(1)).count() == 0


def test_keyed_joins_refuse_repeated_keys(spark):
    left = spark.createDataFrame([(1, "x"), (2, None), (None, "z")], "k int, v string")
    right = spark.createDataFrame([(1, None), (2, "h")], "k int, v string")
    assert rows(keyed.override(left, right, ["k"], ["v"])) == [(1, "x"), (2, "h"), (None, "z")]
    twice = right.unionByName(right)
    with pytest.raises(Exception, match="repeated key"):
        keyed.many_to_one(left, twice.withColumnRenamed("v", "w"), ["k"], ["w"]).collect()


def test_cheapest_other_with_ties_and_lone_edges(spark):
    e = spark.createDataFrame([("e1", "t", 2.0), ("e2", "t", 2.0), ("e3", "t", 5.0), ("lone", "u", 1.0)], "edge_id string, t string, cost double")
    got = {r["edge_id"]: (r["other_id"], r["other_cost"]) for r in keyed.cheapest_other(e, ["t"], "edge_id", "cost").collect()}
    assert got == {"e1": ("e2", 2.0), "e2": ("e1", 2.0), "e3": ("e1", 2.0), "lone": (None, None)}


def test_quiet_frames_count_empty_ones(spark):
    r = spark.createDataFrame([("c", f) for f in (0, 0, 1, 2, 2, 3, 6)], "clip string, frame_index long")
    totals = spark.createDataFrame([("c", 9), ("short", 1), ("none", 0)], "clip string, n_frames long")
    assert rows(keyed.quiet_frames(r, "clip", totals, 2)) == [("c", 0, 1, 1), ("c", 1, 0, 4), ("short", 0, 0, 0)]


def test_grids_find_the_shift(spark):
    shape = [(0, 0), (9, 9), (2, 5), (3, 1), (7, 4), (5, 5)]
    data = [("a", float(x), float(y)) for x, y in shape] + [("b", float(x + 100), float(y)) for x, y in shape] + [("far", 0.0, 0.0)]
    cells = keyed.occupancy(spark.createDataFrame(data, "cam string, x_m double, y_m double"), "cam", 1.0)
    got = {(r["cam_a"], r["cam_b"]): (r["score"], r["dx"], r["dy"], r["confidence"]) for r in keyed.align_grids(cells, "cam", 1.0, reach=100).collect()}
    assert got[("a", "b")] == (6, -100, 0, "low")
    assert got[("a", "far")][1:] == (None, None, "none")


def test_faults(spark):
    c = spark.createDataFrame([("e", True, "[]", 1.0), ("e", False, "[]", 1.0), (None, None, "x", float("nan"))], "edge_id string, is_allowed boolean, disallow_reasons_json string, total_cost double")
    assert [r for r, _ in rows(contracts.cost_faults(c))] == ["allowed_null", "edge_id_null", "edge_id_repeated", "forbidden_without_reason", "reasons_not_a_list", "total_not_finite"]


def test_audience_and_sources(spark):
    clips = spark.createDataFrame([("x", 1, 5, 5, None, None, "collision_flagged"), ("y", 1, 5, 6, 9, 9, "created"), ("z", None, 5, 6, None, None, None)], "clip_id string, gym_id int, a_tag int, b_tag int, a_profile int, b_profile int, status string")
    there = spark.createDataFrame([(1, 5, 40), (1, 5, 40), (2, 5, 41)], "gym_id int, tag_id int, profile_id int")
    assert rows(lookup.audience(clips, there)) == [("x", 40), ("y", 9)]
    src = spark.createDataFrame([("c", 2, "new"), ("c", 1, "old")], "clip string, position int, path string")
    got = lookup.source_ids(src, spark.createDataFrame([("old", "v1")], "path string, video_id string"), "clip").first()
    assert got["ids"][0] == "v1" and len(got["ids"][1]) == 16 and got["n_created"] == 1
