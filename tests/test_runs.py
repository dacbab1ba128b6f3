"""Metrics of runs with gaps, ranks of settings, bounds and clocks, case by case."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from motionspark.operators import runs


def test_metrics_of_a_run_with_gaps(spark):
    make = spark.createDataFrame
    frames = make([("a", "t1", True), ("a", "t1", False), ("a", "t2", None), ("b", "", None), ("b", None, None)], "camera_id string, tracklet_id string, on_mat boolean")
    persons = make([("a", "p"), ("a", "p"), ("a", None), ("z", "p")], "camera_id string, person_id string")
    assignments = make([("a", "1", 0.5), ("a", "1", None), ("a", None, 0.25)], "camera_id string, tag_id string, assignment_confidence double")
    identities = make([("g", "a"), ("g", "b"), ("g", "a"), ("h", "a"), ("", "a"), ("k", None)], "global_person_id string, camera_id string")
    matches = make([("a",), ("a",)], "camera_id string")
    audit = make([("cp17_pass2_evidence", 3), ("cp17_pass2_evidence", None), ("coordinate_conflict", None), ("coordinate_conflict", 5)], "event_type string, n long")
    got = {(r.camera_id, r.metric): r.value for r in runs.metrics(frames, persons, assignments, identities, matches, audit).collect()}
    want_a = {"on_mat_pct": 50.0, "tracklet_count": 2, "person_id_count": 1, "person_track_rows": 3, "identity_assignments": 3, "mean_confidence": 0.375, "unique_tags": 1, "matches": 2}
    whole = {"identity_assignments_total": 3, "mean_confidence_all": 0.375, "global_person_ids": 2, "linked_ids": 1, "standalone_ids": 1, "total_matches": 2, "tag_corroborated": 3, "coordinate_corroborated": 0, "coordinate_conflicts": 2}
    assert got == {("a", k): v for k, v in want_a.items()} | {("b", k): 0 for k in want_a} | {("", k): v for k, v in whole.items()}
    empty = {(r.camera_id, r.metric): r.value for r in runs.metrics(*(df.limit(0) for df in (frames, persons, assignments, identities, matches, audit))).collect()}
    assert empty == {("", k): 0 for k in whole}


def test_ranks_of_settings(spark):
    df = spark.createDataFrame([(1, True), (2, True), (3, False), (None, True), (4, None)], "v int, t boolean")
    settings = {"none": F.col("v") > 9, "most": F.col("v") > 0, "some": F.col("v") < 3, "also": F.col("v") < 3}
    got = [(r.setting, r.tp, r.fp, r.fn, r.precision, r.recall) for r in runs.ranked_sweep(df, settings, F.col("t")).orderBy("place").collect()]
    third = pytest.approx(2 / 3)
    assert got == [("also", 2, 0, 1, 1.0, third), ("some", 2, 0, 1, 1.0, third), ("most", 2, 2, 1, 0.5, third), ("none", 0, 0, 3, None, 0.0)]
    assert [r.recall for r in runs.ranked_sweep(df.limit(0), {"x": F.col("v") > 0}, F.col("t")).collect()] == [None]


def test_bounds(spark):
    spans = spark.createDataFrame([("a", 5, 9), ("a", 7, None), ("b", 3, None), ("c", None, 8)], "s string, start_frame long, end_frame long")
    tracks = spark.createDataFrame([("a", 2), ("a", 6), ("c", 4), ("d", None), ("e", 1)], "s string, frame_index long")
    got = {r.s: (r.first_frame, r.last_frame) for r in runs.frame_bounds(spans, tracks, ["s"]).collect()}
    assert got == {"a": (2, 9), "b": (0, 0), "c": (4, 8), "d": (0, 0), "e": (1, 1)}


def test_clocks_and_moves(spark):
    df = spark.createDataFrame([("t", 1, 1000, 0.0, 0.0), ("t", 2, 3000, 6.0, 8.0), ("t", 3, 3000, 7.0, 8.0), ("t", 4, 4000, None, 8.0), ("u", 1, 900, 0.0, 0.0), ("u", None, 7, 0.0, 0.0)], "k string, frame_index long, timestamp_ms long, x_m double, y_m double")
    assert {r.frame_index: r.timestamp_ms for r in runs.frame_clock(df, []).collect()} == {1: 900, 2: 3000, 3: 3000, 4: 4000}
    moves = runs.velocity(df.filter("k = 't'"), "k", "timestamp_ms").collect()
    assert sorted((r.timestamp_ms, r.speed) for r in moves if r.speed is not None) == [(3000, 5.0)]
    offset = lambda a, b, fps=25.0: spark.range(1).select(runs.clip_offset(F.lit(a).cast("long"), F.lit(b).cast("long"), fps).alias("o")).first().o
    assert (offset(2100, 0), offset(20, 0), offset(60, 0), offset(0, 5), offset(None, 0), offset(10, 0, 0.0)) == (52, 0, 2, 0, 0, 0)
