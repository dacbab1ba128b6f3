"""Validators of records, annotations and stages, case by case; manifests with what may be missing in them."""

from __future__ import annotations

import json

from motionspark.operators import records

BASE = {"schema_version": "1", "clip_id": "k", "camera_id": "c", "pipeline_version": "v", "created_at_ms": 1}
GOOD = {
    "identity_hint": {"tracklet_id": "t", "anchor_key": "tag:1", "constraint": "cannot_link", "confidence": 1, "evidence": {}},
    "tag_observation": {"frame_index": 1, "timestamp_ms": 1, "detection_id": "d", "tag_id": "1", "tag_family": "36h11", "confidence": 0, "roi_method": "x"},
    "identity_assignment": {"person_id": "p", "tag_id": "1", "assignment_confidence": 0.5, "evidence": None},
    "match_session": {"match_id": "m", "person_id_a": "a", "person_id_b": "b", "start_frame": 4, "end_frame": 4, "start_ts_ms": 0, "end_ts_ms": 0, "method": "x", "confidence": 0.5, "evidence": {"sources": []}, "partial_end": False},
    "export_manifest": {"export_id": "e", "match_id": "m", "output_video_path": "o", "crop_mode": "x", "privacy": "x", "inputs": {}},
}


def faults(spark, cases, **more):
    lines = [(i, c if c is None or isinstance(c, str) else json.dumps(c)) for i, c in enumerate(cases)]
    out = records.record_faults(spark.createDataFrame(lines, "id long, value string"), "id", **more).collect()
    return sorted((int(r.key), r.kind, r.rule) for r in out)


def record(kind, **changes):
    return {k: v for k, v in (BASE | {"artifact_type": kind} | GOOD[kind] | changes).items() if v != "gone"}


def test_records(spark):
    cases = [record(k, **({"evidence": "x"} if k == "identity_assignment" else {})) for k in GOOD]
    assert faults(spark, cases, clip="k") == []
    cases = [
        record("identity_hint", clip_id="other", anchor_key="tag", constraint="x", confidence=1.5, evidence=[1]),
        record("identity_hint", tracklet_id=" ", evidence=None, confidence="much"),
        record("tag_observation", tag_family="25h9", confidence=-0.1, tag_id=""),
        record("identity_assignment", person_id="gone", pipeline_version=None),
        record("match_session", end_frame=3, partial_start="no", evidence={"sources": {}}),
        record("match_session", start_frame="gone", evidence="text"),
        record("export_manifest", output_video_path="", inputs="gone"),
        {"artifact_type": "x"}, {}, "[1]", "{", "", "   ", None,
    ]
    assert faults(spark, cases, clip="k") == sorted([
        (0, "identity_hint", r) for r in ("clip_mismatch", "anchor_without_namespace", "unknown_constraint", "confidence_range", "evidence_no_object")] + [
        (1, "identity_hint", r) for r in ("empty_tracklet_id", "missing_evidence", "confidence_range")] + [
        (2, "tag_observation", r) for r in ("tag_family_mismatch", "confidence_range", "empty_tag_id")] + [
        (3, "identity_assignment", r) for r in ("missing_person_id", "missing_pipeline_version", "missing_evidence")] + [
        (4, "match_session", r) for r in ("end_before_start", "partial_start_no_bool", "sources_no_list")] + [
        (5, "match_session", "missing_start_frame")] + [
        (6, "export_manifest", r) for r in ("empty_output_video_path", "missing_inputs")] + [
        (7, "", "unknown_kind"), (8, "", "unknown_kind"), (9, "", "not_json"), (10, "", "not_json")])
    assert faults(spark, [record("tag_observation", tag_family="25h9")], family="25h9") == []


def test_annotations(spark):
    body = [v for i in range(17) for v in (float(i), 5.0, 2.0)]

    def changed(**points):
        k = list(body)
        for i, p in points.items():
            k[3 * int(i[1:]) : 3 * int(i[1:]) + 3] = p
        return k

    box = [0.0, 0.0, 20.0, 10.0]
    rows = [
        (1, 9, box, body, 17),
        (2, 9, box, changed(k0=[24.1, 5.0, 1.0], k3=[0.0, -2.1, 2.0], k7=[99.0, 99.0, 0.0]), 17),
        (3, 9, box, changed(k5=[8.0, 5.0, 2.0], k6=[7.0, 5.0, 1.0]), 17),
        (4, 9, box, changed(k5=[5.0, 5.0, 0.0], k6=[5.0, 5.0, 0.0], k11=[5.0, 5.0, 0.0]), 17),
        (5, 9, box, [], 3), (6, 9, box, [], 0), (7, 9, box, None, None), (8, 9, None, body, 17), (9, 9, box, body[:20], 6),
    ]
    df = spark.createDataFrame(rows, "annotation_id long, image_id long, bbox array<double>, keypoints array<double>, num_keypoints int")
    got = sorted((r.annotation_id, r.issue, r.severity, -1 if r.keypoint is None else r.keypoint) for r in records.annotation_faults(df).collect())
    assert got == [
        (2, "keypoint_outside_bbox", "error", 0), (2, "keypoint_outside_bbox", "error", 3), (3, "skeleton_crossing", "warning", 5),
        (4, "missing_keypoints", "error", -1), (5, "missing_keypoints", "error", -1), (9, "missing_keypoints", "error", -1),
    ]


def test_a_clean_stage_has_no_faults(spark):
    d = spark.createDataFrame([("k", "c", 1, "d1", 0.0, 0.0, 1.0, 1.0, 0.5, "m/1"), ("k", "c", 2, "d2", 0.0, 0.0, 1.0, 1.0, None, None)], "clip_id string, camera_id string, frame_index long, detection_id string, x1 double, y1 double, x2 double, y2 double, confidence double, mask_ref string")
    f = spark.createDataFrame([("k", "c", "t", 1, "d1"), ("k", "c", "t", 2, "d2")], "clip_id string, camera_id string, tracklet_id string, frame_index long, detection_id string")
    s = spark.createDataFrame([("k", "c", "t", 1, 2, 2)], "clip_id string, camera_id string, tracklet_id string, start_frame long, end_frame long, n_frames long")
    c = d.selectExpr("clip_id", "camera_id", "frame_index", "detection_id", "confidence AS contact_conf")
    p = f.join(d.drop("mask_ref", "confidence"), ["clip_id", "camera_id", "frame_index", "detection_id"]).selectExpr("*", "'p' AS person_id")
    assert records.detection_stage_faults(d, f, s, c).collect() == []
    assert [tuple(r) for r in records.detection_stage_faults(d, f, s, None).collect()] == [("contact_points", "table_missing", None)]
    assert records.person_stage_faults(p, d, f).collect() == []
    assert records.detection_stage_faults(d.limit(0), f.limit(0), s.limit(0), c.limit(0)).count() == 0
    gone = records.person_stage_faults(p, d.limit(0), f.limit(0)).collect()
    assert sorted(r.rule for r in gone) == ["no_detection", "no_detection", "no_tracklet"]


def test_manifests_with_gaps(spark):
    full = {"export_id": "e", "camera_id": "c", "inputs": {"input_video_path": "i", "uploader_contract": {"clip_row": {"storage_bucket": "b", "storage_object_path": "o", "metadata": {"local_output_path": "l"}}, "log_events": ["x"]}}}
    lines = [json.dumps(full), "", "  ", json.dumps({"export_id": "n", "status": "no_matches"}), json.dumps({"export_id": "f", "status": "ok"})]
    got = {r.export_id: (r.input_video_path, r.local_output_path, r.storage_bucket, r.log_events) for r in records.manifest_clips(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got == {"e": ("i", "l", "b", ["x"]), "f": (None, None, None, [])}
