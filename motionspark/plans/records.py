"""Queries over JSON records, annotations and the tables of a stage: what is wrong with them, and manifests read apart."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records
from ..sources import io
from ..sources.views import FRAMES, frames, table
from .registry import query

@query(f"""WITH {FRAMES}, r AS (SELECT *, detection_id % 5 AS k FROM frames),
hint AS (SELECT * FROM r WHERE k = 0), tag AS (SELECT * FROM r WHERE k = 1), mat AS (SELECT * FROM r WHERE k = 2)
SELECT kind, rule, key FROM (
  SELECT 'identity_hint' AS kind, unnest([CASE WHEN detection_id % 13 = 0 THEN 'missing_pipeline_version' END, CASE WHEN confidence IS NULL THEN 'missing_confidence' END, CASE WHEN detection_id % 3 > 0 THEN 'clip_mismatch' END, CASE WHEN detection_id % 10 = 0 THEN 'empty_tracklet_id' END,
    CASE WHEN detection_id % 15 = 0 THEN 'anchor_without_namespace' END, CASE WHEN detection_id % 20 = 0 THEN 'unknown_constraint' END, CASE WHEN detection_id % 35 = 0 THEN 'evidence_no_object' END]) AS rule, detection_id::VARCHAR AS key FROM hint
  UNION ALL SELECT 'tag_observation', unnest([CASE WHEN detection_id % 13 = 0 THEN 'missing_pipeline_version' END, CASE WHEN x_m IS NULL THEN 'missing_confidence' END, CASE WHEN detection_id % 3 > 0 THEN 'clip_mismatch' END, CASE WHEN detection_id % 4 = 0 THEN 'tag_family_mismatch' END, CASE WHEN x_m > 300 THEN 'confidence_range' END]), detection_id::VARCHAR FROM tag
  UNION ALL SELECT 'match_session', unnest([CASE WHEN detection_id % 13 = 0 THEN 'missing_pipeline_version' END, CASE WHEN detection_id % 3 > 0 THEN 'clip_mismatch' END, CASE WHEN detection_id % 9 < 2 THEN 'end_before_start' END, CASE WHEN detection_id % 8 = 0 THEN 'partial_start_no_bool' END, CASE WHEN detection_id % 6 = 0 THEN 'sources_no_list' END]), detection_id::VARCHAR FROM mat
  UNION ALL SELECT '', CASE k WHEN 3 THEN 'unknown_kind' ELSE 'not_json' END, detection_id::VARCHAR FROM r WHERE k = 3 OR (k = 4 AND detection_id % 2 = 0)) WHERE rule IS NOT NULL""")
def record_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of three kinds with faults of all sorts, some of a kind that nobody knows, some that are no JSON, some blank."""
    i, s = F.col("detection_id"), lambda c: F.col(c).cast("string")
    f = frames(spark, sf_dir)
    base = [F.lit("1").alias("schema_version"), F.concat(F.lit("clip"), (i % 3).cast("string")).alias("clip_id"), F.col("camera_id"), F.when(i % 13 > 0, "v1").alias("pipeline_version"), F.lit(7).alias("created_at_ms")]
    ev = lambda bad, good: F.when(bad, F.lit("[1]")).otherwise(good)
    text = lambda kind, evidence, *cols: F.concat(F.substring_index(F.to_json(F.struct(F.lit(kind).alias("artifact_type"), *base, *cols)), "}", 1), evidence, F.lit("}"))
    hint = text("identity_hint", F.concat(F.lit(',"evidence":'), ev(i % 35 == 0, F.lit('{"a":{"b":1}}'))), F.when(i % 10 == 0, "").otherwise(F.col("tracklet_id")).alias("tracklet_id"), F.when(i % 15 == 0, "tag").otherwise(F.concat(F.lit("tag:"), s("user_id"))).alias("anchor_key"), F.when(i % 20 == 0, "may_link").otherwise("must_link").alias("constraint"), F.col("confidence"))
    tag = text("tag_observation", F.lit(""), "frame_index", F.lit(0).alias("timestamp_ms"), "detection_id", "tag_id", F.when(i % 4 == 0, "25h9").otherwise("36h11").alias("tag_family"), (F.col("x_m") / 300).alias("confidence"), F.lit("full").alias("roi_method"))
    sources = F.when(i % 6 == 0, F.lit('{"sources":"a"}')).otherwise(F.lit('{"sources":["a","b"]}'))
    flag = F.concat(F.lit(',"partial_start":'), F.when(i % 8 == 0, F.lit('"yes"')).otherwise(F.lit("true")), F.lit(',"evidence":'), sources)
    zero = [F.lit(0).alias(c) for c in ("start_ts_ms", "end_ts_ms")]
    match = text("match_session", flag, F.col("detection_id").alias("match_id"), F.col("user_id").alias("person_id_a"), F.col("user_id").alias("person_id_b"), F.col("frame_index").alias("start_frame"), (F.col("frame_index") + i % 9 - 2).alias("end_frame"), *zero, F.lit("x").alias("method"), F.lit(0.5).alias("confidence"))
    value = F.when(i % 5 == 0, hint).when(i % 5 == 1, tag).when(i % 5 == 2, match).when(i % 5 == 3, F.lit('{"artifact_type":"x"}')).when(i % 2 == 0, F.lit('{"artifact_type": ')).otherwise(F.lit("  "))
    return records.record_faults(f.select("detection_id", value.alias("value")), "detection_id", clip="clip0")


_POINTS = "[{'x': embedding[3 * i + 1]::DOUBLE * 100, 'y': embedding[3 * i + 2]::DOUBLE * 100, 'v': floor(abs(embedding[3 * i + 3]::DOUBLE) * 40)} FOR i IN range(17)]"


@query(f"""WITH a AS (SELECT vec_id AS annotation_id, label AS image_id, {_POINTS} AS k FROM embeddings), p AS (SELECT annotation_id, image_id, i, k[i + 1] AS p FROM a, (SELECT unnest(range(17)) AS i))
SELECT image_id, annotation_id, 'keypoint_outside_bbox' AS issue, 'error' AS severity, i AS keypoint FROM p WHERE p.v <> 0 AND (p.x < -14 OR p.x > 14 OR p.y < -21 OR p.y > 21)
UNION ALL SELECT l.image_id, l.annotation_id, 'skeleton_crossing', 'warning', l.i FROM p l JOIN p r ON r.annotation_id = l.annotation_id AND r.i = l.i + 1 WHERE l.i % 2 = 1 AND l.p.v > 0 AND r.p.v > 0 AND l.p.x > r.p.x
UNION ALL SELECT image_id, annotation_id, 'missing_keypoints', 'error', NULL FROM p WHERE i IN (5, 6, 11, 12) GROUP BY 1, 2 HAVING count(*) FILTER (p.v > 0) < 2""")
def annotation_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings read as keypoints: those outside their box, crossed ones, and bodies of which too little is seen."""
    e = lambda i: F.col("embedding")[i].cast("double")
    points = F.array(*(v for i in range(17) for v in (e(3 * i) * 100, e(3 * i + 1) * 100, F.floor(F.abs(e(3 * i + 2)) * 40).cast("double"))))
    box = F.array(*map(F.lit, (-10.0, -15.0, 20.0, 30.0)))
    return records.annotation_faults(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("annotation_id"), F.col("label").alias("image_id"), box.alias("bbox"), points.alias("keypoints"), F.lit(17).alias("num_keypoints")))


_STAGE = """d AS (SELECT 'k' AS clip_id, 'c' || (detection_id // 9000) AS camera_id, frame_index, CASE WHEN detection_id % 50 = 0 THEN '' ELSE 'd' || detection_id END AS detection_id, detection_id AS i, x_m AS x1, y_m AS y1, x_m + 10 - detection_id % 12 AS x2, y_m + 20 AS y2, confidence, CASE WHEN detection_id % 40 = 0 THEN '/m' ELSE 'm' END || detection_id AS mask_ref FROM frames),
tf AS (SELECT 'k' AS clip_id, 'c' || (detection_id // 9000) AS camera_id, tracklet_id, frame_index + (detection_id % 60 = 1)::INT AS frame_index, CASE WHEN detection_id % 50 = 0 THEN '' ELSE 'd' || detection_id END AS detection_id FROM frames),
ts AS (SELECT 'k' AS clip_id, 'c0' AS camera_id, tracklet_id, min(frame_index) AS start_frame, max(frame_index) - 300 AS end_frame, count(*) - 5 AS n_frames FROM frames WHERE user_id % 7 > 0 GROUP BY 3)"""


def _stage(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    f, i = frames(spark, sf_dir), F.col("detection_id")
    place = [F.lit("k").alias("clip_id"), F.concat(F.lit("c"), F.floor(i / 9000).cast("string")).alias("camera_id")]
    name = F.when(i % 50 == 0, "").otherwise(F.concat(F.lit("d"), i.cast("string"))).alias("detection_id")
    d = f.select(*place, "frame_index", name, F.col("x_m").alias("x1"), F.col("y_m").alias("y1"), (F.col("x_m") + 10 - i % 12).alias("x2"), (F.col("y_m") + 20).alias("y2"), "confidence", F.concat(F.when(i % 40 == 0, "/m").otherwise("m"), i.cast("string")).alias("mask_ref"))
    tf = f.select(*place, "tracklet_id", (F.col("frame_index") + (i % 60 == 1).cast("int")).alias("frame_index"), name)
    ts = f.filter("user_id % 7 > 0").groupBy("tracklet_id").agg(F.min("frame_index").alias("start_frame"), (F.max("frame_index") - 300).alias("end_frame"), (F.count("*") - 5).alias("n_frames")).select(F.lit("k").alias("clip_id"), F.lit("c0").alias("camera_id"), "*")
    return d, tf, ts


@query(f"""WITH {FRAMES}, {_STAGE}, cp AS (SELECT clip_id, camera_id, frame_index + (i % 70 = 2)::INT AS frame_index, detection_id, confidence * 1.02 AS cc FROM d WHERE i % 2 = 0)
SELECT 'detections' AS "table", unnest([CASE WHEN NOT coalesce(x2 >= x1, false) THEN 'x_order' END, CASE WHEN NOT coalesce(y2 >= y1, false) THEN 'y_order' END, CASE WHEN NOT coalesce(confidence BETWEEN 0 AND 1, true) THEN 'confidence_range' END, CASE WHEN detection_id = '' THEN 'id_empty' END, CASE WHEN mask_ref LIKE '/%' THEN 'path_absolute' END]) AS rule, detection_id AS key FROM d
UNION ALL SELECT 'tracklet_summaries', unnest([CASE WHEN end_frame < start_frame THEN 'span_order' END, CASE WHEN n_frames < 1 THEN 'no_frames' END]), tracklet_id FROM ts
UNION ALL SELECT DISTINCT 'tracklet_frames', 'no_summary', tracklet_id FROM tf WHERE tracklet_id NOT IN (SELECT tracklet_id FROM ts)
UNION ALL SELECT DISTINCT 'tracklet_frames', 'no_detection', concat_ws('/', clip_id, camera_id, frame_index, detection_id) FROM tf t WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.camera_id = t.camera_id AND d.frame_index = t.frame_index AND d.detection_id = t.detection_id)
UNION ALL SELECT 'contact_points', unnest([CASE WHEN NOT coalesce(cc BETWEEN 0 AND 1, true) THEN 'confidence_range' END, CASE WHEN detection_id = '' THEN 'id_empty' END]), detection_id FROM cp
UNION ALL SELECT DISTINCT 'contact_points', 'no_detection', concat_ws('/', clip_id, camera_id, frame_index, detection_id) FROM cp t WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.camera_id = t.camera_id AND d.frame_index = t.frame_index AND d.detection_id = t.detection_id)
UNION ALL SELECT 'detections', 'several_values', 'camera_id' FROM d HAVING count(DISTINCT camera_id) > 1 UNION ALL SELECT 'tracklet_frames', 'several_values', 'camera_id' FROM tf HAVING count(DISTINCT camera_id) > 1
UNION ALL SELECT 'contact_points', 'several_values', 'camera_id' FROM cp HAVING count(DISTINCT camera_id) > 1""".replace("SELECT 'detections' AS", "SELECT * FROM (SELECT 'detections' AS", 1) + ") WHERE rule IS NOT NULL")
def detection_stage_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first stage's tables together, with faults of every rule."""
    d, tf, ts = _stage(spark, sf_dir)
    number = F.substring("detection_id", 2, 20).try_cast("long")
    i = F.coalesce(number, F.substring(F.regexp_replace("mask_ref", "/", ""), 2, 20).try_cast("long"))
    cp = d.filter(i % 2 == 0).select("clip_id", "camera_id", (F.col("frame_index") + (i % 70 == 2).cast("int")).alias("frame_index"), "detection_id", (F.col("confidence") * 1.02).alias("contact_conf"))
    return records.detection_stage_faults(d, tf, ts, cp)


@query(f"""WITH {FRAMES}, {_STAGE}, pt AS (SELECT CASE WHEN i % 30 > 0 THEN d.clip_id END AS clip_id, d.camera_id, 'p' || (i % 17) AS person_id, CASE WHEN i % 45 = 0 THEN 'nobody' ELSE f.tracklet_id END AS tracklet_id, d.frame_index + (i % 80 = 3)::INT AS frame_index, d.detection_id, x1, y1, x2, y2 FROM d JOIN frames f ON f.detection_id = i)
SELECT * FROM (SELECT 'person_tracks' AS "table", unnest([CASE WHEN clip_id IS NULL THEN 'clip_null' END, CASE WHEN NOT coalesce(x2 >= x1, false) THEN 'x_order' END, CASE WHEN NOT coalesce(y2 >= y1, false) THEN 'y_order' END]) AS rule, person_id || '/' || frame_index AS key FROM pt
UNION ALL SELECT DISTINCT 'person_tracks', 'no_detection', concat_ws('/', clip_id, camera_id, frame_index, detection_id) FROM pt t WHERE clip_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d WHERE d.camera_id = t.camera_id AND d.frame_index = t.frame_index AND d.detection_id = t.detection_id)
UNION ALL SELECT DISTINCT 'person_tracks', 'no_tracklet', concat_ws('/', clip_id, camera_id, tracklet_id) FROM pt t WHERE clip_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tf WHERE tf.camera_id = t.camera_id AND tf.tracklet_id = t.tracklet_id)
UNION ALL SELECT 'person_tracks', 'several_values', 'camera_id' FROM pt HAVING count(DISTINCT camera_id) > 1) WHERE rule IS NOT NULL""")
def person_stage_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Person tracks made of detections, some without clip, some of no known track or at a frame too late."""
    d, tf, _ = _stage(spark, sf_dir)
    f = frames(spark, sf_dir).select(F.col("detection_id").alias("i"), "tracklet_id")
    i = F.col("i")
    pt = d.withColumn("i", F.regexp_extract("mask_ref", "[0-9]+", 0).cast("long")).join(f, "i").select(F.when(i % 30 > 0, F.col("clip_id")).alias("clip_id"), "camera_id", F.concat(F.lit("p"), (i % 17).cast("string")).alias("person_id"), F.when(i % 45 == 0, "nobody").otherwise(F.col("tracklet_id")).alias("tracklet_id"), (F.col("frame_index") + (i % 80 == 3).cast("int")).alias("frame_index"), "detection_id", "x1", "y1", "x2", "y2")
    return records.person_stage_faults(pt, d, tf)


@query("""SELECT 'e' || l_orderkey || '-' || l_linenumber AS export_id, 'cam' || (l_suppkey % 4) AS camera_id, CASE WHEN l_suppkey % 3 > 0 THEN 'g' || l_suppkey END AS gym_id, 'in/' || l_partkey AS input_video_path, 'out/' || l_orderkey AS local_output_path,
  CASE WHEN l_quantity < 45 THEN 'b' END AS storage_bucket, 'k/' || l_partkey AS storage_object_path, CASE WHEN l_tax > 0.04 THEN 'in/' || l_partkey || ',in/' || l_suppkey END AS sources, CASE WHEN l_discount > 0.05 THEN 2 ELSE 0 END AS n_events FROM lineitem WHERE l_returnflag <> 'A'""")
def manifest_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as export manifests, written as JSON lines and read back; a third says that there was no match."""
    s = lambda c: F.col(c).cast("string")
    put = lambda p, c: F.concat(F.lit(p), s(c))
    row = F.struct(F.when(F.col("l_quantity") < 45, "b").alias("storage_bucket"), put("k/", "l_partkey").alias("storage_object_path"), F.when(F.col("l_tax") > 0.04, F.array(put("in/", "l_partkey"), put("in/", "l_suppkey"))).alias("source_video_paths"), F.struct(put("out/", "l_orderkey").alias("local_output_path")).alias("metadata"))
    contract = F.struct(row.alias("clip_row"), F.when(F.col("l_discount") > 0.05, F.array(F.lit("a"), F.lit("b"))).alias("log_events"))
    li = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("e"), F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("export_id"), F.concat(F.lit("cam"), (F.col("l_suppkey") % 4).cast("string")).alias("camera_id"), F.when(F.col("l_suppkey") % 3 > 0, put("g", "l_suppkey")).alias("gym_id"), F.when(F.col("l_returnflag") == "A", "no_matches").alias("status"), F.struct(put("in/", "l_partkey").alias("input_video_path"), contract.alias("uploader_contract")).alias("inputs"))
    path = f"{io.shared_dir(spark)}/manifest-{uuid.uuid4().hex}"
    io.write_jsonl(li, path, compression="gzip")
    out = records.manifest_clips(spark.read.text(path))
    return out.select("export_id", "camera_id", "gym_id", "input_video_path", "local_output_path", "storage_bucket", "storage_object_path", F.array_join("source_video_paths", ",").alias("sources"), F.size("log_events").alias("n_events"))
