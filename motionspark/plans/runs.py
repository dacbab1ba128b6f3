"""Queries over runs: their metrics, how settings rank, the bounds and clocks of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import runs
from ..sources.views import BANK, FRAMES, bank, frames, table
from .registry import query

_RUN = """f AS (SELECT camera_id, tracklet_id, CASE WHEN detection_id % 6 > 0 THEN x_m > 80 END AS on_mat FROM frames),
p AS (SELECT camera_id, user_id % 30 AS person_id FROM frames WHERE camera_id <> 'c2'), a AS (SELECT camera_id, CASE WHEN detection_id % 5 > 0 THEN tag_id END AS tag_id, CASE WHEN detection_id % 4 > 0 THEN confidence END AS conf FROM frames WHERE detection_id % 3 = 0 AND camera_id <> 'c1'),
g AS (SELECT 'g' || (user_id % 97) AS gid, 'c' || (user_id % 2) AS camera_id FROM frames), m AS (SELECT camera_id FROM frames WHERE detection_id % 50 = 0),
e AS (SELECT CASE tag_id WHEN 'click' THEN 'cp17_pass2_evidence' WHEN 'view' THEN 'cp17_coordinate_evidence' WHEN 'error' THEN 'coordinate_conflict' ELSE 'other' END AS event, detection_id % 4 AS n FROM frames),
cams AS (SELECT DISTINCT camera_id AS k FROM f), gs AS (SELECT gid, count(DISTINCT camera_id) AS n FROM g GROUP BY 1)"""


@query(f"""WITH {FRAMES}, {_RUN} SELECT k AS camera_id, metric, value FROM (
  SELECT k, 'on_mat_pct' AS metric, coalesce((SELECT round(100.0 * avg(on_mat::INT), 2) FROM f WHERE camera_id = k), 0)::DOUBLE AS value FROM cams
  UNION ALL SELECT k, 'tracklet_count', (SELECT count(DISTINCT tracklet_id) FROM f WHERE camera_id = k) FROM cams
  UNION ALL SELECT k, 'person_id_count', (SELECT count(DISTINCT person_id) FROM p WHERE camera_id = k) FROM cams UNION ALL SELECT k, 'person_track_rows', (SELECT count(*) FROM p WHERE camera_id = k) FROM cams
  UNION ALL SELECT k, 'identity_assignments', (SELECT count(*) FROM a WHERE camera_id = k) FROM cams UNION ALL SELECT k, 'unique_tags', (SELECT count(DISTINCT tag_id) FROM a WHERE camera_id = k) FROM cams
  UNION ALL SELECT k, 'mean_confidence', coalesce((SELECT round(avg(conf), 4) FROM a WHERE camera_id = k), 0) FROM cams UNION ALL SELECT k, 'matches', (SELECT count(*) FROM m WHERE camera_id = k) FROM cams
  UNION ALL SELECT '', 'identity_assignments_total', (SELECT count(*) FROM a) UNION ALL SELECT '', 'mean_confidence_all', (SELECT round(avg(conf), 4) FROM a)
  UNION ALL SELECT '', 'global_person_ids', (SELECT count(*) FROM gs) UNION ALL SELECT '', 'linked_ids', (SELECT count(*) FROM gs WHERE n >= 2) UNION ALL SELECT '', 'standalone_ids', (SELECT count(*) FROM gs WHERE n = 1)
  UNION ALL SELECT '', 'total_matches', (SELECT count(*) FROM m) UNION ALL SELECT '', 'tag_corroborated', (SELECT sum(n) FROM e WHERE event = 'cp17_pass2_evidence')
  UNION ALL SELECT '', 'coordinate_corroborated', (SELECT sum(n) FROM e WHERE event = 'cp17_coordinate_evidence') UNION ALL SELECT '', 'coordinate_conflicts', (SELECT count(*) FROM e WHERE event = 'coordinate_conflict'))""")
def whole_run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of a run whose tables lack this or that camera."""
    f, i = frames(spark, sf_dir), F.col("detection_id")
    event = F.when(F.col("tag_id") == "click", "cp17_pass2_evidence").when(F.col("tag_id") == "view", "cp17_coordinate_evidence").when(F.col("tag_id") == "error", "coordinate_conflict").otherwise("other")
    return runs.metrics(
        f.select("camera_id", "tracklet_id", F.when(i % 6 > 0, F.col("x_m") > 80).alias("on_mat")),
        f.filter("camera_id <> 'c2'").select("camera_id", (F.col("user_id") % 30).alias("person_id")),
        f.filter("detection_id % 3 = 0 AND camera_id <> 'c1'").select("camera_id", F.when(i % 5 > 0, F.col("tag_id")).alias("tag_id"), F.when(i % 4 > 0, F.col("confidence")).alias("assignment_confidence")),
        f.select(F.concat(F.lit("g"), (F.col("user_id") % 97).cast("string")).alias("global_person_id"), F.concat(F.lit("c"), (F.col("user_id") % 2).cast("string")).alias("camera_id")),
        f.filter("detection_id % 50 = 0").select("camera_id"),
        f.select(event.alias("event_type"), (i % 4).alias("n")),
    )


@query(f"""WITH {FRAMES}, s AS (SELECT a, b, 'x' || a || 'y' || b AS setting FROM (SELECT unnest([50, 100, 200, 5000]) AS a), (SELECT unnest([20, 40, 80]) AS b)),
c AS (SELECT setting, count(*) FILTER (coalesce(x_m > a AND y_m > b, false) AND coalesce(confidence > 0.5, false)) AS tp, count(*) FILTER (coalesce(x_m > a AND y_m > b, false) AND NOT coalesce(confidence > 0.5, false)) AS fp,
  count(*) FILTER (NOT coalesce(x_m > a AND y_m > b, false) AND coalesce(confidence > 0.5, false)) AS fn FROM frames, s GROUP BY 1)
SELECT setting, tp, fp, fn, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, row_number() OVER (ORDER BY tp / nullif(tp + fn, 0) DESC NULLS LAST, tp / nullif(tp + fp, 0) DESC NULLS LAST, setting) AS place FROM c""")
def ranked_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve settings of two thresholds, ranked by how well they foretell confident rows."""
    settings = {f"x{a}y{b}": (F.col("x_m") > a) & (F.col("y_m") > b) for a in (50, 100, 200, 5000) for b in (20, 40, 80)}
    out = runs.ranked_sweep(frames(spark, sf_dir), settings, F.col("confidence") > 0.5)
    return out.withColumn("precision", F.round("precision", 9)).withColumn("recall", F.round("recall", 9))


@query("""WITH s AS (SELECT l_suppkey % 60 AS session, CASE WHEN l_suppkey % 60 % 7 > 0 THEN l_orderkey END AS a, CASE WHEN l_suppkey % 60 % 5 > 0 THEN l_orderkey + l_linenumber END AS b FROM lineitem), t AS (SELECT user_id % 80 AS session, CASE WHEN user_id % 80 % 14 > 0 THEN event_id END AS f FROM events),
u AS (SELECT session, min(a) AS lo, max(b) AS hi FROM s GROUP BY 1 UNION ALL SELECT session, min(f), max(f) FROM t GROUP BY 1)
SELECT session, CASE WHEN min(lo) IS NULL OR max(hi) IS NULL THEN 0 ELSE min(lo) END AS first_frame, CASE WHEN min(lo) IS NULL OR max(hi) IS NULL THEN 0 ELSE max(hi) END AS last_frame FROM u GROUP BY 1""")
def frame_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of sessions from two tables, each of which knows only some ends."""
    li, e = table(spark, sf_dir, "lineitem").withColumn("session", F.col("l_suppkey") % 60), table(spark, sf_dir, "events").withColumn("session", F.col("user_id") % 80)
    k = F.col("session")
    spans = li.select("session", F.when(k % 7 > 0, F.col("l_orderkey")).alias("start_frame"), F.when(k % 5 > 0, F.col("l_orderkey") + F.col("l_linenumber")).alias("end_frame"))
    return runs.frame_bounds(spans, e.select("session", F.when(k % 14 > 0, F.col("event_id")).alias("frame_index")), ["session"])


@query(f"""WITH {BANK}, r AS (SELECT *, frame_index * 500 - (detection_id % 3) * 200 AS ms, frame_index * 40 + user_id AS s0 FROM bank),
o AS (SELECT *, (ms - lag(ms) OVER w) / 1000.0 AS dt, x_m - lag(x_m) OVER w AS dx, y_m - lag(y_m) OVER w AS dy FROM r WINDOW w AS (PARTITION BY tracklet_id ORDER BY ms))
SELECT detection_id, round(CASE WHEN dt > 0 THEN dx / dt END, 6) AS vx, round(CASE WHEN dt > 0 THEN dy / dt END, 6) AS vy, round(CASE WHEN dt > 0 THEN sqrt(power(dx / dt, 2) + power(dy / dt, 2)) END, 6) AS speed,
  CASE WHEN ms - s0 * 10 >= 0 THEN round_even((ms - s0 * 10) / 1000.0 * 25.0, 0)::BIGINT ELSE 0 END AS clip_offset, min(ms) OVER (PARTITION BY camera_id, frame_index) AS frame_ms FROM o""")
def clocked_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Velocities by the clock, a clip's offset in frames, and the time of each row's frame."""
    r = bank(spark, sf_dir).withColumn("ms", F.col("frame_index") * 500 - F.col("detection_id") % 3 * 200).withColumn("offset", runs.clip_offset(F.col("ms"), (F.col("frame_index") * 40 + F.col("user_id")) * 10, 25.0))
    clock = runs.frame_clock(r.withColumn("timestamp_ms", F.col("ms")), ["camera_id"]).withColumnRenamed("timestamp_ms", "frame_ms")
    out = runs.velocity(r, "tracklet_id", "ms").join(clock, ["camera_id", "frame_index"])
    return out.select("detection_id", *(F.round(c, 6).alias(c) for c in ("vx", "vy", "speed")), F.col("offset").alias("clip_offset"), "frame_ms")
