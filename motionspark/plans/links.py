"""Queries over keyed joins, endpoints, triggers, grids, validators, and geometry and names as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.text import frame_ms, joined_id, node_tracklet, string_list
from ..operators import contracts, endpoints, keyed, lookup, triggers, windows
from ..sources.views import BANK, CLIPS, FRAMES, VIDEOS, bank, boxes, clips, frames, table, videos
from .registry import SQL, query
from .tracks import RUNS, run_tables

_SPANS = ", spans AS (SELECT tracklet_id, min(frame_index) AS start_frame, max(frame_index) AS end_frame FROM bank GROUP BY 1)"


def _spans(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tracklet_id").agg(F.min("frame_index").alias("start_frame"), F.max("frame_index").alias("end_frame"))


# keyed joins

_HINTS = ", hints AS (SELECT tracklet_id, min(tag_id) AS tag_id FROM frames WHERE confidence > 0.97 GROUP BY 1)"


@query(f"""WITH {FRAMES}{_HINTS}, base AS (SELECT tracklet_id, max(tag_id) AS tag_id, count(*) AS n_frames FROM frames GROUP BY 1)
SELECT b.tracklet_id, coalesce(h.tag_id, b.tag_id) AS tag_id, n_frames FROM base b LEFT JOIN hints h USING (tracklet_id)""")
def hint_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    base = f.groupBy("tracklet_id").agg(F.max("tag_id").alias("tag_id"), F.count("*").alias("n_frames"))
    return keyed.override(base, f.filter("confidence > 0.97").groupBy("tracklet_id").agg(F.min("tag_id").alias("tag_id")), ["tracklet_id"], ["tag_id"])


@query(f"""WITH {BANK} SELECT b.tracklet_id, b.frame_index, b.detection_id, f.y_m AS top, f.y_m + 20 AS bottom
FROM bank b LEFT JOIN frames f ON f.detection_id = b.detection_id AND f.tracklet_id = b.tracklet_id AND f.frame_index = b.frame_index AND f.camera_id = b.camera_id AND f.confidence > 0.05""")
def box_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track's rows with their detection's upper and lower edge, joined on four keys; detections of little confidence have none."""
    boxed = boxes(frames(spark, sf_dir).filter("confidence > 0.05")).withColumnsRenamed({"y1": "top", "y2": "bottom"})
    return keyed.many_to_one(bank(spark, sf_dir).select("tracklet_id", "frame_index", "detection_id", "camera_id"), boxed, ["detection_id", "tracklet_id", "frame_index", "camera_id"], ["top", "bottom"]).drop("camera_id")


@query(f"""WITH {FRAMES}, s AS (SELECT tracklet_id, min(frame_index) AS start_frame FROM frames GROUP BY 1)
SELECT s.tracklet_id, start_frame, detection_id, x_m, y_m FROM s JOIN frames f ON f.tracklet_id = s.tracklet_id AND f.frame_index = s.start_frame
QUALIFY row_number() OVER (PARTITION BY s.tracklet_id ORDER BY detection_id) = 1""")
def start_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    at = f.groupBy("tracklet_id").agg(F.min("frame_index").alias("start_frame")).join(f.withColumnRenamed("frame_index", "start_frame"), ["tracklet_id", "start_frame"])
    return keyed.first_by(at, ["tracklet_id", "start_frame"], [F.col("detection_id")], ["detection_id", "x_m", "y_m"])


@query(f"""WITH {FRAMES}, e AS (SELECT camera_id, tag_id, tracklet_id AS person_id, round(max(confidence), 2) AS confidence, count(*) AS n_tag_frames FROM frames WHERE confidence IS NOT NULL GROUP BY 1, 2, 3)
SELECT camera_id, tag_id, person_id, confidence, n_tag_frames FROM e QUALIFY row_number() OVER (PARTITION BY camera_id, tag_id ORDER BY confidence DESC, n_tag_frames DESC, person_id) = 1""")
def camera_tag_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One person for each tag of a camera: by confidence, then frames with the tag, then id."""
    e = frames(spark, sf_dir).dropna(subset=["confidence"]).groupBy("camera_id", "tag_id", F.col("tracklet_id").alias("person_id")).agg(F.round(F.max("confidence"), 2).alias("confidence"), F.count("*").alias("n_tag_frames"))
    return keyed.first_by(e, ["camera_id", "tag_id"], [-F.col("confidence"), -F.col("n_tag_frames"), F.col("person_id")], ["person_id", "confidence", "n_tag_frames"])


_LINKS = "links AS (SELECT l_partkey AS tag, l_discount::DOUBLE AS ratio, l_quantity::DOUBLE AS mean_m, l_orderkey * 10 + l_linenumber AS arrival, 'c' || (l_suppkey % 3) || '-c' || (3 + l_linenumber % 2) AS pair FROM lineitem)"


@query(f"""WITH {_LINKS}, b AS (SELECT tag, ratio, mean_m FROM links QUALIFY row_number() OVER (PARTITION BY tag ORDER BY ratio DESC, arrival) = 1),
p AS (SELECT tag, string_agg(pair, ',' ORDER BY pair) AS pairs FROM (SELECT DISTINCT tag, pair FROM links) GROUP BY 1)
SELECT tag, ratio, mean_m, pairs FROM b JOIN p USING (tag)""")
def best_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    pair = F.concat(F.lit("c"), (F.col("l_suppkey") % 3).cast("string"), F.lit("-c"), (3 + F.col("l_linenumber") % 2).cast("string"))
    links = li.select(F.col("l_partkey").alias("tag"), F.col("l_discount").cast("double").alias("ratio"), F.col("l_quantity").cast("double").alias("mean_m"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("arrival"), pair.alias("pair"))
    return keyed.best_metrics(links, "tag", "ratio", "arrival", ["mean_m"], F.col("pair")).withColumn("pairs", F.array_join("pairs", ","))


_EDGES = "edges AS (SELECT l_orderkey || '-' || l_linenumber AS edge_id, l_suppkey AS tracklet, l_returnflag AS kind, l_extendedprice::DOUBLE AS cost FROM lineitem)"


@query(f"""WITH {_EDGES}, b AS (SELECT tracklet, kind, min(struct_pack(c := cost, e := edge_id)) AS a FROM edges GROUP BY 1, 2),
s AS (SELECT tracklet, kind, min(struct_pack(c := cost, e := edge_id)) AS z FROM edges JOIN b USING (tracklet, kind) WHERE edge_id <> a.e GROUP BY 1, 2)
SELECT edge_id, tracklet, kind, cost, CASE WHEN edge_id = a.e THEN z.e ELSE a.e END AS other_id, CASE WHEN edge_id = a.e THEN z.c ELSE a.c END AS other_cost FROM edges JOIN b USING (tracklet, kind) LEFT JOIN s USING (tracklet, kind)""")
def best_alternative(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("edge_id"), F.col("l_suppkey").alias("tracklet"), F.col("l_returnflag").alias("kind"), F.col("l_extendedprice").cast("double").alias("cost"))
    return keyed.cheapest_other(edges, ["tracklet", "kind"], "edge_id", "cost")


@query("""SELECT l_orderkey || '-' || l_linenumber AS edge_id, round(l_extendedprice / 7000, 6) AS cost, round_even(l_extendedprice / 7000 * 1000, 0)::BIGINT AS cost_int,
  o_orderstatus AS status, p_partkey IS NOT NULL AND p_partkey % 2 = 0 AS selected, s_nationkey AS node
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey""")
def cost_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs with their edge, whether it was selected, and its node; whole costs are rounded half to even."""
    t = lambda n: table(spark, sf_dir, n)
    star = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey"), "left").join(t("part"), F.col("p_partkey") == F.col("l_partkey"), "left").join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"), "left")
    cost = F.col("l_extendedprice") / 7000
    return star.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("edge_id"), F.round(cost, 6).alias("cost"), F.bround(cost * 1000).cast("long").alias("cost_int"), F.col("o_orderstatus").alias("status"), F.coalesce(F.col("p_partkey") % 2 == 0, F.lit(False)).alias("selected"), F.col("s_nationkey").alias("node"))


@query("""WITH t AS (SELECT l_returnflag AS class, unnest(['distance', 'gap', 'tax']) AS term, unnest([l_extendedprice::DOUBLE, l_quantity::DOUBLE, l_tax::DOUBLE]) AS v FROM lineitem)
SELECT term, round(avg(v) FILTER (class = 'A'), 4) AS good, round(avg(v) FILTER (class = 'R'), 4) AS bad FROM t GROUP BY term""")
def mean_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cost terms of good and bad edges, a row a term."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", *(F.col(c).cast("double").alias(n) for c, n in (("l_extendedprice", "distance"), ("l_quantity", "gap"), ("l_tax", "tax"))))
    long = li.unpivot("l_returnflag", ["distance", "gap", "tax"], "term", "v")
    of = lambda k, n: F.round(F.avg(F.when(F.col("l_returnflag") == k, F.col("v"))), 4).alias(n)
    return long.groupBy("term").agg(of("A", "good"), of("R", "bad"))


# endpoints

_EFF = ", eff AS (SELECT *, CASE WHEN x_m > 250 THEN NULL ELSE x_m > 20 END AS on_mat FROM bank)"


def _eff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank(spark, sf_dir).withColumn("on_mat", F.when(F.col("x_m") > 250, None).otherwise(F.col("x_m") > 20))


@query(f"""WITH {BANK}{_SPANS}{_EFF}, g AS (SELECT e.*, start_frame, end_frame FROM eff e JOIN spans USING (tracklet_id) WHERE coalesce(on_mat, true) AND x_m IS NOT NULL AND y_m IS NOT NULL),
a AS (SELECT tracklet_id, frame_index AS f0, x_m AS x0, y_m AS y0 FROM g WHERE frame_index <= start_frame + 12 QUALIFY row_number() OVER (PARTITION BY tracklet_id ORDER BY frame_index) = 1),
z AS (SELECT tracklet_id, frame_index AS f1, x_m AS x1, y_m AS y1 FROM g WHERE frame_index >= end_frame - 12 QUALIFY row_number() OVER (PARTITION BY tracklet_id ORDER BY frame_index DESC) = 1)
SELECT s.tracklet_id, f0, x0, y0, f1, x1, y1 FROM spans s LEFT JOIN a USING (tracklet_id) LEFT JOIN z USING (tracklet_id)""")
def track_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _eff(spark, sf_dir)
    s = _spans(rows)
    return endpoints.endpoint(rows, s, 12).toDF("tracklet_id", "f0", "x0", "y0").join(endpoints.endpoint(rows, s, 12, False).toDF("tracklet_id", "f1", "x1", "y1"), "tracklet_id")


@query(f"""WITH {BANK}{_SPANS}{_EFF}
SELECT s.tracklet_id, coalesce(bool_or(coalesce(on_mat, false)) FILTER (frame_index <= start_frame + 8), false) AS start_ok, coalesce(bool_or(coalesce(on_mat, false)) FILTER (frame_index >= end_frame - 8), false) AS end_ok
FROM spans s LEFT JOIN eff USING (tracklet_id) GROUP BY 1""")
def boundary_on_mat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _eff(spark, sf_dir)
    s = _spans(rows)
    return endpoints.on_mat_near(rows, s, 8, True).withColumnRenamed("ok", "start_ok").join(endpoints.on_mat_near(rows, s, 8, False).withColumnRenamed("ok", "end_ok"), "tracklet_id")


_SAMPLES = ", d AS (SELECT tracklet_id, frame_index, start_frame, end_frame, greatest(0.0, least(x_m, y_m, 500.0 - x_m, 100.0 - y_m)) AS b FROM bank JOIN spans USING (tracklet_id) WHERE x_m IS NOT NULL AND y_m IS NOT NULL)"


@query(f"""WITH {BANK}{_SPANS}{_SAMPLES}, i AS (SELECT tracklet_id, count(*) AS n, arg_min(b, frame_index) AS a, arg_max(b, frame_index) AS z FROM d WHERE frame_index < start_frame + 48 GROUP BY 1),
o AS (SELECT tracklet_id, count(*) AS n, arg_min(b, frame_index) AS a, arg_max(b, frame_index) AS z FROM d WHERE frame_index > end_frame - 48 GROUP BY 1)
SELECT s.tracklet_id, coalesce(i.n >= 3 AND (i.a <= 5 OR (i.a <= 15 AND i.z - i.a >= 10)), false) AS enters, coalesce(o.n >= 3 AND o.z <= 15 AND o.a <= 35 AND o.a - o.z >= 5, false) AS leaves
FROM spans s LEFT JOIN i USING (tracklet_id) LEFT JOIN o USING (tracklet_id)""")
def border_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who enters by either sign, and who leaves by both."""
    rows = bank(spark, sf_dir)
    s = _spans(rows)
    rows = rows.withColumn("border_px", endpoints.border(F.col("x_m"), F.col("y_m"), 500.0, 100.0))
    enter = endpoints.crossings(rows, s, 48, 5, 15, 10, 3, True).select("tracklet_id", F.col("crosses").alias("enters"))
    return enter.join(endpoints.crossings(rows, s, 48, 15, 35, 5, 3, False, both=True).select("tracklet_id", F.col("crosses").alias("leaves")), "tracklet_id")


@query(f"""WITH {RUNS}, p AS (SELECT * FROM run_starts WHERE x IS NOT NULL AND y IS NOT NULL),
m AS (SELECT a.run_id, count(*) AS n FROM p a JOIN p b ON a.run_id <> b.run_id AND abs(a.frame_index - b.frame_index) <= 5 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 30 GROUP BY 1)
SELECT s.run_id AS tracklet_id, coalesce(n, 0) AS n_births FROM run_starts s LEFT JOIN m USING (run_id)""")
def nearby_births(spark: SparkSession, sf_dir: str) -> DataFrame:
    return endpoints.births_nearby(run_tables(spark, sf_dir)[2], 5, 30.0)


@query("""WITH s AS (SELECT l_partkey AS d, l_suppkey AS n, l_linenumber::BIGINT AS start_frame, (l_linenumber + l_quantity)::BIGINT AS end_frame, l_orderkey AS carrier_id FROM lineitem),
w AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY d, n ORDER BY start_frame, end_frame, carrier_id) = 1), p AS (SELECT p_partkey AS d, p_partkey % 10 + 1 AS n FROM part)
SELECT d, n, start_frame, end_frame, carrier_id FROM p LEFT JOIN w USING (d, n)""")
def shadow_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("d"), F.col("l_suppkey").alias("n"), F.col("l_linenumber").cast("long").alias("start_frame"), (F.col("l_linenumber") + F.col("l_quantity")).cast("long").alias("end_frame"), F.col("l_orderkey").alias("carrier_id"))
    return endpoints.witnesses(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("d"), (F.col("p_partkey") % 10 + 1).alias("n")), s, "d", "n")


@query(f"WITH {RUNS}, c AS (SELECT split_part(run_id, ':', 1) AS track, run_id AS src, lead(run_id) OVER (PARTITION BY split_part(run_id, ':', 1) ORDER BY start_frame) AS dst FROM run_spans) SELECT track, src, dst FROM c WHERE dst IS NOT NULL")
def run_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = run_tables(spark, sf_dir)[1].withColumn("track", F.substring_index("tracklet_id", ":", 1))
    return windows.chain_edges(s, "track", "start_frame", "tracklet_id")


# triggers

@query(f"""WITH {BANK}, n AS (SELECT camera_id, frame_index, row_number() OVER (PARTITION BY camera_id ORDER BY frame_index) AS n FROM (SELECT DISTINCT camera_id, frame_index FROM bank)),
b AS (SELECT camera_id, frame_index, n, tracklet_id AS id, x_m AS x1, y_m AS y1, x_m + 200 AS x2, y_m + 90 AS y2 FROM bank JOIN n USING (camera_id, frame_index)),
c AS (SELECT a.camera_id, a.frame_index, a.n, a.id AS a_id, b.id AS b_id, greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i,
  (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS u FROM b a JOIN b ON a.camera_id = b.camera_id AND a.frame_index = b.frame_index AND a.id < b.id),
o AS (SELECT *, i / (u - i) AS iou FROM c WHERE i / (u - i) >= 0.2),
r AS (SELECT *, n - row_number() OVER (PARTITION BY camera_id, a_id, b_id ORDER BY n) AS run FROM o)
SELECT camera_id, frame_index, a_id, b_id, round(iou, 9) AS iou FROM r QUALIFY row_number() OVER (PARTITION BY camera_id, a_id, b_id, run ORDER BY n) = 2""")
def overlap_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bank(spark, sf_dir).select("camera_id", "frame_index", "tracklet_id", F.col("x_m").alias("x1"), F.col("y_m").alias("y1"), (F.col("x_m") + 200).alias("x2"), (F.col("y_m") + 90).alias("y2"))
    return triggers.sustained_overlap(b, ["camera_id"], 0.2, 2, 100.0).withColumn("iou", F.round("iou", 9))


@query(f"""WITH {BANK}, p AS (SELECT tracklet_id, frame_index, frame_index * 3600.0 AS t, x_m > 30 AS m, CASE WHEN x_m > 30 THEN x_m ELSE y_m * 2 END AS x, CASE WHEN x_m > 30 THEN y_m ELSE y_m * 3 END AS y FROM bank),
l AS (SELECT *, lag(t) OVER w AS t1, lag(x) OVER w AS x1, lag(y) OVER w AS y1, lag(m) OVER w AS m1, lag(t, 2) OVER w AS t0, lag(x, 2) OVER w AS x0, lag(y, 2) OVER w AS y0, lag(m, 2) OVER w AS m0 FROM p WINDOW w AS (PARTITION BY tracklet_id ORDER BY frame_index)),
v AS (SELECT *, (x - x1) / (t - t1) - (x1 - x0) / (t1 - t0) AS vx, (y - y1) / (t - t1) - (y1 - y0) / (t1 - t0) AS vy FROM l WHERE m = m1 AND m1 = m0),
j AS (SELECT *, sqrt(vx * vx + vy * vy) AS dv, sqrt(vx * vx + vy * vy) / (t - t1) AS accel FROM v),
f AS (SELECT tracklet_id, frame_index, CASE WHEN m THEN 'metric' ELSE 'pixel' END AS units, dv, accel, dv >= CASE WHEN m THEN 0.01 ELSE 0.005 END AS vel_jump, accel >= CASE WHEN m THEN 0.000005 ELSE 0.000001 END AS accel_jump FROM j)
SELECT * FROM f WHERE vel_jump OR accel_jump""")
def motion_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bank(spark, sf_dir).select("tracklet_id", "frame_index", F.when(F.col("x_m") > 30, F.col("x_m")).alias("x_m"), "y_m", (F.col("y_m") * 2).alias("x_px"), (F.col("y_m") * 3).alias("y_px"))
    return triggers.motion_jumps(b, "tracklet_id", "frame_index", F.col("frame_index") * 3600.0, {"metric": 0.01, "pixel": 0.005}, {"metric": 0.000005, "pixel": 0.000001})


# grids and quiet frames

@query(f"""WITH {BANK}, c AS (SELECT camera_id, frame_index, count(*) AS n FROM bank GROUP BY 1, 2), t AS (SELECT camera_id, max(frame_index) + 1 AS total FROM bank GROUP BY 1),
f AS (SELECT camera_id, unnest(range(total)) AS frame_index, greatest(1, total // 10) AS size FROM t)
SELECT f.camera_id, f.frame_index // size AS segment, coalesce(n, 0) AS n_rows, f.frame_index FROM f LEFT JOIN c USING (camera_id, frame_index) WHERE f.frame_index // size < 10
QUALIFY row_number() OVER (PARTITION BY f.camera_id, f.frame_index // size ORDER BY coalesce(n, 0), f.frame_index) = 1""")
def quiet_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bank(spark, sf_dir)
    return keyed.quiet_frames(b, "camera_id", b.groupBy("camera_id").agg((F.max("frame_index") + 1).alias("n_frames")), 10)


_CELLS = """, box AS (SELECT camera_id, min(x_m) AS x0, min(y_m) AS y0, max(x_m) AS x9, max(y_m) AS y9 FROM seen GROUP BY 1),
cells AS (SELECT DISTINCT camera_id, x0, y0, least(floor((x_m - x0) / 10), greatest(1, ceil((x9 - x0) / 10)) - 1)::BIGINT AS cx, least(floor((y_m - y0) / 10), greatest(1, ceil((y9 - y0) / 10)) - 1)::BIGINT AS cy FROM seen JOIN box USING (camera_id))"""
_SEEN = ", seen AS (SELECT camera_id, x_m, y_m FROM frames WHERE x_m IS NOT NULL AND y_m IS NOT NULL)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.occupancy(frames(spark, sf_dir), "camera_id", 10.0)


@query(f"WITH {FRAMES}{_SEEN}{_CELLS} SELECT camera_id, x0, y0, cx, cy FROM cells")
def occupied_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir)


@query(f"""WITH {FRAMES}{_SEEN}{_CELLS}, s AS (SELECT unnest(range(-10, 11)) AS d),
m AS (SELECT a.camera_id AS cam_a, b.camera_id AS cam_b, dy.d AS dy, dx.d AS dx, count(*) AS score FROM cells a JOIN cells b ON a.camera_id < b.camera_id, s dx, s dy
  WHERE a.cx = b.cx + round_even((b.x0 - a.x0) / 10, 0)::BIGINT + dx.d AND a.cy = b.cy + round_even((b.y0 - a.y0) / 10, 0)::BIGINT + dy.d GROUP BY 1, 2, 3, 4)
SELECT cam_a, cam_b, score, dx, dy, CASE WHEN score >= 20 THEN 'high' WHEN score >= 10 THEN 'medium' ELSE 'low' END AS confidence FROM m QUALIFY row_number() OVER (PARTITION BY cam_a, cam_b ORDER BY score DESC, dy, dx) = 1""")
def grid_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.align_grids(_cells(spark, sf_dir), "camera_id", 10.0)


# validators

@query("""SELECT event_id, 'c' || (user_id % 3) AS camera_id FROM (SELECT *, lag(value) OVER w AS v0, lag(user_id) OVER w AS u0 FROM events WINDOW w AS (PARTITION BY user_id % 3 ORDER BY event_id))
WHERE value < v0 OR (value = v0 AND user_id < u0)""")
def unsorted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "value", "user_id", F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("camera_id"))
    return contracts.unsorted(e, "camera_id", ["value", "user_id"], "event_id").select("event_id", "camera_id")


_COSTS = """costs AS (SELECT CASE WHEN l_quantity > 49 THEN NULL ELSE l_orderkey || '-' || (l_linenumber % 5) END AS edge_id, CASE WHEN l_quantity < 2 THEN NULL ELSE l_returnflag <> 'R' END AS is_allowed,
  CASE WHEN l_tax > 0.07 THEN 'no list' WHEN l_tax > 0.06 THEN '{"a": 1}' WHEN l_tax > 0.04 THEN '[]' ELSE '["gap"]' END AS reasons, CASE WHEN l_discount > 0.09 THEN NULL WHEN l_discount > 0.08 THEN 'inf'::DOUBLE ELSE l_extendedprice::DOUBLE END AS total FROM lineitem)"""


@query(f"""WITH {_COSTS}, n AS (SELECT *, CASE WHEN json_valid(reasons) AND json_type(CASE WHEN json_valid(reasons) THEN reasons END) = 'ARRAY' THEN json_array_length(CASE WHEN json_valid(reasons) THEN reasons END) END AS k FROM costs)
SELECT 'edge_id_null' AS rule, edge_id AS key FROM n WHERE edge_id IS NULL UNION ALL SELECT 'allowed_null', edge_id FROM n WHERE is_allowed IS NULL UNION ALL SELECT 'reasons_not_a_list', edge_id FROM n WHERE k IS NULL
UNION ALL SELECT 'forbidden_without_reason', edge_id FROM n WHERE NOT is_allowed AND k = 0 UNION ALL SELECT 'total_not_finite', edge_id FROM n WHERE total IS NULL OR isinf(total)
UNION ALL SELECT 'edge_id_repeated', edge_id FROM n WHERE edge_id IS NOT NULL GROUP BY edge_id HAVING count(*) > 1""")
def edge_cost_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_quantity") <= 49, F.concat_ws("-", "l_orderkey", (F.col("l_linenumber") % 5).cast("string"))).alias("edge_id"),
        F.when(F.col("l_quantity") >= 2, F.col("l_returnflag") != "R").alias("is_allowed"),
        F.when(F.col("l_tax") > 0.07, "no list").when(F.col("l_tax") > 0.06, '{"a": 1}').when(F.col("l_tax") > 0.04, "[]").otherwise('["gap"]').alias("disallow_reasons_json"),
        F.when(F.col("l_discount") > 0.09, None).when(F.col("l_discount") > 0.08, float("inf")).otherwise(F.col("l_extendedprice").cast("double")).alias("total_cost"),
    )
    return contracts.cost_faults(c)


@query("""WITH d AS (SELECT l_orderkey AS k, list(l_suppkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS ids, list({'a': l_suppkey, 'b': l_partkey} ORDER BY l_linenumber, l_suppkey, l_partkey) AS pairs FROM lineitem GROUP BY 1)
SELECT 'ids_not_canonical' AS rule, k::VARCHAR AS key FROM d WHERE ids <> list_sort(list_distinct(ids)) UNION ALL SELECT 'pair_reversed', k::VARCHAR FROM d WHERE len(list_filter(pairs, lambda p: p.a >= p.b)) > 0
UNION ALL SELECT 'pairs_not_canonical', k::VARCHAR FROM d WHERE pairs <> list_sort(list_distinct(pairs))""")
def constraint_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"))))
    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(rows.alias("r"))
    d = d.select("l_orderkey", F.transform("r", lambda x: x["a"]).alias("ids"), F.transform("r", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))).alias("pairs"))
    return contracts.list_faults(d, "l_orderkey", "ids", "pairs")


# lookups

@query(f"""WITH {CLIPS} SELECT clip_id, CASE WHEN clip_id = '1-1' AND a_profile IS NULL THEN 77 ELSE a_profile END AS a_profile, CASE WHEN clip_id = '1-1' AND a_profile IS NULL THEN 'uploaded' ELSE 'created' END AS status FROM clips""")
def claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.claim(clips(spark, sf_dir).withColumn("status", F.lit("created")), "1-1", "a", 77).select("clip_id", "a_profile", "status")


@query("""WITH n AS (SELECT s_suppkey AS gym_id, 'n' || s_nationkey AS ssid, s_suppkey % 7 AS bssid FROM supplier), r AS (SELECT c_custkey, 'n' || c_nationkey AS ssid, c_custkey % 7 AS bssid FROM customer)
SELECT c_custkey, coalesce((SELECT min(gym_id) FROM n WHERE n.ssid = r.ssid AND n.bssid = r.bssid), (SELECT min(gym_id) FROM n WHERE n.ssid = r.ssid)) AS gym_id FROM r""")
def network_gym(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda t, k: table(spark, sf_dir, t).select(f"{k[0]}_{k[1]}key", F.concat(F.lit("n"), F.col(f"{k[0]}_nationkey").cast("string")).alias("ssid"), (F.col(f"{k[0]}_{k[1]}key") % 7).alias("bssid"))
    return lookup.network_place(at("customer", ("c", "cust")), at("supplier", ("s", "supp")).withColumnRenamed("s_suppkey", "gym_id")).select("c_custkey", "gym_id")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, 'p' || l_partkey AS path, CASE WHEN l_partkey % 3 = 0 THEN 'v' || l_partkey ELSE substring(sha256('p' || l_partkey), 1, 16) END AS id, l_partkey % 3 <> 0 AS created FROM lineitem)
SELECT l_orderkey, string_agg(id, ',' ORDER BY l_linenumber, id) AS ids, count(*) FILTER (created) AS n_created FROM s GROUP BY 1""")
def source_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("position"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path"))
    known = table(spark, sf_dir, "part").filter("p_partkey % 3 = 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("video_id"))
    return lookup.source_ids(rows, known, "l_orderkey").withColumn("ids", F.array_join("ids", ","))


@query(f"""WITH {CLIPS}, {VIDEOS}, ci AS (SELECT c_custkey AS profile_id, c_custkey % 25 AS gym_id, c_custkey % 587 AS tag_id FROM customer),
s AS (SELECT clip_id, gym_id, a_tag, b_tag, a_profile, b_profile, c.video_id % 4 = 0 AS flagged FROM clips c JOIN videos v ON v.video_id = c.video_id)
SELECT DISTINCT clip_id, profile_id FROM s JOIN ci ON s.gym_id = ci.gym_id AND (ci.tag_id = a_tag OR ci.tag_id = b_tag) WHERE flagged
UNION ALL (SELECT clip_id, a_profile FROM s WHERE NOT flagged AND a_profile IS NOT NULL UNION SELECT clip_id, b_profile FROM s WHERE NOT flagged AND b_profile IS NOT NULL)""")
def notify_audience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.audience(*_told(spark, sf_dir))


def _told(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = clips(spark, sf_dir).join(videos(spark, sf_dir).select("video_id", "gym_id"), "video_id").withColumn("status", F.when(F.col("video_id") % 4 == 0, "collision_flagged").otherwise("created"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("profile_id"), (F.col("c_custkey") % 25).alias("gym_id"), (F.col("c_custkey") % 587).alias("tag_id"))
    return c, people


_ZONES = ["America/New_York", "Europe/Berlin", "Asia/Tokyo"]
_DAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


@query(f"""WITH s AS (SELECT s_suppkey % 10 AS gym_id, {_ZONES}[s_suppkey % 10 % 3 + 1] AS zone, s_suppkey AS entry, {_DAYS}[(s_suppkey + k) % 7 + 1] AS weekday, 480 + s_suppkey % 6 * 170 AS start_min, (480 + s_suppkey % 6 * 170 + 155) % 1440 AS end_min FROM supplier, (SELECT unnest(range(5)) AS k)),
z AS (SELECT gym_id, min(zone) AS zone FROM s GROUP BY 1),
c AS (SELECT event_id, user_id % 10 AS gym_id, zone, timezone(zone, timezone('UTC', date_trunc('minute', ts)::TIMESTAMP)) AS l FROM events JOIN z ON z.gym_id = user_id % 10),
m AS (SELECT event_id, c.gym_id, c.zone, l, entry, start_min, CASE WHEN end_min <= start_min THEN end_min + 1440 ELSE end_min END AS e FROM c JOIN s ON s.gym_id = c.gym_id AND s.weekday = strftime(l, '%a'))
SELECT event_id, gym_id, entry, strftime(l, '%Y-%m-%d') AS session_date, strftime(l, '%Y-%m-%d') || 'T' || lpad((start_min // 60)::VARCHAR, 2, '0') || lpad((start_min % 60)::VARCHAR, 2, '0') AS session_id,
  timezone('UTC', timezone(zone, date_trunc('day', l)::TIMESTAMP + to_minutes(e))) AS session_end
FROM m WHERE l >= date_trunc('day', l)::TIMESTAMP + to_minutes(start_min - 30) AND l <= date_trunc('day', l)::TIMESTAMP + to_minutes(e) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY entry) = 1""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions of events at places in three zones, two of which change their clocks."""
    k, pick = F.col("s_suppkey"), lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    start = 480 + k % 6 * 170
    s = table(spark, sf_dir, "supplier").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).select((k % 10).alias("gym_id"), pick(_ZONES, k % 10 % 3).alias("zone"), k.alias("entry"), pick(_DAYS, (k + F.col("k")) % 7).alias("weekday"), start.alias("start_min"), ((start + 155) % 1440).alias("end_min"))
    c = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 10).alias("gym_id"), F.expr("CAST(date_trunc('MINUTE', CAST(ts AS TIMESTAMP_NTZ)) AS TIMESTAMP_NTZ)").alias("at"))
    return lookup.session_windows(c, s).drop("at")


@query("""WITH k AS (SELECT 'v' || lpad(o_orderkey::VARCHAR, 9, '0') AS video_id, 'p' || (o_orderkey % 1500) AS path, CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 25 END AS gym_id FROM orders WHERE o_orderkey % 2 = 0),
u AS (SELECT 'p' || (l_partkey * 3) AS path, CASE WHEN l_tax > 0.03 THEN l_suppkey END AS gym_id, (l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_partkey) AS at_ FROM lineitem),
said AS (SELECT path, arg_max(gym_id, at_) FILTER (gym_id IS NOT NULL) AS said FROM u GROUP BY 1), f AS (SELECT path, min(video_id) AS found FROM k GROUP BY 1)
SELECT video_id, k.path, CASE WHEN video_id = found THEN coalesce(said, gym_id) ELSE gym_id END AS gym_id, false AS created FROM k JOIN f USING (path) LEFT JOIN said USING (path)
UNION ALL SELECT substring(sha256(path), 1, 16), path, said, true FROM said WHERE path NOT IN (SELECT path FROM k)""")
def registered_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the orders are videos; lines are uploads that find them by path or make new ones, and may name a gym."""
    o, li, s = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), lambda c: c.cast("string")
    known = o.filter("o_orderkey % 2 = 0").select(F.concat(F.lit("v"), F.lpad(s(F.col("o_orderkey")), 9, "0")).alias("video_id"), F.concat(F.lit("p"), s(F.col("o_orderkey") % 1500)).alias("path"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey") % 25).alias("gym_id"))
    paths = li.select(F.concat(F.lit("p"), s(F.col("l_partkey") * 3)).alias("path"), F.when(F.col("l_tax") > 0.03, F.col("l_suppkey")).alias("gym_id"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").alias("position"))
    return lookup.registered_videos(known, paths)


@query(f"""WITH told AS ({SQL["notify_audience"]}), t AS (SELECT c_custkey AS profile_id, 't' || (c_custkey % 400) AS token FROM customer WHERE c_custkey % 5 > 0 UNION ALL SELECT c_custkey, 'second' || c_custkey FROM customer WHERE c_custkey % 4 = 0)
SELECT DISTINCT clip_id, token FROM told JOIN t USING (profile_id)""")
def push_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The devices to tell of each clip; some have none, some two, and some share one."""
    c, s = table(spark, sf_dir, "customer"), F.col("c_custkey").cast("string")
    first = c.filter("c_custkey % 5 > 0").select(F.col("c_custkey").alias("profile_id"), F.concat(F.lit("t"), (F.col("c_custkey") % 400).cast("string")).alias("token"))
    second = c.filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("profile_id"), F.concat(F.lit("second"), s).alias("token"))
    return lookup.audience_tokens(*_told(spark, sf_dir), first.union(second))


@query(f"WITH {CLIPS} SELECT clip_id, a_tag FROM clips WHERE video_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') QUALIFY row_number() OVER (PARTITION BY a_tag ORDER BY created_at, clip_id) <= 2")
def next_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = videos(spark, sf_dir).filter("status = 'F'")
    return lookup.next_open(clips(spark, sf_dir), done, "video_id", "a_tag", 2, ["created_at", "clip_id"]).select("clip_id", "a_tag")


# geometry and names

MAT = [(50, 10), (400, 20), (380, 90), (60, 80)]
_SIDES = list(enumerate(zip(MAT, [*MAT[1:], MAT[0]], strict=True)))
_CROSS = " + ".join(f"(CASE WHEN ({p[1]} > y_m) <> ({q[1]} > y_m) AND x_m < {q[0] - p[0]}.0 * (y_m - {p[1]}) / {q[1] - p[1]}.0 + {p[0]} THEN 1 ELSE 0 END)" for _, (p, q) in _SIDES)
_NEAR = " UNION ALL ".join(
    f"SELECT detection_id, {i} AS i, sqrt(power(x_m - ({p[0]} + t * ({q[0] - p[0]})), 2) + power(y_m - ({p[1]} + t * ({q[1] - p[1]})), 2)) AS d FROM (SELECT detection_id, x_m, y_m, least(1.0, greatest(0.0, ((x_m - {p[0]}) * ({q[0] - p[0]}) + (y_m - {p[1]}) * ({q[1] - p[1]})) / {(q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2}.0)) AS t FROM seen)"
    for i, (p, q) in _SIDES
)


@query(f"""WITH {FRAMES}, seen AS (SELECT * FROM frames WHERE x_m IS NOT NULL AND y_m IS NOT NULL), d AS ({_NEAR}),
b AS (SELECT detection_id, round(d, 6) AS edge_m, i::BIGINT AS edge FROM d QUALIFY row_number() OVER (PARTITION BY detection_id ORDER BY d, i) = 1)
SELECT detection_id, ({_CROSS}) % 2 = 1 AS inside, edge_m, edge FROM seen JOIN b USING (detection_id)""")
def mat_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a place is within a polygon, and its nearest edge."""
    f = frames(spark, sf_dir).dropna(subset=["x_m", "y_m"])
    x, y = F.col("x_m"), F.col("y_m")
    near = G.nearest_edge(MAT, x, y)
    return f.select("detection_id", G.in_polygon(MAT, x, y).alias("inside"), F.round(near["d"], 6).alias("edge_m"), near["i"].cast("long").alias("edge"))


@query(f"""WITH {FRAMES}, b AS (SELECT detection_id, (x_m + x_m + 10) / 2 AS cx, (y_m + y_m + 20) / 2 AS cy, greatest(10 + 2 * 8.0, 64.0) AS w, greatest(20 + 2 * 8.0, 64.0) AS h FROM frames WHERE x_m IS NOT NULL AND y_m IS NOT NULL),
c AS (SELECT detection_id, floor(cx - w / 2) AS x1, floor(cy - h / 2) AS y1, ceil(cx + w / 2) AS x2, ceil(cy + h / 2) AS y2 FROM b),
s AS (SELECT *, CASE WHEN x1 < 0 THEN -x1 WHEN x2 > 480 THEN 480 - x2 ELSE 0 END AS sx, CASE WHEN y1 < 0 THEN -y1 WHEN y2 > 120 THEN 120 - y2 ELSE 0 END AS sy FROM c)
SELECT detection_id, least(greatest(x1 + sx, 0), 480)::BIGINT AS x1, least(greatest(y1 + sy, 0), 120)::BIGINT AS y1, least(greatest(x2 + sx, 0), 480)::BIGINT AS x2, least(greatest(y2 + sy, 0), 120)::BIGINT AS y2 FROM s""")
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(frames(spark, sf_dir).dropna(subset=["x_m", "y_m"])).select("detection_id", F.struct("x1", "y1", "x2", "y2").alias("b"))
    return b.select("detection_id", G.crop_box(F.col("b"), 8.0, 64.0, 480, 120).alias("c")).select("detection_id", "c.*")


@query(f"""WITH {FRAMES} SELECT detection_id, greatest(0.0, least(x_m, y_m, 480 - (x_m + 10), 120 - (y_m + 20))) AS border_px, 1 + 2.0 * (1 - greatest(least(greatest(confidence, 0.0), 1.0), 0.1)) AS scale,
  round_even(frame_index / 30.0 * 1000, 0)::BIGINT AS ms FROM frames WHERE x_m IS NOT NULL AND y_m IS NOT NULL""")
def contact_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to the image border, the factor for unreliable contacts and a frame's time."""
    f = boxes(frames(spark, sf_dir).dropna(subset=["x_m", "y_m"]))
    return f.select("detection_id", G.border_distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), 480, 120).alias("border_px"), G.reliability(F.col("confidence"), 2.0, 0.1).alias("scale"), frame_ms(F.col("frame_index"), 30.0).alias("ms"))


@query("""WITH n AS (SELECT l_orderkey || '-' || l_linenumber AS id, CASE l_linenumber % 3 WHEN 0 THEN 'T:' || l_suppkey || ':s1' WHEN 1 THEN 'G:3-9:carrier=' || l_suppkey || ':d=1' ELSE 'SOURCE' END AS node FROM lineitem)
SELECT id, node, CASE WHEN node LIKE 'T:%' THEN split_part(node, ':', 2) WHEN node LIKE 'G:%' THEN split_part(split_part(node, 'carrier=', 2), ':', 1) END AS tracklet FROM n""")
def node_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("l_linenumber") % 3, F.col("l_suppkey").cast("string")
    node = F.when(k == 0, F.concat(F.lit("T:"), s, F.lit(":s1"))).when(k == 1, F.concat(F.lit("G:3-9:carrier="), s, F.lit(":d=1"))).otherwise("SOURCE")
    return table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), node.alias("node")).withColumn("tracklet", node_tracklet(F.col("node")))


@query("""WITH g AS (SELECT l_orderkey, list_sort(list_distinct(list(l_suppkey::VARCHAR))) AS ids, CASE WHEN l_orderkey % 3 = 0 THEN '["a","b"]' WHEN l_orderkey % 3 = 1 THEN 'broken [' END AS reasons FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN len(ids) = 1 THEN ids[1] ELSE substring(sha1(array_to_string(ids, '|')), 1, 16) END AS export_id, CASE WHEN l_orderkey % 3 = 0 THEN 2 ELSE 0 END::BIGINT AS n_reasons FROM g""")
def export_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One id for a group of ids, and lists read from text that may be broken or missing."""
    k = F.col("l_orderkey") % 3
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))).alias("ids"))
    return g.select("l_orderkey", joined_id(F.col("ids")).alias("export_id"), F.size(string_list(F.when(k == 0, '["a","b"]').when(k == 1, "broken ["))).cast("long").alias("n_reasons"))
