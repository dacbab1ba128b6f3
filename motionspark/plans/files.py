"""Queries over sources, sinks and contracts: tables written to the shared folder and read back, paths, and checks by rule."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.text import file_time
from ..operators import contracts, graph
from ..sources import io
from ..sources.views import BANK, FRAMES, bank, frames, table
from .registry import query


def _new(spark: SparkSession, name: str) -> str:
    return f"{io.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {FRAMES} SELECT detection_id, camera_id, x_m FROM frames WHERE camera_id = 'c1'")
def partitioned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by camera; one camera's folder and three columns are read back."""
    path = _new(spark, "frames")
    io.write_table(frames(spark, sf_dir), path, ["camera_id"])
    return io.read_table(spark, path, columns=["detection_id", "camera_id", "x_m"]).filter("camera_id = 'c1'")


@query(f"WITH {FRAMES} SELECT detection_id, tracklet_id, confidence FROM frames WHERE camera_id <> 'c2'")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends of JSON lines of three kinds; the records of two are read back, strictly."""
    path, f = _new(spark, "lines"), frames(spark, sf_dir).select("detection_id", "tracklet_id", "confidence", F.col("camera_id").alias("artifact_type"))
    io.write_jsonl(f.filter("detection_id % 2 = 0"), path, append=True)
    io.write_jsonl(f.filter("detection_id % 2 = 1"), path, append=True)
    fields = "detection_id long, tracklet_id string, confidence double, artifact_type string"
    return io.read_jsonl(spark, path, fields, kind="c0").union(io.read_jsonl(spark, path, fields, kind="c1")).drop("artifact_type")


@query("SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS l_quantity, l_comment FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag || ',\"' || l_linestatus AS l_comment FROM lineitem)")
def comma_separated(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _new(spark, "csv")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity"), F.concat("l_returnflag", F.lit(',"'), "l_linestatus").alias("l_comment"))
    io.write_csv(rows, path)
    return spark.read.option("header", "true").option("escape", "\\").schema("l_orderkey long, l_linenumber long, l_quantity double, l_comment string").csv(path)


@query("SELECT n_nationkey, n_name FROM nation")
def first_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second of two paths, as the first is not there."""
    return io.read_first(spark, f"{sf_dir}/none.parquet", f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")


_PATHS = """paths AS (SELECT o_orderkey AS id, 'cam' || (o_custkey % 3) AS camera,
  CASE o_orderkey % 5 WHEN 0 THEN 'other.mp4' ELSE '/in/' || CASE WHEN o_orderkey % 2 = 0 THEN 'gym' || (o_custkey % 7) || '/' ELSE '' END || 'cam' || (o_orderkey % 3) || '/' || strftime(o_orderdate, '%Y-%m-%d') || '/' || lpad((o_orderkey % 26)::VARCHAR, 2, '0') || '/clip' || o_orderkey || '.mp4' END AS path FROM orders)"""


@query(f"""WITH {_PATHS}, m AS (SELECT *, regexp_extract(path, '(?:^|.*/)(?:([^/]+)/)?([^/]+)/([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})/([0-9]{{2}})/([^/]+)[.][^./]+$', ['g', 'c', 'd', 'h', 'clip']) AS p FROM paths)
SELECT id, nullif(p.c, '') AS camera_id, nullif(p.d, '') AS date, nullif(p.h, '') AS hour, nullif(p.clip, '') AS clip_id,
       CASE WHEN p.clip = '' THEN 'unknown_layout' WHEN p.c <> camera THEN 'camera_mismatch' WHEN TRY_CAST(p.h AS INT) > 23 THEN 'bad_hour' END AS fault FROM m""")
def clip_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of clips' paths, and why a clip does not belong to its camera."""
    o, s = table(spark, sf_dir, "orders"), lambda c: F.col(c).cast("string")
    gym = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("gym"), (F.col("o_custkey") % 7).cast("string"), F.lit("/"))).otherwise("")
    path = F.concat(F.lit("/in/"), gym, F.lit("cam"), (F.col("o_orderkey") % 3).cast("string"), F.lit("/"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("/"), F.lpad((F.col("o_orderkey") % 26).cast("string"), 2, "0"), F.lit("/clip"), s("o_orderkey"), F.lit(".mp4"))
    rows = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("cam"), (F.col("o_custkey") % 3).cast("string")).alias("camera"), F.when(F.col("o_orderkey") % 5 == 0, "other.mp4").otherwise(path).alias("path"))
    rows = rows.withColumn("p", io.path_parts(F.col("path")))
    return rows.select("id", "p.camera_id", "p.date", "p.hour", "p.clip_id", io.path_fault(F.col("p"), F.col("camera")).alias("fault"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def pending_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return io.pending(table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT DISTINCT l_orderkey, NULL FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)")
def ingested_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the orders, and those that lines tell of besides, each once."""
    known = table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return io.ingest(known, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")), "id")


@query(f"""WITH {BANK}, o AS (SELECT camera_id AS clip_id, min(frame_index) * 10 AS offset_ FROM bank GROUP BY 1)
SELECT clip_id, clip_id || ':' || tracklet_id AS tracklet_id, frame_index + offset_ AS frame_index, x_m FROM (SELECT camera_id AS clip_id, * FROM bank) JOIN o USING (clip_id)""")
def session_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras' tables as clips of one session."""
    parts = bank(spark, sf_dir).select(F.col("camera_id").alias("clip_id"), "tracklet_id", "frame_index", "x_m")
    return io.union_shifted(parts, parts.groupBy("clip_id").agg((F.min("frame_index") * 10).alias("offset"))).select("clip_id", "tracklet_id", "frame_index", "x_m")


@query("SELECT l_orderkey::VARCHAR AS tracklet_id, TRY_CAST(CASE WHEN l_linenumber % 3 = 0 THEN 'x' ELSE l_linenumber::VARCHAR END AS BIGINT) AS frame_index, l_quantity::DOUBLE AS x_m, NULL::DOUBLE AS y_m FROM lineitem")
def coerced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in the shape of a contract: what cannot be cast and what is missing is null, other columns go."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tracklet_id"), F.when(F.col("l_linenumber") % 3 == 0, "x").otherwise(F.col("l_linenumber").cast("string")).alias("frame_index"), F.col("l_quantity").alias("x_m"), F.lit(1).alias("other"))
    return contracts.coerce(rows, contracts.schema(tracklet_id="string", frame_index="int", x_m="float", y_m="float"))


@query(f"""WITH {BANK}, r AS (SELECT detection_id, CASE WHEN detection_id % 7 = 0 THEN '/' ELSE 'in/' END || detection_id AS path, detection_id % 4 = 0 AS rep, CASE WHEN x_m < 400 THEN x_m END AS xr, y_m AS yr, CASE WHEN detection_id % 3 = 0 THEN 's' END AS sid FROM bank)
SELECT 'relative' AS rule, detection_id::VARCHAR AS key FROM r WHERE path LIKE '/%' UNION ALL SELECT 'repair', detection_id::VARCHAR FROM r WHERE rep AND (xr IS NULL OR yr IS NULL OR sid IS NULL)""")
def row_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that are not relative, and repairs without places or a span."""
    i = F.col("detection_id")
    rows = bank(spark, sf_dir).select("detection_id", F.concat(F.when(i % 7 == 0, "/").otherwise("in/"), i.cast("string")).alias("path"), (i % 4 == 0).alias("is_repaired"), F.when(F.col("x_m") < 400, F.col("x_m")).alias("x_m_repaired"), F.col("y_m").alias("y_m_repaired"), F.when(i % 3 == 0, "s").alias("repair_span_id"))
    return contracts.violations(rows, i, relative=contracts.relative_path(F.col("path")), repair=contracts.repair_rule())


@query(f"WITH {FRAMES}, o AS (SELECT *, lag(frame_index) OVER (PARTITION BY tracklet_id ORDER BY confidence, detection_id) AS before FROM frames WHERE confidence IS NOT NULL) SELECT detection_id, tracklet_id, frame_index, before FROM o WHERE frame_index <= before")
def rows_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that do not grow in the order of confidence, then id."""
    f = frames(spark, sf_dir).dropna(subset=["confidence"]).select("detection_id", "tracklet_id", "frame_index", F.struct("confidence", "detection_id").alias("arrival"))
    return contracts.out_of_order(f, "tracklet_id", "frame_index", "arrival").select("detection_id", "tracklet_id", "frame_index", "before")


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS edge_id FROM lineitem WHERE l_linenumber <= 2), c AS (SELECT l_orderkey AS edge_id, count(*) AS n FROM lineitem WHERE l_linenumber BETWEEN 2 AND 3 GROUP BY 1)
SELECT CASE WHEN c.edge_id IS NULL THEN 'missing' WHEN e.edge_id IS NULL THEN 'extra' ELSE 'duplicate' END AS rule, edge_id AS key FROM e FULL JOIN c USING (edge_id) WHERE c.edge_id IS NULL OR e.edge_id IS NULL OR n > 1""")
def cost_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges without a price, with several, and prices of no edge."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("edge_id"), "l_linenumber")
    return contracts.cover(li.filter("l_linenumber <= 2"), li.filter("l_linenumber BETWEEN 2 AND 3"))


@query(f"WITH {FRAMES} SELECT detection_id, CASE WHEN x_m IS NULL THEN 'no_place' WHEN x_m < 30 THEN 'off_mat' WHEN coalesce(confidence, 0) < 0.2 THEN 'weak' END AS reason FROM frames")
def gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a detection is not read: the first check it fails."""
    checks = (("no_place", F.col("x_m").isNotNull()), ("off_mat", F.col("x_m") >= 30), ("weak", F.coalesce("confidence", F.lit(0.0)) >= 0.2))
    return frames(spark, sf_dir).select("detection_id", contracts.first_reason(*checks).alias("reason"))


@query("""WITH n AS (SELECT o_orderkey AS node, o_orderkey % 3 - 1 AS capacity FROM orders), e AS (SELECT l_orderkey AS src, l_partkey AS dst, l_linenumber % 4 AS desired FROM lineitem),
a AS (SELECT node, max(desired) AS d FROM (SELECT src AS node, desired FROM e UNION ALL SELECT dst, desired FROM e) GROUP BY 1)
SELECT node, greatest(capacity, coalesce(d, 1), 1) AS capacity FROM n LEFT JOIN a USING (node)""")
def node_capacities(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), (F.col("o_orderkey") % 3 - 1).alias("capacity"))
    return graph.node_capacity(nodes, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), (F.col("l_linenumber") % 4).alias("desired")))


@query("""WITH n AS (SELECT o_orderkey AS node, o_orderkey % 5 AS capacity, o_custkey AS s, o_orderkey AS e FROM orders WHERE o_orderkey % 7 > 0), l AS (SELECT l_orderkey || '-' || l_linenumber AS edge_id, l_orderkey AS src, l_partkey AS dst FROM lineitem)
SELECT 'capacity' AS rule, node::VARCHAR AS key FROM n WHERE capacity < 1 UNION ALL SELECT 'span_order', node::VARCHAR FROM n WHERE e < s
UNION ALL SELECT DISTINCT 'no_such_node', edge_id FROM l WHERE src NOT IN (SELECT node FROM n) OR dst NOT IN (SELECT node FROM n)""")
def graph_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes without capacity or that end before they start, and edges of no node."""
    nodes = table(spark, sf_dir, "orders").filter("o_orderkey % 7 > 0").select(F.col("o_orderkey").alias("node"), (F.col("o_orderkey") % 5).alias("capacity"), F.col("o_custkey").alias("start_frame"), F.col("o_orderkey").alias("end_frame"))
    return graph.graph_violations(nodes, table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("edge_id"), F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")))


@query(f"""WITH {BANK}, r AS (SELECT detection_id, x_m, y_m, CASE WHEN detection_id % 3 = 0 THEN x_m + 1 END AS xr, CASE WHEN detection_id % 2 = 0 THEN y_m + 1 END AS yr, frame_index FROM bank)
SELECT detection_id, coalesce(xr, x_m) AS x, coalesce(yr, y_m) AS y, CASE WHEN xr IS NOT NULL AND yr IS NOT NULL THEN xr ELSE x_m END AS bx, CASE WHEN xr IS NOT NULL AND yr IS NOT NULL THEN yr ELSE y_m END AS by_, 2 * x_m - 0.5 * y_m + 3 AS u, 0.25 * x_m + y_m - 1 AS v, frame_index / 30.0 AS start_s, (frame_index + 5) / 30.0 AS end_s FROM r""")
def repaired_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repaired places or raw ones, by axis and only whole; through an affine map; and frames as seconds."""
    i = F.col("detection_id")
    rows = bank(spark, sf_dir).withColumn("x_m_repaired", F.when(i % 3 == 0, F.col("x_m") + 1)).withColumn("y_m_repaired", F.when(i % 2 == 0, F.col("y_m") + 1))
    (x, y), (bx, by) = graph.effective_xy(), graph.effective_xy(both=True)
    u, v = G.affine([[2, -0.5, 3], [0.25, 1, -1]], F.col("x_m"), F.col("y_m"))
    start, end = G.frame_seconds(F.col("frame_index"), F.col("frame_index") + 4, 30.0)
    return rows.select("detection_id", x.alias("x"), y.alias("y"), bx.alias("bx"), by.alias("by_"), u.alias("u"), v.alias("v"), start.alias("start_s"), end.alias("end_s"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN strptime(strftime(o_orderdate, '%Y%m%d') || '-' || lpad((o_orderkey % 24)::VARCHAR, 2, '0') || '3015', '%Y%m%d-%H%M%S') END AS at_time FROM orders")
def file_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time that a file's name tells; null if it tells none."""
    name = F.concat(F.lit("cam1-"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-"), F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit("3015.mp4"))
    return table(spark, sf_dir, "orders").select("o_orderkey", file_time(F.when(F.col("o_orderkey") % 4 > 0, name).otherwise("clip.mp4")).alias("at_time"))
