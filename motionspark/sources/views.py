"""Adapter views: the driver's tables in the shapes the operators take.

Each view has a DataFrame form and the same rows as SQL text (for the oracles). Frames are hours since
2024-01-01; NaN becomes NULL here, at the source, and nowhere later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def no_nan(c: str) -> Column:
    return F.when(F.isnan(c), None).otherwise(F.col(c))


def _since(unit: str, c: str, start: str) -> Column:
    return F.expr(f"timestampdiff({unit}, TIMESTAMP_NTZ '{start}', CAST({c} AS TIMESTAMP_NTZ))").cast("long")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("tracklet_id"),
        F.expr("floor(timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) / 3600)").cast("long").alias("frame_index"),
        F.col("event_id").alias("detection_id"),
        no_nan("value").alias("x_m"),
        F.get_json_object("props", "$.k").cast("double").alias("y_m"),
        F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("camera_id"),
        F.col("event_type").alias("tag_id"),
        F.least(F.lit(1.0), no_nan("value") / 100).alias("confidence"),
        F.col("user_id"),
    )


FRAMES = """frames AS (
  SELECT 'u' || user_id AS tracklet_id, CAST(floor(date_diff('second', TIMESTAMP '2024-01-01', ts) / 3600) AS BIGINT) AS frame_index,
         event_id AS detection_id, value AS x_m, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y_m,
         'c' || (user_id % 3) AS camera_id, event_type AS tag_id, least(1.0, value / 100)::DOUBLE AS confidence, user_id
  FROM events)"""


def one_per_frame(df: DataFrame) -> DataFrame:
    """One row per (tracklet, frame): the greatest detection id wins."""
    others = [c for c in df.columns if c not in ("tracklet_id", "frame_index")]
    best = F.max_by(F.struct(*others), "detection_id").alias("_b")
    return df.groupBy("tracklet_id", "frame_index").agg(best).select("tracklet_id", "frame_index", "_b.*")


BANK = FRAMES + """, bank AS (
  SELECT * FROM frames QUALIFY row_number() OVER (PARTITION BY tracklet_id, frame_index ORDER BY detection_id DESC) = 1)"""


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_per_frame(frames(spark, sf_dir))


def boxes(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("x_m").alias("x1"), F.col("y_m").alias("y1"), (F.col("x_m") + 10).alias("x2"), (F.col("y_m") + 20).alias("y2"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    day = lambda c: _since("DAY", c, "1992-01-01 00:00:00")
    n = li.count()
    li, o = dealt(li, "l_orderkey", n=n), dealt(o, "o_orderkey", n=n)
    s = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("a_id"), F.col("l_suppkey").alias("b_id"), day("o_orderdate").alias("start_frame"), day("l_shipdate").alias("end_frame"), "l_orderkey", "l_linenumber")
    return s.filter("end_frame >= start_frame")


SPANS = """spans AS (
  SELECT o_custkey AS a_id, l_suppkey AS b_id, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS start_frame,
         date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS end_frame, l_orderkey, l_linenumber
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE date_diff('day', DATE '1992-01-01', l_shipdate::DATE) >= date_diff('day', DATE '1992-01-01', o_orderdate::DATE))"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("gym_id"), ((F.col("s_suppkey") * 37) % 180 - 90).cast("double").alias("lat"), ((F.col("s_suppkey") * 73) % 360 - 180).cast("double").alias("lng"))


PLACES = "places AS (SELECT s_suppkey AS gym_id, ((s_suppkey * 37) % 180 - 90)::DOUBLE AS lat, ((s_suppkey * 73) % 360 - 180)::DOUBLE AS lng FROM supplier)"


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("clip_id"), F.col("l_orderkey").alias("video_id"), (F.col("l_partkey") % 587).alias("a_tag"), (F.col("l_suppkey") % 587).alias("b_tag"), F.when(F.col("l_returnflag") == "R", F.col("l_partkey")).alias("a_profile"), F.when(F.col("l_linestatus") == "F", F.col("l_suppkey")).alias("b_profile"), F.col("l_shipdate").cast("timestamp_ntz").alias("created_at"))


CLIPS = """clips AS (
  SELECT l_orderkey || '-' || l_linenumber AS clip_id, l_orderkey AS video_id, l_partkey % 587 AS a_tag, l_suppkey % 587 AS b_tag,
         CASE WHEN l_returnflag = 'R' THEN l_partkey END AS a_profile, CASE WHEN l_linestatus = 'F' THEN l_suppkey END AS b_profile, l_shipdate AS created_at
  FROM lineitem)"""


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video_id"), (F.col("o_custkey") % 25).alias("gym_id"), F.col("o_orderstatus").alias("status"))


VIDEOS = "videos AS (SELECT o_orderkey AS video_id, o_custkey % 25 AS gym_id, o_orderstatus AS status FROM orders)"


def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("person_id"), (F.col("vec_id") % 2).alias("camera"), F.transform("embedding", lambda x: F.abs(x).cast("double")).alias("h"))
    total = F.aggregate("h", F.lit(0.0), lambda a, x: a + x)
    return e.withColumn("t", total).filter("t > 0").select("vec_id", "person_id", "camera", F.transform("h", lambda x: x / F.col("t")).alias("hist"))


HISTS = """hists AS (
  SELECT vec_id, person_id, camera, list_transform(h, lambda x: x / list_sum(h)) AS hist
  FROM (SELECT vec_id, label AS person_id, vec_id % 2 AS camera, list_transform(embedding, lambda x: abs(x)::DOUBLE) AS h FROM embeddings) WHERE list_sum(h) > 0)"""
