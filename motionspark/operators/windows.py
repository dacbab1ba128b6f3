"""Ordered analytics over time series and interval sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def kinematics(rows: DataFrame, fps: float, v_max: float, a_max: float, key: str = "tracklet_id", order: str = "frame_index") -> DataFrame:
    """Gap-aware speed and acceleration between neighbouring rows of a track; the first row has neither.

    A step counts only if time moves on and both ends have coordinates; acceleration also needs the speed
    before. Flags are strict comparisons and false where there is no value.
    """
    w = Window.partitionBy(key).orderBy(order)
    lagged = rows.select("*", F.lag(order).over(w).alias("_f"), F.lag("x_m").over(w).alias("_x"), F.lag("y_m").over(w).alias("_y"))
    dt = (F.col(order) - F.col("_f")) / F.lit(fps)
    dx, dy = F.col("x_m") - F.col("_x"), F.col("y_m") - F.col("_y")
    moved = lagged.withColumn("dt_s", F.when(F.col(order) > F.col("_f"), dt)).withColumn("speed", F.when(F.col("dt_s").isNotNull(), F.sqrt(dx * dx + dy * dy) / F.col("dt_s")))
    accel = F.abs(F.col("speed") - F.lag("speed").over(w)) / F.col("dt_s")
    out = moved.withColumn("accel", accel)
    return out.withColumn("speed_flag", F.coalesce(F.col("speed") > v_max, F.lit(False))).withColumn("accel_flag", F.coalesce(F.col("accel") > a_max, F.lit(False))).drop("_f", "_x", "_y")


def box_deltas(rows: DataFrame, key: str = "tracklet_id", order: str = "frame_index") -> DataFrame:
    """Absolute change of a box's height and bottom, and the height's change relative to the height before (null over 0)."""
    w = Window.partitionBy(key).orderBy(order)
    h = F.col("y2") - F.col("y1")
    out = rows.withColumn("height", h).withColumn("_h", F.lag(h).over(w)).withColumn("_b", F.lag("y2").over(w))
    return out.withColumn("d_height", F.abs(F.col("height") - F.col("_h"))).withColumn("d_bottom", F.abs(F.col("y2") - F.col("_b"))).withColumn("rel_height", F.col("d_height") / F.nullif("_h", F.lit(0.0))).drop("_h", "_b")


def trailing_median(rows: DataFrame, value: str, n: int, key: str = "tracklet_id", order: str = "frame_index") -> DataFrame:
    """The median of a row's value and those of the n - 1 rows before it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1 - n, 0)
    kept = F.array_sort(F.collect_list(value).over(w))
    size = F.size("_v")
    middle = (F.get("_v", ((size - 1) / 2).cast("int")) + F.get("_v", (size / 2).cast("int"))) / 2
    return rows.withColumn("_v", kept).withColumn("median", F.when(size > 0, middle)).drop("_v")


def gap_merge(intervals: DataFrame, keys: list[str], gap: int, start: str = "start_frame", end: str = "end_frame") -> DataFrame:
    """Intervals of a key that overlap or lie at most ``gap`` apart become one: start, the greatest end, and how many."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0)
    island = intervals.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged")).drop("_island")


def true_runs(rows: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """Runs of consecutive rows for which the flag holds: first and last value of ``order`` and the length."""
    w = Window.partitionBy(*keys).orderBy(order)
    numbered = rows.withColumn("_n", F.row_number().over(w)).filter(F.coalesce(flag, F.lit(False)))
    return numbered.withColumn("_run", F.col("_n") - F.row_number().over(w)).groupBy(*keys, "_run").agg(F.min(order).alias("start_frame"), F.max(order).alias("end_frame"), F.count("*").alias("n_rows")).drop("_run")


def tile(whole: DataFrame, pieces: DataFrame, key: str) -> DataFrame:
    """Cut each key's [start, end] by disjoint pieces into GROUP pieces and the SOLO stretches between them, numbered from 0."""
    w = Window.partitionBy(key).orderBy("start_frame")
    p = pieces.select(key, "start_frame", "end_frame")
    bounds = whole.select(key, F.col("start_frame").alias("_s"), F.col("end_frame").alias("_e"))
    cut = p.join(bounds, key).withColumn("_prev", F.lag("end_frame").over(w)).withColumn("_last", F.lead("start_frame").over(w).isNull())
    before = cut.select(key, F.coalesce(F.col("_prev") + 1, F.col("_s")).alias("start_frame"), (F.col("start_frame") - 1).alias("end_frame"), F.lit("SOLO").alias("kind"))
    after = cut.filter("_last").select(key, (F.col("end_frame") + 1).alias("start_frame"), F.col("_e").alias("end_frame"), F.lit("SOLO").alias("kind"))
    none = bounds.join(p.select(key).distinct(), key, "left_anti").select(key, F.col("_s").alias("start_frame"), F.col("_e").alias("end_frame"), F.lit("SOLO").alias("kind"))
    group = cut.select(key, "start_frame", "end_frame", F.lit("GROUP").alias("kind"))
    all_ = before.unionByName(after).unionByName(none).unionByName(group).filter("end_frame >= start_frame")
    return all_.withColumn("k", F.row_number().over(w) - 1)


def sliding_window_ids(frame: Column, first: Column, width: int) -> Column:
    """The numbers of the windows [first + i * hop, first + i * hop + width) that hold a frame; hop is half the width, at least 1."""
    hop = max(1, width // 2)
    off = frame - first
    return F.sequence(F.greatest(F.lit(0), F.floor((off - width) / hop) + 1).cast("long"), F.floor(off / hop).cast("long"))


def chain_edges(nodes: DataFrame, key: str, order: str, node: str) -> DataFrame:
    """An edge from each node of a chain to the next."""
    w = Window.partitionBy(key).orderBy(order)
    return nodes.withColumn("next_node", F.lead(node).over(w)).filter("next_node IS NOT NULL").select(key, F.col(node).alias("src"), F.col("next_node").alias("dst"))


SPAN_TYPE = T.StructType([T.StructField("tracklet_id", T.StringType()), T.StructField("start_frame", T.LongType()), T.StructField("end_frame", T.LongType())])
