"""Triggers that ask for a tag reading: pairs whose boxes stay over one another, and sudden changes of motion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import iou
from ..functions.text import missing


def sustained_overlap(boxes: DataFrame, session: list[str], least: float, frames: int, cell: float) -> DataFrame:
    """Pairs (a < b) at the frame where their boxes' overlap has lasted for exactly ``frames`` frames in a row.

    Frames in which nobody is seen do not count; a frame with people but without the pair starts it anew. Boxes meet
    in the grid cell that holds the upper left corner of what they share. ``least`` must be over 0.
    """
    if least <= 0:
        raise ValueError("least must be over 0, as boxes apart are not compared")
    at = [*session, "frame_index"]
    order = Window.partitionBy(*session).orderBy("frame_index")
    numbered = boxes.select(*at).distinct().withColumn("_n", F.row_number().over(order))
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell).cast("long"), F.floor(F.col(hi) / cell).cast("long")))
    # a pair lasts no longer than both are seen in a row, so tracks that are not seen for long enough meet nobody
    track = Window.partitionBy(*session, "tracklet_id")
    whole = boxes.dropna(subset=["x1", "y1", "x2", "y2"]).join(numbered, at).withColumn("_i", F.col("_n") - F.dense_rank().over(track.orderBy("_n")))
    stay = Window.partitionBy(*session, "tracklet_id", "_i")
    whole = whole.withColumn("_s", F.min("_n").over(stay)).withColumn("_e", F.max("_n").over(stay)).filter(F.col("_e") - F.col("_s") + 1 >= frames)
    cut = whole.filter("x2 >= x1 AND y2 >= y1").withColumn("_cx", span("x1", "x2")).withColumn("_cy", span("y1", "y2"))
    side = lambda s: cut.select(*at, "_cx", "_cy", F.col("tracklet_id").alias(f"{s}_id"), F.struct("x1", "y1", "x2", "y2").alias(s), F.col("_s").alias(f"{s}_s"), F.col("_e").alias(f"{s}_e"))
    together = F.least("a_e", "b_e") - F.greatest("a_s", "b_s") + 1 >= frames
    met = side("a").join(side("b").hint("merge"), [*at, "_cx", "_cy"]).filter((F.col("a_id") < F.col("b_id")) & together)
    corner = (F.floor(F.greatest("a.x1", "b.x1") / cell) == F.col("_cx")) & (F.floor(F.greatest("a.y1", "b.y1") / cell) == F.col("_cy"))
    over = met.filter(corner).withColumn("iou", iou(F.col("a"), F.col("b"))).filter(F.col("iou") >= least).select(*at, "a_id", "b_id", "iou")
    pair = Window.partitionBy(*session, "a_id", "b_id").orderBy("_n")
    run = over.join(numbered, at).withColumn("_run", F.col("_n") - F.row_number().over(pair))
    lasted = F.row_number().over(Window.partitionBy(*session, "a_id", "b_id", "_run").orderBy("_n"))
    return run.withColumn("_k", lasted).filter(F.col("_k") == frames).select(*at, "a_id", "b_id", "iou")


def motion_jumps(rows: DataFrame, key: str, order: str, seconds: Column, dv: dict[str, float], accel: dict[str, float]) -> DataFrame:
    """Rows at which the velocity between three rows of a track changes by at least ``dv`` or as fast as ``accel``.

    A place is in metres (x_m, y_m) if it has both, else in pixels (x_px, y_px); three rows of mixed units, or at times
    that do not grow, say nothing. An event stands at the last of its three rows, once. ``dv``, ``accel``: thresholds
    of the units "metric" and "pixel".
    """
    w = Window.partitionBy(key).orderBy(order)
    metric = ~missing(F.col("x_m")) & ~missing(F.col("y_m"))
    p = rows.withColumn("_p", F.struct(seconds.cast("double").alias("t"), F.when(metric, F.col("x_m")).otherwise(F.col("x_px")).alias("x"), F.when(metric, F.col("y_m")).otherwise(F.col("y_px")).alias("y"), metric.alias("m")))
    p = p.withColumn("_p1", F.lag("_p").over(w)).withColumn("_p0", F.lag("_p", 2).over(w))
    d01, d12 = F.col("_p1.t") - F.col("_p0.t"), F.col("_p.t") - F.col("_p1.t")
    ok = (F.col("_p.m") == F.col("_p1.m")) & (F.col("_p1.m") == F.col("_p0.m")) & (d01 > 0) & (d12 > 0)
    change = lambda c: (F.col(f"_p.{c}") - F.col(f"_p1.{c}")) / d12 - (F.col(f"_p1.{c}") - F.col(f"_p0.{c}")) / d01
    jump = p.filter(ok).withColumn("dv", F.sqrt(change("x") * change("x") + change("y") * change("y"))).withColumn("accel", F.col("dv") / d12).withColumn("units", F.when(F.col("_p.m"), "metric").otherwise("pixel"))
    over = lambda v, limit: F.col(v) >= F.when(F.col("units") == "metric", limit["metric"]).otherwise(limit["pixel"])
    return jump.withColumn("vel_jump", over("dv", dv)).withColumn("accel_jump", over("accel", accel)).filter("vel_jump OR accel_jump").select(key, order, "units", "dv", "accel", "vel_jump", "accel_jump")
