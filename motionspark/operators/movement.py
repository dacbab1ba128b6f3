"""How a track moves: extent, speed, stillness, and how it meets the edge of a mat.

Rows: tracklet_id, frame_index, x_m, y_m. The extent is the area of the convex hull; a track's rows pass by
in one task, which holds at most a few thousand of its points, or their hull.

Defined cases: rows without coordinates count for nothing; tracks of fewer than two other rows are left out; fewer than three
distinct points, or points on a line, have no extent; a track that does not move meets no edge; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import in_polygon, nearest_edge

#: Points of a track that are held before their hull is taken.
HELD = 4096


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull, in order; by the monotone chain."""
    corners = sorted(set(map(tuple, points.tolist())))
    if len(corners) < 3:
        return np.array(corners, float).reshape(-1, 2)

    def half(rows: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for x, y in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x - out[-2][0]) <= 0:
                out.pop()
            out.append((x, y))
        return out

    return np.array(half(corners)[:-1] + half(corners[::-1])[:-1])


def polygon_area(corners: np.ndarray) -> float:
    if len(corners) < 3:
        return 0.0
    x, y = (corners - corners[0]).T
    return abs(float((x * np.roll(y, -1) - y * np.roll(x, -1)).sum())) / 2


def hull_areas(rows: DataFrame) -> DataFrame:
    """tracklet_id and hull_m2, the area of the convex hull of each track's points."""

    def pass_by(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        track, held = None, np.zeros((0, 2))
        for b in batches:
            out, names, places = [], b["tracklet_id"].to_numpy(), b[["x", "y"]].to_numpy(float)
            first = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for i, j in zip(first, first[1:], strict=False):
                if i == j:
                    continue
                if names[i] != track:
                    if track is not None:
                        out.append((track, polygon_area(hull(held))))
                    track, held = names[i], places[i:j]
                else:
                    held = np.concatenate([held, places[i:j]])
                held = hull(held) if len(held) > HELD else held
            yield pd.DataFrame(out, columns=["tracklet_id", "hull_m2"])
        if track is not None:
            yield pd.DataFrame([(track, polygon_area(hull(held)))], columns=["tracklet_id", "hull_m2"])

    points = rows.dropna(subset=["tracklet_id", "x_m", "y_m"]).select("tracklet_id", F.col("x_m").cast("double").alias("x"), F.col("y_m").cast("double").alias("y"))
    return points.repartition("tracklet_id").sortWithinPartitions("tracklet_id").mapInPandas(pass_by, "tracklet_id string, hull_m2 double")


def angle_between(ax: Column, ay: Column, bx: Column | float, by: Column | float) -> Column:
    """Degrees between two lines, 0 to 90; null if the first has no length. (bx, by) has length 1."""
    length = F.sqrt(ax * ax + ay * ay)
    cosine = F.least(F.lit(1.0), F.abs(ax * bx + ay * by) / length)
    return F.when(length >= 1e-6, F.degrees(F.acos(cosine)))


def crosses(dx: Column, dy: Column, edge: Column, corners: list[tuple[float, float]], within: float) -> Column:
    """Whether a movement is within so many degrees of the normal of the polygon's edge of that number."""
    out = F.lit(None).cast("double")
    for i, (p, q) in enumerate(zip(corners, [*corners[1:], corners[0]], strict=True)):
        length = float(np.hypot(q[0] - p[0], q[1] - p[1]))
        out = F.when(edge == i, angle_between(dx, dy, (q[0] - p[0]) / length, (q[1] - p[1]) / length)).otherwise(out)
    return F.coalesce(F.abs(out - 90.0) <= within, F.lit(False))


def profiles(rows: DataFrame, corners: list[tuple[float, float]], fps: float, extent: float = 1.0, speeds: tuple[float, float] = (0.3, 3.0), still: float = 0.5, still_speed: float = 0.1, touch: float = 1.0, within: float = 45.0, approach: int = 5) -> DataFrame:
    """A row a track: extent, path, duration, speed, share of still steps and of places on the mat, how it begins and ends at the mat's
    edge (``corners``), and its class: ``cleaning`` if it covers ground at a walking speed without standing still, else ``lingering``."""
    seen = rows.dropna(subset=["tracklet_id", "x_m", "y_m"]).select("tracklet_id", "frame_index", F.col("x_m").alias("x"), F.col("y_m").alias("y"))
    w = Window.partitionBy("tracklet_id").orderBy("frame_index", "x", "y")
    back = Window.partitionBy("tracklet_id").orderBy(F.col("frame_index").desc(), F.col("x").desc(), F.col("y").desc())
    x, y = F.col("x"), F.col("y")
    step = F.sqrt((x - F.lag("x").over(w)) * (x - F.lag("x").over(w)) + (y - F.lag("y").over(w)) * (y - F.lag("y").over(w)))
    timed = seen.withColumn("step", step).withColumn("i", F.row_number().over(w) - 1).withColumn("j", F.row_number().over(back) - 1)
    place = F.struct("x", "y")
    agg = timed.groupBy("tracklet_id").agg(
        F.count("*").alias("n"), F.sum("step").alias("distance_m"), (F.max("frame_index") - F.min("frame_index")).alias("frames"), (F.count_if(F.col("step") * fps < still_speed) / F.greatest(F.count("step"), F.lit(1))).alias("stillness"),
        (F.count_if(in_polygon(corners, x, y)) / F.count("*")).alias("on_mat"),
        F.min_by(place, "i").alias("born"), F.min_by(place, "j").alias("died"), F.max_by(place, F.when(F.col("i") <= approach, F.col("i"))).alias("after"), F.max_by(place, F.when(F.col("j") <= approach, F.col("j"))).alias("before"),
    ).filter("n >= 2")
    agg = agg.withColumn("duration_s", F.greatest(F.col("frames") / F.lit(fps), F.lit(1.0 / fps))).withColumn("speed_mps", F.col("distance_m") / F.col("duration_s"))
    agg = agg.withColumn("b", nearest_edge(corners, F.col("born.x"), F.col("born.y"))).withColumn("d", nearest_edge(corners, F.col("died.x"), F.col("died.y")))
    agg = agg.withColumn("birth_crosses", crosses(F.col("after.x") - F.col("born.x"), F.col("after.y") - F.col("born.y"), F.col("b.i"), corners, within))
    agg = agg.withColumn("death_crosses", crosses(F.col("died.x") - F.col("before.x"), F.col("died.y") - F.col("before.y"), F.col("d.i"), corners, within))
    out = agg.join(hull_areas(rows), "tracklet_id")
    touches = ((F.col("b.d") < touch) & F.col("birth_crosses")).cast("long") + ((F.col("d.d") < touch) & F.col("death_crosses")).cast("long")
    cleaning = (F.col("hull_m2") > extent) & (F.col("speed_mps") > speeds[0]) & (F.col("speed_mps") < speeds[1]) & (F.col("stillness") < still)
    r = lambda c, n=4: F.round(c, n)
    return out.select("tracklet_id", F.when(cleaning, "cleaning").otherwise("lingering").alias("class"), r("hull_m2").alias("hull_m2"), r("distance_m").alias("distance_m"), r("duration_s", 2).alias("duration_s"), r("speed_mps").alias("speed_mps"), r("stillness").alias("stillness"), r("on_mat").alias("on_mat"), r("b.d").alias("birth_edge_m"), r("d.d").alias("death_edge_m"), F.col("b.i").cast("long").alias("birth_edge"), F.col("d.i").cast("long").alias("death_edge"), "birth_crosses", "death_crosses", touches.alias("n_touches"))
