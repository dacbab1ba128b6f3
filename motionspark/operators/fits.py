"""Calibration over many cameras: affine fits, labels carried between cameras, coverage zones, segments along one line.

Defined cases: rows with a null coordinate count for nothing; fewer than three places, or places on a line, have no fit; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import homography, world_to_pixel
from ..sources.io import cut
from .overlaps import with_match, yielding

PLACES = ("x", "y", "u", "v")
FIT = ("a", "b", "tx", "c", "d", "ty")


def fit_affine(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The least-squares affine map (u, v) = (a x + b y + tx, c x + d y + ty) of each key, and ``n``, its places.

    One aggregate of means and covariances, which merge from task to task, and a solution in columns; null where there is none.
    """
    whole = pairs.dropna(subset=list(PLACES))
    mean = {c: F.avg(c).alias(f"_{c}") for c in PLACES}
    cov = [F.covar_pop(p, q).alias(f"_{p}{q}") for p, q in ("xx", "yy", "xy", "xu", "yu", "xv", "yv")]
    m = whole.groupBy(*keys).agg(F.count("*").alias("n"), *mean.values(), *cov)
    det = F.col("_xx") * F.col("_yy") - F.col("_xy") * F.col("_xy")
    able = (F.col("n") >= 3) & (det > 1e-12 * F.col("_xx") * F.col("_yy"))
    m = m.withColumn("_det", F.when(able, det))
    row = lambda t: ((F.col(f"_x{t}") * F.col("_yy") - F.col(f"_y{t}") * F.col("_xy")) / F.col("_det"), (F.col(f"_y{t}") * F.col("_xx") - F.col(f"_x{t}") * F.col("_xy")) / F.col("_det"))
    (a, b), (c, d) = row("u"), row("v")
    m = m.withColumns({"a": a, "b": b, "c": c, "d": d})
    m = m.withColumn("tx", F.col("_u") - F.col("a") * F.col("_x") - F.col("b") * F.col("_y")).withColumn("ty", F.col("_v") - F.col("c") * F.col("_x") - F.col("d") * F.col("_y"))
    return m.select(*keys, "n", *FIT)


def residual() -> Column:
    """How far a fit's image of (x, y) lies from (u, v)."""
    du = F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("tx") - F.col("u")
    dv = F.col("c") * F.col("x") + F.col("d") * F.col("y") + F.col("ty") - F.col("v")
    return F.sqrt(du * du + dv * dv)


def robust_affine(pairs: DataFrame, keys: list[str], tries: int = 100, within: float = 0.5, seed: int = 0) -> DataFrame:
    """The fit over the inliers of the best of ``tries`` fits through three places each: ``n`` inliers, ``mean_m``, their mean residual
    under the try, and the map.

    The places of a try come from hashes of the seed, so any dealing of the rows gives the same. A try beats earlier ones by
    more inliers only. Rows are numbered by their values within a key; each meets all tries of its key.
    """
    whole = pairs.dropna(subset=[*keys, *PLACES]).select(*keys, *PLACES)
    rows = whole.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy(*PLACES)) - 1)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("size")).filter("size >= 3")
    draws = sizes.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    pick = lambda j, left: F.pmod(F.xxhash64(F.lit(seed), *keys, "k", F.lit(j)), F.col("size") - F.lit(left)).cast("int")
    # three different numbers: each is drawn among those left and moved past the ones before
    draws = draws.withColumn("p0", pick(0, 0)).withColumn("p1", pick(1, 1)).withColumn("p1", F.col("p1") + (F.col("p1") >= F.col("p0")).cast("int"))
    low, high = F.least("p0", "p1"), F.greatest("p0", "p1")
    draws = draws.withColumn("_l", low).withColumn("_h", high).withColumn("p2", pick(2, 2)).withColumn("p2", F.col("p2") + (F.col("p2") >= F.col("_l")).cast("int")).withColumn("p2", F.col("p2") + (F.col("p2") >= F.col("_h")).cast("int"))
    chosen = draws.select(*keys, "k", F.explode(F.array("p0", "p1", "p2")).alias("i")).join(rows, [*keys, "i"])
    fits = fit_affine(chosen, [*keys, "k"]).dropna(subset=["a"]).drop("n")
    met = rows.join(fits, keys).withColumn("r", residual()).filter(F.col("r") < within)
    score = met.groupBy(*keys, "k").agg(F.count("*").alias("inliers"), F.avg("r").alias("mean_m"))
    best = score.groupBy(*keys).agg(F.max_by(F.struct("k", "mean_m"), F.struct("inliers", -F.col("k"))).alias("best")).select(*keys, "best.*")
    inliers = met.join(best, [*keys, "k"]).select(*keys, *PLACES, best["mean_m"])
    return fit_affine(inliers, [*keys, "mean_m"])


def carried_labels(boxes: DataFrame, matrices: dict[str, list[list[float]]], threshold: float = 0.3, size: float = 50.0, keys: tuple[str, ...] = ("frame_index",)) -> DataFrame:
    """Each camera's boxes (id, camera_id, sides) in every other camera: of the same size, about where the box's centre lies there, unless a
    box that the other camera has at that frame overlaps it by more than ``threshold``. ``matrices``: pixels to the ground, by camera."""
    boxes, out = cut(boxes), None  # made once, not for every two cameras
    for source, h in matrices.items():
        wx, wy = homography(h, (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2)
        seen = boxes.filter(F.col("camera_id") == source).withColumn("wx", wx).withColumn("wy", wy)
        for target, g in matrices.items():
            if target != source:
                u, v = world_to_pixel(g, F.col("wx"), F.col("wy"))
                half_w, half_h = (F.col("x2") - F.col("x1")) / 2, (F.col("y2") - F.col("y1")) / 2
                there = seen.withColumn("u", u).withColumn("v", v).dropna(subset=["u", "v"]).select(*keys, F.lit(target).alias("camera_id"), F.col("camera_id").alias("source"), "id", (F.col("u") - half_w).alias("x1"), (F.col("v") - half_h).alias("y1"), (F.col("u") + half_w).alias("x2"), (F.col("v") + half_h).alias("y2"))
                out = there if out is None else out.unionByName(there)
    return with_match(cut(out), boxes, [*keys, "camera_id"], threshold, size, none=True, own=("source", "id"))  # cut: the join repeats its sides' expressions


def coverage_zones(scores: DataFrame, least: int | None = None, threshold: float = 0.7, buffer_m: float = 1.0) -> DataFrame:
    """Which cameras should watch which points: ``scores`` (point, x, y, camera, score) with ``covers``, ``is_primary`` and ``in_zone``.

    A camera watches the points at which it is the best (of equals the first), those that too few others cover, and those it
    covers within ``buffer_m`` of these; then points that still have fewer than ``least`` get the first further cameras
    that cover them. ``least``: 2, or the fewest cameras that any point has, if that is less.
    """
    at = Window.partitionBy("point")
    s = scores.withColumn("covers", F.col("score") > threshold).withColumn("is_primary", F.row_number().over(at.orderBy(F.col("score").desc_nulls_last(), "camera")) == 1)
    s = s.withColumn("others", F.sum(F.col("covers").cast("int")).over(at) - F.col("covers").cast("int"))
    if least is None:
        bound = s.groupBy("point").agg(F.count_if("covers").alias("n")).agg(F.least(F.lit(2), F.coalesce(F.min("n"), F.lit(0))).alias("least"))
        s = s.crossJoin(F.broadcast(bound))  # one row
    else:
        s = s.withColumn("least", F.lit(least))
    s = s.withColumn("core", F.col("is_primary") | (F.col("covers") & (F.col("others") < F.col("least"))))
    cell = lambda c: F.floor(F.col(c) / buffer_m).cast("long")
    step = F.array(*(F.lit(d).cast("long") for d in (-1, 0, 1)))
    core = s.filter("core").select("camera", F.col("x").alias("ox"), F.col("y").alias("oy"), cell("x").alias("_cx"), cell("y").alias("_cy")).withColumn("_dx", F.explode(step)).withColumn("_dy", F.explode(step)).withColumn("_cx", F.col("_cx") + F.col("_dx")).withColumn("_cy", F.col("_cy") + F.col("_dy"))
    apart = F.sqrt((F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy")))
    rim = s.filter("covers AND NOT core").withColumn("_cx", cell("x")).withColumn("_cy", cell("y")).join(core, ["camera", "_cx", "_cy"]).filter(apart <= buffer_m).select("point", "camera").distinct().withColumn("rim", F.lit(True))
    s = s.join(rim, ["point", "camera"], "left").withColumn("zone", F.col("core") | F.col("rim").isNotNull())
    lacks = F.col("least") - F.sum((F.col("zone") & F.col("covers")).cast("int")).over(at)
    spare = F.col("covers") & ~F.col("zone")
    nth = F.sum(spare.cast("int")).over(at.orderBy("camera"))
    return s.withColumn("_lacks", lacks).withColumn("_nth", nth).select(*scores.columns, "covers", "is_primary", (F.col("zone") | (spare & (F.col("_nth") <= F.col("_lacks")))).alias("in_zone"))


def merged_segments(segments: DataFrame, degrees: float = 10.0, offset: float = 20.0) -> DataFrame:
    """Segments (id, x1, y1, x2, y2) along about one line, as one: id (of the first), n, and the ends.

    Going through them by id, each one not yet taken takes all later ones that are not, whose angle differs by less than
    ``degrees`` and whose distance from the origin, across the line, by less than ``offset``. The result lies along the longest.
    """
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    s = segments.dropna(subset=["id", "x1", "y1", "x2", "y2"]).withColumn("length", F.sqrt(dx * dx + dy * dy)).filter("length >= 1e-6")
    s = s.withColumn("angle", F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0))).withColumn("off", ((F.col("x1") + F.col("x2")) / 2 * -dy + (F.col("y1") + F.col("y2")) / 2 * dx) / F.col("length"))
    n_angles = max(1, int(180 // degrees))
    bucket = F.least(F.floor(F.col("angle") / (180.0 / n_angles)).cast("long"), F.lit(n_angles - 1))
    side = s.select("id", "angle", "off", bucket.alias("_a"), F.floor(F.col("off") / offset).cast("long").alias("_o"))
    step = F.array(*(F.lit(d).cast("long") for d in (-1, 0, 1)))
    other = side.select(F.col("id").alias("late"), F.col("angle").alias("angle2"), F.col("off").alias("off2"), F.explode(F.array_distinct(F.transform(step, lambda d: F.pmod(F.col("_a") + d, F.lit(n_angles))))).alias("_a"), F.col("_o")).withColumn("_d", F.explode(step)).withColumn("_o", F.col("_o") + F.col("_d"))
    turn = F.abs(F.col("angle") - F.col("angle2"))
    near = side.join(other, ["_a", "_o"]).filter((F.col("id") < F.col("late")) & (F.when(turn > 90, 180 - turn).otherwise(turn) < degrees) & (F.abs(F.col("off") - F.col("off2")) < offset)).select(F.col("id").alias("early"), "late").distinct()
    taken = yielding(near)
    if taken is None:
        return s.select("id", F.lit(1).cast("long").alias("n"), "x1", "y1", "x2", "y2")
    leader = near.join(taken.withColumnRenamed("id", "early"), "early", "left_anti").groupBy(F.col("late").alias("id")).agg(F.min("early").alias("leader"))
    grouped = s.join(leader, "id", "left").withColumn("leader", F.coalesce("leader", "id"))
    axis = grouped.groupBy("leader").agg(F.max_by(F.struct("x1", "y1", "x2", "y2", "length"), F.struct("length", -F.col("id"))).alias("m"), F.count("*").alias("n"))
    ux, uy = (F.col("m.x2") - F.col("m.x1")) / F.col("m.length"), (F.col("m.y2") - F.col("m.y1")) / F.col("m.length")
    along = lambda x, y: (F.col(x) - F.col("m.x1")) * ux + (F.col(y) - F.col("m.y1")) * uy
    ends = grouped.join(axis, "leader").groupBy("leader", "n", "m").agg(F.min(F.least(along("x1", "y1"), along("x2", "y2"))).alias("t0"), F.max(F.greatest(along("x1", "y1"), along("x2", "y2"))).alias("t1"))
    one = F.col("n") == 1
    point = lambda c, u, t, own: F.when(one, F.col(f"m.{own}")).otherwise(F.col(f"m.{c}1") + F.col(t) * u)
    return ends.select(F.col("leader").alias("id"), "n", point("x", ux, "t0", "x1").alias("x1"), point("y", uy, "t0", "y1").alias("y1"), point("x", ux, "t1", "x2").alias("x2"), point("y", uy, "t1", "y2").alias("y2"))
