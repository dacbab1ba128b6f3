"""How cameras agree and lie to each other: errors along shared edges, boxes of what they see, ways in and out, quality of a correction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..sources.io import cut
from .quantiles import exact_quantiles


def to_segment(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The distance of a place to a segment whose ends are columns; a segment without length is a point."""
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.when(length < 1e-12, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((x - x1) * dx + (y - y1) * dy, length))))
    return G.distance(x, y, x1 + t * dx, y1 + t * dy)


def edge_errors(points: DataFrame, cameras: DataFrame, edges: DataFrame) -> DataFrame:
    """How far a camera's pixels along an edge (camera_id, edge, u, v) lie from it on the ground.

    ``cameras``: camera_id, h (nine numbers by row, pixel to ground), width, height; ``edges``: edge, x1, y1, x2, y2. Pixels outside the
    frame and those at infinity are left out.
    """
    at = points.join(cameras, "camera_id").filter(F.col("u").between(0, F.col("width")) & F.col("v").between(0, F.col("height")))
    q = [F.col("h")[3 * i] * F.col("u") + F.col("h")[3 * i + 1] * F.col("v") + F.col("h")[3 * i + 2] for i in range(3)]
    ground = at.withColumn("_w", q[2]).withColumn("_x", F.try_divide(q[0], q[2])).withColumn("_y", F.try_divide(q[1], q[2])).filter("abs(_w) >= 1e-12")
    return ground.join(edges, "edge").select("camera_id", "edge", to_segment(*(F.col(c) for c in ("_x", "_y", "x1", "y1", "x2", "y2"))).alias("error_m"))


def pair_agreement(errors: DataFrame, least: int = 2) -> DataFrame:
    """For each two cameras the edges both know, how many errors count (of edges where each has at least ``least``), and their
    mean, 95th percentile and maximum, of four digits; null where none counts.

    A row a pair of cameras, also of those that share nothing. Errors meet as counts of equal values, once for each other camera
    that knows the edge.
    """
    values = cut(errors.groupBy("camera_id", "edge", "error_m").agg(F.count("*").alias("c")))  # made once: it is looked at several times
    known = cut(values.groupBy("camera_id", "edge").agg(F.sum("c").alias("n")))
    side = lambda s: known.select(F.col("camera_id").alias(f"camera_{s}"), "edge", F.col("n").alias(f"n_{s}"))
    shared = side("a").join(side("b"), "edge").filter("camera_a < camera_b")
    counted = shared.filter((F.col("n_a") >= least) & (F.col("n_b") >= least))
    who = counted.select("camera_a", "camera_b", "edge", F.explode(F.array("camera_a", "camera_b")).alias("camera_id"))
    met = who.join(values, ["camera_id", "edge"])
    keys = ["camera_a", "camera_b"]
    means = met.groupBy(*keys).agg(F.sum("c").alias("n_samples"), F.bround(F.sum(F.col("error_m") * F.col("c")) / F.sum("c"), 4).alias("mean_m"), F.bround(F.max("error_m"), 4).alias("max_m"))
    p95 = exact_quantiles(met, keys, "error_m", {"p95_m": 0.95}, F.col("c")).select(*keys, F.bround("p95_m", 4).alias("p95_m"))
    cams = known.select("camera_id").distinct()
    pairs = cams.select(F.col("camera_id").alias("camera_a")).join(cams.select(F.col("camera_id").alias("camera_b")), F.col("camera_a") < F.col("camera_b"))
    n_shared = shared.groupBy(*keys).agg(F.count("*").alias("shared_edges"))
    out = pairs.join(n_shared, keys, "left").join(means, keys, "left").join(p95, keys, "left")
    return out.select(*keys, F.coalesce("shared_edges", F.lit(0)).alias("shared_edges"), F.coalesce("n_samples", F.lit(0)).alias("n_samples"), "mean_m", "p95_m", "max_m")


def extents(rows: DataFrame, key: str = "camera_id") -> DataFrame:
    """The box (x_min, y_min, x_max, y_max) of the places a camera sees."""
    seen = rows.dropna(subset=["x_m", "y_m"])
    return seen.groupBy(key).agg(F.min("x_m").alias("x_min"), F.min("y_m").alias("y_min"), F.max("x_m").alias("x_max"), F.max("y_m").alias("y_max"))


def relations(boxes: DataFrame, key: str = "camera_id", overlap: float = 0.1, near_m: float = 2.0) -> DataFrame:
    """Whether two cameras' boxes overlap (by more than a share of either), lie nearer than some metres (adjacent) or apart (separated).

    A row a pair of cameras: share is the greater of the two, gap_m the distance of the boxes.
    """
    side = lambda s: boxes.select(*(F.col(c).alias(f"{c}_{s}") for c in (key, "x_min", "y_min", "x_max", "y_max")))
    pairs = side("a").join(side("b"), F.col(f"{key}_a") < F.col(f"{key}_b"))
    c = F.col
    low, high = {a: F.greatest(c(f"{a}_min_a"), c(f"{a}_min_b")) for a in "xy"}, {a: F.least(c(f"{a}_max_a"), c(f"{a}_max_b")) for a in "xy"}
    area = lambda s: F.greatest(F.lit(1e-6), (c(f"x_max_{s}") - c(f"x_min_{s}")) * (c(f"y_max_{s}") - c(f"y_min_{s}")))
    meet = (low["x"] < high["x"]) & (low["y"] < high["y"])
    common = (high["x"] - low["x"]) * (high["y"] - low["y"])
    share = F.when(meet, F.greatest(common / area("a"), common / area("b"))).otherwise(0.0)
    gap = F.sqrt(F.pow(F.greatest(F.lit(0.0), low["x"] - high["x"]), 2) + F.pow(F.greatest(F.lit(0.0), low["y"] - high["y"]), 2))
    kind = F.when(share > overlap, "overlap").when(gap < near_m, "adjacent").otherwise("separated")
    return pairs.select(c(f"{key}_a").alias("camera_a"), c(f"{key}_b").alias("camera_b"), kind.alias("relation"), share.alias("share"), gap.alias("gap_m"))


def boundary_vectors(rows: DataFrame, boxes: DataFrame, affine: list[list[float]] | None = None, n: int = 5, margin: float = 1.0) -> DataFrame:
    """Where and in which direction tracks come into a camera's box and leave it (side entry or exit).

    ``rows``: camera_id, tracklet_id, frame_index (one row a frame), x_m, y_m; ``boxes``: as of :func:`extents`. A track of at least ``n`` places gives
    an entry if its first (corrected) place is nearer than ``margin`` to a side of the box, and an exit likewise; the direction, of length 1, goes
    from the first to the last of its ``n`` first or last places, and is (0, 0) if these are not over a centimetre apart.

    Only the places at the two ends and in the n-th place from them are kept of a track, by ranks within it.
    """
    x, y = (F.col("x_m"), F.col("y_m")) if affine is None else G.affine(affine, F.col("x_m"), F.col("y_m"))
    track = ["camera_id", "tracklet_id"]
    w = Window.partitionBy(*track).orderBy("frame_index")
    seen = rows.dropna(subset=["x_m", "y_m"]).select(*track, "frame_index", x.alias("x"), y.alias("y")).withColumn("_i", F.row_number().over(w))
    size = seen.withColumn("_n", F.count("*").over(Window.partitionBy(*track))).filter(F.col("_n") >= n)
    place = F.struct("x", "y")
    pick = lambda i: F.max(F.when(F.col("_i") == i, place))  # noqa: E731 - one row each
    ends = size.groupBy(*track).agg(pick(F.lit(1)).alias("e0"), pick(F.lit(n)).alias("e1"), pick(F.col("_n") - n + 1).alias("x0"), pick(F.col("_n")).alias("x1"))
    sides = F.explode(F.array(F.struct(F.lit("entry").alias("side"), F.col("e0").alias("at"), F.col("e0").alias("a"), F.col("e1").alias("b")), F.struct(F.lit("exit").alias("side"), F.col("x1").alias("at"), F.col("x0").alias("a"), F.col("x1").alias("b"))))
    each = ends.select(*track, sides.alias("_s")).select(*track, "_s.*").join(boxes, "camera_id")
    close = F.least(*(F.abs(F.col(f"at.{a}") - F.col(f"{a}_{m}")) for a in "xy" for m in ("min", "max"))) < margin
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    length = F.sqrt(dx * dx + dy * dy)
    unit = lambda d: F.when(length > 0.01, d / length).otherwise(0.0)
    return each.filter(close).select(*track, "side", F.col("at.x").alias("x"), F.col("at.y").alias("y"), unit(dx).alias("dir_x"), unit(dy).alias("dir_y"))


def correction_scores(places: DataFrame, corners: list[tuple[float, float]], candidates: dict[str, list[list[float]]], weights: tuple[float, float, float, float], keys: list[str]) -> DataFrame:
    """What candidate corrections of a camera cost, and how they do: a row a key and candidate, in one pass over the places.

    ``places``: kind ('line': x_m, y_m on an edge of the plan with the detected segment lx1, ly1, lx2, ly2; 'inside': should lie in the
    polygon; 'outside': should not), x_m, y_m. The cost adds weights times squared distances: of lines to their segment, of
    inner places outside and outer places inside to the nearest edge of the polygon, and of the map to the identity.
    inside_share is the share of inner places in the polygon (0 without any), line_m the mean distance of lines (0 without any).
    """
    w_line, w_in, w_out, w_same = weights
    kind = lambda k: F.col("kind") == k
    rows = places.dropna(subset=["x_m", "y_m"])
    moved = [G.affine(m, F.col("x_m"), F.col("y_m")) for m in candidates.values()]
    rows = rows.withColumns({f"_{c}{i}": xy[j] for i, xy in enumerate(moved) for j, c in enumerate("xy")})
    at = lambda i: (F.col(f"_x{i}"), F.col(f"_y{i}"))
    ids = range(len(candidates))  # in steps, so that no place is worked out again for each use
    rows = rows.withColumns({f"_l{i}": to_segment(*at(i), *(F.col(c) for c in ("lx1", "ly1", "lx2", "ly2"))) for i in ids} | {f"_in{i}": G.in_polygon(corners, *at(i)) for i in ids} | {f"_e{i}": G.nearest_edge(corners, *at(i))["d"] for i in ids})
    found = []
    for i, (name, m) in enumerate(candidates.items()):
        line, inside, edge = F.col(f"_l{i}"), F.col(f"_in{i}"), F.col(f"_e{i}")
        part = F.when(kind("line"), w_line * line * line).when(kind("inside") & ~inside, w_in * edge * edge).when(kind("outside") & inside, w_out * edge * edge).otherwise(0.0)
        same = w_same * sum((m[j][k] - float(j == k)) ** 2 for j in range(2) for k in range(3))
        found.append(F.struct(F.lit(name).alias("candidate"), (F.sum(part) + same).alias("cost"), F.coalesce(F.avg(F.when(kind("inside"), inside.cast("int"))), F.lit(0.0)).alias("inside_share"), F.coalesce(F.avg(F.when(kind("line"), line)), F.lit(0.0)).alias("line_m")))
    return rows.groupBy(*keys).agg(F.array(*found).alias("_f")).select(*keys, F.explode("_f").alias("_c")).select(*keys, "_c.*")
