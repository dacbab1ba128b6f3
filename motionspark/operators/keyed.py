"""Joins on keys with what they promise, best-of selections, and grids of occupied cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def override(base: DataFrame, hints: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Base rows whose columns take the hint's value wherever there is one. A key has at most one hint (else the task fails)."""
    h = _single(hints.select(*keys, *columns), keys, columns, "_h")
    taken = [F.coalesce(F.col("_h")[c], F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns]
    return base.join(h, keys, "left").select(*taken)


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A left join that fails when the right side repeats a key it is asked for, instead of repeating rows."""
    return left.join(_single(right, keys, columns, "_r"), keys, "left").select(*left.columns, *(F.col("_r")[c].alias(c) for c in columns))


def _single(df: DataFrame, keys: list[str], columns: list[str], name: str) -> DataFrame:
    """One struct a key. The count is checked where it is made, within the plan, so nothing runs before the join does."""
    one = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*columns)).alias("_v"))
    clash = F.raise_error(F.concat(F.lit("repeated key: "), F.concat_ws("|", *(F.col(k).cast("string") for k in keys))))
    return one.select(*keys, F.when(F.col("_n") == 1, F.col("_v")).otherwise(clash).alias(name))


def first_by(rows: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The columns of each key's first row in a total order, by a partial aggregate instead of a sort of each key's rows."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_b")).select(*keys, "_b.*")


def cheapest_other(edges: DataFrame, keys: list[str], edge: str, cost: str) -> DataFrame:
    """Each edge with the cheapest other one of the same keys (of equals the least id); null if it is the only one.

    The least and the second least of each key are found by aggregation, so no key's edges meet in one task.
    """
    least = F.min(F.struct(F.col(cost).alias("c"), F.col(edge).alias("e")))
    best = edges.groupBy(*keys).agg(least.alias("_a"))
    rest = edges.join(best, keys).filter(F.col(edge) != F.col("_a.e"))
    second = rest.groupBy(*keys).agg(least.alias("_b"))
    both = edges.join(best.join(second, keys, "left"), keys, "left")
    other = F.when(F.col(edge) == F.col("_a.e"), F.col("_b")).otherwise(F.col("_a"))
    return both.select(*edges.columns, other["e"].alias("other_id"), other["c"].alias("other_cost"))


def best_metrics(links: DataFrame, key: str, metric: str, arrival: str, kept: list[str], pair: Column) -> DataFrame:
    """A row a key: the link of the greatest metric (of equals the first to arrive), and the camera pairs of all its links.

    Pairs are distinct and sorted; there are no more of them than the cameras have pairs.
    """
    best = F.max_by(F.struct(metric, *kept), F.struct(F.col(metric), (-F.col(arrival)).alias("_o"))).alias("_b")
    return links.groupBy(key).agg(best, F.array_sort(F.collect_set(pair)).alias("pairs")).select(key, "_b.*", "pairs")


def quiet_frames(rows: DataFrame, key: str, totals: DataFrame, n: int) -> DataFrame:
    """The least occupied frame of each of ``n`` equal stretches of a clip, of equals the earliest; a frame without rows counts 0.

    ``totals``: key and n_frames. A clip of fewer than ``n`` frames gives each of its frames. The stretch that is left
    over at the end is not looked at.
    """
    size = F.greatest(F.lit(1), F.floor(F.col("n_frames") / n)).cast("long")
    frames = totals.filter("n_frames > 0").select(key, size.alias("_size"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_frames").cast("long") - 1)).alias("frame_index"))
    counts = rows.groupBy(key, "frame_index").agg(F.count("*").alias("_c"))
    filled = frames.join(counts, [key, "frame_index"], "left").withColumn("segment", F.floor(F.col("frame_index") / F.col("_size")).cast("long")).filter(F.col("segment") < n)
    least = F.min(F.struct(F.coalesce("_c", F.lit(0)).alias("n_rows"), F.col("frame_index").alias("frame_index"))).alias("_m")
    return filled.groupBy(key, "segment").agg(least).select(key, "segment", "_m.*")


def occupancy(rows: DataFrame, key: str, cell: float) -> DataFrame:
    """The distinct grid cells that a camera's rows fall into, with the grid's origin; the far edge belongs to the last cell."""
    seen = rows.dropna(subset=[key, "x_m", "y_m"])
    box = seen.groupBy(key).agg(F.min("x_m").alias("x0"), F.min("y_m").alias("y0"), F.max("x_m").alias("_x9"), F.max("y_m").alias("_y9"))
    last = lambda lo, hi: F.greatest(F.lit(1), F.ceil((F.col(hi) - F.col(lo)) / cell)) - 1
    at = lambda v, lo, hi: F.least(F.floor((F.col(v) - F.col(lo)) / cell), last(lo, hi)).cast("long")
    return seen.join(box, key).select(key, "x0", "y0", at("x_m", "x0", "_x9").alias("cx"), at("y_m", "y0", "_y9").alias("cy")).distinct()


def align_grids(cells: DataFrame, key: str, cell: float, reach: int = 10) -> DataFrame:
    """For every two cameras (a < b) the shift in cells, up to ``reach`` each way, at which most occupied cells coincide.

    Shifts are counted from the rounded (half to even) distance of the origins; of equals the least (dy, dx) wins. Fewer
    than 3 shared cells: confidence none and no shift; from 10 medium, from 20 high, else low.
    """
    a = cells.select(F.col(key).alias("cam_a"), F.col("x0").alias("ax0"), F.col("y0").alias("ay0"), F.col("cx").alias("ax"), F.col("cy").alias("ay"))
    grids = cells.select(key, "x0", "y0").distinct()
    ga, gb = (grids.select(F.col(key).alias(f"cam_{s}"), F.col("x0").alias(f"{s}x0"), F.col("y0").alias(f"{s}y0")) for s in "ab")
    pairs = ga.join(gb, F.col("cam_a") < F.col("cam_b"))  # a row a camera
    off = lambda v: F.bround((F.col(f"b{v}0") - F.col(f"a{v}0")) / cell).cast("long")
    shifts = F.sequence(F.lit(-reach).cast("long"), F.lit(reach).cast("long"))
    b = cells.select(F.col(key).alias("cam_b"), F.col("cx").alias("bx"), F.col("cy").alias("by"))
    moved = pairs.select("cam_a", "cam_b", off("x").alias("ox"), off("y").alias("oy")).join(b, "cam_b").withColumn("dy", F.explode(shifts)).withColumn("dx", F.explode(shifts))
    moved = moved.select("cam_a", "cam_b", "dx", "dy", (F.col("bx") + F.col("ox") + F.col("dx")).alias("ax"), (F.col("by") + F.col("oy") + F.col("dy")).alias("ay"))
    scored = moved.join(a.select("cam_a", "ax", "ay"), ["cam_a", "ax", "ay"]).groupBy("cam_a", "cam_b", "dy", "dx").agg(F.count("*").alias("score"))
    best = scored.groupBy("cam_a", "cam_b").agg(F.min(F.struct((-F.col("score")).alias("s"), "dy", "dx")).alias("m"))
    out = pairs.select("cam_a", "cam_b").join(best, ["cam_a", "cam_b"], "left").withColumn("score", F.coalesce(-F.col("m.s"), F.lit(0)))
    enough = F.col("score") >= 3
    level = F.when(F.col("score") >= 20, "high").when(F.col("score") >= 10, "medium").when(enough, "low").otherwise("none")
    return out.select("cam_a", "cam_b", "score", F.when(enough, F.col("m.dx")).alias("dx"), F.when(enough, F.col("m.dy")).alias("dy"), level.alias("confidence"))
