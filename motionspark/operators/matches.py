"""Seeds, unions, snapping, cropping, redaction, metrics and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .quantiles import exact_quantiles

from .windows import gap_merge


def cap2_seeds(spans: DataFrame) -> DataFrame:
    """Nodes that exactly two persons pass through, and the frames both are in."""
    each = spans.groupBy("node_id", "person_id").agg(F.min("start_frame").alias("s"), F.max("end_frame").alias("e"))
    both = each.groupBy("node_id").agg(F.count("*").alias("n"), F.min("person_id").alias("person_a"), F.max("person_id").alias("person_b"), F.max("s").alias("start_frame"), F.min("e").alias("end_frame"))
    return both.filter("n = 2 AND end_frame >= start_frame").drop("n")


def buffered(intervals: DataFrame, buffer: int, first: int, last: int) -> DataFrame:
    """Intervals widened by a buffer and cut to the session; what was cut is marked."""
    return intervals.withColumn("partial_start", F.col("start_frame") - buffer < first).withColumn("partial_end", F.col("end_frame") + buffer > last).withColumn("start_frame", F.greatest(F.col("start_frame") - buffer, F.lit(first))).withColumn("end_frame", F.least(F.col("end_frame") + buffer, F.lit(last)))


def union_buffered(intervals: DataFrame, seeds: DataFrame, keys: list[str], buffer: int, gap: int, session: tuple[int, int]) -> DataFrame:
    """Intervals widened by a buffer, and seeds as they are, merged over gaps; what reaches into the session is cut to it, the rest goes."""
    first, last = session
    columns = [*keys, "start_frame", "end_frame"]
    inside = (F.col("start_frame") <= last) & (F.col("end_frame") >= first)
    rows = buffered(intervals.filter(inside), buffer, first, last).select(*columns).unionByName(buffered(seeds.filter(inside), 0, first, last).select(*columns))
    return gap_merge(rows, keys, gap)


def snap(intervals: DataFrame, tones: DataFrame, keys: list[str], id_col: str, within: int) -> DataFrame:
    """The tone nearest to each interval's end, of equals the earliest, if one lies within a distance."""
    d = F.abs(F.col("end_frame") - F.col("tone_frame"))
    wide = intervals.withColumn("_b", F.explode(F.sequence(F.floor((F.col("end_frame") - within) / within).cast("long"), F.floor((F.col("end_frame") + within) / within).cast("long"))))
    near = wide.join(tones.withColumn("_b", F.floor(F.col("tone_frame") / within).cast("long")), [*keys, "_b"]).filter(d <= within)
    return near.groupBy(id_col).agg(F.min_by("tone_frame", F.struct(d, F.col("tone_frame"))).alias("snapped_frame"))


def union_boxes(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.countDistinct("tracklet_id").alias("n_persons"))


def crop_plan(boxes: DataFrame, keys: list[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """One crop for a clip: exact quantiles of the boxes' edges, so that a few far boxes do not widen it. A clip may have any number of boxes."""
    sides = {"x1": "low", "y1": "low", "x2": "high", "y2": "high"}
    flat = boxes.select(*keys, *(F.col(c).cast("double").alias(c) for c in sides)).unpivot(keys, list(sides), "_side", "_value")
    found = exact_quantiles(flat, [*keys, "_side"], "_value", {"low": low, "high": high})
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("_side") == c, F.col(q))).alias(c) for c, q in sides.items()))


def meets(box: tuple[str, str, str, str], crop: tuple[str, str, str, str]) -> Column:
    """Half-open overlap."""
    return (F.col(box[0]) < F.col(crop[2])) & (F.col(crop[0]) < F.col(box[2])) & (F.col(box[1]) < F.col(crop[3])) & (F.col(crop[1]) < F.col(box[3]))


def unpivot(metrics: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in metrics.columns if c not in keys]
    return metrics.unpivot(keys, values, "metric", "value")


def compare(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Two metric tables side by side, with the difference."""
    return a.withColumnRenamed("value", "baseline").join(b.withColumnRenamed("value", "experiment"), keys, "full_outer").withColumn("delta", F.col("experiment") - F.col("baseline"))


def precision_recall(rows: DataFrame, keys: list[str], predicted: Column, label: Column) -> DataFrame:
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    counts = rows.groupBy(*keys).agg(n(predicted & label).alias("tp"), n(predicted & ~label).alias("fp"), n(~predicted & label).alias("fn"))
    return counts.withColumn("precision", F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), 6)).withColumn("recall", F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), 6))


def periodicity(tones: DataFrame, keys: list[str], second: Column, most_cv: float = 0.05) -> DataFrame:
    """Intervals between tones, rounded to a tenth: mean, variation and whether they are regular; three tones are needed."""
    w = Window.partitionBy(*keys).orderBy("_s")
    gaps = tones.withColumn("_s", second).withColumn("_g", F.round(F.lead("_s").over(w) - F.col("_s"), 1))
    out = gaps.groupBy(*keys).agg(F.count("*").alias("n_tones"), F.round(F.avg("_g"), 6).alias("mean_s"), F.round(F.try_divide(F.stddev_pop("_g"), F.avg("_g")), 6).alias("cv"))
    return out.filter("n_tones >= 3").withColumn("periodic", F.coalesce(F.col("cv") < most_cv, F.lit(False)))
