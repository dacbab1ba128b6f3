"""Exact quantiles of groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.io import cut


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, points: dict[str, float], weight: Column | None = None) -> DataFrame:
    """Per key the quantiles named in ``points`` (name: share), interpolated between neighbours, and ``n``, how many values there are.

    Equal values are counted before anything is moved. The counts are dealt to ordered ranges of (key, value), so a large key
    is spread over many tasks; a value's rank is its rank in its range plus what the key has in earlier ranges (a row a
    range and key). No task or aggregation buffer ever holds a key whole. ``weight``: how often a row counts.
    Missing values are left out, NaN is the greatest; a key without values has no row; null keys are a key.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.sum(F.lit(1) if weight is None else weight).alias("_c")).filter("_c > 0")
    ranged = cut(counts.repartitionByRange(*keys, "_v").withColumn("_p", F.spark_partition_id()))
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(*keys, "_p").agg(F.sum("_c").alias("_s"))
    parts = parts.withColumn("_o", F.coalesce(F.sum("_s").over(before), F.lit(0))).withColumn("_n", F.sum("_s").over(by_key)).drop("_s")
    same = reduce(lambda a, b: a & b, (F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in [*keys, "_p"]))
    both = ranged.alias("r").join(parts.alias("o"), same).select("r.*", "o._o", "o._n")
    end = F.col("_o") + F.sum("_c").over(Window.partitionBy("_p", *keys).orderBy("_v"))
    placed = both.withColumn("_end", end).withColumn("_start", F.col("_end") - F.col("_c"))
    found = []
    for i, share in enumerate(points.values()):
        at = F.lit(float(share)) * (F.col("_n") - 1)
        for side, rank in (("l", F.floor(at)), ("h", F.ceil(at))):
            found.append(F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_end")), F.col("_v"))).alias(f"_{side}{i}"))
    out = placed.groupBy(*keys).agg(F.max("_n").alias("n"), *found)

    def between(i: int, share: float) -> Column:
        at = F.lit(float(share)) * (F.col("n") - 1)
        low, high = F.col(f"_l{i}"), F.col(f"_h{i}")
        return F.when(F.floor(at) == F.ceil(at), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return out.select(*keys, "n", *(between(i, p).alias(name) for i, (name, p) in enumerate(points.items())))
