"""Contracts: schemas, coercion to them, and validators that return violations as rows (rule, key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

_KINDS = {"string": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType()}


def schema(**columns: str) -> T.StructType:
    """A schema of the four families string, int, float and bool."""
    return T.StructType([T.StructField(k, _KINDS[v]) for k, v in columns.items()])


TABLES = {
    "detections": schema(clip_id="string", camera_id="string", frame_index="int", timestamp_ms="int", detection_id="string", class_name="string", confidence="float", x1="float", y1="float", x2="float", y2="float", mask_ref="string"),
    "tracklet_frames": schema(clip_id="string", camera_id="string", tracklet_id="string", frame_index="int", timestamp_ms="int", detection_id="string"),
    "tracklet_summaries": schema(clip_id="string", camera_id="string", tracklet_id="string", start_frame="int", end_frame="int", n_frames="int"),
    "bank_frames": schema(tracklet_id="string", frame_index="int", detection_id="string", x_m="float", y_m="float", x_m_repaired="float", y_m_repaired="float", is_repaired="bool", repair_span_id="string"),
    "edge_costs": schema(edge_id="string", edge_type="string", src_node_id="string", dst_node_id="string", is_allowed="bool", disallow_reasons_json="string", total_cost="float"),
    "person_tracks": schema(clip_id="string", camera_id="string", person_id="string", tracklet_id="string", frame_index="int", detection_id="string", x_m="float", y_m="float"),
}


def coerce(df: DataFrame, to: T.StructType) -> DataFrame:
    """The contract's columns in its order: missing ones null, others dropped, values cast as far as they can be."""
    return df.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in to.fields))


def empty(spark: SparkSession, to: T.StructType) -> DataFrame:
    return spark.createDataFrame([], to)


def family(kind: T.DataType) -> str:
    if isinstance(kind, T.StringType):
        return "string"
    if isinstance(kind, T.BooleanType):
        return "bool"
    return "int" if isinstance(kind, T.IntegralType) else "float" if isinstance(kind, T.FractionalType) else "other"


def schema_faults(df: DataFrame, to: T.StructType) -> list[str]:
    """Missing and unexpected columns and those of another family; an int is taken for a float."""
    have, want = {f.name: family(f.dataType) for f in df.schema.fields}, {f.name: family(f.dataType) for f in to.fields}
    out = [f"missing {c}" for c in want if c not in have] + [f"unexpected {c}" for c in have if c not in want]
    return out + [f"{c} is {have[c]}, not {k}" for c, k in want.items() if c in have and have[c] != k and (have[c], k) != ("int", "float")]


def violations(df: DataFrame, key: Column, **rules: Column) -> DataFrame:
    """A row for each rule that does not hold (false or null) in a row."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.select(F.explode(F.array_compact(F.array(*broken))).alias("rule"), key.cast("string").alias("key"))


def box_rules() -> dict[str, Column]:
    return {"x_order": F.col("x2") >= F.col("x1"), "y_order": F.col("y2") >= F.col("y1"), "confidence_range": F.col("confidence").isNull() | F.col("confidence").between(0, 1)}


def relative_path(c: Column) -> Column:
    return c.isNull() | ~(c.startswith("/") | c.rlike(r"^[A-Za-z]:\\"))


def repair_rule() -> Column:
    return ~F.col("is_repaired") | (F.col("x_m_repaired").isNotNull() & F.col("y_m_repaired").isNotNull() & F.col("repair_span_id").isNotNull())


def foreign_keys(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """The child's distinct keys that the parent lacks; keys with a null part are not looked at."""
    return child.select(*keys).dropna().distinct().join(parent.select(*keys), keys, "left_anti")


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def single_value(df: DataFrame, column: str) -> bool:
    return df.agg(F.countDistinct(column)).first()[0] <= 1


def out_of_order(df: DataFrame, key: str, order: str, arrival: str) -> DataFrame:
    """Rows whose frame does not grow in the order of arrival within their key."""
    before = F.lag(order).over(Window.partitionBy(key).orderBy(arrival))
    return df.withColumn("before", before).filter(F.col(order) <= F.col("before"))


def cover(edges: DataFrame, costs: DataFrame) -> DataFrame:
    """Edges without a cost, with several, and costs without an edge."""
    e, c = edges.select("edge_id", F.lit(1).alias("e")).distinct(), costs.groupBy("edge_id").agg(F.count("*").alias("c"))
    both = e.join(c, "edge_id", "full_outer")
    rule = F.when(F.col("c").isNull(), "missing").when(F.col("e").isNull(), "extra").when(F.col("c") > 1, "duplicate")
    return both.select(rule.alias("rule"), F.col("edge_id").alias("key")).filter("rule IS NOT NULL")


def first_reason(*checks: tuple[str, Column]) -> Column:
    """The name of the first check that fails, in order; null if all pass."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(checks):
        out = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def unsorted(df: DataFrame, session: str, order: list[str], arrival: str) -> DataFrame:
    """Rows that come before their predecessor in a session's order, by the struct of the order's columns.

    Rows are dealt to ranges of (session, arrival), so no task sorts a whole session; a range's first row of a session is
    compared with the last one of that session in an earlier range (a row a range and session). Rows of one arrival are in any order.
    """
    from ..sources.io import cut

    ranged = cut(df.withColumn("_r", F.struct(*order)).repartitionByRange(session, arrival).withColumn("_p", F.spark_partition_id()))
    ends = ranged.groupBy(F.col(session).alias("_s"), F.col("_p").alias("_q")).agg(F.max_by("_r", F.struct(arrival, "_r")).alias("_last"))
    ends = ends.withColumn("_seam", F.lag("_last").over(Window.partitionBy("_s").orderBy("_q"))).drop("_last")
    before = F.lag("_r").over(Window.partitionBy("_p", session).orderBy(arrival, "_r"))
    seen = ranged.withColumn("_b", before).join(ends, F.col(session).eqNullSafe(F.col("_s")) & (F.col("_p") == F.col("_q")))
    return seen.filter(F.col("_r") < F.coalesce("_b", "_seam")).drop("_r", "_b", "_p", "_q", "_s", "_seam")


def cost_faults(costs: DataFrame) -> DataFrame:
    """Faults of priced edges (rule, key): repeated or missing ids, reasons that are no JSON list, forbidden edges without one, totals that are no finite number."""
    reasons = F.json_array_length("disallow_reasons_json")
    total = F.col("total_cost")
    rules = violations(
        costs,
        F.col("edge_id"),
        edge_id_null=F.col("edge_id").isNotNull(),
        allowed_null=F.col("is_allowed").isNotNull(),
        reasons_not_a_list=reasons.isNotNull(),
        forbidden_without_reason=F.coalesce("is_allowed", F.lit(True)) | (F.coalesce(reasons, F.lit(1)) >= 1),
        total_not_finite=total.isNotNull() & ~F.isnan(total) & (F.abs(total) < float("inf")),
    )
    twice = repeated(costs.filter("edge_id IS NOT NULL"), ["edge_id"]).select(F.lit("edge_id_repeated").alias("rule"), F.col("edge_id").cast("string").alias("key"))
    return rules.unionByName(twice)


def list_faults(lists: DataFrame, key: str, ids: str, pairs: str) -> DataFrame:
    """Faults of a constraint document's lists (rule, key): ids not sorted and distinct, pairs not (a < b), not sorted and distinct."""
    canonical = lambda c: F.col(c) == F.array_sort(F.array_distinct(c))
    return violations(lists, F.col(key), ids_not_canonical=canonical(ids), pair_reversed=F.forall(pairs, lambda p: p["a"] < p["b"]), pairs_not_canonical=canonical(pairs))
