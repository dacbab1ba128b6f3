"""Components, promotion, pricing and flows over node and edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import hinge_squared
from ..sources.io import cut


_CHUNK = 1 << 19


def _least(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of each of ``n`` nodes the least one it is joined to by edges (a, b)."""
    least = np.arange(n)
    while len(a):
        x, y = least[a], least[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := least[least], least):
            least = up
    return least


def _stars(edges: DataFrame) -> DataFrame:
    """The same components as those of ``edges`` (src, dst) in fewer edges (a, b): of some half a million edges at once, each node with the
    least one it is joined to (which may be itself)."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def star() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            ends = pa.chunked_array([*table["src"].chunks, *table["dst"].chunks]).combine_chunks().dictionary_encode()
            order = pc.sort_indices(ends.dictionary).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            at, names = rank[ends.indices.to_numpy()], ends.dictionary.take(pa.array(order))
            least = _least(at[: len(table)], at[len(table) :], len(names))
            return pa.RecordBatch.from_arrays([names, names.take(pa.array(least))], names=["a", "b"])

        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= _CHUNK:
                yield star()
                held, n = [], 0
        if n:
            yield star()

    kind = edges.schema["src"].dataType.simpleString()
    return edges.dropna(subset=["src", "dst"]).select("src", "dst").mapInArrow(contract, f"a {kind}, b {kind}")


def components(edges: DataFrame) -> DataFrame:
    """node and component (the least node of it) for every node of ``edges`` (src, dst).

    Edges are contracted within tasks first, so what the rounds join are about as many rows as nodes and tasks. Each round joins every
    node's neighbours to the least of them; a star at the least node is what remains.
    """
    half = edges.filter("src IS NULL OR dst IS NULL").select(F.explode(F.array("src", "dst")).alias("node"))
    stars = cut(_stars(edges).distinct())
    all_nodes = stars.select(F.col("a").alias("node")).unionAll(half).distinct()
    now = cut(stars.filter("a <> b"))
    before = None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
        both = now.unionAll(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = both.join(least, "u").select("v", "m").unionAll(least.select(F.col("u").alias("v"), "m"))
        now = cut(moved.select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b")).filter("a <> b").distinct())
    return all_nodes.join(now.toDF("node", "component"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def promote(seeds: DataFrame, edges: DataFrame, rounds: int = 25) -> DataFrame:
    """Nodes that reach a seed's standing along edges (src to dst), with the round in which they do; at most ``rounds``."""
    edges = cut(edges.select("src", "dst").distinct())  # made once, not in every round
    seen = front = cut(seeds.select("node", F.lit(0).alias("round")).distinct())
    for i in range(1, rounds + 1):
        front = cut(edges.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("round", F.lit(i)))
        if front.isEmpty():
            break
        seen = cut(seen.unionAll(front))
    return seen


def price_edges(edges: DataFrame, w_time: float, w_vreq: float, v_hinge: float, v_max: float, dt_max: float, base: float, blocked: float = 1e6) -> DataFrame:
    """Adds is_allowed, reasons (sorted) and total_cost to edges (kind, dt_s, dist_m)."""
    v = F.col("dist_m") / F.when(F.col("dt_s") > 1e-6, F.col("dt_s"))
    no_geometry = F.col("dist_m").isNull()
    reasons = F.array_sort(F.array_compact(F.array(F.when(F.col("dt_s") > dt_max, F.lit("dt_exceeds_max")), F.when(no_geometry, F.lit("missing_geom")), F.when(F.col("dt_s") <= 1e-6, F.lit("dt_nonpositive")), F.when((F.col("kind") == "RECONNECT") & (v > v_max), F.lit("v_exceeds_max")))))
    priced = edges.withColumn("v_req", v).withColumn("reasons", reasons).withColumn("is_allowed", F.size("reasons") == 0)
    total = F.lit(base) + F.lit(w_time) * F.log1p("dt_s") + F.lit(w_vreq) * hinge_squared(F.col("v_req") / v_hinge)
    return priced.withColumn("total_cost", F.when(F.col("is_allowed"), F.round(total, 6)).otherwise(F.lit(blocked)))


def reason_counts(priced: DataFrame) -> DataFrame:
    return priced.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def node_capacity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A node's capacity: its own or the greatest its edges ask for, at least 1."""
    asked = edges.select(F.explode(F.array("src", "dst")).alias("node"), "desired").groupBy("node").agg(F.max("desired").alias("d"))
    return nodes.join(asked, "node", "left").select("node", F.greatest(F.coalesce("capacity", F.lit(1)), F.coalesce("d", F.lit(1)), F.lit(1)).alias("capacity"))


def graph_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """rule and key of each broken rule: capacities, span order, ends that are no node."""
    low = nodes.filter("capacity < 1").select(F.lit("capacity").alias("rule"), F.col("node").cast("string").alias("key"))
    span = nodes.filter("end_frame < start_frame").select(F.lit("span_order"), F.col("node").cast("string"))
    ends = edges.select(F.col("edge_id").cast("string").alias("key"), F.explode(F.array("src", "dst")).alias("node"))
    lost = ends.join(nodes.select("node"), "node", "left_anti").select(F.lit("no_such_node"), "key").distinct()
    return low.unionAll(span).unionAll(lost)


def chains(nodes: DataFrame, key: str, most: float) -> DataFrame:
    """The persons of the cheapest flow (key, person_id, step, node) where each node's only way on is the next node of its key and every node is worth a person.

    ``nodes``: key, node, start_frame, end_frame. A chain is cut where log1p of the gap exceeds ``most``, the cost of
    an end and a start; so the choice at each gap is its own. Persons are numbered by their first nodes.
    """
    w = Window.partitionBy(key).orderBy("start_frame")
    gap = (F.col("start_frame") - F.lag("end_frame").over(w)).cast("double")
    n = nodes.withColumn("_new", F.coalesce((F.log1p(gap) > most).cast("int"), F.lit(1)))
    n = n.withColumn("_chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    in_chain = Window.partitionBy(key, "_chain").orderBy("start_frame")
    n = n.withColumn("_j", F.row_number().over(in_chain)).withColumn("_last", F.lead("node").over(in_chain).isNull())
    heads = n.filter("_j = 1").withColumn("_p", F.row_number().over(Window.partitionBy(key).orderBy("node")))
    heads = heads.select(key, "_chain", F.concat(F.lit("p"), F.when(F.col("_p") < 10_000, F.lpad(F.col("_p").cast("string"), 4, "0")).otherwise(F.col("_p").cast("string"))).alias("person_id"))
    at = lambda step, name: F.struct(step.cast("long").alias("step"), name.alias("node"))
    j = F.col("_j")
    both = F.array(at(2 * j - 1, F.concat("node", F.lit("/in"))), at(2 * j, F.concat("node", F.lit("/out"))))
    path = F.concat(F.when(j == 1, F.array(at(F.lit(0), F.lit("S")))).otherwise(F.array().cast("array<struct<step:bigint,node:string>>")), both, F.when(F.col("_last"), F.array(at(2 * j + 1, F.lit("T")))).otherwise(F.array().cast("array<struct<step:bigint,node:string>>")))
    return n.withColumn("_path", F.explode(path)).join(heads, [key, "_chain"]).select(key, "person_id", "_path.step", "_path.node")


def effective_xy(both: bool = False) -> tuple[Column, Column]:
    """Repaired coordinates, else raw ones: per axis, or only if both repaired ones are there."""
    if not both:
        return F.coalesce("x_m_repaired", "x_m"), F.coalesce("y_m_repaired", "y_m")
    whole = F.col("x_m_repaired").isNotNull() & F.col("y_m_repaired").isNotNull()
    return F.when(whole, F.col("x_m_repaired")).otherwise(F.col("x_m")), F.when(whole, F.col("y_m_repaired")).otherwise(F.col("y_m"))
