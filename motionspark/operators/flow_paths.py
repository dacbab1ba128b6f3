"""Whole flows cut into paths from SOURCE to SINK.

An edge of flow f is f units. At a node the units that come in are matched with those that go out in the order of their
paths' numbers: the first path takes the first unit by the start of the node it leads to, then by edge, unless a hint
sends it to another that is still free. Paths are numbered by their first units in that same order; so the paths are those
of a walk that takes one after another.

Where a node has one unit in and one out nothing has to be decided, so runs of such units are contracted first, by pointer
doubling: a run of n units takes log n joins of those units only. Then nodes with choices are settled, all those at once whose
incoming runs have their numbers: as many rounds as choices follow one another on a path. A unit is known by the node it leaves
and its number there; the table of units lies in buckets of these, so a round shuffles only the runs that have just arrived.

Defined cases: edges without a positive flow are no part of it; of a node's units that have no partner the path ends there, or
none begins; units that no path from SOURCE reaches are left out, as are nodes that wait for such a unit; an empty table gives
no rows. The units of one node are ordered in one task; a node's capacity bounds them (two, in the graphs built here).
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.io import cut, shared_dir

LATE = 10**12


def numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows`` with ``number`` (from 1) in the order of all: sorted range partitions and the sizes of those before."""
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, starts, before = F.shiftright("_at", 33), [], 0
    for r in sorted(dealt.groupBy(part.alias("part")).count().collect()):  # a row a partition
        starts.append((r["part"], before))
        before += r["count"]
    starts = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part long, _before long"))
    return dealt.join(starts, part == F.col("_part")).withColumn("number", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_part", "_before")


def units(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """u, v, edge_id, copy, start (of the node it leads to) and n_in (how many units lead there) of each unit; ``edges`` (edge_id, u, v, flow)."""
    start, some = nodes.select(F.col("node_id").alias("v"), "start_frame"), edges.filter("flow > 0").select("edge_id", "u", "v", F.col("flow").cast("int").alias("flow"))
    there = some.filter("NOT v <=> 'SINK'").join(start.filter("v <> 'SINK'"), "v", "left").withColumn("n_in", F.sum("flow").over(Window.partitionBy("v")))
    # a great part leads to SINK, so these do not go to one task
    sunk = some.filter("v = 'SINK'").join(F.broadcast(start.filter("v = 'SINK'")), "v", "left").withColumn("n_in", F.lit(0).cast("long"))
    late = F.coalesce("start_frame", F.lit(LATE)).cast("long").alias("start")
    return there.unionByName(sunk).select("u", "v", "edge_id", F.explode(F.sequence(F.lit(1), F.col("flow"))).alias("copy"), late, "n_in")


def runs(slots: DataFrame) -> DataFrame | None:
    """node, edge_id, v, n_in: units that alone leave a node which one unit alone enters; (u, i): the first unit of their run, ``step``: their
    place in it (from 1). None if there are none."""
    alone = slots.filter("n_out = 1 AND u <> 'SOURCE'").select(F.col("u").alias("node"), "edge_id", "v", "n_in")
    into = slots.filter("n_in = 1 AND v <> 'SINK'").select(F.col("v").alias("node"), "u", "i")
    inner = cut(alone.join(into, "node"))
    if inner.isEmpty():
        return None
    plain = inner.select(F.col("node").alias("u"), F.lit(True).alias("_plain"))
    now = inner.select("node", "u", "i").join(plain, "u", "left").select("node", "u", "i", F.lit(1).cast("long").alias("step"), F.col("_plain").isNull().alias("done"))
    now, finished, open_ = cut(now), [], -1
    while True:  # each node points 2 ** j units back, or to its run's first unit
        back = now.select(F.col("node").alias("u"), F.col("u").alias("_u"), F.col("i").alias("_i"), F.col("step").alias("_step"), F.col("done").alias("_done"))
        finished.append(now.filter("done"))
        known = back if len(finished) == 1 else back.unionByName(reduce(DataFrame.unionByName, finished[:-1]).select(F.col("node").alias("u"), F.col("u").alias("_u"), F.col("i").alias("_i"), F.col("step").alias("_step"), F.lit(True).alias("_done")))
        now = cut(now.filter("NOT done").join(known, "u").select("node", F.col("_u").alias("u"), F.col("_i").alias("i"), (F.col("step") + F.col("_step")).alias("step"), F.col("_done").alias("done")))
        still = now.filter("NOT done").count()
        if still in (0, open_):  # of a run, some units get done each time; what stays open is rings, which no path enters
            finished.append(now.filter("done"))
            return reduce(DataFrame.unionByName, finished).join(inner.select("node", "edge_id", "v", "n_in"), "node")
        open_ = still


def _hinted(ready: DataFrame, slots: DataFrame, hints: DataFrame) -> DataFrame:
    """node, path, steps and i: at each node, in the order of the paths, its hinted unit if it is free, else the first free one."""
    wish = hints.groupBy(F.col("node"), F.col("in_edge")).agg(F.min("out_edge").alias("wish"))
    come = ready.join(wish, ["node", "in_edge"], "left").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("path", "steps", "wish"))).alias("coming"))
    both = come.join(slots.groupBy(F.col("u").alias("node")).agg(F.array_sort(F.collect_list(F.struct("i", "edge_id"))).alias("free")), "node")  # a node's units, its capacity at most
    blank = F.filter(F.transform("free", lambda x: F.struct(x["i"].alias("i"), F.col("coming")[0]["path"].alias("path"), F.lit(0).cast("long").alias("steps"))), lambda x: F.lit(False))

    def take(acc: Column, c: Column) -> Column:
        wished = F.filter(acc["free"], lambda x: x["edge_id"] == c["wish"])
        one = F.when(F.size(wished) > 0, F.get(wished, F.lit(0))).otherwise(F.get(acc["free"], F.lit(0)))
        got = F.concat(acc["got"], F.when(F.size(acc["free"]) > 0, F.array(F.struct(one["i"].alias("i"), c["path"].alias("path"), c["steps"].alias("steps")))).otherwise(blank))
        return F.struct(F.filter(acc["free"], lambda x: x != one).alias("free"), got.alias("got"))

    done = F.aggregate("coming", F.struct(F.col("free"), blank.alias("got")), take, lambda acc: acc["got"])
    return both.select("node", F.explode(done).alias("m")).select("node", "m.*")


def paths(nodes: DataFrame, edges: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """path (1, 2, 3 ... ), step (from 0), edge_id, u and v of every unit that a path from SOURCE takes.

    ``nodes`` (node_id, start_frame), ``edges`` (edge_id, u, v, flow), ``hints`` (node, in_edge, out_edge): which edge to leave a node
    by after coming in by another.
    """
    spark, order = nodes.sparkSession, ["start", "edge_id", "copy"]
    every = cut(units(nodes, edges))
    kept = ["u", "i", "edge_id", "v", "n_in"]
    # those that leave SOURCE are numbered over all tasks: their numbers are those of the paths
    first = cut(numbered(every.filter("u = 'SOURCE'"), *order).withColumnRenamed("number", "i").select(*kept))
    by_u = Window.partitionBy("u")
    later = every.filter("u <> 'SOURCE'").withColumn("i", F.row_number().over(by_u.orderBy(*order)).cast("long")).withColumn("n_out", F.count("*").over(by_u)).select(*kept, "n_out")
    later = cut(later)
    inner = runs(later.unionByName(first.withColumn("n_out", F.lit(0).cast("long"))))
    # of each first unit of a run that goes on: where the run ends, by which edge, and its length
    if inner is None:
        with_end = lambda df, dealt=lambda x: x: dealt(df).select("u", "i", "edge_id", "v", "n_in", *(F.lit(None).cast(t).alias(c) for c, t in (("end", "string"), ("by", "string"), ("length", "long"))))
    else:
        last = inner.groupBy("u", "i").agg(F.max_by(F.struct(F.col("v").alias("end"), F.col("edge_id").alias("by"), F.col("n_in").alias("end_in"), (F.col("step") + 1).alias("length")), "step").alias("e")).select("u", "i", "e.*")
        with_end = lambda df, dealt=lambda x: x: dealt(df).join(dealt(last), ["u", "i"], "left").select("u", "i", "edge_id", "v", F.coalesce("end_in", "n_in").alias("n_in"), "end", "by", "length")
    buckets = max(spark.sparkContext.defaultParallelism, -(-later.count() // 500_000))
    dealt = lambda df: df.repartition(buckets, "u", "i")
    name = f"units_{uuid.uuid4().hex}"
    with_end(later, dealt).write.bucketBy(buckets, "u", "i").sortBy("u", "i").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    slots = spark.table(name)
    fresh = cut(with_end(first).select(F.col("i").alias("path"), F.lit(0).cast("long").alias("step"), "*"))
    found, waiting = [fresh], None
    while True:
        came = fresh.select(F.coalesce("end", "v").alias("node"), "n_in", F.coalesce("by", "edge_id").alias("in_edge"), "path", (F.col("step") + F.coalesce("length", F.lit(1))).alias("steps")).filter("node <> 'SINK'")
        came = came if hints is not None else came.drop("in_edge")
        arrived = came if waiting is None else came.unionByName(waiting)
        at = Window.partitionBy("node")
        here = arrived.withColumn("_n", F.count("*").over(at)).withColumn("i", F.row_number().over(at.orderBy("path")).cast("long"))
        if hints is None:  # whoever waits for others gets a number that no unit has
            ready = here.withColumn("i", F.when(F.col("_n") == F.col("n_in"), F.col("i")).otherwise(-F.col("i"))).withColumn("in_edge", F.lit(None).cast("string"))
        else:
            ready = _hinted(here.filter("_n = n_in"), slots, hints).unionByName(here.filter("_n <> n_in").withColumn("i", -F.col("i")), allowMissingColumns=True)
        ready = dealt(ready.select(F.col("node").alias("u"), "i", "path", F.col("steps").alias("step"), F.col("n_in").alias("_in"), F.col("in_edge").alias("_by")))
        met = ready.join(slots, ["u", "i"], "left").filter("i < 0 OR edge_id IS NOT NULL")
        round_ = cut(met.select("path", "step", "u", "i", "edge_id", "v", F.when(F.col("i") < 0, F.col("_in")).otherwise(F.col("n_in")).alias("n_in"), "end", F.when(F.col("i") < 0, F.col("_by")).otherwise(F.col("by")).alias("by"), "length"))
        fresh = round_.filter("i > 0")
        if fresh.isEmpty():
            break
        found.append(fresh)
        waiting = round_.filter("i < 0").select(F.col("u").alias("node"), "n_in", *[F.col("by").alias("in_edge")] * (hints is not None), "path", F.col("step").alias("steps"))
    spark.sql(f"DROP TABLE {name}")
    taken = reduce(DataFrame.unionByName, found)
    steps = taken.select("path", "step", "edge_id", "u", "v")
    if inner is None:
        return steps
    within = taken.filter("length > 1").select("u", "i", "path", F.col("step").alias("_before")).join(inner.withColumnRenamed("step", "_step"), ["u", "i"])
    return steps.unionByName(within.select("path", (F.col("_before") + F.col("_step")).alias("step"), "edge_id", F.col("node").alias("u"), "v"))


def person_spans(steps: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """person_id, node_id, start_frame, end_frame and capacity of every node that a path visits; nodes without tracks (SOURCE, SINK) are none.

    The capacity is the node's own or the greatest its edges wish for, 1 at least.
    """
    wished = edges.select(F.explode(F.array("u", "v")).alias("node_id"), "desired_capacity").groupBy("node_id").agg(F.max("desired_capacity").alias("wished"))
    known = nodes.filter("base_tracklet_id IS NOT NULL").join(wished, "node_id", "left").select("node_id", "start_frame", "end_frame", F.greatest(F.coalesce("capacity", F.lit(1)), F.coalesce("wished", F.lit(1)), F.lit(1)).alias("effective_cap"))
    person = F.concat(F.lit("p"), F.when(F.col("path") < 10_000, F.lpad(F.col("path").cast("string"), 4, "0")).otherwise(F.col("path").cast("string")))
    seen = steps.select(person.alias("person_id"), F.explode(F.array("u", "v")).alias("node_id")).distinct()
    return seen.join(known, "node_id").select("person_id", "node_id", "start_frame", "end_frame", "effective_cap")
