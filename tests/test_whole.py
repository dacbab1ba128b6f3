"""Queries over whole tables against brute force, on the smallest tables and small fixtures."""

from __future__ import annotations

import math

import flow_oracle
import pyarrow.parquet as pq

from motionspark.operators import graph, matches
from motionspark.plans import catalog

DIR = "/root/testdata/sf0.001"


def least_of(edges: set[tuple[str, str]]) -> dict[str, str]:
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for x in list(root)}


def components_of(edges: set[tuple[str, str]]) -> dict[str, str]:
    root, least = least_of(edges), {}
    for x, r in root.items():
        least[r] = min(least.get(r, x), x)
    return {x: least[r] for x, r in root.items()}


def test_components_over_every_edge(spark):
    li = pq.read_table(f"{DIR}/lineitem.parquet", columns=["l_partkey", "l_suppkey"]).to_pydict()
    want = components_of({(f"p{p}", f"s{s}") for p, s in zip(li["l_partkey"], li["l_suppkey"], strict=True)})
    got = {r.node: r.component for r in catalog.queries()["components"](spark, DIR).collect()}
    assert got == want
    assert len(got) == len(set(li["l_partkey"])) + len(set(li["l_suppkey"]))


def test_components_of_a_small_graph(spark):
    chain = {(f"n{i:02d}", f"n{i + 1:02d}") for i in range(30)}
    edges = chain | {("b", "a"), ("c", "b"), ("x", "x"), ("q", "z"), ("y", "z")}
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(sorted(edges), "src string, dst string")).collect()}
    assert got == components_of(edges)


def test_promotion_over_every_edge(spark):
    li = pq.read_table(f"{DIR}/lineitem.parquet", columns=["l_partkey", "l_suppkey"]).to_pydict()
    out: dict[int, set[int]] = {}
    for p, s in zip(li["l_partkey"], li["l_suppkey"], strict=True):
        out.setdefault(p, set()).add(p + s % 7 + 1)
    want = front = {1: 0, 2: 0}
    for i in range(1, 26):
        front = {d: i for n in front for d in out.get(n, ()) if d not in want}
        want = want | front
    assert {r.node: r.round for r in catalog.queries()["promotion_fixpoint"](spark, DIR).collect()} == want


def test_spans_that_reach_into_the_session_are_cut(spark):
    spans = spark.createDataFrame([(1, 1, 50, 150), (2, 1, 1900, 2500), (3, 1, 10, 99), (4, 1, 2001, 2010), (5, 1, 300, 310), (6, 1, 0, 9000)], "a_id long, b_id long, start_frame long, end_frame long")
    seeds = spark.createDataFrame([(1, 1, 98, 101), (2, 1, 1999, 2002), (3, 1, 10, 13)], spans.schema)
    got = sorted(tuple(r[c] for c in ("a_id", "start_frame", "end_frame", "n_merged")) for r in matches.union_buffered(spans, seeds, ["a_id", "b_id"], 7, 30, (100, 2000)).collect())
    assert got == [(1, 100, 157, 2), (2, 1893, 2000, 2), (5, 293, 317, 1), (6, 100, 2000, 1)]


def test_every_span_takes_part(spark):
    assert catalog.queries()["union_buffered"](spark, DIR).agg({"n_merged": "sum"}).first()[0] == 2 * catalog.queries()["gap_merge"](spark, DIR).agg({"n_merged": "sum"}).first()[0]


def test_chains_are_the_cheapest_flow(spark):
    starts = {"u1": [0, 10, 3000, 9000, 9010, *range(9100, 9200, 10), 20_000], "u2": [5], "u3": [0, 2981, 5963, 8943]}
    nodes = [(t, f"{t}:{i}", s, s + 1) for t, all_ in starts.items() for i, s in enumerate(all_)]
    edges = [(t, f"{k}:{n}", a, b, 1, c) for t, n, _, _ in nodes for k, a, b, c in (("b", "S", f"{n}/in", 4.0), ("n", f"{n}/in", f"{n}/out", -10.0), ("d", f"{n}/out", "T", 4.0))]
    edges += [(t, f"c:{n}", f"{n}/out", f"{m}/in", 1, math.log1p(s - e)) for (t, n, _, e), (u, m, s, _) in zip(nodes, nodes[1:], strict=False) if t == u]
    got = graph.chains(spark.createDataFrame(nodes, "track string, node string, start_frame long, end_frame long"), "track", 8.0)
    assert got.columns == ["track", "person_id", "step", "node"]
    assert sorted(map(tuple, got.collect())) == flow_oracle.persons(edges)


def test_flow_runs_no_python(spark):
    assert "Pandas" not in catalog.queries()["solve_flow"](spark, DIR)._jdf.queryExecution().toString()
