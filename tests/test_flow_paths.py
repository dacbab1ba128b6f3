"""Paths of flows against a walk that takes one unit after another."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from motionspark.operators import flow_paths

NODES, EDGES, HINTS = "node_id string, start_frame long", "edge_id string, u string, v string, flow long", "node string, in_edge string, out_edge string"


def walk(nodes, edges, hints):
    start = defaultdict(lambda: 10**12, {n: s for n, s in nodes if s is not None})
    out, left, wish = defaultdict(list), {}, {}
    for e, u, v, f in edges:
        if f > 0:
            out[u].append((start[v], e, v))
            left[e] = f
    for n, i, o in hints or []:
        wish[n, i] = min(o, wish.get((n, i), o))
    for u in out:
        out[u].sort()
    rows = []
    for path in range(1, sum(left[e] for _, e, _ in out["SOURCE"]) + 1):
        at, came, step = "SOURCE", None, 0
        while at != "SINK":
            free = [(e, v) for _, e, v in out[at] if left[e]]
            hinted = [x for x in free if x[0] == wish.get((at, came))]
            if not free:
                break
            e, v = (hinted or free)[0]
            left[e] -= 1
            rows.append((path, step, e, at, v))
            at, came, step = v, e, step + 1
    return sorted(rows)


def made(rng, layers, width, persons, most):
    """Flows of persons who walk through layers of nodes; a node takes ``most`` of them."""
    nodes = [(f"n{i}.{j}", rng.choice([10 * i + rng.randrange(3), None])) for i in range(layers) for j in range(width)]
    flow, used = defaultdict(int), defaultdict(int)
    for _ in range(persons):
        at, i = "SOURCE", rng.randrange(2)
        while i < layers:
            free = [j for j in range(width) if used[i, j] < most]
            if free and rng.random() < 0.9:
                j = rng.choice(free[:3])
                used[i, j] += 1
                flow[at, f"n{i}.{j}"] += 1
                at = f"n{i}.{j}"
            i += 1
        if at != "SOURCE":
            flow[at, "SINK"] += 1
    edges = [(f"E{k}", u, v, f) for k, ((u, v), f) in enumerate(sorted(flow.items(), key=lambda _: rng.random()))]
    return nodes, [*edges, ("none", "SOURCE", "n0.0", 0)]


@pytest.mark.parametrize("seed,layers,width,persons,most", [(2, 9, 3, 5, 2), (3, 4, 2, 9, 5)])
@pytest.mark.parametrize("hinted", [False, True])
def test_against_a_walk(spark, seed, layers, width, persons, most, hinted):
    rng = random.Random(seed)
    nodes, edges = made(rng, layers, width, persons, most)
    hints = None
    if hinted:
        into, out = defaultdict(list), defaultdict(list)
        for e, u, v, f in edges:
            if f:
                into[v].append(e)
                out[u].append(e)
        hints = [(n, i, rng.choice(out[n])) for n in into if n in out for i in into[n] if rng.random() < 0.7] + [("n1.0", "E0", "gone")]
    table = spark.createDataFrame(hints, HINTS) if hints else None
    got = flow_paths.paths(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), table)
    assert sorted(tuple(r) for r in got.collect()) == walk(nodes, edges, hints)


def test_a_long_run_takes_few_joins(spark, monkeypatch):
    """A path of 300 nodes: log n tables are written."""
    n, cuts, real = 300, [], flow_paths.cut
    monkeypatch.setattr(flow_paths, "cut", lambda df: cuts.append(1) or real(df))
    names = ["SOURCE", *(f"n{i:03d}" for i in range(n)), "SINK"]
    edges = [(f"E{i}", u, v, 1) for i, (u, v) in enumerate(zip(names, names[1:], strict=False))]
    nodes = [(x, i) for i, x in enumerate(names)]
    got = sorted(tuple(r) for r in flow_paths.paths(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)).collect())
    assert got == walk(nodes, edges, None)
    assert len(cuts) < 20


def test_rings_ends_and_empty_tables(spark):
    edges = [("a", "SOURCE", "x", 1), ("b", "x", "y", 1), ("c", "r", "s", 1), ("d", "s", "t", 1), ("e", "t", "r", 1)]
    got = flow_paths.paths(spark.createDataFrame([("x", 1)], NODES), spark.createDataFrame(edges, EDGES)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, "a", "SOURCE", "x"), (1, 1, "b", "x", "y")]
    assert flow_paths.paths(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)).count() == 0


def test_spans_of_persons(spark):
    nodes = spark.createDataFrame([("T:a", 1, 5, 1, "a"), ("G:b", 6, 9, 2, "b"), ("SOURCE", None, None, 0, None)], "node_id string, start_frame long, end_frame long, capacity int, base_tracklet_id string")
    edges = spark.createDataFrame([("SOURCE", "T:a", 2), ("T:a", "G:b", None)], "u string, v string, desired_capacity int")
    steps = spark.createDataFrame([(1, "SOURCE", "T:a"), (1, "T:a", "G:b"), (12345, "SOURCE", "G:b")], "path long, u string, v string")
    assert sorted(tuple(r) for r in flow_paths.person_spans(steps, nodes, edges).collect()) == [("p0001", "G:b", 6, 9, 2), ("p0001", "T:a", 1, 5, 2), ("p12345", "G:b", 6, 9, 2)]
