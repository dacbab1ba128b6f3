"""Steps whose rows must not grow with the square of a frame's: what is shuffled after a join of places, and what meets at all."""

from __future__ import annotations

import random

from motionspark.operators import joins, machines

POINTS = "tracklet_id string, frame_index long, x double, y double"


def plan(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def above_join(df) -> str:
    """The plan down to its first join."""
    lines = plan(df)
    return "\n".join(lines[: next(i for i, line in enumerate(lines) if "Join" in line)])


def tracks(spark, n=60, frames=12):
    rng = random.Random(n)
    rows = [(f"t{i}", f, float(rng.randrange(200)), float(rng.randrange(100))) for i in range(n) for f in range(frames) if rng.random() < 0.6]
    bank = spark.createDataFrame(rows, "tracklet_id string, frame_index long, x_m double, y_m double")
    lives = [(t, min(f for u, f, *_ in rows if u == t), max(f for u, f, *_ in rows if u == t)) for t in sorted({r[0] for r in rows})]
    return rows, bank, lives, spark.createDataFrame(lives, "tracklet_id string, start_frame long, end_frame long")


def test_carriers_near_a_point_are_not_shuffled_once_met(spark):
    rows, bank, lives, spans = tracks(spark)
    ends = [next(r for r in rows if r[:2] == (t, e)) for t, _, e in lives]
    got = joins.alive_near(spark.createDataFrame(ends, POINTS), spans, bank, 40.0, window=2)
    assert "Exchange" not in above_join(got)
    want = set()
    for t, f, x, y in ends:
        for c, s, e in lives:
            near = [r for r in rows if r[0] == c and abs(r[1] - f) <= 2]
            if c != t and s <= f <= e and near:
                _, _, cx, cy = min(near, key=lambda r: (abs(r[1] - f), r[1]))
                if ((x - cx) ** 2 + (y - cy) ** 2) ** 0.5 <= 40.0:
                    want.add((t, c, f))
    assert {(r.tracklet_id, r.carrier_id, r.frame_index) for r in got.collect()} == want and want


def test_triggers_of_a_carrier_at_one_frame_are_thinned_before_they_are_shuffled(spark):
    rows = [("c", f, f"t{i}", float((i * 7 + f) % 11)) for f in range(20) for i in range(50)]
    points = spark.createDataFrame(rows, "carrier_id string, frame_index long, tracklet_id string, dist_m double")
    assert any("partial_min" in line for line in plan(machines.thin(points, 3)))


def test_reconnects_meet_in_cells_only(spark):
    rng = random.Random(3)
    at = lambda n: [(f"{n}{i}", rng.randrange(30), rng.randrange(3000) / 10, rng.randrange(1000) / 10) for i in range(300)]
    ends, starts = at("e"), at("s")
    got = joins.reconnects(spark.createDataFrame(ends, POINTS), spark.createDataFrame(starts, POINTS), 6, 5.0, 1.0)
    assert any("Join" in line and "_cx" in line for line in plan(got))
    want = {(e[0], s[0]) for e in ends for s in starts if 0 < s[1] - e[1] <= 6 and ((e[2] - s[2]) ** 2 + (e[3] - s[3]) ** 2) ** 0.5 / (s[1] - e[1]) <= 5.0}
    assert sorted((r.src, r.dst) for r in got.collect()) == sorted(want) and want


def test_windows_of_many_entries_meet_a_clip_once(spark):
    from datetime import datetime

    from motionspark.operators import lookup

    entries = [("g", "Europe/Berlin", i, "Wed", 600, 700) for i in range(40, 0, -1)]
    schedule = spark.createDataFrame(entries, "gym_id string, zone string, entry long, weekday string, start_min int, end_min int")
    clips = spark.createDataFrame([("k", "g", datetime(2024, 1, 3, 9, 30))], "clip_id string, gym_id string, at timestamp_ntz")
    got = lookup.session_windows(clips, schedule)
    assert [r.entry for r in got.collect()] == [1]
    text = "\n".join(plan(got))
    assert "min(entry" in text


def boxes(spark, n):
    rng = random.Random(n)
    rows = [(rng.randrange(2), i, x := rng.randrange(300) / 10, y := rng.randrange(300) / 10, x + 10, y + 20, rng.randrange(9)) for i in range(n)]
    return spark.createDataFrame(rows, "frame long, id long, x1 double, y1 double, x2 double, y2 double, score long")


def test_suppression_and_free_entries_pass_by_without_pairs(spark):
    from motionspark.operators import overlaps

    kept = overlaps.suppress(boxes(spark, 500), ["frame"], "score", 0.05, 20.0)
    assert not any("_cx" in line for line in plan(kept)) and 0 < kept.count() < 100
    ends = boxes(spark, 200).selectExpr("frame AS g", "id", "id AS place", "x1 AS x", "y1 AS y")
    got = overlaps.nearest_free(ends, ends.selectExpr("g", "id + 1000 AS id", "place", "x + 0.5 AS x", "y"), ["g"], 12.0)
    assert not any("Join" in line for line in plan(got))
    assert got.count() == len({r.entry_id for r in got.collect()}) > 150


def test_who_is_told_once_and_on_which_devices(spark):
    from motionspark.operators import lookup

    clips = spark.createDataFrame([("k", "g", 1, 2, None, None, "collision_flagged"), ("k", "g", 1, 3, None, None, "collision_flagged"), ("m", "g", 1, 2, 7, 8, "created")], "clip_id string, gym_id string, a_tag long, b_tag long, a_profile long, b_profile long, status string")
    people = spark.createDataFrame([("g", 1, 10), ("g", 1, 10), ("g", 2, 10), ("g", 2, 11), ("g", 3, 12), ("h", 1, 13)], "gym_id string, tag_id long, profile_id long")
    told = lookup.audience(clips, people)
    assert sorted(map(tuple, told.collect())) == [("k", 10), ("k", 11), ("k", 12), ("m", 7), ("m", 8)]
    tokens = spark.createDataFrame([(10, "a"), (11, "a"), (12, "b"), (12, "c"), (7, "a"), (8, None)], "profile_id long, token string")
    got = lookup.audience_tokens(clips, people, tokens)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, lookup.push_tokens(told, tokens).collect())) == [("k", "a"), ("k", "b"), ("k", "c"), ("m", "a")]


def test_births_are_not_sought_through_the_driver(spark):
    from motionspark.operators import endpoints

    starts = spark.range(50).selectExpr("'t' || id AS tracklet_id", "id % 7 AS frame_index", "CAST(id AS double) AS x", "1.0D AS y")
    got = endpoints.births_nearby(starts, 2, 5.0)
    assert "Broadcast" not in "\n".join(plan(got))
    want = {f"t{i}": sum(i != j and abs(i % 7 - j % 7) <= 2 and abs(i - j) <= 5 for j in range(50)) for i in range(50)}
    assert {r.tracklet_id: r.n_births for r in got.collect()} == want


def test_tracks_seen_too_briefly_meet_nobody(spark):
    from motionspark.operators import triggers

    rows = [(f, t, 0.0, 0.0, 10.0, 10.0) for f in range(6) for t in ("a", "b")] + [(f, f"x{f}", 0.0, 0.0, 10.0, 10.0) for f in range(6)]
    got = triggers.sustained_overlap(spark.createDataFrame(rows, "frame_index long, tracklet_id string, x1 double, y1 double, x2 double, y2 double"), [], 0.2, 2, 10.0)
    assert any("_e" in line and "Filter" in line for line in plan(got))
    assert [(r.frame_index, r.a_id, r.b_id) for r in got.collect()] == [(1, "a", "b")]


def test_intervals_meet_once_for_both_directions(spark):
    from motionspark.operators import identity

    rng = random.Random(4)
    rows = [(f"t{i}", rng.choice("xy"), 2, 2.0, 1.0, s := rng.randrange(40), s + rng.randrange(5)) for i in range(80)]
    votes = spark.createDataFrame(rows, "tracklet_id string, tag_id string, votes int, weight double, max_conf double, first_frame int, last_frame int")
    want = sorted((a[1], a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and a[1] == b[1] and a[5] <= b[6] and b[5] <= a[6])
    for width in (1, 3, 24):
        got = identity.tag_conflicts(votes, lambda s: joins.interval_overlaps(s, ["tag_id"], "tracklet_id", width))
        assert sum("Join" in line for line in plan(got)) == 1
        assert sorted(map(tuple, got.collect())) == want


def test_edges_of_a_promotion_are_made_once(spark):
    from pyspark.sql import functions as F

    from motionspark.operators import graph

    made = spark.sparkContext.accumulator(0)

    def counted(x: int) -> int:
        made.add(1)
        return x

    edges = spark.range(10).select(F.udf(counted, "long")("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = graph.promote(spark.range(1).select(F.col("id").alias("node")), edges)
    assert sorted(map(tuple, got.collect())) == [(i, i) for i in range(11)]
    assert made.value == 10


def test_a_box_looks_for_one_match_only(spark):
    from motionspark.operators import overlaps

    a, b = boxes(spark, 200), boxes(spark, 150).selectExpr("frame", "id + 1000 AS id", "x1 + 3 AS x1", "y1", "x2 + 3 AS x2", "y2")
    hit = {(r.frame, r.a_id) for r in overlaps.overlapping(a, b, ["frame"], 0.3, 20.0).collect()}
    got = overlaps.with_match(a, b, ["frame"], 0.3, 20.0)
    assert not any("_cx" in line for line in plan(got))
    assert {(r.frame, r.id) for r in got.collect()} == hit and hit


def test_spans_are_dealt_to_as_many_tasks_as_they_need(spark):
    from motionspark.operators import matches
    from motionspark.sources import io, views

    assert io.dealt(spark.range(10), "id", n=3_000_001).rdd.getNumPartitions() == 7
    spans = views.spans(spark, "/root/testdata/sf0.001")
    seeds = matches.cap2_seeds(spans.selectExpr("l_orderkey AS node_id", "b_id AS person_id", "start_frame", "end_frame"))
    shuffles = [line for line in plan(seeds) if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 2 and all("REPARTITION_BY_NUM" in line for line in shuffles)


def test_manifests_are_written_compressed(spark):
    from pathlib import Path

    from motionspark.plans import catalog
    from motionspark.sources import io

    shared = Path(io.shared_dir(spark).removeprefix("file://"))
    before = set(shared.glob("manifest-*"))
    assert catalog.queries()["manifest_clips"](spark, "/root/testdata/sf0.001").count() > 0
    (made,) = set(shared.glob("manifest-*")) - before
    names = [p.name for p in made.glob("part-*")]
    assert names and all(n.endswith(".gz") for n in names)


def test_errors_of_cameras_are_made_once(spark):
    from pyspark.sql import functions as F

    from motionspark.operators import cameras

    made = spark.sparkContext.accumulator(0)

    def counted(x: float) -> float:
        made.add(1)
        return x

    errors = spark.range(40).select(F.concat(F.lit("c"), (F.col("id") % 2).cast("string")).alias("camera_id"), F.lit("e").alias("edge"), F.udf(counted, "double")(F.col("id").cast("double")).alias("error_m"))
    assert [tuple(r) for r in cameras.pair_agreement(errors).collect()] == [("c0", "c1", 1, 40, 19.5, 37.05, 39.0)]
    assert made.value == 40


def test_a_round_of_a_flow_shuffles_what_has_arrived_only(spark, monkeypatch):
    from motionspark.operators import flow_paths

    plans, real = [], flow_paths.cut
    monkeypatch.setattr(flow_paths, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString().splitlines()) or real(df))
    legs = [(a, b) for i in range(3) for j in range(4) for k in range(4) for a, b in [(f"n{i}.{j}", f"n{i + 1}.{k}")]]
    legs += [("SOURCE", f"n0.{j}") for j in range(4)] + [(f"n3.{j}", "SINK") for j in range(4)]
    edges = [(f"{u}>{v}", u, v, 4 if u == "SOURCE" or v == "SINK" else 1) for u, v in legs]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = flow_paths.paths(spark.createDataFrame([(v, 1) for _, v in legs if v != "SINK"], "node_id string, start_frame long").distinct(), spark.createDataFrame(edges, "edge_id string, u string, v string, flow long"))
        assert got.count() == 5 * 16
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rounds = [p for p in plans if any("Bucketed: true" in line for line in p)]
    assert len(rounds) == 5  # four layers of nodes, and one round in which nobody is left
    for p in rounds:
        table = p[next(i for i, line in enumerate(p) if "Join" in line) :]
        table = table[max(i for i, line in enumerate(table) if "Exchange" in line) + 1 :]
        assert any("Bucketed: true" in line for line in table)  # nothing is shuffled between the table of units and the join


def test_edges_of_components_are_contracted_before_they_are_shuffled(spark, monkeypatch):
    from motionspark.operators import graph

    rows, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: rows.append((out := real(df)).count()) or out)
    rng = random.Random(6)
    edges = [(f"p{c}.{rng.randrange(20)}", f"s{c}.{rng.randrange(20)}") for c in range(3) for _ in range(2000)] + [("x", "x"), ("y", None)]
    got = graph.components(spark.createDataFrame(edges, "src string, dst string").coalesce(1)).collect()
    assert max(rows) < 200 and sum(rows) < 1000
    parts = {n: min(x for x in {s for e in edges for s in e if s} if x[1:2] == n[1:2]) for e in edges for n in e if n}
    assert sorted((str(r.node), r.component) for r in got) == sorted([*((n, p) for n, p in parts.items() if n not in "xy"), ("x", "x"), ("y", "y"), ("None", None)], key=lambda t: t[0])


def test_least_nodes_of_one_task():
    import numpy as np

    from motionspark.operators import graph

    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (50, 30), (200, 150), (200, 400)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        want = list(range(n))
        for _ in range(n):
            for x, y in zip(a, b, strict=True):
                want[x] = want[y] = min(want[x], want[y])
        assert graph._least(a, b, n).tolist() == want
    assert graph._least(np.arange(99), np.arange(1, 100), 100).tolist() == [0] * 100


def test_first_points_of_carriers_are_chosen_where_they_meet(spark):
    """Neither the nearest nor the least of those met is sorted or shuffled out of rows a pair (F3, F9)."""
    rows, bank, lives, spans = tracks(spark, 80)
    places = [(*next(r for r in rows if r[:2] == (t, e))[:2], 10.0 * (i % 4), 10.0 * (i % 3)) for i, (t, _, e) in enumerate(lives)]  # many at one place
    points = spark.createDataFrame(places, POINTS)
    near = joins.alive_near(points, spans, bank, 40.0, window=2).collect()
    for nearest in (True, False):
        want = {}
        for r in near:
            order = (r.dist_m, r.tracklet_id) if nearest else (r.tracklet_id, r.dist_m)
            want[r.carrier_id, r.frame_index] = min(want.get((r.carrier_id, r.frame_index), order), order)
        got = joins.alive_first(points, spans, bank, 40.0, window=2, nearest=nearest)
        assert sorted((r.carrier_id, r.frame_index, *((r.dist_m, r.tracklet_id) if nearest else (r.tracklet_id, r.dist_m))) for r in got.collect()) == sorted((*k, *v) for k, v in want.items()) and want
    assert joins.alive_first(points.limit(0), spans, bank, 40.0).count() == 0
    assert joins.alive_first(points, spans, bank, 40.0, window=2).count() < len(near)


def test_groups_do_not_meet_carriers_as_rows(spark):
    from motionspark.plans import tracks as plans

    for query in (plans.split_thinning, plans.group_spans):
        assert not any("_cx" in line and "Join" in line for line in plan(query(spark, "/root/testdata/sf0.001")))


def test_pairs_of_edges_are_not_shuffled_once_they_have_met(spark):
    """The last join is the one by group and tag (F1)."""
    from motionspark.operators.preferences import pair_preferences

    nodes = spark.createDataFrame([("g", "GROUP"), ("a", "SINGLE"), ("b", "SINGLE")], "node_id string, node_type string")
    edges = spark.createDataFrame([("e1", "MERGE", "a", "g"), ("e2", "SPLIT", "g", "b"), ("e2", "SPLIT", "g", "b")], "edge_id string, edge_type string, u string, v string")
    evidence = spark.createDataFrame([("a", "t", "x"), ("b", "t", "y")], "node_id string, tag_key string, source string")
    got = pair_preferences(nodes, edges, evidence)
    assert "tag_key" in next(line for line in plan(got) if "Join" in line)
    assert [(r.pair_id, r.group_node_type, r.in_sources, r.out_sources) for r in got.collect()] == [("g|t|e1|e2", "GROUP", ["x"], ["y"])]
