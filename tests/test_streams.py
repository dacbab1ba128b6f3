"""Streams cut and mixed at random give what the batch forms give, with state that does not grow."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest

from motionspark.operators import lookup, machines
from motionspark.streaming import ordered

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
DELAY = 40


def play(spark, tmp_path, rows, schema, build, seed):
    """Run ``build`` over ``rows``, whose first value is their second, dealt to files out of order by less than DELAY seconds."""
    rng = random.Random(seed)
    dealt = sorted(rows, key=lambda r: r[0] + rng.random() * (DELAY - 2))
    cuts = sorted(rng.sample(range(1, len(dealt)), 4))
    parts = [dealt[a:b] for a, b in zip([0, *cuts], [*cuts, len(dealt)], strict=True)]
    blank = [None] * (len(rows[0]) - 2)
    parts += [[(10**7 + i, "end", *blank)] for i in range(2)]
    for i, part in enumerate(parts):
        at = spark.createDataFrame([(START + timedelta(seconds=r[0]), *r[1:]) for r in part], schema)
        at.coalesce(1).write.parquet(f"{tmp_path}/in/{i:03d}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    name = f"out{abs(hash(str(tmp_path)))}"
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        q = build(source.withWatermark("ts", f"{DELAY} seconds")).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    out = sorted(tuple(r) for r in spark.table(name).collect())
    spark.catalog.dropTempView(name)
    return out


def test_engagements(spark, tmp_path):
    rng = random.Random(1)
    params = {"near": 1.0, "far": 2.0, "n_start": 2, "n_end": 3, "least": 2}
    rows = [(f, a, b, f, rng.choice([0.5, 0.8, 1.5, 2.5, 3.0]) if rng.random() < 0.95 else None) for a, b in (("p", "q"), ("p", "r")) for f in range(0, 200) if rng.random() < 0.9]
    schema = "ts timestamp, person_a string, person_b string, frame_index long, dist_m double"
    got = play(spark, tmp_path, rows, schema, lambda s: ordered.engagements(s, "ts", 10**6, (0, 199), **params), 2)
    batch = spark.createDataFrame([r[1:] for r in rows], "person_a string, person_b string, frame_index long, dist_m double")
    assert got == sorted(tuple(r) for r in machines.engagements(batch, session=(0, 199), **params).collect())
    assert len(got) > 4


OCCLUSION = {"window": 5, "onset": 2, "drop_bottom": 0.2, "drop_height": 0.2, "recover_bottom": 0.1, "recover_height": 0.1, "recover": 2, "jump": 5.0, "least": 2, "most": 12, "gap": 3}


def boxes(rng, n):
    y2, out = 100.0, []
    while len(out) < n:
        cut = rng.random() < 0.15
        for _ in range(rng.randrange(1, 9)):
            low = y2 - rng.choice([25, 30, 40]) if cut else y2 + rng.choice([-1, 0, 1])
            out.append((None, None) if rng.random() < 0.05 else (0.0, low))
    return out[:n]


def test_occlusions(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f, t, f, *b) for t in ("a", "b") for f, b in enumerate(boxes(rng, 150))]
    got = play(spark, tmp_path, rows, "ts timestamp, tracklet_id string, frame_index long, y1 double, y2 double", lambda s: ordered.occlusions(s, "ts", 10**6, **OCCLUSION), 4)
    batch = spark.createDataFrame([r[1:] for r in rows], "tracklet_id string, frame_index long, y1 double, y2 double")
    assert got == sorted(tuple(r) for r in machines.occlusions(batch, **OCCLUSION).collect())
    assert len(got) > 3


def whole_spans(rows, window, onset, drop_bottom, drop_height, recover_bottom, recover_height, recover, jump, least, most, gap):
    """The spans by lists over the whole track: found first, then cut to length and joined."""
    found, spans, i, heights, bottoms, flags = [], [], 0, [], [], []
    start = base = None
    whole, before = 0, None
    for i, (_, h, b) in enumerate(rows):
        moved = abs(b - before) if b is not None and before is not None else 0.0
        before = b
        fit = h is not None and b is not None and h > 0
        if start is None and not (fit and heights):
            if fit:
                heights.append(h)
                bottoms.append(b)
            continue
        if start is None:
            base = (pd.Series(bottoms[-window:]).median(), pd.Series(heights[-window:]).median())
        rise, fall = (max(0.0, (base[0] - b) / base[1]), max(0.0, (base[1] - h) / base[1])) if fit else (1e9, 1e9)
        if start is not None:
            whole = whole + 1 if rise < drop_bottom and fall < drop_height and rise <= recover_bottom and fall <= recover_height else 0
            if whole >= recover:
                found.append((start, i))
                start, flags = None, []
            continue
        flags.append(rise >= drop_bottom and fall >= drop_height and moved >= jump)
        last = flags[-window:]
        if len(last) == window and sum(last) >= onset:
            start, whole = max(0, i - window + 1 + last.index(True)), 0
        else:
            heights.append(h)
            bottoms.append(b)
    if start is not None:
        found.append((start, i))
    for s, e in found:
        if e - s + 1 >= least:
            e = min(e, s + most - 1)
            if spans and s - spans[-1][1] - 1 <= gap:
                spans[-1] = (spans[-1][0], e)
            else:
                spans.append((s, e))
    return [(rows[a][0], rows[b][0]) for a, b in spans]


@pytest.mark.parametrize("seed", range(6))
def test_occlusion_steps_against_lists_and_through_packing(seed):
    rng = random.Random(seed)
    params = OCCLUSION | {"window": rng.choice([1, 3, 5]), "onset": 1, "gap": rng.choice([0, 3, 9]), "least": rng.choice([1, 2, 4])}
    rows = [(10 + 3 * i, None if b[0] is None else b[1] - b[0], b[1]) for i, b in enumerate(boxes(rng, 400))]
    assert machines.occlusion_spans(rows, **params) == whole_spans(rows, **params)
    machine, out, sizes = machines.Occlusion(**params), [], []
    for row in rows:
        fresh = machines.Occlusion(**params)
        packed = json.dumps(machine.packed())
        sizes.append(len(packed))
        fresh.unpack(json.loads(packed))
        machine = fresh
        out += [tuple(x) for x in machine.step(*row)]
    assert out + [tuple(x) for x in machine.finish()] == whole_spans(rows, **params)
    assert max(sizes[200:]) <= max(sizes[:200]) + 40  # what is held does not grow with the rows


EVENT = "ts timestamp, session_id string, cam_id string, clip_id string, done boolean, tag_bytes long, end_ms long"
MS = int(START.timestamp() * 1000)


def batch_events(spark, rows):
    return spark.createDataFrame([(r[1], r[2], r[3], MS + r[0] * 1000, *r[4:]) for r in rows], "session_id string, cam_id string, clip_id string, at long, done boolean, tag_bytes long, end_ms long")


def test_readiness(spark, tmp_path):
    """All cameras early, one timed out, none by then, no tags, tags too late, a late clip, never; and sessions at random."""
    end = MS + 100_000
    named = [
        (1, "early", "a", "1", True, 5, end), (2, "early", "b", "2", False, 0, end), (3, "early", "b", "2", True, 0, end),
        (1, "timeout", "a", "1", True, 5, end), (2, "timeout", "b", "2", False, 0, end),
        (1, "none", "a", "1", False, 5, end), (150, "none", "a", "1", True, 0, end),
        (1, "untagged", "a", "1", True, 0, end), (120, "untagged", "b", "2", True, 9, end),
        (1, "late", "a", "1", True, 5, end), (130, "late", "a", "3", False, 0, end), (140, "late", "a", "3", True, 0, end),
        (1, "never", "a", "1", False, 5, end), (110, "exact", "a", "1", True, 1, end), (110, "exact", "b", "1", False, 0, end), (5, "open", "a", "1", True, 1, None),
    ]
    rng = random.Random(6)
    made = [(rng.randrange(200), f"s{rng.randrange(8)}", f"c{rng.randrange(3)}", f"{rng.randrange(4)}", rng.random() < 0.5, rng.choice([0, 0, 0, 1]), end) for _ in range(150)]
    want = sorted(tuple(r) for r in lookup.readiness(batch_events(spark, named + made), 10_000).collect())
    got = {r[0]: r[1:] for r in want}
    ring = MS + 110_000
    assert got["early"] == (ring, "ready", "a,b", "")
    assert got["timeout"] == (ring, "ready", "a", "b")
    assert got["none"] == (MS + 150_000, "ready", "a", "")
    assert got["untagged"] == got["late"][:0] + (ring, "tag_required", "a", "")
    assert got["late"] == (ring, "ready", "a", "")
    assert got["exact"] == (ring, "ready", "a", "b")
    assert "never" not in got and "open" not in got
    assert play(spark, tmp_path, named + made, EVENT, lambda s: ordered.readiness(s, "ts", 10_000, 500_000), 7) == want


def test_decided_sessions_hold_little_and_end():
    machine = ordered.Readiness(10)
    assert machine.step(1, [("a", str(i), True, 1, 100) for i in range(50)]) == []
    assert machine.wake() == 110
    held = len(json.dumps(machine.packed()))
    assert machine.alarm(110) == [(110, "ready", "a", "")]
    assert len(json.dumps(machine.packed())) < held / 5 and machine.wake() is None
    assert machine.step(500, [("b", "x", True, 1, 100)]) == [] and machine.finish() == []
