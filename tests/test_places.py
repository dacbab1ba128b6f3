"""Nearest others and how many are near, against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from motionspark.operators import joins, places


def of_all_pairs(who, x, y, radius):
    d = np.sqrt((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2)
    same = who[:, None] == who
    least, near = np.where(same, np.inf, d).min(1), ((d <= radius) & ~same).sum(1)
    for w in set(who):
        least[who == w], near[who == w] = least[who == w].min(), near[who == w].sum()
    return [None if s.all() else v for s, v in zip(same, least, strict=True)], near


@pytest.mark.parametrize("kind", ["anywhere", "levels", "edges", "one column", "far apart"])
def test_strips_against_all_pairs(kind):
    rng = np.random.default_rng(3)
    for n in (1, 2, 30, 150):
        x, y = rng.random(n) * 500, rng.random(n) * 100
        if kind == "levels":
            x, y = np.round(x, 2), np.floor(y)
        elif kind == "edges":  # distances of exactly the radius
            x, y = np.floor(x / 20) * 8, np.floor(y / 10) * 8
        elif kind == "one column":
            x, y = np.zeros(n) + 7, np.floor(y / 3)
        elif kind == "far apart":
            x, y = rng.choice([0.0, 1e6, 1e6 + 24], n), rng.choice([0.0, 32.0, -3e5], n)
        for names in (np.arange(n), rng.integers(0, n, n)):
            who = names.astype(str).astype(object)
            got, want = places.nearest_and_near(who, x, y, 40.0), of_all_pairs(who, x, y, 40.0)
            assert got[0] == want[0] and (got[1] == want[1]).all()


def test_persons_of_a_frame_do_not_meet_as_pairs(spark):
    rows = spark.range(300).selectExpr("'t' || id AS tracklet_id", "id % 2 AS frame_index", "CAST(id * 37 % 100 AS double) AS x_m", "CAST(id % 7 AS double) AS y_m")
    got = joins.neighbours(rows, 9.0)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    frame = [r for r in rows.collect() if r.frame_index == 1]
    least, near = of_all_pairs(*(np.array([r[c] for r in frame]) for c in ("tracklet_id", "x_m", "y_m")), 9.0)
    assert {r.tracklet_id: (r.nn_dist, r.n_near) for r in got.collect() if r.frame_index == 1} == {r.tracklet_id: (d, n) for r, d, n in zip(frame, least, near, strict=True)}
