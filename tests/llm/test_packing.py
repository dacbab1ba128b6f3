"""Certificates of groups, and how they steer the exchange."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd

from motionspark.llm import packing


def test_certified_groups_give_back_one_sequence_others_all_unfilled(spark):
    # 0: six pieces of 60 need six sequences of 100, certified; 1: best fit decreasing takes one too many
    groups = {0: [60] * 6, 1: [59, 57, 57, 50, 45, 39, 30, 30, 22]}
    seen = {}
    for lengths in groups.values():
        rows = [(i, 0, 0, n, 0, 0) for i, n in enumerate(lengths)]
        got = packing._pack(spark.createDataFrame(rows, packing.PIECES), 1, 0, 100).toPandas()
        gap = got["sequence_id"].nunique() - packing.lower_bound(np.array(lengths), np.ones(len(lengths), np.int64), 100)
        assert set(got["gap"]) == {gap}
        back = got[got["again"]]["sequence_id"].nunique()
        unfilled = got[got["filled"] < 100]["sequence_id"].nunique()
        assert back == (unfilled if gap else min(1, unfilled))
        seen[gap > 0] = back
    assert seen == {False: 1, True: 5}


def check(got: pd.DataFrame, lengths: list[int], capacity: int) -> int:
    assert sorted(zip(got["doc_id"], got["length"], strict=True)) == list(enumerate(lengths))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum()[:-1]]
        assert g["length"].sum() <= capacity
    return got["sequence_id"].nunique()


def test_exchange_over_many_groups_is_near_the_bound(spark):
    for seed, most in ((1, 60), (2, 100)):
        rng = random.Random(seed)
        lengths = [rng.randrange(1, most) for _ in range(4000)]
        pieces = spark.createDataFrame([(i, 0, 0, n, 0, i * 7919) for i, n in enumerate(lengths)], packing.PIECES)
        n = check(packing.pack_pieces(pieces, 100, group_pieces=400).toPandas(), lengths, 100)
        alone = check(packing._pack(pieces, 10, 0, 100).toPandas(), lengths, 100)
        bound = packing.lower_bound(np.array(lengths), np.ones(len(lengths), np.int64), 100)
        whole = packing.best_fit_decreasing(np.array(lengths), 100)[0].max() + 1
        assert bound <= n < alone
        assert n <= whole * 1.02 + 1
