"""Merges into a keyed table against a dictionary, through failures and repeats."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from motionspark.sources.keyed_table import KeyedTable

ROW = "id long, name string, gym string, n long, updated long"


def rows_of(table):
    return {r["id"]: tuple(r)[1:] for r in table.read().collect()}


def opened(spark, tmp_path, rows, buckets=4):
    table = KeyedTable(spark, f"file://{tmp_path}/t", ["id"])
    table.create(spark.createDataFrame(rows, ROW), buckets)
    return table


def test_random_merges_against_a_dictionary(spark, tmp_path):
    rng, want = random.Random(2), {i: (f"a{i}", None, i, 0) for i in range(20)}
    table = opened(spark, tmp_path, [(i, *v) for i, v in want.items()])
    triggers = {"updated": F.lit(None).cast("long")}
    for k in range(4):
        insert, update = k != 1, k != 2
        changes = [(rng.randrange(40), rng.choice(["x", "y", None]), rng.randrange(3), j) for j in range(15)]
        triggers = {"updated": F.when(F.col("is_new"), F.lit(100 + k)).otherwise(F.coalesce("old.updated", F.lit(0)) + 1)}
        table.merge(spark.createDataFrame(changes, "id long, name string, n long, seq long"), f"m{k}", "seq", insert, update, {"gym": F.concat(F.lit("g"), F.col("change.id").cast("string"))}, triggers)
        for i, (name, n) in {c[0]: c[1:3] for c in changes}.items():
            old = want.get(i)
            if old is None and insert:
                want[i] = (name, f"g{i}", n, 100 + k)
            elif old is not None and update and (name, n) != (old[0], old[2]):
                want[i] = (name, old[1], n, old[3] + 1)
        assert rows_of(table) == want
    assert table.version() == 4


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = opened(spark, tmp_path, [(i, "a", "g", i, 0) for i in range(200)], buckets=8)
    before = table._last()["live"]
    table.merge(spark.createDataFrame([(3, "b")], "id long, name string"), "one")
    after = table._last()["live"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert rows_of(table)[3] == ("b", "g", 3, 0)
    assert table.vacuum() == 0  # the first folder still holds seven live buckets
    table.merge(spark.createDataFrame([(i, "c") for i in range(200)], "id long, name string"), "all")
    assert table.vacuum() == 2 and {v[0] for v in rows_of(table).values()} == {"c"}


def test_a_merge_that_fails_changes_nothing_and_can_be_run_again(spark, tmp_path):
    table = opened(spark, tmp_path, [(i, "a", "g", i, 0) for i in range(50)])
    before = rows_of(table)

    def broken(batches):
        for b in batches:
            if (b["id"] == 33).any():
                raise RuntimeError("lost")
            yield b

    changes = spark.createDataFrame([(i, "z", i) for i in range(40)], "id long, name string, n long").repartition(4)
    with pytest.raises(Exception, match="lost"):
        table.merge(changes.mapInPandas(broken, changes.schema), "m1")
    assert rows_of(table) == before and table.version() == 0
    assert table.merge(changes, "m1") == 1
    once = rows_of(table)
    assert table.merge(changes.withColumn("name", F.lit("again")), "m1") == 1 and rows_of(table) == once
    again = KeyedTable(spark, table.path, ["id"])
    stale = again._last()
    table.merge(changes, "m2")
    with pytest.raises(RuntimeError, match="taken"):
        again._commit({**stale, "version": 2, "merge_id": "m3"})


def test_update_from_and_defined_cases(spark, tmp_path):
    table = opened(spark, tmp_path, [(1, "a", "g1", 1, 0), (2, "b", "g2", 2, 0), (3, "c", None, 3, 0)])
    owners = spark.createDataFrame([("g1", "ann"), ("g1", "zoe"), ("g9", "x"), (None, "y")], "gym string, owner string")
    assert table.update_from(owners, {"gym": "gym"}, {"name": "owner"}, "backfill") == 1
    assert {i: v[0] for i, v in rows_of(table).items()} == {1: "zoe", 2: "b", 3: "c"}
    assert table.merge(spark.createDataFrame([(None, "n")], "id long, name string"), "nulls") == 1
    with pytest.raises(ValueError, match="has not got"):
        table.merge(spark.createDataFrame([(1, 2)], "id long, strange long"), "s")
    with pytest.raises(FileExistsError):
        table.create(table.read())
    empty = KeyedTable(spark, f"file://{tmp_path}/e", ["id"])
    with pytest.raises(FileNotFoundError):
        empty.read()
    empty.create(table.read().limit(0))
    assert empty.read().count() == 0
    empty.merge(spark.createDataFrame([(5, "n")], "id long, name string"), "first")
    assert rows_of(empty) == {5: ("n", None, None, None)}
