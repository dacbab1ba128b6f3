"""Contracts and sources that are no query: faults of schemas, single values, absence of tables, areas."""

from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException

from motionspark.functions import geometry
from motionspark.operators import contracts
from motionspark.sources import io


def test_faults_of_schemas(spark):
    want = contracts.schema(a="int", b="float", c="string", d="bool")
    df = spark.createDataFrame([(1, 2, "x", 3)], "a int, b long, c string, e int")
    assert contracts.schema_faults(df, want) == ["missing d", "unexpected e"]
    assert contracts.schema_faults(spark.createDataFrame([("x", 1.0, "x", True)], "a string, b float, c string, d boolean"), want) == ["a is string, not int"]
    assert contracts.schema_faults(contracts.empty(spark, want), want) == []


def test_single_values(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "b")], "x int, y string")
    assert contracts.single_value(df, "x") and not contracts.single_value(df, "y") and contracts.single_value(df.limit(0), "y")


def test_only_absence_is_none(spark, tmp_path):
    assert io.read_or_none(spark, f"file://{tmp_path}/nothing") is None
    with pytest.raises(FileNotFoundError):
        io.read_first(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/b")
    (tmp_path / "empty").mkdir()
    with pytest.raises(AnalysisException):  # a folder without any file is no table, but it is there
        io.read_or_none(spark, f"file://{tmp_path}/empty")


def test_bad_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a": \n{"a": 3}\n')
    assert sorted(r.a for r in io.read_jsonl(spark, f"file://{tmp_path}/x.jsonl", "a long", strict=False).collect()) == [1, 3]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        io.read_jsonl(spark, f"file://{tmp_path}/x.jsonl", "a long").collect()


def test_areas_of_polygons():
    assert geometry.polygon_area([(44, 34), (56, 34), (56, 42), (50, 42), (50, 38), (44, 38)]) == 72.0
