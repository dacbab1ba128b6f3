"""Every registered query that SQL can express, against DuckDB on the same tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from motionspark.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def value(x) -> str:
        if isinstance(x, (list, tuple)) or hasattr(x, "tolist") and getattr(x, "ndim", 0):
            return str([value(y) for y in x])
        if pd.isna(x):
            return "null"
        return f"{float(x):.6g}" if "float" in type(x).__name__ or type(x).__name__ == "Decimal" else str(x)

    return sorted(tuple(value(x) for x in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, DIR).toPandas(), duck.execute(catalog.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_the_others_give_rows(spark, name):
    out = catalog.queries()[name](spark, DIR)
    assert out.count() > 0
    assert len(set(out.columns)) == len(out.columns)


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert catalog.FLAGSHIP in entry.queries()
