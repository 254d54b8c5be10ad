"""Every query with SQL gives DuckDB's rows; the others are held against brute force elsewhere."""

import math
import os

import duckdb
import pytest

from lociq.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value:.6f}".rstrip("0").rstrip(".")
    if hasattr(value, "isoformat"):
        return value.isoformat().removesuffix("T00:00:00")
    return str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    ours = QUERIES[name](spark, SF)
    theirs = duck.sql(ORACLES[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    at = [theirs.columns.index(c) for c in columns]
    want = sorted(tuple(plain(row[k]) for k in at) for row in theirs.fetchall())
    got = sorted(tuple(plain(row[c]) for c in columns) for row in ours.collect())
    assert got == want


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "role", "reference_id"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
