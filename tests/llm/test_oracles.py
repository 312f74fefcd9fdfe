"""Queries against their SQL, on the driver's tables."""

import os

import duckdb
import pytest

from notelake.llm import entry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    want = con.sql(entry.oracle_sql()[name]).fetchall()
    names = con.sql(entry.oracle_sql()[name]).columns
    got = entry.queries()[name](spark, SF)
    assert set(got.columns) == set(names)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.select(*names).collect()), key=key) == sorted(want, key=key)
