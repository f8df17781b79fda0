"""Queries of this folder against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from sievewright.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    frame = queries.QUERIES[name](spark, SF)
    told = con.execute(queries.ORACLES[name])
    names, rows = [c[0] for c in told.description], told.fetchall()
    assert sorted(names) == sorted(frame.columns)
    assert sorted(map(repr, map(tuple, frame.select(names).collect()))) == sorted(map(repr, rows))
