"""Every query of the catalogue against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from sievewright.plans import catalogue, runs

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


QUERIES, ORACLES = {**catalogue.QUERIES, **runs.QUERIES}, {**catalogue.ORACLES, **runs.ORACLES}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in frame.collect()]
    assert len(set(frame.columns)) == len(frame.columns)
    if name not in ORACLES:
        return
    query = duck.execute(ORACLES[name])
    names = [c[0] for c in query.description]
    other = query.fetchall()
    assert sorted(names) == sorted(frame.columns)
    place = [names.index(c) for c in frame.columns]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r[i] for i in place)) for r in other)
