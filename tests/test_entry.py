import os

import duckdb
import pytest

import __spark_entry__ as entry
from parcelyard import catalog_queries

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalog_queries.ORACLE_SQL))
def test_catalog_query_matches_sql(spark, name):
    df = catalog_queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as from '{SF}/{f}'")
    want = con.sql(catalog_queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    clean = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted((tuple(clean(x) for x in r) for r in df.select(*cols).collect()), key=repr)
    exp = sorted((tuple(clean(x) for x in r) for r in want.project(", ".join(f'"{c}"' for c in cols)).fetchall()), key=repr)
    assert got == exp
