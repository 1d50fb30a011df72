import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sluice.plans import catalog, io_catalog

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.QUERIES | io_catalog.QUERIES, catalog.ORACLES | io_catalog.ORACLES


def rounded(row):
    return tuple(round(v, 9) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = QUERIES[name](spark, DATA), con.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    assert sorted((rounded(r) for r in got.select(*columns).collect()), key=repr) == sorted((rounded(r[i] for i in place) for r in want.fetchall()), key=repr)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
