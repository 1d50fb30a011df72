"""Queries of the joins over whole tables, on a size where users of all ids have errors."""

import glob
import os

import duckdb

from sluice.plans import catalog

DATA = "/root/testdata/sf0.01"


def sql(text):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con.sql(text)


def test_all_error_events_are_joined(spark):
    rows = catalog.QUERIES["right_only_records"](spark, DATA).where("n_right1 > 0").collect()
    users, events = sql("SELECT count(DISTINCT user_id), count(*) FROM events WHERE event_type = 'error'").fetchall()[0]
    assert (len(rows), sum(r.n_right1 for r in rows)) == (users, events) and max(r.k for r in rows) >= 100


def test_modes_differ_on_whole_tables(spark):
    assert len({catalog.QUERIES[f"record_join_{m.value}"](spark, DATA).count() for m in catalog.JoinMode}) == len(catalog.JoinMode)
