"""The driver's contract on the smallest tables, against DuckDB."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from veilstone.plans import catalogue


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = catalogue.QUERIES[name](spark, data)
    want = con.sql(catalogue.ORACLES[name])
    names, rows = want.columns, want.fetchall()
    cols = sorted(got.columns)
    assert sorted(names) == cols
    assert sorted(map(repr, map(tuple, got.select(*cols).collect()))) == sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in rows)
