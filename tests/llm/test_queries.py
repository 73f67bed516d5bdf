"""The registered queries on the smallest tables: columns as defined, rows distinct, SQL where there is any."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from veilstone.llm import catalogue

COLUMNS = {
    "p1_found": [("span_id_a", "bigint"), ("span_id_b", "bigint")],
    "p2_found": [("result_id", "bigint"), ("lang", "string")],
    "p3_found": [("source_table", "string"), ("id_a", "bigint"), ("id_b", "bigint")],
    "p4_found": [("result_id", "bigint")],
    "p5_found": [("source_table", "string"), ("id_a", "bigint"), ("id_b", "bigint")],
    "p6_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p8_found": [("doc_id_a", "bigint"), ("doc_id_b", "bigint")],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_found_queries(spark, data, name):
    got = entry.queries()[name](spark, data)
    assert got.dtypes == COLUMNS[name]
    rows = [tuple(map(str, r)) for r in got.collect()]
    assert len(rows) == len(set(rows))
    if got.columns[-1].endswith("_b"):
        assert all(int(r[-2]) < int(r[-1]) for r in rows)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(COLUMNS)))
def test_other_queries_run(spark, data, name):
    assert catalogue.QUERIES[name](spark, data).count() > 0


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_queries_equal_sql(spark, data, name):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = con.sql(catalogue.ORACLES[name])
    names, rows = want.columns, want.fetchall()
    got = catalogue.QUERIES[name](spark, data)
    cols = sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*cols).collect()))) == sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in rows)
