"""What the physical plans must and must not have."""

import contextlib
import io

from pyspark.sql import functions as F

from veilstone.operators import fold as D
from veilstone.operators import restore as X
from veilstone.operators import rules as R
from veilstone.operators import spans as S


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_rules_are_one_projection_over_the_text_column(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("lang = 'en'")
    text = plan(docs.select(S.resolve_overlaps(R.rule_spans(F.col("text")))))
    assert "Exchange" not in text and "Python" not in text and "Arrow" not in text
    assert "ReadSchema: struct<text:string,lang:string>" in text and "EqualTo(lang,en)" in text


def test_fold_shuffles_once_by_session(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").repartition(8)  # enough partitions as they are
    text = plan(D.obfuscate_sessions(docs))
    assert text.count("hashpartitioning(session_id") == 1 and "MapInArrow" in text and "FlatMapGroups" not in text
    assert "created_at" not in text.split("ReadSchema")[1].split("\n")[0]


def test_restoring_joins_codes_instead_of_broadcasting_books(spark, data):
    results = spark.read.parquet(f"{data}/obfuscate_results.parquet")
    book = spark.read.parquet(f"{data}/codebook.parquet").select("session_id", "code", "original")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(X.restore_table(results, book, "result_id", "session_id", "text"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Broadcast" not in text and "Cartesian" not in text and "NestedLoop" not in text


def test_tables_of_a_scope_are_deleted_at_its_end(spark):
    import os

    from veilstone import runtime

    runtime.drop_cuts(spark)
    kept = runtime.cut(spark.range(3))
    with runtime.scope(spark):
        inner = runtime.cut(spark.range(4))
        assert inner.count() == 4
        path = runtime._CUTS[-1]
    assert kept.count() == 3 and len(runtime._CUTS) == 1 and not os.path.exists(path.removeprefix("file://"))
    assert runtime.drop_cuts(spark) == 1


def test_tables_of_a_fixed_size_are_checked(spark):
    import pytest

    from veilstone import runtime

    assert len(runtime.fixed_table(spark.range(5), 5)) == 5
    with pytest.raises(ValueError):
        runtime.fixed_table(spark.range(6), 5)
