"""Views for SQL users, notes, and helpers of the session."""

from pyspark.sql import functions as F

from veilstone.functions import sql as Q
from veilstone.operators.restore import restore
from veilstone.runtime import cut, drop_cuts, shared_dir, spread


def test_views(spark):
    spark.createDataFrame([(1, "mail a@x.example or a@x.example, 10.0.0.1"), (2, None), (3, "")], "id long, text string").createOrReplaceTempView("inbox")
    assert Q.register_views(spark, "inbox") == ["veil_functions", "veil_spans", "veil_coded"]
    assert [tuple(r) for r in spark.sql("select id, detected_language, size(codes) from veil_functions order by id").collect()] == [(1, "en", 0), (2, None, None), (3, "en", 0)]
    assert spark.sql("select span_label, span_value from veil_spans where span_label = 'IP'").first()["span_value"] == "10.0.0.1"
    row = spark.table("veil_coded").where("id = 1").select("coded_text", Q.restored(F.col("coded_text"), F.col("original_of")).alias("back")).first()
    assert tuple(row) == ("mail [EMAIL_A] or [EMAIL_A], [IP_A]", "mail a@x.example or a@x.example, 10.0.0.1")
    assert spark.table("veil_coded").where("id = 2").first()["coded_text"] is None


def test_notes(spark):
    row = spark.createDataFrame([("[A_A] [B_B]", {"[A_A]": "x"})], "t string, m map<string,string>")
    assert row.select(Q.restored_note(restore(F.col("t"), F.col("m")))).first()[0] == "1 restored; unknown: [B_B]"
    assert row.select(Q.coded_note(F.array(F.lit(1)), F.lit("zh"))).first()[0] == "1 replaced, zh"


def test_cut_and_spread(spark):
    df = spark.range(10).withColumn("x", F.uuid())
    held = cut(df)
    assert held.dtypes == df.dtypes and held.collect() == held.collect() and shared_dir(spark)
    assert spread(spark.range(3).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert drop_cuts(spark) >= 1 and drop_cuts(spark) == 0
