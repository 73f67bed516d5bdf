"""The engine's functions for SQL users: temporary functions of a session, made from the native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstone.functions import text as T
from veilstone.operators import codebook, restore, rules, spans

#: Name of each view's result column and what makes it of ``text``.
SCALARS: dict[str, Callable[[Column], Column]] = {
    "detected_language": T.detect_language,
    "languages": T.languages_in,
    "spaced_scripts": T.space_scripts,
    "codes": T.codes_in,
    "name_parts": T.name_parts,
    "sensitive_spans": lambda c: spans.resolve_overlaps(rules.rule_spans(c)),
}


def detect_spans(table: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per disjoint span of each row: the table's columns, then ``start, end, label, value``."""
    found = F.explode(spans.resolve_overlaps(rules.rule_spans(F.col(text_col)))).alias("__s")
    return table.select("*", found).select(*table.columns, F.col("__s.start").alias("span_start"), F.col("__s.end").alias("span_end"), F.col("__s.label").alias("span_label"), F.col("__s.text").alias("span_value"))


def register_views(spark: SparkSession, source: str, prefix: str = "veil_", text_col: str = "text") -> list[str]:
    """Temporary views over a table or view for SQL users; returns their names.

    ``<prefix>functions`` has the table's columns and one column per entry of :data:`SCALARS`, of which a query
    computes only those it selects; ``<prefix>spans`` has one row per span; ``<prefix>coded`` has the text coded as
    a session of its own in ``coded_text``, with ``original_of`` to restore it.
    """
    base = spark.table(source)
    functions = base.select("*", *[make(F.col(text_col)).alias(name) for name, make in SCALARS.items()])
    found = base.withColumn("__spans", spans.resolve_overlaps(rules.rule_spans(F.col(text_col))))
    found = found.withColumn("__codes", codebook.document_codes(F.col("__spans")))
    coded = found.select(*base.columns, codebook.obfuscate(F.col(text_col), F.col("__spans"), F.col("__codes"))["text"].alias("coded_text"), F.map_from_arrays(F.map_values("__codes"), F.map_keys("__codes")).alias("original_of"))
    views = {"functions": functions, "spans": detect_spans(base, text_col), "coded": coded}
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in views]


def restored(text: Column, original_of: Column) -> Column:
    """The restored text alone."""
    return restore.restore(text, original_of)["text"]


def coded_note(code_spans: Column, lang: Column) -> Column:
    """How many values were replaced, and the language: the note under a coded reply."""
    return F.concat(F.size(code_spans).cast("string"), F.lit(" replaced, "), lang)


def restored_note(result: Column) -> Column:
    """How many codes were restored, and which are unknown: the note under a restored reply."""
    unknown = F.when(F.size(result["unknown"]) > 0, F.concat(F.lit("; unknown: "), F.array_join(result["unknown"], ", "))).otherwise(F.lit(""))
    return F.concat(result["restored"].cast("string"), F.lit(" restored"), unknown)
