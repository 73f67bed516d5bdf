"""One consistent form for text that looks the same but differs in its characters.

The form is a confusables skeleton: compatibility decomposition, removal of invisible characters,
replacement of every look-alike by its prototype in the public table of confusables, decomposition again. Case, accents, digits,
punctuation and the number of spaces stay visible. Two strings look the same if their skeletons are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstone.llm.unicode_data import Looks, looks
from veilstone.runtime import cut


def skeleton_column(text: F.Column | str, table: Looks) -> F.Column:
    """The skeleton of a column (Arrow batches); null stays null."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(table.skeleton, na_action="ignore")

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}  # evaluated here: annotations are strings in this module
    return F.pandas_udf(run, "string")(F.col(text) if isinstance(text, str) else text)


def _keys(table: Looks):
    def digest(x: str) -> bytes:
        return hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            look, exact = [], []
            for t in b.column("__text").to_pylist():
                s = table.skeleton(t)
                seen = bool(s) and not s.isspace()
                look.append(digest(s) if seen else None)
                exact.append(digest(t) if seen else None)
            cols = [b.column("__source"), b.column("__group"), b.column("__id"), pa.array(look, pa.binary()), pa.array(exact, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["source_table", "grp", "id", "look", "exact"])

    return run


def skeleton_keys(records: DataFrame) -> DataFrame:
    """``(source_table, grp, id, look, exact)``: 128-bit keys of skeleton and text of each record.

    ``records`` has ``source_table, grp, id, text``. Texts leave the scan only as keys, so what is
    shuffled later doesn't depend on their length. Records without group, id or visible text have
    nothing to be compared with and are left out.
    """
    inner = records.select(F.col("source_table").alias("__source"), F.col("grp").cast("string").alias("__group"), F.col("id").cast("long").alias("__id"), F.col("text").alias("__text"))
    inner = inner.where("__group is not null and __id is not null and __text is not null and __text <> ''")
    return inner.mapInArrow(_keys(looks(records.sparkSession)), "source_table string, grp string, id long, look binary, exact binary").where("look is not null")


def same_looking(records: DataFrame) -> DataFrame:
    """``(source_table, id_a, id_b)``: records of one group with equal skeletons and different strings.

    Repeated deliveries of an id count once; the smaller id comes first; records with the very same
    string aren't paired: the distinct strings of a form are, and their ids are joined to the pairs, so that the
    work grows with the result, however often a string stands.
    """
    key = ["source_table", "grp", "look"]
    keys = cut(skeleton_keys(records).dropDuplicates(["source_table", "id"]))  # texts are read once for all uses
    mixed = keys.groupBy(key).agg(F.min("exact").alias("lo"), F.max("exact").alias("hi")).where("lo <> hi").select(key)
    held = keys.join(mixed, key, "left_semi")
    strings = held.select(*key, "exact").distinct()
    pairs = strings.withColumnRenamed("exact", "exact_a").join(strings.withColumnRenamed("exact", "exact_b"), key).where("exact_a < exact_b")
    first = held.select(*key, F.col("exact").alias("exact_a"), F.col("id").alias("x"))
    other = held.select(*key, F.col("exact").alias("exact_b"), F.col("id").alias("y"))
    found = pairs.join(first, [*key, "exact_a"]).join(other, [*key, "exact_b"])
    return found.select("source_table", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
