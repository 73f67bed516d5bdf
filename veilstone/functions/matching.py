"""Regular-expression matches with code-point offsets, as native expressions.

Python's ``re`` reads text by Unicode rules; Java needs the flag ``(?U)`` for that, and ``(?Udm)`` where ``^`` means
the start of a line that ends in a line feed only. Java's own offsets count UTF-16 units, so offsets are
derived from the lengths of the pieces between matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH = "array<struct<start:int,end:int,text:string>>"


def empty(kind: str) -> Column:
    """An empty array of the given type."""
    return F.array().cast(kind)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(text: Column, pattern: str | Column, tail_group: int = 0) -> Column:
    """``ARRAY<STRUCT<start, end, text>>`` of the leftmost non-overlapping matches of ``pattern``.

    With ``tail_group`` the value is that group, which must be the end of the match; matches in which it is
    empty are left out. Null text gives null, text without a match the empty array. Texts without a match are
    read once; the pieces between matches are cut only where there are any.
    """
    p = F.lit(pattern) if isinstance(pattern, str) else pattern

    def step(acc: Column, x: Column) -> Column:
        end = acc["pos"] + F.length(x["gap"]) + F.length(x["hit"])
        found = F.struct((end - F.length(x["value"])).alias("start"), end.alias("end"), x["value"].alias("text"))
        return F.struct(end.alias("pos"), F.when(F.length(x["value"]) > 0, F.array_append(acc["out"], found)).otherwise(acc["out"]).alias("out"))

    def located(hits: Column) -> Column:
        values = F.regexp_extract_all(text, p, F.lit(tail_group)) if tail_group else hits
        rows = F.arrays_zip(F.slice(F.split(text, p, -1), 1, F.size(hits)).alias("gap"), hits.alias("hit"), values.alias("value"))
        start = F.struct(F.lit(0).alias("pos"), empty(MATCH).alias("out"))
        return F.when(F.size(hits) <= 0, empty(MATCH)).otherwise(F.aggregate(rows, start, step, lambda acc: acc["out"]))

    return F.when(text.isNotNull(), let(F.regexp_extract_all(text, p, F.lit(0)), located))


def quoted(value: Column) -> Column:
    """A pattern that matches ``value`` literally, not inside a longer ASCII word.

    A side is guarded only where the value itself has an ASCII letter or digit there.
    """
    literal = F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    left = F.when(value.rlike("^[A-Za-z0-9]"), F.lit("(?<![A-Za-z0-9])")).otherwise(F.lit(""))
    right = F.when(value.rlike("[A-Za-z0-9]\\z"), F.lit("(?![A-Za-z0-9])")).otherwise(F.lit(""))
    return F.concat(left, literal, right)
