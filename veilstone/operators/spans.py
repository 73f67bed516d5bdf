"""Algebra of spans inside one document, on arrays of span structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstone.functions.matching import empty, matches, quoted
from veilstone.functions.text import name_parts
from veilstone.operators.rules import SPANS

#: Order of propagated values in ties, after all detectors.
PRIO_PROPAGATED = 90


def sorted_spans(spans: Column) -> Column:
    """By start, longer first, higher score first, then by the order of the detectors."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (s["start"] - s["end"]).alias("b"), (-s["score"]).alias("c"), s["prio"].alias("d"), s.alias("span")))
    return F.transform(F.array_sort(keyed), lambda x: x["span"])


def resolve_overlaps(spans: Column) -> Column:
    """Disjoint spans: the earlier start wins over the longer span, that over the higher score."""

    def step(acc: Column, s: Column) -> Column:
        free = s["start"] >= acc["end"]
        return F.struct(F.when(free, s["end"]).otherwise(acc["end"]).alias("end"), F.when(free, F.array_append(acc["kept"], s)).otherwise(acc["kept"]).alias("kept"))

    start = F.struct(F.lit(-1).alias("end"), empty(SPANS).alias("kept"))
    return F.aggregate(sorted_spans(spans), start, step, lambda acc: acc["kept"])


def drop_ignored(spans: Column, ignored: Column) -> Column:
    """Without spans whose exact text is in ``ignored``, an array of strings; null ignores nothing."""
    return F.filter(spans, lambda s: ~F.coalesce(F.array_contains(ignored, s["text"]), F.lit(False)))


def keep_scope(spans: Column, scope: Column) -> Column:
    """Only people where the scope is ``names``; to be applied before overlaps are resolved."""
    return F.filter(spans, lambda s: (s["label"] == "PERSON") | F.coalesce(scope != "names", F.lit(True)))


def known_values(spans: Column, known: Column | None = None) -> Column:
    """``MAP<value, label>`` of values longer than one character; spans override known ones, later spans earlier ones."""
    pairs = F.transform(F.filter(spans, lambda s: F.length(s["text"]) > 1), lambda s: F.struct(s["text"].alias("key"), s["label"].alias("value")))
    if known is not None:
        pairs = F.concat(F.filter(F.transform(F.map_entries(known), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))), lambda e: F.length(e["key"]) > 1), pairs)
    # the last entry of each key wins
    last = F.filter(F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), p["value"].alias("value"), i.alias("i"))), lambda p: F.size(F.filter(F.slice(pairs, p["i"] + 2, F.size(pairs) + 1), lambda q: q["key"] == p["key"])) == 0)
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["key"], p["value"])))


def text_aliases(persons: Column) -> Column:
    """Parts of the names in an array that belong to exactly one of them and are none of them."""
    owned = F.flatten(F.transform(F.array_distinct(persons), lambda n: F.transform(F.array_distinct(name_parts(n)), lambda p: p)))
    return F.filter(F.array_distinct(owned), lambda p: (F.size(F.filter(owned, lambda q: q == p)) == 1) & ~F.array_contains(persons, p))


def find_all(text: Column, values: Column, prio: int = PRIO_PROPAGATED) -> Column:
    """Every non-overlapping occurrence of each key of ``values`` (``MAP<value, label>``) as spans; blank values are skipped."""
    entries = F.filter(F.map_entries(values), lambda e: e["key"].rlike("(?U)\\S") & text.contains(e["key"]))
    spans = F.transform(
        entries,
        lambda e: F.transform(
            matches(text, quoted(e["key"])),
            lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), e["value"].alias("label"), m["text"].alias("text"), F.lit(1.0).alias("score"), F.lit(prio).alias("prio")),
        ),
    )
    return F.flatten(spans)


def unique_aliases(names: DataFrame, group: str, name: str, key: str) -> DataFrame:
    """``(group, part, key)``: parts of names that one key of the group owns and that are no full name there."""
    parts = names.select(group, F.col(key).alias("key"), F.explode(F.array_distinct(name_parts(F.col(name)))).alias("part"))
    owned = parts.groupBy(group, "part").agg(F.min("key").alias("key"), F.max("key").alias("last")).where("key = last").drop("last")
    return owned.join(names.select(group, F.col(name).alias("part")).distinct(), [group, "part"], "left_anti")


def explode_spans(documents: DataFrame, spans: Column, keep: list[str]) -> DataFrame:
    """One row per span of each document."""
    return documents.select(*keep, F.inline(spans))
