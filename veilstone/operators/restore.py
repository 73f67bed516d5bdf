"""Restoring coded text, and ranking sessions by what they can restore."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from veilstone.functions.matching import let
from veilstone.functions.text import CODE, codes_in
from veilstone.runtime import cut, fixed_table

#: Sets of codes that others of their part are compared with, when those that can't be the best are left out.
KEPT = 1024
#: Codes of all sets together, and sets, up to which texts are ranked against them as they are read.
MOST_CODES, MOST_SETS = 200_000, 4096


def restore(text: Column, originals: Column) -> Column:
    """``STRUCT<text, restored, unknown>``: one pass from left to right, what is put back isn't read again.

    ``originals`` maps codes to originals (null: none). ``restored`` counts occurrences; unknown codes stay,
    and are listed once, by first occurrence.
    """
    known = F.coalesce(originals, F.create_map().cast("map<string,string>"))

    def put(hits: Column) -> Column:
        back = F.transform(hits, lambda c: F.coalesce(F.element_at(known, c), c))
        joined = F.array_join(F.flatten(F.zip_with(F.split(text, CODE, -1), back, lambda g, c: F.array(g, F.coalesce(c, F.lit(""))))), "")
        restored = F.size(F.filter(hits, lambda c: F.map_contains_key(known, c)))
        unknown = F.array_distinct(F.filter(hits, lambda c: ~F.map_contains_key(known, c)))
        return F.struct(joined.alias("text"), restored.alias("restored"), unknown.alias("unknown"))

    return F.when(text.isNotNull(), let(F.regexp_extract_all(text, F.lit(CODE), F.lit(0)), put))


def match_count(text: Column, codes: Column) -> Column:
    """How many distinct codes of the text are in the array ``codes``."""
    return F.size(F.array_intersect(codes_in(text), codes))


def restore_table(replies: DataFrame, lookup: DataFrame, id_col: str, session_col: str, text_col: str) -> DataFrame:
    """``(id, text, restored, unknown)`` of replies by the lookup ``(session_id, code, original)``.

    The codes of each reply are exploded and joined, so that neither a session's whole lookup nor a broadcast of
    it is needed. Replies without a session restore nothing.
    """
    base = replies.select(F.col(id_col).alias("id"), F.col(session_col).alias("session_id"), F.col(text_col).alias("text"))
    wanted = base.select("id", "session_id", F.explode(codes_in(F.col("text"))).alias("code"))
    found = wanted.join(lookup, ["session_id", "code"]).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("code", "original"))).alias("m"))
    return base.join(found, "id", "left").select("id", restore(F.col("text"), F.col("m")).alias("r")).select("id", "r.*")


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows ``(ord, session_id, held)``, in their order, that no earlier one holds all codes of; the first :data:`KEPT` are compared with."""
    masks, n = {}, 0  # by code: which of those compared with hold it, as bits
    for b in batches:
        left = []
        for i, held in enumerate(b.column("held").to_pylist()):
            over = -1
            for c in held:
                if not (over := over & masks.get(c, 0)):
                    break
            if over:
                continue
            left.append(i)
            if n < KEPT:
                for c in held:
                    masks[c] = masks.get(c, 0) | 1 << n
                n += 1
        yield b.take(pa.array(left, pa.int32()))


def _ranked(masks: dict[str, int], sessions: list[str]) -> Callable:
    """The first of the ``sessions`` that hold most codes of each text; ``masks``: by code, which hold it, as bits."""

    def best(codes: list[str]) -> tuple[int, int]:
        planes: list[int] = []  # binary digits of the count, a bit for each session
        for c in codes:
            carry = masks.get(c, 0)
            for k in range(len(planes)):
                planes[k], carry = planes[k] ^ carry, planes[k] & carry
            if carry:
                planes.append(carry)
        most, among = 0, -1
        for k in reversed(range(len(planes))):
            if among & planes[k]:
                most, among = most | 1 << k, among & planes[k]
        return most, (among & -among).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(i, *best(codes)) for i, codes in enumerate(b.column("codes").to_pylist())]
            got = [x for x in got if x[1]]
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array([i for i, _, _ in got], pa.int32())), pa.array([sessions[s] for _, _, s in got], pa.string()), pa.array([m for _, m, _ in got], pa.int64())], ["id", "session_id", "matches"])

    return run


def _sets_to_compare(held: DataFrame, part_rows: int = 4096) -> DataFrame:
    """``held`` without most sets of codes that are part of an earlier session's, which can't be the best of any text.

    Rounds over parts of at most ``part_rows`` sets, until one part is left or no more than half of them go.
    """
    held = cut(held)
    n = held.count()
    while True:
        parts = max(1, -(-n // part_rows))
        held = cut(held.repartition(parts, "ord").sortWithinPartitions("ord").mapInArrow(_thinned, held.schema))
        before, n = n, held.count()
        if parts == 1 or 2 * n > before:
            return held


def recommend(texts: DataFrame, lookup: DataFrame, order: DataFrame, id_col: str = "id", text_col: str = "text", most_codes: int = MOST_CODES) -> DataFrame:
    """``(id, session_id, matches)``: the session that can restore most distinct codes of each text.

    ``order(session_id, ord)`` breaks ties, the least first. Texts that no session can restore have no row. Sessions whose
    codes an earlier one holds too are left out first, since they can't be the best. If at most :data:`MOST_SETS` sets of at most
    ``most_codes`` codes in all are left, each text is ranked against them as it is read; else distinct sets are joined by
    code, with the same result.
    """
    rows = texts.select(F.col(id_col).alias("id"), F.array_sort(codes_in(F.col(text_col))).alias("codes")).where(F.size("codes") > 0)
    ranks = order.select("session_id", F.col("ord").cast("long").alias("ord"))
    held = lookup.groupBy("session_id").agg(F.array_sort(F.collect_set("code")).alias("held")).join(ranks, "session_id")  # bounded by one code book
    held = held.groupBy("held").agg(F.min(F.struct("ord", F.col("session_id").cast("string").alias("session_id"))).alias("first"))  # the first session of each set
    held = _sets_to_compare(held.select("first.ord", "first.session_id", "held").where(F.size("held") > 0))
    left = held.agg(F.count("*").alias("sets"), F.coalesce(F.sum(F.size("held")), F.lit(0)).alias("codes")).first()
    if left["sets"] <= MOST_SETS and left["codes"] <= most_codes:
        masks, sessions = {}, []
        for r in sorted(fixed_table(held, MOST_SETS), key=lambda r: r["ord"]):
            for c in r["held"]:
                masks[c] = masks.get(c, 0) | 1 << len(sessions)
            sessions.append(r["session_id"])
        kinds = StructType([rows.schema["id"], StructField("session_id", StringType()), StructField("matches", LongType(), False)])
        return rows.mapInArrow(_ranked(masks, sessions), kinds)
    wanted = rows.select("codes").distinct().select("codes", F.explode("codes").alias("code"))
    counted = wanted.join(held.select("ord", F.explode("held").alias("code")), "code").groupBy("codes", "ord").agg(F.count("*").alias("matches"))
    best = counted.groupBy("codes").agg(F.max(F.struct("matches", (-F.col("ord")).alias("o"))).alias("b")).select("codes", F.col("b.matches").alias("matches"), (-F.col("b.o")).alias("ord"))
    return rows.join(best, "codes").join(held.select("ord", "session_id"), "ord").select("id", "session_id", "matches")


def sticky_choice(events: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``events`` with ``chosen``: what is chosen after each, by ``best``, the recommendation, and ``manual``, a choice by hand.

    A recommendation is taken only where it differs from that of the event before (one without any forgets it), so that
    a choice by hand stays until the recommendation changes; before any choice there is null.
    """
    window = Window.partitionBy(group).orderBy(*order)
    turned = F.col("best").isNotNull() & ~F.col("best").eqNullSafe(F.lag("best").over(window))
    picked = F.coalesce("manual", F.when(turned, F.col("best")))
    return events.withColumn("__picked", picked).withColumn("chosen", F.last("__picked", ignorenulls=True).over(window)).drop("__picked")
