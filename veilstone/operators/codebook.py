"""Code books as tables: ``(session_id, original, label, code, ord)`` for live and ``ignored`` for retired originals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstone.functions.matching import empty, let
from veilstone.functions.text import code, label_of_code
from veilstone.runtime import cut

CODE_SPANS = "array<struct<start:int,end:int,label:string,code:string>>"


#: Rows of one group that a single task numbers; larger groups are numbered in ranges.
GROUP_ROWS = 1_000_000


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``rows`` with their number from 0 within the group by order, which must be total within the group.

    Where a group has more than ``group_rows`` rows, rows are range-partitioned by group and order, numbered within
    the partition and shifted by what earlier partitions hold of the group, so that no task sorts a whole hot
    group. The numbers are the same either way.
    """
    largest = rows.groupBy(*group).count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    if (largest["most"] or 0) <= group_rows:
        return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1).cast("long"))
    # written once: both uses below must see the same ranges
    ranged = cut(rows.repartitionByRange(-(-largest["all"] // group_rows), *group, *order).withColumn("__part", F.spark_partition_id()))
    inner = ranged.withColumn("__own", F.row_number().over(Window.partitionBy("__part", *group).orderBy(*order)) - 1)
    held = inner.groupBy("__part", *group).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = held.withColumn("__skip", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return inner.join(shift, ["__part", *group]).withColumn(name, (F.col("__own") + F.col("__skip")).cast("long")).drop("__part", "__own", "__skip")


def assign_codes(spans: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The code book of sessions without linked people, without a fold over their documents.

    ``spans(session_id, seq, start, label, text)``; each original takes the label of its first occurrence and
    the next number of that label, in the order of first occurrences. Null sessions, labels or texts have no code.
    """
    rows = spans.where("session_id is not null and label is not null and text is not null")
    first = rows.groupBy("session_id", F.col("text").alias("original")).agg(F.min(F.struct("seq", "start", "label")).alias("f"))
    first = cut(first.select("session_id", "original", F.col("f.label").alias("label"), F.col("f.seq").alias("seq"), F.col("f.start").alias("start")))
    coded = numbered(first, ["session_id", "label"], ["seq", "start", "original"], "n", group_rows)
    return numbered(coded, ["session_id"], ["seq", "start", "original"], "ord", group_rows).select("session_id", "original", "label", code(F.col("label"), F.col("n")).alias("code"), "ord")


def document_codes(spans: Column) -> Column:
    """``MAP<original, code>`` of a document that is a session of its own, from its disjoint spans: no shuffle at all."""

    def step(acc: Column, s: Column) -> Column:
        seen = F.exists(acc, lambda x: x["original"] == s["text"])
        n = F.size(F.filter(acc, lambda x: x["label"] == s["label"]))
        return F.when(seen, acc).otherwise(F.array_append(acc, F.struct(s["text"].alias("original"), s["label"].alias("label"), n.alias("n"))))

    entries = F.aggregate(spans, empty("array<struct<original:string,label:string,n:int>>"), step)
    return F.map_from_entries(F.transform(entries, lambda x: F.struct(x["original"], code(x["label"], x["n"]))))


def originals_of_codes(book: DataFrame) -> DataFrame:
    """``(session_id, code, original)``: the longest original of each code, the first of equally long ones."""
    best = F.max(F.struct(F.length("original").alias("n"), (-F.col("ord")).alias("o"), "original"))
    return book.groupBy("session_id", "code").agg(best.alias("b")).select("session_id", "code", F.col("b.original").alias("original"))


def restore_lookup(book: DataFrame, ignored: DataFrame) -> DataFrame:
    """``(session_id, code, original)`` for restoring: live codes, and retired ones that no live code overlays.

    Of several retired originals of a code the last in order counts.
    """
    last = ignored.groupBy("session_id", "code").agg(F.max(F.struct("ord", "original")).alias("b")).select("session_id", "code", F.col("b.original").alias("retired"))
    both = originals_of_codes(book).join(last, ["session_id", "code"], "full")
    return both.select("session_id", "code", F.coalesce("original", "retired").alias("original"))


def preview(book: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``(session_id, rank, code, originals)``: codes by label, length and code; their originals longest first."""
    keyed = F.array_sort(F.collect_list(F.struct((-F.length("original")).alias("n"), "ord", "original")))
    rows = book.groupBy("session_id", "code").agg(keyed.alias("k")).select("session_id", "code", F.transform("k", lambda x: x["original"]).alias("originals"), label_of_code(F.col("code")).alias("__label"))
    ranked = numbered(rows.withColumn("__size", F.length("code")), ["session_id"], ["__label", "__size", "code"], "__n", group_rows)
    return ranked.select("session_id", (F.col("__n") + 1).cast("int").alias("rank"), "code", "originals")


def unmark(book: DataFrame, ignored: DataFrame, codes: DataFrame, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame]:
    """Retires ``codes(session_id, code)``: the new code book and the new ignored table, in this order.

    Retired originals are appended longest first; numbers of codes are never used again.
    """
    chosen = codes.select("session_id", "code").distinct()
    kept = book.join(chosen, ["session_id", "code"], "left_anti").select(*book.columns)
    gone = book.join(chosen, ["session_id", "code"], "left_semi")
    base = ignored.groupBy("session_id").agg((F.max("ord") + 1).alias("__base"))
    gone = gone.withColumn("__less", -F.length("original"))
    new = numbered(gone, ["session_id"], ["code", "__less", "ord", "original"], "__n", group_rows).join(base, "session_id", "left")
    new = new.select("session_id", "original", "code", (F.col("__n") + F.coalesce("__base", F.lit(0))).cast("long").alias("ord"))
    return kept, ignored.select("session_id", "original", "code", F.col("ord").cast("long").alias("ord")).unionByName(new)


def obfuscate(text: Column, spans: Column, codes: Column) -> Column:
    """``STRUCT<text, code_spans>``: disjoint spans in order of start, each replaced by its code.

    ``codes`` maps originals to codes; the code spans keep the label of the span they replace.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), s["text"].alias("text"))))

    def step(book: Column, acc: Column, s: Column) -> Column:
        own = F.element_at(book, s["text"])
        gap = F.substr(text, acc["pos"] + 1, s["start"] - acc["pos"])
        begin = acc["size"] + s["start"] - acc["pos"]
        span = F.struct(begin.alias("start"), (begin + F.length(own)).alias("end"), s["label"].alias("label"), own.alias("code"))
        return F.struct(F.concat(acc["out"], gap, own).alias("out"), s["end"].alias("pos"), (begin + F.length(own)).alias("size"), F.array_append(acc["codes"], span).alias("codes"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("pos"), F.lit(0).alias("size"), empty(CODE_SPANS).alias("codes"))
    done = lambda acc: F.struct(F.concat(acc["out"], F.substr(text, acc["pos"] + 1)).alias("text"), acc["codes"].alias("code_spans"))
    coded = let(codes, lambda book: F.aggregate(ordered, start, lambda acc, s: step(book, acc, s), done))
    return F.when(text.isNotNull(), coded)


def session_json(id: Column, label: Column, created_at: Column, to_code: Column, counters: Column, ignored: Column) -> Column:
    """A session as JSON; maps keep the order of their entries."""
    return F.to_json(F.struct(id.alias("id"), label.alias("label"), created_at.alias("created_at"), to_code.alias("to_code"), counters.alias("counters"), ignored.alias("ignored")), {"ignoreNullFields": "false"})


SESSION = "struct<id:string,label:string,created_at:string,to_code:map<string,string>,counters:map<string,bigint>,ignored:map<string,string>>"


def parse_session(json: Column) -> Column:
    """The session of its JSON; a missing ``ignored`` is empty."""
    s = F.from_json(json, SESSION)
    return F.when(s.isNotNull(), s.withField("ignored", F.coalesce(s["ignored"], F.create_map().cast("map<string,string>"))))
