"""Edits of coded replies: taking a code back, and coding a value afterwards."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstone.functions.matching import empty
from veilstone.functions.text import CODE, label_of_code
from veilstone.operators.codebook import CODE_SPANS
from veilstone.operators.spans import find_all


def revert_code(text: Column, code_spans: Column, originals: Column, code: Column) -> Column:
    """``STRUCT<text, code_spans, originals>`` with the originals of one code back in place."""
    items = F.zip_with(code_spans, originals, lambda s, o: F.struct(s.alias("s"), o.alias("o")))

    def step(acc: Column, x: Column) -> Column:
        s, back = x["s"], x["s"]["code"] == code
        moved = F.struct((s["start"] + acc["shift"]).alias("start"), (s["end"] + acc["shift"]).alias("end"), s["label"].alias("label"), s["code"].alias("code"))
        return F.struct(
            F.when(back, F.concat(acc["out"], F.substr(text, acc["pos"] + 1, s["start"] - acc["pos"]), x["o"])).otherwise(acc["out"]).alias("out"),
            F.when(back, s["end"]).otherwise(acc["pos"]).alias("pos"),
            F.when(back, acc["shift"] + F.length(x["o"]) - (s["end"] - s["start"])).otherwise(acc["shift"]).alias("shift"),
            F.when(back, acc["spans"]).otherwise(F.array_append(acc["spans"], moved)).alias("spans"),
            F.when(back, acc["kept"]).otherwise(F.array_append(acc["kept"], x["o"])).alias("kept"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("pos"), F.lit(0).alias("shift"), empty(CODE_SPANS).alias("spans"), empty("array<string>").alias("kept"))
    done = lambda acc: F.struct(F.concat(acc["out"], F.substr(text, acc["pos"] + 1)).alias("text"), acc["spans"].alias("code_spans"), acc["kept"].alias("originals"))
    return F.when(text.isNotNull(), F.aggregate(items, start, step, done))


def apply_codes(text: Column, code_spans: Column, originals: Column, values: Column) -> Column:
    """``STRUCT<text, code_spans, originals, replaced>``: each value of ``MAP<value, code>`` coded wherever it stands outside the codes.

    Of overlapping hits the leftmost counts, of those the longest.
    """
    labels = F.transform_values(values, lambda _, c: label_of_code(c))
    hits = F.filter(find_all(text, labels), lambda m: ~F.exists(code_spans, lambda s: (m["start"] < s["end"]) & (s["start"] < m["end"])))
    ranked = F.array_sort(F.transform(hits, lambda m: F.struct(m["start"].alias("start"), (m["start"] - m["end"]).alias("less"), m["end"].alias("end"), m["label"].alias("label"), m["text"].alias("text"))))

    def pick(acc: Column, m: Column) -> Column:
        free = m["start"] >= acc["end"]
        item = F.struct(m["start"].alias("start"), m["end"].alias("end"), m["label"].alias("label"), F.element_at(values, m["text"]).alias("code"), m["text"].alias("original"))
        return F.struct(F.when(free, m["end"]).otherwise(acc["end"]).alias("end"), F.when(free, F.array_append(acc["kept"], item)).otherwise(acc["kept"]).alias("kept"))

    item_type = "array<struct<start:int,end:int,label:string,code:string,original:string>>"
    new = F.aggregate(ranked, F.struct(F.lit(-1).alias("end"), empty(item_type).alias("kept")), pick, lambda acc: acc["kept"])
    old = F.zip_with(code_spans, originals, lambda s, o: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), s["code"].alias("code"), o.alias("original")))

    def step(acc: Column, s: Column) -> Column:
        begin = acc["size"] + s["start"] - acc["pos"]
        span = F.struct(begin.alias("start"), (begin + F.length(s["code"])).alias("end"), s["label"].alias("label"), s["code"].alias("code"))
        return F.struct(
            F.concat(acc["out"], F.substr(text, acc["pos"] + 1, s["start"] - acc["pos"]), s["code"]).alias("out"),
            s["end"].alias("pos"),
            (begin + F.length(s["code"])).alias("size"),
            F.array_append(acc["spans"], span).alias("spans"),
            F.array_append(acc["kept"], s["original"]).alias("kept"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("pos"), F.lit(0).alias("size"), empty(CODE_SPANS).alias("spans"), empty("array<string>").alias("kept"))
    done = lambda acc: F.struct(F.concat(acc["out"], F.substr(text, acc["pos"] + 1)).alias("text"), acc["spans"].alias("code_spans"), acc["kept"].alias("originals"), F.size(new).alias("replaced"))
    return F.when(text.isNotNull(), F.aggregate(F.array_sort(F.concat(old, new)), start, step, done))


def _edited(replies: DataFrame, touched: Column, result: Column, extra: list[str]) -> DataFrame:
    edited = replies.withColumn("__e", F.when(touched, result))
    cols = [F.coalesce(F.col(f"__e.{c}"), F.col(c)).alias(c) if c in ("text", "code_spans", "originals") else F.col(c) for c in replies.columns]
    return edited.select(*cols, *[F.coalesce(F.col(f"__e.{c}"), F.lit(0)).alias(c) for c in extra])


def unmark_in_transcript(replies: DataFrame, codes: DataFrame) -> DataFrame:
    """Replies ``(session_id, text, code_spans, originals, ...)`` with the code of ``codes(session_id, code)``, one per session, taken back in them."""
    joined = replies.join(codes.select("session_id", F.col("code").alias("__code")), "session_id", "left")
    touched = F.exists("code_spans", lambda s: s["code"] == F.col("__code"))
    return _edited(joined, touched, revert_code(F.col("text"), F.col("code_spans"), F.col("originals"), F.col("__code")), []).select(*replies.columns)


def mark_in_transcript(replies: DataFrame, marks: DataFrame) -> DataFrame:
    """Replies with ``replaced``, after coding the values of ``marks(session_id, values MAP<value, code>)``, one row per session.

    Values that contain a code can't be marked and are left out.
    """
    allowed = marks.select("session_id", F.map_filter("values", lambda v, _: ~v.rlike(CODE)).alias("__values"))
    joined = replies.join(allowed, "session_id", "left")
    result = apply_codes(F.col("text"), F.col("code_spans"), F.col("originals"), F.col("__values"))
    return _edited(joined, F.col("__values").isNotNull(), result, ["replaced"]).select(*replies.columns, "replaced")


def delete_session(replies: DataFrame, session_ids: DataFrame) -> DataFrame:
    """Replies of deleted sessions, with their session set to null; the others unchanged."""
    gone = session_ids.select("session_id", F.lit(True).alias("__gone")).distinct()
    joined = replies.join(gone, "session_id", "left")
    return joined.withColumn("session_id", F.when(F.col("__gone").isNull(), F.col("session_id"))).select(*replies.columns)


def may_mark(selection: Column, session_id: Column) -> Column:
    """A selection can be marked: one line, not blank, no code in it, in a reply that has a session."""
    return session_id.isNotNull() & selection.rlike("(?U)\\S") & ~selection.rlike("[\\n\\r\\x{2028}\\x{2029}]") & ~selection.rlike(CODE)


def highlight(text: Column, spans: Column, color: str = "#ffe08a", link: str | None = None) -> Column:
    """Text as HTML, escaped, line feeds as ``<br>``, spans marked; with ``link``, each mark is an anchor ``<link>:<number of the span>``."""
    signs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("\n", "<br>"))
    esc = lambda t: functools.reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), signs, t)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def part(s: Column, i: Column) -> Column:
        before = F.when(i > 0, F.try_element_at(ordered, i)["end"]).otherwise(F.lit(0))  # the end of the span before
        mark = F.concat(F.lit(f'<span style="background-color:{color}">'), esc(F.substr(text, s["start"] + 1, s["end"] - s["start"])), F.lit("</span>"))
        if link is not None:
            mark = F.concat(F.lit(f'<a href="{link}:'), i.cast("string"), F.lit('">'), mark, F.lit("</a>"))
        return F.concat(esc(F.substr(text, before + 1, s["start"] - before)), mark)

    rest = esc(F.substr(text, F.coalesce(F.try_element_at(ordered, F.lit(-1))["end"], F.lit(0)) + 1))
    return F.concat(F.array_join(F.transform(ordered, part), ""), rest)
