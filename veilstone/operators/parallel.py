"""Coding of sessions that are too large for one task, with the result of the ordered fold.

What a document is coded with depends on earlier ones only through the entries they left in the code book. So the entries are
found first, by rounds: each round reads all documents in parallel with the entries of the round before that stem from
earlier documents, and gathers the first document of each new original. The first document is right after one round, and
each round makes at least the next one right; as most entries don't depend on others, few rounds change anything. Then
codes are given out in order, over the entries alone, and the documents are coded in parallel.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstone.operators.codebook import numbered
from veilstone.operators.fold import _COUNTER, _DOCUMENT, _LIVE, _RETIRED, CHUNK_ROWS, RESULT, CodeBook, code_document, label_in, result_batch, spans_to_code, take_in
from veilstone.runtime import cut

ENTRY = "session_id string, original string, label string, code string, n long, j int, ord long, retired boolean"


def _read(want: str):
    """A task's documents with the entries of their session: its new originals (``entries``) or its coded documents (``results``)."""

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        rows = sorted(docs.to_pylist(), key=lambda r: r["n"])
        entries = sorted((e for e in known.to_pylist() if not e["retired"]), key=lambda e: (e["n"], e["j"]))
        book, at, out = CodeBook(ignored={e["original"]: e["code"] for e in known.to_pylist() if e["retired"]}), 0, []

        def enter(until: int) -> list[dict]:
            nonlocal at
            first = at
            while at < len(entries) and entries[at]["n"] < until:
                e = entries[at]
                book.put(e["original"], e["code"] or f"[{e['label']}_A]")  # while codes aren't given out, only labels matter
                at += 1
            return entries[first:at]

        for r in rows:
            enter(r["n"])
            head = (r["session_id"], r["seq"], r["doc_id"])
            if r["text"] is None:
                if want == "results":
                    out.append((*head, None, None, None, None, None, r["model_used"], []))
                continue
            found = [(s["start"], s["end"], s["label"], s["text"], s["score"]) for s in sorted(r["cand"], key=lambda s: s["prio"])]
            labels = [(x["start"], x["end"], x["text"], x["likely"]) for x in r["speakers"]]
            spans = spans_to_code(r["text"], found, labels, book, r["scope"])
            if want == "entries":
                new = {s[3]: s[2] for s in reversed(spans) if s[3] not in book.to_code}  # the first span of each counts
                order = list(dict.fromkeys(s[3] for s in spans if s[3] in new))
                out += [(r["session_id"], o, new[o], r["n"], j) for j, o in enumerate(order)]
                continue
            own = [{"original": e["original"], "label": label_in(e["code"]), "code": e["code"], "ord": e["ord"]} for e in enter(r["n"] + 1)]
            coded, codes, _ = code_document(r["text"], spans, book)
            out.append((*head, coded, r["lang"], *_columns(spans, codes), r["model_used"], own))
        if want == "results":
            return pa.Table.from_batches([result_batch(out)])
        cols = list(zip(*out)) or [[]] * 5
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32()))], names=["session_id", "original", "label", "n", "j"])

    return run


def _columns(spans: list[tuple], codes: list[tuple]) -> tuple[list, list, list]:
    return [dict(zip(("start", "end", "label", "text", "score"), s)) for s in spans], [dict(zip(("start", "end", "label", "code"), c)) for c in codes], [s[3] for s in spans]


def _give_codes(batches):
    """Codes for the new entries of whole sessions, in order; state comes first. Only entries pass here, no texts."""
    current, book, ord_ = object(), CodeBook(), 0
    for b in batches:
        out = []
        for r in b.to_pylist():
            if r["session_id"] != current:
                current, book, ord_ = r["session_id"], CodeBook(), 0
            if r["kind"] == _COUNTER:
                book.counters[r["original"]] = max(book.counters.get(r["original"], 0), r["ord"])
            elif r["kind"] in (_LIVE, _RETIRED):
                take_in(book, r["original"], r["code"], r["kind"] == _RETIRED)
                ord_ = max(ord_, r["ord"] + 1) if r["kind"] == _LIVE else ord_
                out.append((current, r["original"], label_in(r["code"]), r["code"], -1, 0, r["ord"], r["kind"] == _RETIRED))
            else:
                code = book.code_for(r["original"], r["label"])
                out.append((current, r["original"], r["label"], code, r["n"], r["j"], ord_, False))
                ord_ += 1
        cols = list(zip(*out)) or [[]] * 8
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in ENTRY.split(", ")])


def obfuscate_large(ready: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Codes the rows of :func:`veilstone.operators.fold.obfuscate_sessions`' input, all of real sessions, without a task per session."""
    docs = ready.where(F.col("kind") == _DOCUMENT).withColumn("tie", F.xxhash64("text"))
    docs = docs.where("doc_id is null").unionByName(docs.where("doc_id is not null").dropDuplicates(["session_id", "seq", "doc_id"]))
    docs = cut(numbered(cut(docs), ["session_id"], ["seq", "doc_id", "tie"], "n", max(chunk_rows, 1)).drop("tie"))
    parts = docs.groupBy("session_id").agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("parts"))
    docs = docs.join(parts, "session_id").withColumn("part", F.pmod(F.xxhash64("n"), F.col("parts")).cast("int")).drop("parts", "kind", "lone")
    state = ready.where(F.col("kind") != _DOCUMENT).select("session_id", "kind", F.col("text").alias("original"), F.col("lang").alias("code"), F.col("seq").alias("ord"))
    state = cut(state)
    label = F.regexp_replace(F.substr("code", F.lit(2)), "_[^_]*$", "")
    old = state.where(F.col("kind") != _COUNTER).select("session_id", "original", label.alias("label"), "code", F.lit(-1).cast("long").alias("n"), F.lit(0).alias("j"), F.col("ord"), (F.col("kind") == _RETIRED).alias("retired"))

    def beside(entries: DataFrame) -> DataFrame:
        """Entries for each part of their session."""
        return entries.join(parts, "session_id").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def over(entries: DataFrame, want: str, schema: str) -> DataFrame:
        return docs.groupBy("session_id", "part").cogroup(beside(entries).groupBy("session_id", "part")).applyInArrow(_read(want), schema)

    known = docs.sparkSession.createDataFrame([], "session_id string, original string, label string, n long, j int")
    while True:
        filled = known.select("session_id", "original", "label", F.lit(None).cast("string").alias("code"), "n", "j", F.lit(None).cast("long").alias("ord"), F.lit(False).alias("retired"))
        found = over(old.unionByName(filled), "entries", "session_id string, original string, label string, n long, j int")
        # a document that was read without an entry of an earlier one finds it again: the first counts
        first = cut(found.groupBy("session_id", "original").agg(F.min(F.struct("n", "j", "label")).alias("f")).select("session_id", "original", "f.label", "f.n", "f.j"))
        if first.count() == known.count() and first.exceptAll(known.select(*first.columns)).isEmpty():
            break
        known = first
    inputs = state.select("session_id", "kind", "original", F.lit(None).cast("string").alias("label"), "code", F.lit(-1).cast("long").alias("n"), F.lit(0).alias("j"), "ord")
    inputs = inputs.unionByName(known.select("session_id", F.lit(_DOCUMENT).alias("kind"), "original", "label", F.lit(None).cast("string").alias("code"), "n", "j", F.lit(None).cast("long").alias("ord")))
    coded = cut(inputs.repartition("session_id").sortWithinPartitions("session_id", "kind", "n", "j", "ord").mapInArrow(_give_codes, ENTRY))
    return over(coded, "results", RESULT)
