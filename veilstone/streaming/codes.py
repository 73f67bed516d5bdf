"""Coding of a stream of documents, with each session's code book as keyed state."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veilstone.operators.fold import CodeBook, code_document, label_in, spans_to_code, stage_a
from veilstone.operators.names import SEED_NAMES
from veilstone.operators.rules import RULES, Rule

OUTPUT = "session_id string, seq long, doc_id long, text string, lang string, code_spans array<struct<start:int,end:int,label:string,code:string>>, originals array<string>"
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Coder(StatefulProcessor):
    """State by session: live and retired originals with their codes and order, the next number of each label, and the ids seen.

    The code book is read from the state once per micro-batch and session and changed entry by entry; documents
    delivered again are known by their ids, whose state is 8 bytes each.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.codes = handle.getMapState("to_code", "original string", "code string, ord long")
        self.counts = handle.getMapState("counters", "label string", "n long")
        self.ignored = handle.getMapState("ignored", "original string", "code string")
        self.seen = handle.getMapState("seen", "doc_id long", "seq long")

    def _book(self) -> tuple[CodeBook, int]:
        kept = sorted(((v[1], k[0], v[0]) for k, v in self.codes.iterator()), key=lambda x: x[0]) if self.codes.exists() else []
        book = CodeBook(to_code={original: code for _, original, code in kept})
        book.counters = {k[0]: v[0] for k, v in self.counts.iterator()} if self.counts.exists() else {}
        book.ignored = {k[0]: v[0] for k, v in self.ignored.iterator()} if self.ignored.exists() else {}
        return book, kept[-1][0] + 1 if kept else 0

    def _store(self, book: CodeBook, originals, n: int) -> int:
        """Writes what is live of some originals, and the counters of their labels; retired ones leave the state of live ones."""
        for original in originals:
            if original in book.to_code:
                code = book.to_code[original]
                if not self.codes.containsKey((original,)):
                    self.codes.updateValue((original,), (code, n))
                    n += 1
                if book.counters.get(label_in(code)):
                    self.counts.updateValue((label_in(code),), (book.counters[label_in(code)],))
                if self.ignored.exists() and self.ignored.containsKey((original,)):
                    self.ignored.removeKey((original,))
            elif original in book.ignored:
                self.codes.removeKey((original,))
                self.ignored.updateValue((original,), (book.ignored[original],))
        return n

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        book, n = self._book()
        for r in sorted(rows, key=lambda r: (r["seq"] is not None, r["seq"] or 0, r["doc_id"] or 0)):  # one micro-batch of one session
            if r["op"] == "unmark":
                n = self._store(book, book.retire(r["text"]), n)
                continue
            if r["op"] == "mark":
                n = self._store(book, book.mark(r["text"], r["label"]), n)
                continue
            if r["doc_id"] is not None:
                if self.seen.exists() and self.seen.containsKey((r["doc_id"],)):
                    continue  # delivered again
                self.seen.updateValue((r["doc_id"],), (r["seq"] or 0,))
            head = {"session_id": key[0], "seq": r["seq"], "doc_id": r["doc_id"]}
            if r["text"] is None:
                yield Row(**head, text=None, lang=None, code_spans=None, originals=None)
                continue
            found = [(s["start"], s["end"], s["label"], s["text"], s["score"]) for s in sorted(r["cand"], key=lambda s: s["prio"])]
            labels = [(x["start"], x["end"], x["text"], x["likely"]) for x in r["speakers"]]
            spans = spans_to_code(r["text"], found, labels, book, r["scope"])
            coded, codes, new = code_document(r["text"], spans, book)
            n = self._store(book, [original for original, _, _ in new], n)
            yield Row(**head, text=coded, lang=r["lang"], code_spans=[Row(start=a, end=b, label=label, code=c) for a, b, label, c in codes], originals=[s[3] for s in spans])

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """Sets the state store that keyed map state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)


def obfuscate_stream(documents: DataFrame, rules: Iterable[Rule] = RULES, names: Iterable[str] = SEED_NAMES, extra: Column | None = None) -> DataFrame:
    """Codes a stream of ``documents(session_id, seq, doc_id, text[, lang_choice, scope, op, label])`` in order of arrival.

    Within a micro-batch documents go by ``seq``. A late document is coded when it comes: codes given out never
    change, though their numbers may differ from those of a batch run over all documents. A document delivered again counts
    once. A row with ``op`` ``unmark`` retires the code in its ``text``, one with ``mark`` codes its ``text`` under its ``label`` from
    then on; neither gives a row. Documents without a session are sessions of their own and come out with a null session.
    """
    optional = {c: F.col(c) if c in documents.columns else F.lit(None).cast("string") for c in ("scope", "op", "label")}
    lone = F.when(F.col("session_id").isNull(), F.coalesce(F.col("doc_id").cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256)))
    src = documents.withColumns(optional).withColumn("lone", lone)
    ready = stage_a(src, rules, names, extra).select("session_id", "lone", F.col("seq").cast("long").alias("seq"), F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "scope", "op", "label", "cand", "speakers")
    return ready.groupBy("session_id", "lone").transformWithState(statefulProcessor=_Coder(), outputStructType=OUTPUT, outputMode="Append", timeMode="None")
