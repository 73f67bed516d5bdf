"""Language of documents and of their segments, with a confidence.

Multinomial naive Bayes over hashed character n-grams. The model is fitted here, on a bounded sample of rows
whose label names one of the languages; its log-probability matrix has a fixed size and is broadcast. Segments
(sentences and lines) of a whole Arrow batch are scored together: their n-gram numbers index the matrix, and
the rows are summed per segment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilstone.llm.unicode_data import Looks, looks

LANGS = ("en", "zh", "de", "fr", "es", "pt", "ja")
#: Hash buckets of the n-grams; the broadcast matrix has BUCKETS x 8 floats of 4 bytes.
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Rows of each language, at most, on which the model is fitted; the same rows whatever the order of the input.
TRAIN_ROWS = 400
#: Letters that make a segment decide by itself: alphabetic scripts, Chinese and Japanese.
STRONG_LETTERS, STRONG_CJK = 14, 5
#: Log-odds per segment, over the next language, that make it decide by itself.
STRONG_ODDS = 20.0
#: Log-odds from which a training segment is held to be in another language than its row's label.
FOREIGN_ODDS = 40.0
#: N-grams of several orders repeat the same evidence; log-odds are divided by this for the confidence.
TEMPER = 3.0

# Notations of the languages besides the two-letter codes; a region after - or _ is cut off first.
NOTATIONS = {
    "eng": "en", "english": "en", "zho": "zh", "chi": "zh", "chinese": "zh", "cmn": "zh", "deu": "de", "ger": "de", "german": "de", "deutsch": "de", "fra": "fr", "fre": "fr", "french": "fr",
    "français": "fr", "francais": "fr", "spa": "es", "spanish": "es", "español": "es", "espanol": "es", "por": "pt", "portuguese": "pt", "português": "pt", "portugues": "pt",
    "jpn": "ja", "japanese": "ja", "日本語": "ja", "中文": "zh", "mandarin": "zh", "yue": "zh", "cantonese": "zh",
}
# Labels that name no language.
NO_LANGUAGE = ("", "und", "unknown", "mul", "mixed", "mis", "zxx", "none", "null", "n/a", "na", "other", "auto", "?", "-")

_MASK = re.compile(r"\[[A-Z]+_[A-Z]+\]|<[^<>\s]{1,16}>")
_LINK = re.compile(r"https?://\S+|[^\s@]+@\S+")
_SEGMENT = re.compile(r"[^\s.!?。！？；;．][^\n\r  .!?。！？；;．]*(?:[.!?;．]+(?![\s​-‍⁠﻿]|$)[^\n\r  .!?。！？；;．]*)*[.!?。！？；;．]*")
_LETTER = re.compile(r"[^\W\d_]")
#: Runs of letters that touch no digit: pieces of ids are no words.
_WORD = re.compile(r"(?<![\w+/=])[^\W\d_]{2,}(?![\w+/=])|[぀-ヿ㐀-鿿豈-﫿⼀-⿟]+")



@dataclass(frozen=True)
class Model:
    """Log-probabilities, buckets by languages, and the look-alikes that are folded before n-grams are taken."""

    matrix: np.ndarray
    table: Looks


SEGMENT_SCHEMA = "id long, segment_start int, segment_end int, lang string, confidence double"


def named_language(label: F.Column | str) -> F.Column:
    """The two-letter code that a label stands for; null if it is missing or names no language.

    Labels of languages other than :data:`LANGS` come out as they are.
    """
    col = F.col(label) if isinstance(label, str) else label
    plain = F.lower(F.trim(col))
    head = F.regexp_extract(plain, "^([^-_]*)", 1)
    known = F.create_map([F.lit(x) for kv in NOTATIONS.items() for x in kv])
    return F.when(col.isNull() | plain.isin(*NO_LANGUAGE) | head.isin(*NO_LANGUAGE), None).otherwise(F.coalesce(known[plain], known[head], head))


def _segments(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, what is scored)`` of each sentence or line; what has no letters is left out."""
    masked = _MASK.sub(lambda m: "\x01" * (m.end() - m.start()), text)
    if "@" in masked or "://" in masked:
        masked = _LINK.sub(lambda m: "\x01" * (m.end() - m.start()), masked)
    out = []
    for m in _SEGMENT.finditer(masked):
        if _LETTER.search(s := m[0]):
            out.append((m.start(), m.end(), s))
    return out


def _features(parts: list[str], table: Looks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(bucket of each n-gram, where each part's n-grams begin, rows of the parts that have any)``."""
    joined = table.skeleton("\n".join(parts)).lower()
    text = np.frombuffer(("\n" + joined + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    brk = text == 10
    own = np.cumsum(brk) - 1
    plain = np.where(text < 0x41, np.uint32(32), text)  # digits and signs count as space
    plain[brk] = 32
    ids, rows = [], []
    for n in ORDERS:
        h = np.zeros(len(text) - n + 1, np.uint32)
        letter = np.zeros(len(h), bool)
        crossed = np.zeros(len(h), bool)
        for k in range(n):
            x = plain[k : len(plain) - n + 1 + k]
            h = (h ^ x) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            letter |= x > 32
            if 0 < k < n - 1:
                crossed |= brk[k : len(brk) - n + 1 + k]
        h = (h * np.uint32(0x85EBCA6B)) >> np.uint32(16)
        keep = letter & ~crossed  # a gram that begins with a break belongs to the part that begins there
        ids.append((h[keep] & np.uint32(BUCKETS - 1)).astype(np.int32))
        rows.append(own[: len(h)][keep])
    ids_all, rows_all = np.concatenate(ids), np.concatenate(rows)
    order = np.argsort(rows_all, kind="stable")
    ids_all, rows_all = ids_all[order], rows_all[order]
    starts = np.flatnonzero(np.r_[True, rows_all[1:] != rows_all[:-1]]) if len(rows_all) else np.empty(0, np.int64)
    return ids_all, starts, rows_all[starts] if len(rows_all) else np.empty(0, np.int64)


def _score(parts: list[str], model: Model) -> np.ndarray:
    out = np.zeros((len(parts), len(LANGS)), np.float32)
    step = 4000  # parts at once; bounds the memory of the gathered rows
    for a in range(0, len(parts), step):
        ids, starts, rows = _features(parts[a : a + step], model.table)
        if len(starts):
            out[a + rows] = np.add.reduceat(model.matrix[ids], starts, axis=0)[:, : len(LANGS)]
    return out


def _matrix(parts: list[str], labels: np.ndarray, table: Looks, alpha: float = 0.05) -> np.ndarray:
    counts = np.zeros((len(LANGS), BUCKETS), np.float64)
    for a in range(0, len(parts), 4000):
        ids, starts, rows = _features(parts[a : a + 4000], table)
        each = np.repeat(labels[a : a + 4000][rows], np.diff(np.r_[starts, len(ids)]))
        for k in range(len(LANGS)):
            counts[k] += np.bincount(ids[each == k], minlength=BUCKETS)
    totals = np.maximum(counts.sum(1, keepdims=True), 1)
    p = counts / totals
    floor = alpha / totals.max()
    logp = np.log(p + floor)
    logp[:, counts.sum(0) == 0] = 0  # says nothing about any language
    logp[totals[:, 0] <= 1] = -20.0  # no training row of this language
    out = np.zeros((BUCKETS, 8), np.float32)
    out[:, : len(LANGS)] = logp.T
    return out


def fit(labelled: list[tuple[str, str]], table: Looks) -> Model:
    """A model from ``(language, text)``; labels may be partly wrong.

    A first model is fitted to all segments under their row's label; segments that it clearly puts in
    another language (wrong labels, mixed texts) are left out of the second.
    """
    parts, labels = [], []
    for lang, text in labelled:
        own = [s for _, _, s in _segments(text)]
        parts += own
        labels += [LANGS.index(lang)] * len(own)
    y = np.asarray(labels, np.int64)
    matrix = _matrix(parts, y, table)
    if len(parts):
        scores = _score(parts, Model(matrix, table))
        against = scores.max(1) - scores[np.arange(len(y)), y]
        keep = np.flatnonzero(against < FOREIGN_ODDS)
        matrix = _matrix([parts[i] for i in keep], y[keep], table)
    return Model(matrix, table)


def train(rows: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int = TRAIN_ROWS) -> Model:
    """A model fitted on the whole texts of at most ``per_lang`` rows of each language, those with the least hash of id."""
    base = rows.select(F.col(id_col).alias("id"), named_language(lang_col).alias("lang")).where(F.col("lang").isin(*LANGS) & F.col("id").isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = base.distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_lang).select("id", "lang")
    texts = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    got = texts.join(F.broadcast(chosen), "id").select("id", "lang", "text").distinct().collect()  # at most 7 x per_lang rows
    return fit([(r["lang"], r["text"]) for r in sorted(got, key=lambda r: (r["id"], r["lang"]))], looks(rows.sparkSession, east=False))


def _judge(segments: list[tuple[int, int, str]], scores: np.ndarray) -> tuple[list[int], list[float], bool]:
    """Language and confidence of each segment of one text, and whether the text has a sentence at all.

    Segments with enough letters and clear odds decide by themselves; the others take the best language
    among those decided in the text, or, where none is, the language of all of them together.
    """
    top = np.sort(scores, axis=1)
    best, odds = scores.argmax(1), top[:, -1] - top[:, -2]
    strong = []
    for (_, _, s), o in zip(segments, odds):
        if o < STRONG_ODDS:
            strong.append(False)
            continue
        words = _WORD.findall(s)
        cjk = sum(len(w) for w in words if w[0] > "\u2eff")
        small = {w for w in words if len(w) <= 24 and not w.isupper()} or {w for w in words if len(w) <= 24 and len(words) >= 4}  # not ids and repeated letters
        strong.append(cjk >= STRONG_CJK or (len(small) >= 3 and sum(map(len, small)) >= STRONG_LETTERS))
    allowed = sorted({int(b) for b, k in zip(best, strong) if k})
    sentence = bool(allowed)
    if not allowed:
        enough = [o > 1 and (len(w := _WORD.findall(s)) >= 2 or sum(len(x) for x in w if x[0] > "\u2eff") >= 2) for (_, _, s), o in zip(segments, odds)]
        sentence = any(enough)
        allowed = [int(scores.sum(0).argmax())]
    langs, conf = [], []
    for row, b, k in zip(scores, best, strong):
        lang = int(b) if k else allowed[int(row[allowed].argmax())]
        e = np.exp((row - row.max()) / TEMPER)
        langs.append(lang)
        conf.append(float(e[lang] / e.sum()))
    return langs, conf, sentence


def segment_languages(rows: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """``(id, segment_start, segment_end, lang, confidence)``: the runs of each text in one language.

    Neighbouring sentences and lines of one language are one run; its confidence is their mean by
    length. Null, empty and blank texts, texts without any sentence and rows without an id have no run.
    """
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, found = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if segs := _segments(t):
                    ids.append(i)
                    found.append(segs)
            scores = _score([s for segs in found for _, _, s in segs], held.value)
            out, at = [], 0
            for i, segs in zip(ids, found):
                langs, conf, sentence = _judge(segs, scores[at : at + len(segs)])
                at += len(segs)
                if not sentence:
                    continue
                first = 0
                for k in range(1, len(segs) + 1):
                    if k == len(segs) or langs[k] != langs[first]:
                        size = [e - s for s, e, _ in segs[first:k]]
                        out.append((i, segs[first][0], segs[k - 1][1], LANGS[langs[first]], sum(map(float.__mul__, conf[first:k], map(float, size))) / sum(size)))
                        first = k
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64()))], ["id", "segment_start", "segment_end", "lang", "confidence"])

    src = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null and text <> ''")
    return src.mapInArrow(run, SEGMENT_SCHEMA)


def relabel(rows: DataFrame, id_col: str, text_col: str, lang_col: str, model: Model) -> DataFrame:
    """``(id, lang, confidence)`` of each text whose label doesn't fit: one row per language written in it.

    A label doesn't fit if it is missing, names no language or one in which nothing is written, or if
    the text has sentences in more than one language. Deliveries of an id count once.
    """
    runs = segment_languages(rows.withColumn("__id", F.col(id_col)), "__id", text_col, model)
    size = F.col("segment_end") - F.col("segment_start")
    per = runs.groupBy("id", "lang").agg((F.sum(F.col("confidence") * size) / F.sum(size)).alias("confidence"))
    label = rows.select(F.col(id_col).cast("long").alias("id"), named_language(lang_col).alias("label")).groupBy("id").agg(F.min("label").alias("label"))
    whole = per.groupBy("id").agg(F.collect_list(F.struct("lang", "confidence")).alias("langs"))  # at most one entry per language
    wrong = F.col("label").isNull() | (F.size("langs") > 1) | ~F.exists("langs", lambda x: x["lang"] == F.col("label"))
    return whole.join(label, "id").where(wrong).select("id", F.inline("langs"))
