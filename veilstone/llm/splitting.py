"""Cutting of long texts into overlapping pieces at topic boundaries.

Lexical-cohesion segmentation: texts are read as units (sentences and lines); at each gap between
units the words of the block before and the block after are compared by cosine; valleys of that
similarity mark topic boundaries. Within each size window the deepest valley is the cut; the next piece
begins ``overlap`` code points before it. The window is the second half of what the limit allows, so that no piece is
needlessly short; where it has no boundary, the last one from an eighth of the limit on counts, and where there is none
either, the cut is at white space or outside a word.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP, BLOCK = 2000, 200, 4

_UNIT = re.compile(r"[^\n\r 。！？!?.;；]*(?:[。！？；]+[」』”\s]*|[.!?;]+[\"')\]»”]*(?:\s+|$)|[.!?;]+|\r?\n\s*|\r\s*| \s*|$)")
_WORD = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]|[^\W\d_]{2,}")
_UNSPLIT = re.compile(r"\[[A-Z]+_[A-Z]+\]|\w+(?:[.@:/_-]\w+)*")


def _gaps(text: str) -> tuple[list[int], list[float]]:
    """Ends of the units but the last, and the depth of the cohesion valley at each."""
    ends, bags, at = [], [], 0
    while at < len(text):
        end = _UNIT.match(text, at).end()
        if end == at:
            end = at + 1
        hard = text[end - 1].isspace() or text[end - 1] in "。！？；」』”"
        unit = text[at:end]
        words = Counter(_WORD.findall(unit.lower()))
        if bags and not ends[-1][1]:  # a stop inside a number, address or code is no boundary
            bags[-1].update(words)  # in place: a run of such stops costs what it adds
            ends[-1] = (end, hard)
        else:
            bags.append(words)
            ends.append((end, hard))
        at = end
    sims: list[float] = []
    left: Counter = Counter()
    right: Counter = Counter()
    for b in bags[:BLOCK]:
        right.update(b)
    dot, nl, nr = 0, 0, sum(v * v for v in right.values())

    def shift(words: Counter, own: Counter, other: Counter, sign: int) -> tuple[int, int]:
        d_dot = d_norm = 0
        for w, n in words.items():
            old = own[w]
            new = old + sign * n
            d_dot += sign * n * other[w]
            d_norm += new * new - old * old
            if new:
                own[w] = new
            else:
                del own[w]
        return d_dot, d_norm

    for i in range(len(bags) - 1):
        for words, own, other, sign, is_left in ((bags[i], right, left, -1, False), (bags[i], left, right, 1, True), (bags[i - BLOCK] if i >= BLOCK else None, left, right, -1, True), (bags[i + BLOCK] if i + BLOCK < len(bags) else None, right, left, 1, False)):
            if words is None:
                continue
            d_dot, d_norm = shift(words, own, other, sign)
            dot += d_dot
            nl, nr = (nl + d_norm, nr) if is_left else (nl, nr + d_norm)
        sims.append(dot / math.sqrt(nl * nr) if nl and nr else 0.0)
    up_left, up_right = sims[:], sims[:]  # nearest peak on either side
    for i in range(1, len(sims)):
        up_left[i] = max(sims[i], up_left[i - 1]) if sims[i - 1] >= sims[i] else sims[i]
    for i in range(len(sims) - 2, -1, -1):
        up_right[i] = max(sims[i], up_right[i + 1]) if sims[i + 1] >= sims[i] else sims[i]
    return [e for e, _ in ends[:-1]], [a + b - 2 * s for a, b, s in zip(up_left, up_right, sims)]


def _soft_cut(text: str, low: int, high: int) -> int:
    """Last white space in ``(low, high]``, else the last place outside a word, else ``high``."""
    for at in range(high, low, -1):
        if text[at - 1].isspace():
            return at
    at = high
    for m in _UNSPLIT.finditer(text, max(low, high - 80), min(len(text), high + 80)):
        if m.start() < high < m.end() and m.start() > low:
            at = m.start()
    while at > low + 1 and at < len(text) and (0x300 <= ord(text[at]) < 0x370 or text[at] in "‍️゙゚" or text[at - 1] == "‍"):
        at -= 1
    return at


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """``[start, end)`` of the pieces of one text. Texts within the limit, empty ones too, are one piece."""
    if len(text) <= limit:
        return [(0, len(text))]
    ends, depth = _gaps(text)
    pieces, start, first = [], 0, 0
    while len(text) - start > limit:
        low, high = start + max(overlap + 1, limit // 2), start + limit
        while first < len(ends) and ends[first] <= start + overlap:
            first += 1
        best, spare, i = None, None, first
        while i < len(ends) and ends[i] <= high:
            if ends[i] >= low:
                if best is None or depth[i] >= depth[best]:
                    best = i
            else:
                spare = i
            i += 1
        if best is not None:
            cut = ends[best]
        elif spare is not None and ends[spare] >= start + overlap + limit // 8:
            cut = ends[spare]
        else:
            cut = _soft_cut(text, low, high)
        pieces.append((start, cut))
        start = cut - overlap
    pieces.append((start, len(text)))
    return pieces


def split_long(items: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``(id, piece_no, piece_start, piece_end, piece)`` of every item; ``overlap`` must be below ``limit``.

    Items within the limit stay in the JVM as one piece; only longer ones go through Python. Null texts
    have no piece; an empty text is one empty piece; an id delivered again with the same text counts once.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    src = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    return _pieces(src.dropDuplicates(["id"]), limit, overlap)  # whole texts are shuffled, not their overlapping pieces


def _pieces(src: DataFrame, limit: int, overlap: int) -> DataFrame:
    short = src.where(F.length("text") <= limit).select("id", F.lit(0).alias("piece_no"), F.lit(0).alias("piece_start"), F.length("text").alias("piece_end"), F.col("text").alias("piece"))
    own = src.schema["id"].dataType.simpleString()
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[own]
    names = ["id", "piece_no", "piece_start", "piece_end", "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, s, e, t[s:e]) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, (s, e) in enumerate(split_text(t, limit, overlap))]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, pa.int32(), pa.int32(), pa.int32(), pa.string()))], names)

    return short.unionByName(src.where(F.length("text") > limit).mapInArrow(run, f"id {own}, piece_no int, piece_start int, piece_end int, piece string"))


def oversized(items: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``(id)`` of the items that :func:`split_long` cuts into more than one piece."""
    long = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where((F.length("text") > limit) & F.col("id").isNotNull())
    return _pieces(long, limit, overlap).where("piece_no > 0").select("id").distinct()  # only ids are shuffled
