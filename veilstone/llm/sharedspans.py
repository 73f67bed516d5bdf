"""Long spans that stand verbatim in more than one text.

Relative Lempel-Ziv parsing against reference blocks. The reference of a block is all text around one anchor: anchors are
the positions of locally least hash of a gram, chosen so that any run of the required length holds at least one, the same
one in every text. A block is indexed by the sorted suffixes that begin at its anchors and the sorted prefixes that
end there, with the lengths that neighbours have in common. A text is parsed against each block that holds one of its
anchors: the factor to the right and the factor to the left are the longest matches in the index, and where one source
continues a factor over the boundary, the two are joined. Joined factors of the required length are shared spans.

Hashes only bring texts together: what is shared is decided on the characters. Equal surroundings are one
entry of a block. A block with too many entries for one task is halved by where its spans may begin, each half being
split by the characters that all of its spans must have, down to the spans themselves, whose holders need no
comparison.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstone.runtime import cut

LENGTH, GRAM = 200, 96
#: Different surroundings that one task indexes as a block; larger blocks are split. It chooses the plan, not the result.
BLOCK_ROWS = 8192
#: Code points that are hashed at once.
CHUNK = 1 << 21

_POSITION = np.uint64((1 << 22) - 1)


def _gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each run of ``gram`` code points, built by doubling."""
    with np.errstate(over="ignore"):
        block = (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        block ^= block >> np.uint64(29)
        power, size, done, width = np.uint64(0x9E3779B97F4A7C15), 1, None, 0
        while True:
            if gram & size:
                if done is None:
                    done, width = block, size
                else:
                    n = min(len(done), len(block) - width)
                    done, width = done[:n] * power + block[width : width + n], width + size
            if size * 2 > gram:
                break
            block = block[:-size] * power + block[size:]
            power, size = power * power, size * 2
        done = done[: len(text) - gram + 1]
        done = (done ^ (done >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        return done ^ (done >> np.uint64(27))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size, least = 1, values
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return np.minimum(least[: len(values) - width + 1], least[width - size : width - size + len(values) - width + 1])


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def anchors_of(texts: list[str], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(number of the text, position, hash)`` of the anchors of texts of at least ``length`` code points.

    The texts together must be shorter than 2^22 code points, or be a single one.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    data = _code_points("".join(texts))
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    hashes = _gram_hashes(data, gram)
    own = np.repeat(np.arange(len(texts)), sizes)
    width = length - gram + 1
    marked = (hashes & ~_POSITION) | (np.arange(len(hashes), dtype=np.uint64) & _POSITION)
    least = _sliding_min(marked, width)
    starts = np.arange(len(least))
    inside = own[: len(least)] == own[starts + length - 1]
    at = (least[inside] & _POSITION).astype(np.int64)
    if len(hashes) > int(_POSITION):  # a single longer text: positions are kept by their low bits
        begin = starts[inside]
        at = begin + ((at - begin) & int(_POSITION))
    at = np.unique(at)
    return own[at], at - bounds[own[at]], hashes[at]


def _anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(keys: list[int], texts: list[str]) -> pa.RecordBatch:
            which, pos, hashes = anchors_of(texts, length, gram)
            ends = np.searchsorted(which, np.arange(len(keys) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (hashes.view(np.int64), pos.astype(np.int32))]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *lists], ["t", "hs", "ps"])

        for b in batches:
            keys, texts, size = [], [], 0
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if texts and size + len(x) > CHUNK:
                    yield emit(keys, texts)
                    keys, texts, size = [], [], 0
                keys.append(k)
                texts.append(x)
                size += len(x)
            if texts:
                yield emit(keys, texts)

    return run


def _surroundings(length: int, gram: int):
    side = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, text, spots in zip(b.column("t").to_pylist(), b.column("text").to_pylist(), b.column("spots").to_pylist()):
                for s in spots:
                    begin = max(0, s["pos"] - side)
                    out.append((s["h"], t, begin, s["pos"] - begin, text[begin : s["pos"] + length]))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()))], ["h", "t", "begin", "off", "around"])

    return run


def _in_common(texts: list[str], order: list[int], width: int) -> np.ndarray:
    """Length that each text of an order has in common with the one before it; the first has none."""
    out = np.zeros(len(order), np.int64)
    rows = _code_points("".join(texts[i].ljust(width, "\0") for i in order)).reshape(-1, width)
    differs = rows[1:] != rows[:-1]
    sizes = np.array([len(texts[i]) for i in order])
    same = np.where(differs.any(1), differs.argmax(1), width)
    out[1:] = np.minimum(same, np.minimum(sizes[1:], sizes[:-1]))
    return out


def factor_block(block: np.ndarray, off: list[int], around: list[str], first: np.ndarray, last: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int, gram: int) -> tuple[list[tuple[int, np.ndarray]], list[list[tuple[int, int]]]]:
    """Parses each entry of some blocks against the index of its block.

    ``block`` numbers the block of each entry, ``off`` is the place of the anchor in ``around``, spans begin from
    ``first`` to ``last`` places before the anchor, and ``lo``, ``hi`` are the least and the greatest text that has the
    entry. Returns the classes, ``(places before the anchor, entries)`` of spans that stand in two different texts, and
    for each entry the stretches ``[start, end)`` of it that such spans cover. Classes all of whose entries
    share another span too are left out.
    """
    side, n = length - gram, len(around)
    right = [x[o : o + length] for x, o in zip(around, off)]
    left = [x[:o][::-1] for x, o in zip(around, off)]
    sizes = np.array([len(x) for x in right]), np.array([len(x) for x in left])
    orders, common = [], []
    for texts, width in ((right, length), (left, max(side, 1))):
        order = sorted(range(n), key=lambda i, texts=texts: (block[i], texts[i]))
        shared = _in_common(texts, order, width)
        own = block[order]
        shared[0], shared[1:][own[1:] != own[:-1]] = -1, -1
        orders.append(np.array(order))
        common.append(shared)
    ranks = np.empty((2, n), np.int64)
    held: list[np.ndarray] = []  # class of each entry, by the places before the anchor; -1 without
    for k in range(side + 1):
        for i, depth in ((0, length - k), (1, k)):
            ranks[i, orders[i]] = np.cumsum(common[i] < depth)
        keys = ranks[1] * (n + 1) + ranks[0]
        may = (sizes[1] >= k) & (sizes[0] >= length - k) & (first <= k) & (k <= last)
        cls = np.full(n, -1, np.int64)
        if may.any():
            _, cls[may] = np.unique(keys[may], return_inverse=True)
        held.append(cls)
    classes: list[tuple[int, np.ndarray]] = []
    shared_at = np.zeros((n, side + 1), bool)
    counts = [np.bincount(c[c >= 0], minlength=1) for c in held]
    for k, cls in enumerate(held):
        at = np.flatnonzero(cls >= 0)
        if not len(at):
            continue
        at = at[np.argsort(cls[at], kind="stable")]
        starts = np.flatnonzero(np.r_[True, cls[at][1:] != cls[at][:-1]])
        size = np.diff(np.r_[starts, len(at)])
        real = np.minimum.reduceat(lo[at], starts) != np.maximum.reduceat(hi[at], starts)
        shared_at[at[np.repeat(real, size)], k] = True
        for near, least in ((k + 1, 0), (k - 1, 1)):
            if 0 <= near <= side:
                other = held[near][at]
                together = (np.minimum.reduceat(other, starts) == np.maximum.reduceat(other, starts)) & (other[starts] >= 0)
                real &= ~(together & (counts[near][np.maximum(other[starts], 0)] >= size + least))
        ends = starts + size
        classes += [(k, at[a:b]) for a, b in zip(starts[real], ends[real])]
    edges = np.diff(np.pad(shared_at, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    covers: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for (i, a), (_, b) in zip(np.argwhere(edges == 1), np.argwhere(edges == -1)):
        covers[i].append((off[i] - int(b) + 1, off[i] - int(a) + length))
    return classes, covers


_BLOCK = ["h", "first", "last", "part"]


def _parse(length: int, gram: int, want: str, rows_at_once: int = 4096):
    """Arrow batches of entries, in the order of their blocks, to the classes or the covered stretches of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows: pa.Table) -> pa.RecordBatch:
            h, c, d, lo, hi, first, last = (rows.column(x).to_numpy() for x in ("h", "c", "d", "lo", "hi", "first", "last"))
            part = rows.column("part").to_pylist()
            new = [True] + [part[i] != part[i - 1] for i in range(1, len(part))]
            block = np.cumsum(np.array(new) | np.r_[True, (h[1:] != h[:-1]) | (first[1:] != first[:-1]) | (last[1:] != last[:-1])])
            classes, covers = factor_block(block, rows.column("off").to_pylist(), rows.column("around").to_pylist(), first, last, lo, hi, length, gram)
            if want == "classes":
                at = np.concatenate([x for _, x in classes]) if classes else np.empty(0, np.int64)
                names = np.frombuffer(os.urandom(8 * len(classes)), np.int64)  # fixed by the written table of classes
                name = np.repeat(names, [len(x) for _, x in classes]) if classes else names
                return pa.RecordBatch.from_arrays([pa.array(x) for x in (h[at], name, c[at], d[at])] + [pa.array(np.full(len(at), -1, np.int32))], ["h", "k", "c", "d", "place"])
            flat = [(i, a, b) for i, own in enumerate(covers) for a, b in own]
            at = np.array([x[0] for x in flat], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(c[at]), pa.array(d[at]), pa.array([x[1] for x in flat], pa.int32()), pa.array([x[2] for x in flat], pa.int32())], ["c", "d", "cover_from", "cover_to"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) < rows_at_once:
                continue
            rows = pa.Table.from_batches(held)
            last = [rows.column(x)[rows.num_rows - 1].as_py() for x in _BLOCK]
            cut_at = rows.num_rows - 1  # the last block may go on in the next batch
            while cut_at > 0 and [rows.column(x)[cut_at - 1].as_py() for x in _BLOCK] == last:
                cut_at -= 1
            if cut_at:
                yield emit(rows.slice(0, cut_at).combine_chunks())
            held = rows.slice(cut_at).to_batches()
        if held:
            yield emit(pa.Table.from_batches(held).combine_chunks())

    return run


def reference_blocks(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The blocks of anchors that occur in two different texts.

    Returns ``members(t, doc_id)`` of every text of the length or more, ``t`` being the least id of its copies,
    ``entries(h, c, d, off, around, lo, hi)``, the different surroundings of each shared anchor with the least and
    the greatest text that has them, and ``holders(c, d, t, begin)``, where they stand.
    """
    src = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where((F.length("text") >= length) & F.col("doc_id").isNotNull())
    names = cut(src.select("doc_id", F.unhex(F.sha2("text", 256)).alias("name")).distinct())
    least = names.groupBy("name").agg(F.min("doc_id").alias("t"))
    members = cut(names.join(least, "name").select("t", "doc_id"))
    # one document of each text goes on: copies, however many, don't
    anchors = src.mapInArrow(_anchors(length, gram), "t long, hs array<long>, ps array<int>").join(members.select("t").distinct(), "t", "left_semi")
    anchors = cut(anchors.select("t", F.inline(F.arrays_zip("hs", "ps")).alias("h", "pos")))
    shared = anchors.groupBy("h").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo <> hi").select("h")
    spots = anchors.join(shared, "h", "left_semi").groupBy("t").agg(F.collect_set(F.struct("h", "pos")).alias("spots"))  # bounded by the text's own length
    around = src.withColumnRenamed("doc_id", "t").join(spots, "t").mapInArrow(_surroundings(length, gram), "h long, t long, begin int, off int, around string")
    around = cut(around.withColumn("c", F.xxhash64("h", "off", "around")).withColumn("d", F.xxhash64("around", "off")))
    entries = cut(around.groupBy("h", "c", "d", "off", "around").agg(F.min("t").alias("lo"), F.max("t").alias("hi")))
    return members, entries, around.select("c", "d", "t", "begin").distinct()


def _split_blocks(entries: DataFrame, length: int, gram: int, block_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Entries with their block ``(h, first, last, part)``, and those whose block is one span, however many they are.

    The spans of a block begin from ``first`` to ``last`` places before the anchor, so that all have the
    characters in between in common. A block of more than ``block_rows`` entries is halved: a span that begins in one of
    the halves has more characters in common, by which that half is split.
    """
    part = F.substring("around", F.col("off") - F.col("first") + 1, F.col("first") + F.lit(length) - F.col("last"))
    todo = entries.withColumn("first", F.lit(0)).withColumn("last", F.lit(length - gram)).withColumn("part", F.lit(""))
    small, whole = [], []
    while (large := cut(todo.groupBy(*_BLOCK).agg(F.count("*").alias("n")).where(F.col("n") > block_rows).select(*_BLOCK))).take(1):
        small.append(todo.join(large, _BLOCK, "left_anti"))
        again = todo.join(large, _BLOCK, "left_semi")
        whole.append(again.where("first = last"))
        middle = F.floor((F.col("first") + F.col("last")) / 2).cast("int")
        halves = F.array(F.struct(F.col("first").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("last").alias("b")))
        halved = again.where("first < last").withColumn("half", F.explode(halves)).withColumn("first", F.col("half.a")).withColumn("last", F.col("half.b")).drop("half")
        halved = halved.where((F.col("off") >= F.col("first")) & (F.length("around") - F.col("off") >= F.lit(length) - F.col("last")))
        todo = cut(halved.withColumn("part", part))  # log2 of the places, at most
    return functools.reduce(DataFrame.unionByName, small, todo), functools.reduce(DataFrame.unionByName, whole) if whole else None


def _parsed(entries: DataFrame, want: str, schema: str, length: int, gram: int) -> DataFrame:
    ordered = entries.repartition("h", "first", "last", "part").sortWithinPartitions(*_BLOCK)
    return ordered.mapInArrow(_parse(length, gram, want), schema)


def shared_pairs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(doc_id_a, doc_id_b)``: documents whose texts have a run of at least ``length`` code points in common.

    Null and shorter texts share nothing. Equal texts are parsed once and expanded at the end; a row
    delivered again counts once. Classes of spans, not pairs of entries, come out of the blocks; they are
    expanded to pairs once, here.
    """
    members, entries, holders = reference_blocks(documents, id_col, text_col, length, gram)
    small, whole = _split_blocks(entries, length, gram, block_rows)
    classes = _parsed(small, "classes", "h long, k long, c long, d long, place int", length, gram)
    if whole is not None:
        spans = whole.groupBy("h", "first", "part").agg(F.min("c").alias("k"), F.min("lo").alias("__lo"), F.max("hi").alias("__hi")).where("__lo <> __hi").drop("__lo", "__hi")
        classes = classes.unionByName(whole.join(spans, ["h", "first", "part"]).select("h", "k", "c", "d", F.col("first").alias("place")))
    held = cut(cut(classes).join(holders.select("c", "d", "t").distinct(), ["c", "d"]).select("h", "k", "place", "t").distinct())
    one = ["h", "k", "place"]
    texts = held.withColumnRenamed("t", "x").join(held.withColumnRenamed("t", "y"), one).where("x < y").select("x", "y").distinct()
    pairs = texts.join(members.select(F.col("t").alias("x"), F.col("doc_id").alias("a")), "x").join(members.select(F.col("t").alias("y"), F.col("doc_id").alias("b")), "y").select("a", "b")
    copies = members.withColumnRenamed("doc_id", "a").join(members.withColumnRenamed("doc_id", "b"), "t").where("a < b").select("a", "b")
    return pairs.unionByName(copies).select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of each text, joined where they touch."""
    kind = pa.list_(pa.struct([("span_start", pa.int32()), ("span_end", pa.int32())]))
    for b in batches:
        out = []
        for parts in b.column("parts").to_pylist():
            own: list[dict] = []
            for a, z in sorted((p["a"], p["b"]) for p in parts):
                if own and a <= own[-1]["span_end"]:
                    own[-1]["span_end"] = max(own[-1]["span_end"], z)
                else:
                    own.append({"span_start": a, "span_end": z})
            out.append(own)
        yield pa.RecordBatch.from_arrays([b.column("t"), pa.array(out, kind)], ["t", "spans"])


def shared_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(doc_id, spans ARRAY<STRUCT<span_start, span_end>>, shared_chars, n_chars, shared_part)``, one row per document.

    ``spans`` are the maximal stretches of the text that are covered by runs of at least ``length`` code points that
    stand in another document too. The work is linear in the shared text: no pairs of documents are built.
    Null texts have null figures; shorter texts share nothing; a text with copies is shared as a whole. Rows
    without an id are left out, an id delivered again counts once.
    """
    members, entries, holders = reference_blocks(documents, id_col, text_col, length, gram)
    small, whole = _split_blocks(entries, length, gram, block_rows)
    covered = _parsed(small, "covers", "c long, d long, cover_from int, cover_to int", length, gram)
    if whole is not None:
        spans = whole.groupBy("h", "first", "part").agg(F.min("lo").alias("__lo"), F.max("hi").alias("__hi")).where("__lo <> __hi").drop("__lo", "__hi")
        begin = F.col("off") - F.col("first")
        covered = covered.unionByName(whole.join(spans, ["h", "first", "part"], "left_semi").select("c", "d", begin.alias("cover_from"), (begin + length).alias("cover_to")))
    stretches = covered.join(holders, ["c", "d"]).select("t", (F.col("begin") + F.col("cover_from")).alias("a"), (F.col("begin") + F.col("cover_to")).alias("b"))
    spans = stretches.groupBy("t").agg(F.collect_set(F.struct("a", "b")).alias("parts")).mapInArrow(_merge, "t long, spans array<struct<span_start:int,span_end:int>>")
    n = F.length(text_col)
    ids = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), n.alias("n_chars")).dropDuplicates(["doc_id"])
    copies = members.groupBy("t").agg(F.count("*").alias("copies"))
    known = members.join(copies, "t").join(spans, "t", "left").select("doc_id", "copies", "spans")
    out = ids.join(known, "doc_id", "left")
    all_of_it = F.array(F.struct(F.lit(0).alias("span_start"), F.col("n_chars").alias("span_end")))
    out = out.withColumn("spans", F.when(F.col("n_chars").isNull(), None).when(F.col("copies") > 1, all_of_it).otherwise(F.coalesce("spans", F.array().cast("array<struct<span_start:int,span_end:int>>"))))
    chars = F.aggregate("spans", F.lit(0), lambda acc, x: acc + x["span_end"] - x["span_start"])
    return out.select("doc_id", "spans", chars.alias("shared_chars"), "n_chars", F.when(F.col("n_chars") > 0, chars / F.col("n_chars")).alias("shared_part"))
