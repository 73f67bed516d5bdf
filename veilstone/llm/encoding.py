"""Token ids of a whole corpus by a public byte-level BPE vocabulary.

Pre-tokens repeat: a block of texts is reduced to its distinct words and one word number per position.
The words of all blocks are shuffled, each distinct one of the corpus is encoded once, and its ids are joined
back to the blocks, which put the ids together by position.
"""

from __future__ import annotations

import base64
import functools
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstone.runtime import cut

#: Code points of text in a block; it bounds what one block needs in memory.
BLOCK_CHARS = 2_000_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Place of a vocabulary file of the installed public tokenizers; callers may pass another."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@functools.cache
def pattern() -> str:
    """The pre-token pattern that belongs to the vocabulary."""
    import public_tokenizers

    return public_tokenizers.PATTERN


@functools.cache
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def encoder(path: str):
    """The encoder of one vocabulary, made once per Python worker."""
    import tiktoken

    return tiktoken.Encoding("corpus", pat_str=pattern(), mergeable_ranks=_ranks(path), special_tokens={})


def _blocks(chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        import zstandard

        find = regex.compile(pattern()).findall

        def emit(ids: list, found: list[list[str]]) -> pa.RecordBatch:
            coded = pa.array(itertools.chain.from_iterable(found), pa.string()).dictionary_encode()
            lens = np.fromiter(map(len, found), np.int32, len(found))
            codes = coded.indices.to_numpy().astype(np.int32)
            name = int.from_bytes(os.urandom(8), "little", signed=True)  # fixed by the written table of blocks
            packed = zstandard.compress(codes.tobytes())
            cols = [pa.array([name], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int32())), pa.array([packed], pa.binary()), pa.array([coded.dictionary.to_pylist()], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(cols, ["block", "doc_ids", "lens", "codes", "words"])

        ids, found, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                found.append(find(t) if t else [])
                size += len(t or "") + 1
                if size >= chars:
                    yield emit(ids, found)
                    ids, found, size = [], [], 0
        if ids:
            yield emit(ids, found)

    return run


def _width(path: str) -> str:
    """Bytes that an id of the vocabulary needs in a shuffle."""
    return "<u2" if max(_ranks(path).values()) < 1 << 16 else "<u4"


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, kind = encoder(path).encode_ordinary, _width(path)
        for b in batches:
            ids = [np.array(one(w), kind).tobytes() for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["word", "ids"])

    return run


def _assemble(left: pa.Table, right: pa.Table, kind: str) -> pa.Table:
    import zstandard

    n = right.num_rows
    out_ids, out_lists = [], []
    if n:
        packed = right.column("ids").combine_chunks()
        spot = np.empty(n, np.int64)
        spot[right.column("idx").to_numpy()] = np.arange(n)
        width = np.dtype(kind).itemsize
        offs = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + n + 1] // width
        flat = np.frombuffer(packed.buffers()[2], kind, count=int(offs[-1]))
        size = np.diff(offs)[spot]
        first = offs[:-1][spot]
    for row in left.select(["doc_ids", "lens", "codes"]).to_pylist():
        codes = np.frombuffer(zstandard.decompress(row["codes"]), np.int32)
        lens = np.asarray(row["lens"], np.int64)
        if len(codes):
            each = size[codes]
            ends = np.cumsum(each)
            at = np.arange(ends[-1]) - np.repeat(ends - each, each) + np.repeat(first[codes], each)
            values = flat[at]
            bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lens)])]
        else:
            values, bounds = np.empty(0, np.int32), np.zeros(len(lens) + 1, np.int64)
        out_ids.append(pa.array(row["doc_ids"], pa.int64()))
        out_lists.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.astype(np.int32), pa.int32())))
    return pa.table({"doc_id": pa.chunked_array(out_ids, pa.int64()), "ids": pa.chunked_array(out_lists, pa.list_(pa.int32()))})


def _tasks(blocks: int) -> int:
    """Tasks that put blocks together: two blocks each, or up to 64 of them where there would be too many tasks."""
    return max(1, -(-blocks // 2) if blocks <= 40_000 else max(20_000, -(-blocks // 64)))


def encode_corpus(documents: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id LONG, ids ARRAY<INT>)``, one row per document row, without special tokens.

    Null and empty texts have the empty list of ids, rows without an id a null id. Strings that look like
    special tokens are ordinary text. A text is never cut: a longer one makes a block of its own.
    """
    path = vocabulary or vocabulary_path()
    src = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = cut(src.mapInArrow(_blocks(block_chars), "block long, doc_ids array<long>, lens array<int>, codes binary, words array<string>"))
    words = blocks.select(F.col("block").alias("home"), F.posexplode("words").alias("idx", "word"))
    distinct = words.select("word").distinct().mapInArrow(_encode(path), "word string, ids binary")
    back = words.join(distinct, "word").select("home", "idx", "ids")
    skeleton = blocks.select("block", "doc_ids", "lens", "codes")
    kind = _width(path)

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        return _assemble(left, right, kind)

    n = _tasks(blocks.count())  # read from the footers of the written table
    return skeleton.repartition(n, "block").groupBy("block").cogroup(back.repartition(n, "home").groupBy("home")).applyInArrow(together, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, text)`` of ``(doc_id, ids)``, row by row: the ids looked up in the token-byte table, which has a fixed size.

    An empty list gives the empty text, null gives null; ids may repeat or be null. A list that isn't whole UTF-8, such as
    a piece of a text, has the replacement character where bytes are missing.
    """
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {i: b for b, i in _ranks(path).items()}
        for b in batches:
            texts = [None if ids is None else b"".join(map(token.__getitem__, ids)).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    own = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {own}, text string")
