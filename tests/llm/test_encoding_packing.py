"""Encoding against the tokenizer itself, and packing against its own invariants."""

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilstone.llm import encoding as E
from veilstone.llm import packing as P

TEXTS = [None, "", " ", "  two  spaces ", "plain words, don't we've", "<|endoftext|> is text", "日本語 と emoji 👩‍💻", "a\r\n\tb\n\n c", "x" * 5000, "１２３ ①② ½", "​zero‌width", "repeat repeat repeat"]


def rows(spark, texts, extra=True):
    data = [(i, t, "clash", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "doc_id long, text string, block string, idx int")
    return df if extra else df.select("doc_id", "text")


def test_ids_equal_the_tokenizer(spark):
    enc = E.encoder(E.vocabulary_path())
    for chars in (1, 40, 10**6):
        got = {r["doc_id"]: r["ids"] for r in E.encode_corpus(rows(spark, TEXTS), block_chars=chars).collect()}
        assert got == {i: (enc.encode_ordinary(t) if t else []) for i, t in enumerate(TEXTS)}


def test_ids_equal_the_other_library(spark, data):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    tok.encode_special_tokens = True
    docs = spark.read.parquet(f"{data}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["ids"] for r in E.encode_corpus(docs).collect()}
    assert got == {i: tok.encode(t, add_special_tokens=False).ids if t else [] for i, t in text.items()}


def test_round_trip(spark):
    back = {r["doc_id"]: r["text"] for r in E.decode_ids(E.encode_corpus(rows(spark, TEXTS))).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def test_decoding_row_by_row(spark):
    enc = E.encoder(E.vocabulary_path()).encode_ordinary
    rows = [(1, enc("ab cd")), (1, enc("ef")), (None, enc("日本 x")), (2, []), (3, None)]
    got = E.decode_ids(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "ab cd"), (1, "ef"), (None, "日本 x"), (2, ""), (3, None)], key=str)


def test_empty_repeated_and_null_ids(spark):
    assert E.encode_corpus(rows(spark, []).limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, len(r["ids"])) for r in E.encode_corpus(twice).collect()) == [(0, 1), (1, 2), (1, 2)]


def contents(plan):
    out = Counter()
    for pattern, bins in plan:
        for size, n in pattern:
            out[size] += n * bins
    return out


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 2048), st.integers(1, 300), max_size=40), st.sampled_from([None, (256, 512, 1024, 2048), (512, 2048, 1024, 2048)]))
def test_best_fit_places_every_item_once(histogram, policy):
    plan = P.best_fit(histogram, policy=policy)
    assert contents(plan) == Counter(histogram)
    assert all(sum(s * n for s, n in pattern) <= 2048 for pattern, _ in plan)


def test_best_fit_is_tight():
    plan = P.best_fit({1500: 10, 548: 10, 1024: 6})
    assert sum(n for _, n in plan) == 13
    assert sum(n for _, n, _ in P.cheapest({100: 1})) == 1 and P.cheapest({100: 1})[0][2] == 256 and P.cheapest({}) == []


def test_lengths_are_chosen_jointly():
    """Long containers cost more than their length: a mix of lengths beats the largest one and the smallest ones."""
    lengths, histogram = (256, 512, 1024, 2048), {1800: 5, 1000: 40, 200: 30, 90: 10}
    costs = {256: 300, 512: 512, 1024: 1100, 2048: 2600}
    joint = P.cost_of(P.cheapest(histogram, lengths, costs), costs)
    largest = P.cost_of(P.sized(histogram, lengths), costs)
    smallest = P.cost_of(P.sized(histogram, lengths, lengths), costs)
    assert joint < min(largest, smallest)
    assert contents([(c, n) for c, n, _ in P.cheapest(histogram, lengths, costs)]) == Counter(histogram)
    many = tuple(range(128, 2049, 128))  # too many policies to try all
    steep = {x: x + x * x / 1000 for x in many}
    assert P.cost_of(P.cheapest(histogram, many, steep), steep) <= P.cost_of(P.sized(histogram, many), steep)


@pytest.mark.parametrize("rank_rows", [3, 10**6])
def test_pack(spark, rank_rows):
    sizes = [0, None, 5000, 2048, 2047, 1] + [700] * 31 + [90] * 40
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "doc_id long, n_tokens int, container_id string")
    got = P.pack(df, rank_rows=rank_rows).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == set(range(len(sizes)))
    for i, s in enumerate(sizes):
        own = sorted(by_doc[i], key=lambda r: r["piece_no"])
        assert sum(r["n_tokens"] for r in own) == (s or 0)
        assert len(own) == max(1, -(-(s or 0) // 2048)) and [r["token_start"] for r in own] == [2048 * k for k in range(len(own))]
        assert all((r["container_id"] is None) == (not s) for r in own)
    load, length = Counter(), {}
    for r in got:
        if r["container_id"] is not None:
            load[r["container_id"]] += r["n_tokens"]
            length[r["container_id"]] = r["container_length"]
    assert all(load[c] <= length[c] <= 2048 for c in load)
    assert all(length[c] == min(x for x in P.LENGTHS if x >= load[c]) for c in load)
    assert len(load) == 20  # no container holds three of the 31 items of 700, and 4 are full without them: none can be saved
    assert P.pack(df.limit(0)).count() == 0


def test_token_counts(spark):
    got = {r["doc_id"]: r["n_tokens"] for r in P.token_counts(rows(spark, TEXTS)).collect()}
    enc = E.encoder(E.vocabulary_path())
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(TEXTS)}
