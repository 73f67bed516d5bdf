"""Skeletons, splitting, languages and shared spans."""

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilstone.llm import confusables as C
from veilstone.llm import langid as L
from veilstone.llm import sharedspans as R
from veilstone.llm import splitting as S
from veilstone.llm import unicode_data as U

SAME = [("Ａｎｎ　Lee", "Ann Lee"), ("Café", "Café"), ("a​b﻿", "ab"), ("x y z", "x y z"), ("co‑op", "co-op"), ("Јасоb", "Jacob"), ("ΑΒΕ", "ABE"), ("２０２４－１", "2024-1"), ("⼈", "人"), ("ﬁx", "fix"), ("👍️", "👍"), ("a\U000e0041", "a"), ("é", "е́")]
OTHER = [("Ann", "ann"), ("Café", "Cafe"), ("a1", "a2"), ("a.b", "ab"), ("a  b", "a b"), ("臺", "台"), ("it's", "its"), ("o", "0"), ("I", "l")]


@pytest.fixture(scope="module")
def looks(spark):
    return U.looks(spark)


PUBLIC = [("ɡoogle", "google"), ("ꓮpple", "Apple"), ("ꮯom", "com"), ("ⲟne", "one"), ("ıs", "is"), ("ɑ", "a"), ("ꓢ", "S"), ("ᴏ", "o"), ("ᴄ", "c"), ("ꜱ", "s"), ("1⁄2", "1/2"), ("ʼ", "'"), ("ロ", "口"), ("一", "ー"), ("カ", "力"), ("Ӏ", "I"), ("ӏ", "l")]


@pytest.mark.parametrize("a,b", SAME + PUBLIC)
def test_same_looking(looks, a, b):
    assert looks.skeleton(a) == looks.skeleton(b)


@pytest.mark.parametrize("a,b", OTHER + [("m", "rn"), ("士", "土"), ("’", "'"), ("—", "-"), ("٠", "."), ("ç", "c")])
def test_visible_differences(looks, a, b):
    assert looks.skeleton(a) != looks.skeleton(b)


def test_skeleton_is_stable(looks):
    @settings(max_examples=200, deadline=None)
    @given(st.text(max_size=40))
    def check(text):
        once = looks.skeleton(text)
        assert looks.skeleton(once) == once and looks.skeleton(unicodedata.normalize("NFC", text)) == once

    check()
    assert looks.skeleton(None) is None and looks.skeleton("") == "" and len(looks.table) < 10_000


def test_letters_alone_leave_chinese_and_kana(spark):
    assert U.looks(spark, east=False).skeleton("一ロ Аnn") == "一ロ Ann"


def test_equal_strings_are_not_paired_one_by_one(spark):
    rows = [("t", "s", i, "Ann Lee") for i in range(5000)] + [("t", "s", 5000, "Аnn Lee")]
    df = spark.createDataFrame(rows, "source_table string, grp string, id long, text string")
    got = C.same_looking(df)
    assert got.count() == 5000 and got.where("id_b <> 5000").count() == 0


def test_pairs_of_equal_skeletons(spark):
    rows = [("t", "s", 1, "Ann"), ("t", "s", 2, "Аnn"), ("t", "s", 2, "Аnn"), ("t", "s", 3, "Ann"), ("t", "r", 4, "Аnn"), ("t", "s", 5, "ann"), ("u", "s", 6, "Ａｎｎ"), ("t", None, 7, "Ａｎｎ"), ("t", "s", None, "Ａｎｎ"), ("t", "s", 8, None), ("t", "s", 9, ""), ("t", "s", 10, "​"), ("t", "s", 11, " "), ("t", "s", 12, "A​nn")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "source_table string, grp string, id long, text string, look string")
    got = sorted(tuple(r) for r in C.same_looking(df).collect())
    assert got == [("t", 1, 2), ("t", 1, 12), ("t", 2, 3), ("t", 2, 12), ("t", 3, 12)]
    assert C.same_looking(df.limit(0)).count() == 0
    assert [r[0] for r in df.select(C.skeleton_column("text", U.looks(spark))).collect()][8:10] == ["Ann", None]


def long_text(seed, n=9000, sentences=True):
    random.seed(seed)
    topics = [["ship", "harbour", "sail", "deck", "anchor"], ["bread", "flour", "oven", "yeast", "crust"], ["code", "byte", "loop", "stack", "cache"]]
    out = []
    while sum(map(len, out)) < n:
        words = topics[len(out) // 12 % 3]
        out.append(" ".join(random.choice(words) for _ in range(random.randint(4, 14))) + (". " if sentences else " "))
    return "".join(out)


@pytest.mark.parametrize("text", [long_text(1), long_text(2, 40000), "x" * 7000, "中文字。" * 2000, "a\n" * 4000, long_text(3, sentences=False), "[PERSON_A] " * 900, "🏽" * 4500, " " * 5000, "é" * 3000, "short", ""])
def test_pieces_cover_the_text(text):
    pieces = S.split_text(text)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and all(0 <= e - s <= 2000 for s, e in pieces)
    assert all(b[0] == a[1] - 200 and b[1] > a[1] for a, b in zip(pieces, pieces[1:]))
    assert (len(pieces) > 1) == (len(text) > 2000)


def test_cuts_are_natural_and_follow_topics():
    text = long_text(5, 20000)
    for _, end in S.split_text(text)[:-1]:
        assert text[:end].endswith(". ") or text[:end].endswith(".")
    two = ("The ship left the harbour and set sail. " * 38) + ("Knead the flour and bake the bread. " * 40)
    turn = two.index("Knead")
    assert S.split_text(two)[0][1] == turn
    assert all(text[s:e] for s, e in S.split_text("word " * 2000, 100, 10))


def test_stops_inside_words_are_read_once():
    import time

    def seconds(n):
        text, began = "1.22.a-7." * n, time.perf_counter()
        S.split_text(text)
        return time.perf_counter() - began

    assert seconds(64_000) < 20 * max(seconds(8_000), 0.02)  # eight times the text, not its square


def test_split_long_table(spark):
    rows = [(1, long_text(1)), (1, long_text(1)), (2, None), (3, ""), (None, "x"), (4, "x" * 2000), (5, "x" * 2001)]
    df = spark.createDataFrame([(*r, 7, "p") for r in rows], "id long, text string, piece_no int, piece string")
    got = S.split_long(df, "id", "text").collect()
    assert {r["id"] for r in got} == {1, 3, 4, 5} and all(len(r["piece"]) == r["piece_end"] - r["piece_start"] for r in got)
    own = sorted((r for r in got if r["id"] == 1), key=lambda r: r["piece_no"])
    assert "".join(p["piece"][200 * (k > 0) :] for k, p in enumerate(own)) == rows[0][1]
    assert sorted(r["id"] for r in S.oversized(df, "id", "text").collect()) == [1, 5]
    assert S.split_long(df.limit(0), "id", "text").count() == 0
    with pytest.raises(ValueError):
        S.split_long(df, "id", "text", 100, 100)


def test_notations_of_languages(spark):
    labels = ["en", "EN", "en-US", "en_GB", "English", "ger", "zh_Hant", "中文", None, "", " ", "und", "mul", "ko", "pt-BR", "unknown"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, l string").orderBy("i").select(L.named_language("l")).collect()]
    assert got == ["en", "en", "en", "en", "en", "de", "zh", "zh", None, None, None, None, None, "ko", "pt", None]


def test_language_accuracy_on_held_out_rows(spark, data):
    big = data.replace("0.001", "0.01")
    rows = spark.read.parquet(f"{big}/obfuscate_results.parquet")
    model = L.train(rows, "result_id", "text", "lang", per_lang=60)
    chosen = rows.select("result_id", "text", L.named_language("lang").alias("label")).where("text <> '' and label is not null").dropDuplicates(["result_id"]).collect()
    segments = {}
    for r in L.segment_languages(rows, "result_id", "text", model).distinct().collect():
        segments.setdefault(r["id"], []).append(r)
    one = [(r["label"], segments[r["result_id"]][0]["lang"]) for r in chosen if len({x["lang"] for x in segments.get(r["result_id"], [])}) == 1]
    assert len(one) > 700 and sum(a == b for a, b in one) / len(one) > 0.9  # about 7 % of the labels are wrong on purpose
    assert all(0 <= x["confidence"] <= 1 and x["segment_start"] < x["segment_end"] for own in segments.values() for x in own)


def test_mixed_and_wrong_labels(spark, data):
    rows = spark.read.parquet(data.replace("0.001", "0.01") + "/obfuscate_results.parquet")
    model = L.train(rows, "result_id", "text", "lang", per_lang=60)
    en, de, ja = "Please send the customs form to the office before Friday.", "Bitte schicken Sie das Formular bis Freitag an das Büro.", "仮のパスワードは金曜日まで使えます。"
    cases = [(1, en, "en"), (2, en, "de"), (3, de + "\n" + en, "de"), (4, de, None), (5, "[PERSON_A] INFO 12:30", None), (6, None, "en"), (7, "", None), (8, ja + "\r\n" + de, "ja"), (8, ja + "\r\n" + de, "ja"), (9, de, "German"), (10, (en + " ") * 3000, "mul"), (None, de, "en")]
    df = spark.createDataFrame([(*c, "c") for c in cases], "result_id long, text string, lang string, confidence string")
    got = sorted((r["id"], r["lang"]) for r in L.relabel(df, "result_id", "text", "lang", model).collect())
    assert got == [(2, "en"), (3, "de"), (3, "en"), (4, "de"), (8, "de"), (8, "ja"), (10, "en")]
    runs = sorted((r["segment_start"], r["segment_end"], r["lang"]) for r in L.segment_languages(df.where("result_id = 3"), "result_id", "text", model).collect())
    assert runs == [(0, len(de), "de"), (len(de) + 1, len(de) + 1 + len(en), "en")]
    assert L.relabel(df.limit(0), "result_id", "text", "lang", model).count() == 0


def shared_corpus():
    random.seed(11)
    noise = lambda n: "".join(random.choice("abcdefgh 😀中") for _ in range(n))
    passage, other = noise(260), noise(205)
    texts = [noise(300) + passage + noise(50), passage, noise(10) + passage[:199] + noise(300), other + noise(400), noise(1000) + other, noise(30) + passage[30:240] + noise(9), "a" * 700, "b" + "a" * 250, noise(500), None, "", noise(199), "a" * 199 + "b" + noise(40)]
    texts += [texts[3], texts[0]]
    texts += [noise(20) + passage[5:] + noise(20 + i) for i in range(12)]
    return texts


def brute(texts, n=200):
    grams = [{t[i : i + n] for i in range(len(t) - n + 1)} if t else set() for t in texts]
    return sorted((i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if grams[i] & grams[j])


@pytest.mark.parametrize("block_rows", [0, 8192])
def test_shared_pairs_against_brute_force(spark, block_rows):
    texts = shared_corpus()
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, t string")
    assert sorted(map(tuple, R.shared_pairs(df.unionByName(df.limit(5)), block_rows=block_rows).collect())) == brute(texts)
    assert R.shared_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize("block_rows", [0, 8192])
def test_shared_spans_against_brute_force(spark, block_rows):
    texts = shared_corpus()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "x" * 300)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in R.shared_spans(df, block_rows=block_rows).collect()}
    assert set(got) == set(range(len(texts)))
    holders = {}
    for i, t in enumerate(texts):
        for k in range(len(t or "") - 199):
            holders.setdefault(t[k : k + 200], set()).add(i)
    for i, t in enumerate(texts):
        if t is None:
            assert got[i]["spans"] is None and got[i]["shared_part"] is None
            continue
        covered = {p for k in range(len(t) - 199) if len(holders[t[k : k + 200]]) > 1 for p in range(k, k + 200)}
        assert {p for s in got[i]["spans"] for p in range(s["span_start"], s["span_end"])} == covered and got[i]["shared_chars"] == len(covered)


@settings(max_examples=40, deadline=None)
@given(st.text("ab", min_size=60, max_size=400), st.text("ab", max_size=200), st.text("ab", max_size=200))
def test_equal_runs_share_an_anchor(run, before, after):
    length, gram = 60, 24
    _, _, h1 = R.anchors_of([before + run], length, gram)
    _, _, h2 = R.anchors_of([run + after], length, gram)
    assert set(h1.tolist()) & set(h2.tolist())


def test_anchors_of_a_very_long_text():
    random.seed(2)
    text = "".join(random.choice("abcd") for _ in range(4_300_000))
    _, pos, h = R.anchors_of([text])
    assert pos.max() > 4_200_000 and len(pos) > 60_000
    _, _, tail = R.anchors_of([text[-5000:]])
    assert set(tail.tolist()) <= set(h.tolist())
