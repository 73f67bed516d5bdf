"""Scalar functions, matches with offsets and rules, against Python."""

import ipaddress
import re

import pytest
from pyspark.sql import functions as F

from veilstone.functions import text as T
from veilstone.functions.matching import matches, quoted
from veilstone.operators import names as N
from veilstone.operators import rules as R


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.repartition(2).select("i", expr(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_letters(spark):
    cases = {0: "A", 1: "B", 25: "Z", 26: "AA", 27: "AB", 51: "AZ", 52: "BA", 701: "ZZ", 702: "AAA", 18277: "ZZZ", 18278: "AAAA"}
    assert column(spark, list(cases), T.letters, "long") == list(cases.values())
    assert column(spark, [-1, None], T.letters, "long") == [None, None]


def test_language(spark):
    cases = [("plain words", "en"), ("這是中文", "zh"), ("", "en"), ("123 !?", "en"), (None, None), ("See you 明天 at the station", "en"), ("會議 ok 我知道", "zh"), ("ひらがな", "en"), ("。", "zh")]
    assert column(spark, [c for c, _ in cases], T.detect_language) == [x for _, x in cases]


def test_languages_in(spark):
    assert column(spark, ["請 Li 來", "a 中", "ab", "1", None], T.languages_in) == [["zh", "en"], ["zh"], ["en"], [], None]


def test_script_spacing(spark):
    texts = ["跟Ann說", "Ann說ok，Bob", "none", "", "中a", None]

    def python(t):
        cls = "　-〿㐀-鿿豈-﫿＀-￯"
        cuts = [m.start() for m in re.finditer(f"(?<=[{cls}])(?=[A-Za-z])|(?<=[A-Za-z])(?=[{cls}])", t)]
        index = []
        for i in range(len(t) + 1):
            index += [i] * (2 if i in cuts else 1)
        return re.sub(f"(?<=[{cls}])(?=[A-Za-z])|(?<=[A-Za-z])(?=[{cls}])", " ", t), index

    want = [python(t) if t is not None else (None, None) for t in texts]
    assert column(spark, texts, T.space_scripts) == [w for w, _ in want]
    assert column(spark, texts, T.space_scripts_index) == [w for _, w in want]


def test_checksums(spark):
    assert column(spark, ["4111 1111 1111 1111", "4111-1111-1111-1112", "411111111111", "５５００ 0000 0000 0004"], T.luhn_ok) == [True, False, False, True]
    assert column(spark, ["A123456789", "a123456789", "A123456788", "O100000009"], T.twid_ok) == [True, True, False, sum(d * w for d, w in zip([3, 5, 1, 0, 0, 0, 0, 0, 0, 0, 9], [1, 9, 8, 7, 6, 5, 4, 3, 2, 1, 1])) % 10 == 0]
    assert column(spark, ["123-45-6789", "000-45-6789", "666-45-6789", "912-45-6789", "123-00-6789", "123-45-0000"], T.ssn_ok) == [True, False, False, False, False, False]


def test_ipv6_against_python(spark):
    import random

    random.seed(5)
    cases = {"2001:db8::1", "::1", "a::", "1::2::3", ":::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "12345::1", ":1:2:3", "1:2:3:"}
    cases |= {":".join(random.choice(["", "1", "ab", "0000", "ffff"]) for _ in range(random.randint(3, 9))) for _ in range(400)}
    cases = sorted(c for c in cases if re.fullmatch("(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}", c))

    def ok(v):
        try:
            ipaddress.IPv6Address(v)
        except ValueError:
            return False
        return len(v) >= 6

    assert column(spark, cases, T.ipv6_ok) == [ok(c) for c in cases]


def test_name_parts(spark):
    cases = {"Ada Byron": ["Ada", "Byron"], "Dr Ada Byron": ["Ada", "Byron"], "Ada": [], "王小明": ["小明"], "歐陽娜娜": ["娜娜"], "王大小明": [], "小明": [], "Jean-Luc O'Neil": ["Jean-Luc", "O'Neil"], "J. Smith": ["Smith"], "ada Byron": ["Byron"], "": []}
    assert column(spark, list(cases), T.name_parts) == list(cases.values())


def test_labels_of_codes(spark):
    assert column(spark, ["[EMAIL_A]", "[X_AB]"], T.label_of_code) == ["EMAIL", "X"]
    assert column(spark, ["a [B_A] [B_A] [C_Z] [c_A] []", None], T.codes_in) == [["[B_A]", "[C_Z]"], None]


def test_matches_count_code_points(spark):
    text = "😀 ab 𝟛 ab\nab"
    got = column(spark, [text, "", None, "zz"], lambda c: matches(c, "ab"))
    assert [(m["start"], m["end"], m["text"]) for m in got[0]] == [(m.start(), m.end(), "ab") for m in re.finditer("ab", text)]
    assert got[1:] == [[], None, []]


def test_quoted_values(spark):
    rows = spark.createDataFrame([("Al met Alice, xAl Al1 Al.", "Al"), ("C++ and C++x", "C++"), ("a\\Eb \\E", "\\E"), ("明天明", "明")], "t string, v string")
    got = [[m["start"] for m in r[0]] for r in rows.select(matches(F.col("t"), quoted(F.col("v")))).collect()]
    assert got == [[0, 22], [0, 8], [5], [0, 2]]  # the first \\E touches a letter


POSITIVE = [
    ("write to kim@shop.example now", "EMAIL", "kim@shop.example"), ("寄到kim@shop.example吧", "EMAIL", "kim@shop.example"), ("see https://a.example/x?y=1).", "URL", "https://a.example/x?y=1"), ("網址https://a.example/路，好", "URL", "https://a.example/路"),
    ("card 4111 1111 1111 1111.", "CARD", "4111 1111 1111 1111"), ("at 192.168.0.254!", "IP", "192.168.0.254"), ("addr fe80::1:2 up", "IP", "fe80::1:2"), ("證A123456789號", "TWID", "A123456789"), ("ssn 123-45-6789", "SSN", "123-45-6789"),
    ("call 0912-345-678", "PHONE", "0912-345-678"), ("call +886 912 345 678", "PHONE", "+886 912 345 678"), ("(02) 2345-6789", "PHONE", "(02) 2345-6789"), ("02-2345-6789", "PHONE", "02-2345-6789"), ("+44 20 7946 0958", "PHONE", "+44 20 7946 0958"), ("(555) 010-9999", "PHONE", "(555) 010-9999"),
    ("password: hunter22 ok", "SECRET", "hunter22"), ("API_KEY=\"abcd-1234\"", "SECRET", "abcd-1234"), ("密碼：p@ss1234，", "SECRET", "p@ss1234"), ("sk-" + "a1" * 12, "SECRET", "sk-" + "a1" * 12), ("AKIA" + "A1" * 8, "SECRET", "AKIA" + "A1" * 8),
    ("臺北市中正區重慶南路一段122號3樓之1", "LOC", "臺北市中正區重慶南路一段122號3樓之1"), ("住在中山路５號", "LOC", "中山路５號"), ("12 Oak Hill Road, Apt 3B, Springfield, IL 62704.", "LOC", "12 Oak Hill Road, Apt 3B, Springfield, IL 62704"), ("at 5 W. 4th St NE today", "LOC", "5 W. 4th St NE"),
]
NEGATIVE = [("build 7.7.7.7.7", "IP"), ("card 4111 1111 1111 1112", "CARD"), ("A123456788", "TWID"), ("000-12-3456", "SSN"), ("環北路與新生路口", "LOC"), ("線路 3 號", "LOC"), ("the 3 roads", "LOC"), ("xkim@", "EMAIL"), ("pwd: abc", "SECRET"), ("1234567", "PHONE"), ("256.1.1.1", "IP")]


@pytest.fixture(scope="module")
def found(spark):
    texts = [t for t, *_ in POSITIVE + NEGATIVE]
    return dict(zip(texts, column(spark, texts, R.rule_spans)))


@pytest.mark.parametrize("text,label,value", POSITIVE)
def test_rule_finds(found, text, label, value):
    assert (label, value, text.index(value)) in [(s["label"], s["text"], s["start"]) for s in found[text]]


@pytest.mark.parametrize("text,label", NEGATIVE)
def test_rule_leaves(found, text, label):
    assert label not in {s["label"] for s in found[text]}


def test_rules_of_null_and_empty(spark):
    assert column(spark, [None, ""], R.rule_spans) == [None, []]
    assert column(spark, ["x"], lambda c: R.rule_spans(c, ())) == [[]]
    own = R.Rule("ticket", "ID", "TK-\\d+")
    assert [s["text"] for s in column(spark, ["see TK-12 TK-9"], lambda c: R.rule_spans(c, (own,)))[0]] == ["TK-12", "TK-9"]


def test_given_names_only_beside_chinese(spark):
    def values(text):
        return [(s["start"], s["text"]) for s in column(spark, [text], lambda c: N.given_name_matches(c, ["Jason", "Emily", "Mary-Jane"]))[0]]

    assert values("Jason is here") == []
    assert values("跟Jason說 hi Emily Chen Wang Lee") == [(1, "Jason"), (11, "Emily Chen Wang")]
    assert values("Hi Emily 你好\nJason left") == [(3, "Emily")]
    assert values("這是Jason's電腦") == [(2, "Jason")]
    assert values("Mary-Jane 在") == [(0, "Mary-Jane")]
    assert values("Jasonx在 xJason") == []


def test_titles(spark):
    got = column(spark, ["請問 Dr. Kevin Lee 在嗎", "Dr. Kevin Lee", "Mrs Wu來了"], N.titled_matches)
    assert [[(s["start"], s["text"]) for s in x] for x in got] == [[(7, "Kevin Lee")], [], [(4, "Wu")]]


def test_speakers(spark):
    chat = "10:23 張明：好\n[10:24] Emma: ok\n業務員: 在\nNote: x\n王先生\t嗨\n 　Bob: no"
    rows = spark.createDataFrame([(chat, ["Emma"]), (chat, ["Nobody"]), (chat, [])], "t string, p array<string>")
    got = [[s["text"] for s in r[0]] for r in rows.select(N.speaker_matches(F.col("t"), F.col("p"))).collect()]
    assert got == [["張明", "Emma", "王先生"], [], []]
