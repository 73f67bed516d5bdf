"""Span algebra, code books, restoring, edits and the fold over sessions."""

import random

from pyspark.sql import functions as F

from veilstone.operators import codebook as C
from veilstone.operators import edits as E
from veilstone.operators import fold as D
from veilstone.operators import restore as X
from veilstone.operators import spans as S
from veilstone.operators.rules import SPANS

DOCS = "session_id string, seq long, doc_id long, text string, lang_choice string, scope string"


def fold(spark, texts, session="s", scope="all", names=("Jason", "Emily"), lang="auto"):
    rows = spark.createDataFrame([(session, i, i, t, lang, scope) for i, t in enumerate(texts)], DOCS)
    return sorted(D.obfuscate_sessions(rows, names=names).collect(), key=lambda r: r["seq"])


def test_overlaps_against_python(spark):
    random.seed(3)
    rows = []
    for i in range(60):
        rows.append((i, [(a, a + random.randint(1, 9), "L", "x", random.choice([0.5, 1.0]), k) for k in range(random.randint(0, 8)) for a in [random.randint(0, 20)]]))
    got = {r["i"]: r["k"] for r in spark.createDataFrame(rows, f"i int, s {SPANS}").select("i", S.resolve_overlaps(F.col("s")).alias("k")).collect()}
    for i, spans in rows:
        kept = []
        for s in sorted(spans, key=lambda s: (s[0], s[0] - s[1], -s[4], s[5])):
            if not kept or s[0] >= kept[-1][1]:
                kept.append(s)
        assert [tuple(x) for x in got[i]] == kept


def test_scope_before_overlaps(spark):
    spans = [(0, 20, "ORG", "Ann Lee Trading Corp", 1.0, 0), (0, 7, "PERSON", "Ann Lee", 1.0, 1)]
    rows = spark.createDataFrame([(spans, "names"), (spans, "all"), (spans, None)], f"s {SPANS}, scope string")
    got = [[x["label"] for x in r[0]] for r in rows.select(S.resolve_overlaps(S.keep_scope(F.col("s"), F.col("scope")))).collect()]
    assert got == [["PERSON"], ["ORG"], ["ORG"]]


def test_ignored_and_known(spark):
    spans = [(0, 3, "A", "one", 1.0, 0), (4, 5, "B", "x", 1.0, 1), (6, 9, "C", "one", 1.0, 2)]
    row = spark.createDataFrame([(spans, {"one": "OLD", "two": "T", "y": "Z"}, ["two"])], f"s {SPANS}, k map<string,string>, i array<string>")
    got = row.select(S.known_values(F.col("s"), F.col("k")), S.drop_ignored(F.col("s"), F.array(F.lit("one"))), S.drop_ignored(F.col("s"), F.lit(None).cast("array<string>"))).first()
    assert got[0] == {"one": "C", "two": "T"} and [x["text"] for x in got[1]] == ["x"] and len(got[2]) == 3


def test_aliases(spark):
    one = spark.createDataFrame([(["John Smith", "John Doe", "王小明", "Doe"],)], "n array<string>").select(S.text_aliases(F.col("n"))).first()[0]
    assert sorted(one) == ["Smith", "小明"]
    names = spark.createDataFrame([("s", "John Smith", "[P_A]"), ("s", "John A. Smith", "[P_A]"), ("s", "John Doe", "[P_B]"), ("s", "Doe", "[P_C]"), ("t", "John Doe", "[P_A]")], "session_id string, original string, code string")
    got = {(r["session_id"], r["part"], r["key"]) for r in S.unique_aliases(names, "session_id", "original", "code").collect()}
    assert got == {("s", "Smith", "[P_A]"), ("t", "John", "[P_A]"), ("t", "Doe", "[P_A]")}


def test_codes_are_stable_and_restore(spark):
    texts = ["mail a@x.example and b@x.example", "again a@x.example, 10.0.0.7", "b@x.example a@x.example"]
    out = fold(spark, texts)
    assert out[0]["text"] == "mail [EMAIL_A] and [EMAIL_B]" and out[1]["text"] == "again [EMAIL_A], [IP_A]" and out[2]["text"] == "[EMAIL_B] [EMAIL_A]"
    for r, t in zip(out, texts):
        assert all(t[s["start"] : s["end"]] == s["text"] for s in r["spans"])
        assert all(r["text"][s["start"] : s["end"]] == s["code"] for s in r["code_spans"])
    results = spark.createDataFrame(out)
    book = D.code_book(results)
    assert {(r["label"], r["n"]) for r in D.counters(book).collect()} == {("EMAIL", 2), ("IP", 1)}
    back = X.restore_table(results, C.originals_of_codes(book), "doc_id", "session_id", "text")
    assert [r["text"] for r in back.orderBy("id").collect()] == texts


def test_names_link_within_a_session(spark):
    out = fold(spark, ["跟Emily Chen說", "Emily wrote, Chen too", "請Jason來"])
    assert [r["text"] for r in out] == ["跟[PERSON_A]說", "[PERSON_A] wrote, [PERSON_A] too", "請[PERSON_B]來"]


def test_book_links_full_name_to_its_part_once():
    book = D.CodeBook()
    assert book.code_for("John", "PERSON") == "[PERSON_A]"
    assert book.code_for("John Smith", "PERSON") == "[PERSON_A]"
    assert book.code_for("John Doe", "PERSON") == "[PERSON_B]"
    assert book.code_for("Smith", "PERSON") == "[PERSON_A]"
    assert book.code_for("John", "LOC") == "[PERSON_A]"
    assert book.code_for("Doe Street", "LOC") == "[LOC_A]"


def test_unmark_and_mark():
    book = D.CodeBook()
    book.code_for("Ann Lee", "PERSON")
    book.code_for("Ann", "PERSON")
    assert book.unmark("[PERSON_A]") == ["Ann Lee", "Ann"] and not book.to_code and book.unmark("[PERSON_A]") == []
    assert book.code_for("Bo Li", "PERSON") == "[PERSON_B]"
    assert book.mark("Ann Lee", "ORG") == {"Ann Lee": "[PERSON_A]"}
    assert D.CodeBook().mark("王小明", "PERSON") == {"王小明": "[PERSON_A]", "小明": "[PERSON_A]"}


def test_single_characters_are_not_propagated(spark):
    assert list(D.occurrences("明天 明", "明")) == [(0, 1), (3, 4)]
    spans = D.spans_to_code("明 明天", [(0, 1, "PERSON", "明", 1.0)], [], D.CodeBook(), "all")
    assert [(s[0], s[1]) for s in spans] == [(0, 1)]


def test_sessions_go_on_from_their_state(spark):
    first = spark.createDataFrame([("s", 0, 0, "a@x.example 10.0.0.1 Emily在", "auto", "all"), ("t", 0, 1, "b@x.example", "auto", "all")], DOCS)
    book = D.code_book(spark.createDataFrame(D.obfuscate_sessions(first).collect(), D.RESULT))
    book, ignored = C.unmark(book, spark.createDataFrame([], "session_id string, original string, code string, ord long"), spark.createDataFrame([("s", "[IP_A]")], "session_id string, code string"))
    more = spark.createDataFrame([("s", 1, 2, "Emily: 10.0.0.1 10.0.0.2 c@x.example a@x.example", "auto", "all"), ("u", 0, 3, "a@x.example", "auto", "all")], DOCS)
    got = {r["doc_id"]: r for r in D.obfuscate_sessions(more, book=book, ignored=ignored).collect()}
    assert got[2]["text"] == "[PERSON_A]: 10.0.0.1 [IP_B] [EMAIL_B] [EMAIL_A]" and got[3]["text"] == "[EMAIL_A]"
    assert [(e["original"], e["ord"]) for e in got[2]["new_codes"]] == [("10.0.0.2", 3), ("c@x.example", 4)]
    counted = D.obfuscate_sessions(more, book=book, counters=spark.createDataFrame([("s", "EMAIL", 9)], "session_id string, label string, n long"))
    assert "[EMAIL_J]" in {r["doc_id"]: r["text"] for r in counted.collect()}[2]


def test_fake_models_in_scenarios(spark):
    from veilstone.operators import detectors as M

    def coded(text, slot, *found, scope="all", lang="auto"):
        registry = M.Registry()
        registry.register(slot, lambda: lambda t: [(t.index(v), t.index(v) + len(v), label, 0.9) for v, label in found if v in t])
        docs = M.model_spans(spark.createDataFrame([("s", 0, 0, text, lang, scope)], DOCS), registry)
        return D.obfuscate_sessions(docs, names=("Jason",), extra=F.col("model_cand"), model_used=F.col("model_used")).first()["text"]

    assert coded("Rosa rang. Later Rosa wrote to Tim.", "en", ("Rosa", "PERSON")) == "[PERSON_A] rang. Later [PERSON_A] wrote to Tim."
    assert coded("Rosa Diaz rang, Diaz and Rosa agreed", "en", ("Rosa Diaz", "PERSON")) == "[PERSON_A] rang, [PERSON_A] and [PERSON_A] agreed"
    assert coded("李大華說，大華走了", "zh", ("李大華", "PERSON")) == "[PERSON_A]說，[PERSON_A]走了"
    assert coded("收件：李大華診所", "zh", ("李大華診所", "ORG"), ("李大華", "PERSON"), scope="names") == "收件：[PERSON_A]診所"
    assert coded("收件：李大華診所", "zh", ("李大華診所", "ORG"), ("李大華", "PERSON")) == "收件：[ORG_A]"
    assert coded("李大華：早\n陳立：早\n備註：無\n9:15\t林安\t好", "zh", ("李大華", "PERSON")) == "[PERSON_A]：早\n[PERSON_B]：早\n備註：無\n9:15\t[PERSON_C]\t好"
    assert coded("請Zed Qor說好", "pii", ("Zed Qor 說", "PERSON")) == "請[PERSON_A]說好"
    assert coded("Zed is here", "mixed", ("Zed", "PERSON")) == "Zed is here" and coded("Zed在", "mixed", ("Zed", "PERSON"), lang="zh") == "[PERSON_A]在"
    assert coded("大華主持stand-up", "zh", ("大華", "PERSON"), ("stand-up", "PERSON")) == "[PERSON_A]主持stand-up"
    assert coded("Jason's 電腦", "zh") == "[PERSON_A]'s 電腦"


def test_null_empty_repeated_and_sessionless(spark):
    rows = spark.createDataFrame([("s", 0, 1, "a@x.example", "auto", "all"), ("s", 0, 1, "a@x.example", "auto", "all"), ("s", 1, 2, None, "zh", None), ("s", 2, 3, "", None, "all"), (None, None, 4, "a@x.example b@x.example", None, None), ("s", 3, 5, "x " * 20000 + "a@x.example", "en", "all")], DOCS)
    out = {r["doc_id"]: r for r in D.obfuscate_sessions(rows).collect()}
    assert sorted(out) == [1, 2, 3, 4, 5] and out[2]["text"] is None and out[3]["text"] == "" and out[3]["spans"] == []
    assert out[4]["text"] == "[EMAIL_A] [EMAIL_B]" and out[5]["text"].endswith("x [EMAIL_A]")
    assert D.obfuscate_sessions(rows.limit(0)).count() == 0


def test_fold_equals_native_on_single_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("text is not null").select(F.lit(None).cast("string").alias("session_id"), "seq", "doc_id", "text")
    spans = D.stage_a(docs, names=()).withColumn("s", S.resolve_overlaps(F.col("cand")))
    native = {r[0]: r[1] for r in spans.select("doc_id", C.obfuscate(F.col("text"), F.col("s"), C.document_codes(F.col("s")))["text"]).collect()}
    folded = {r["doc_id"]: r["text"] for r in D.obfuscate_sessions(docs, names=()).collect()}
    same = sum(native[i] == folded[i] for i in native)
    assert len(native) == len(folded) and same >= 0.9 * len(native)  # the fold also codes occurrences that rules missed


def test_assign_codes_and_hot_numbering(spark):
    rows = spark.createDataFrame([("s", i, 0, "ID", f"v{i % 40:02d}") for i in range(200)] + [("t", 0, 0, "IP", "v"), (None, 0, 0, "IP", "v"), ("t", 0, 0, None, "w")], "session_id string, seq long, start int, label string, text string")
    plain, salted = (sorted(map(tuple, C.assign_codes(rows, n).collect())) for n in (10**6, 9))
    assert plain == salted and len(plain) == 41
    assert ("s", "v27", "ID", "[ID_AB]", 27) in plain


def test_book_tables(spark):
    book = spark.createDataFrame([("s", "Ann", "PERSON", "[PERSON_A]", 0), ("s", "Ann Lee", "PERSON", "[PERSON_A]", 1), ("s", "Leo Ann", "PERSON", "[PERSON_A]", 2), ("s", "x", "IP", "[IP_AA]", 3), ("s", "y", "IP", "[IP_B]", 4)], "session_id string, original string, label string, code string, ord long")
    ignored = spark.createDataFrame([("s", "long gone", "[IP_A]", 0), ("s", "gone", "[IP_A]", 1), ("s", "no", "[IP_B]", 2)], "session_id string, original string, code string, ord long")
    assert {(r["code"], r["original"]) for r in C.restore_lookup(book, ignored).collect()} == {("[PERSON_A]", "Ann Lee"), ("[IP_AA]", "x"), ("[IP_B]", "y"), ("[IP_A]", "gone")}
    assert [(r["rank"], r["code"], r["originals"]) for r in C.preview(book).orderBy("rank").collect()] == [(1, "[IP_B]", ["y"]), (2, "[IP_AA]", ["x"]), (3, "[PERSON_A]", ["Ann Lee", "Leo Ann", "Ann"])]
    kept, gone = C.unmark(book, ignored, spark.createDataFrame([("s", "[PERSON_A]"), ("s", "[NO_A]")], "session_id string, code string"))
    assert kept.count() == 2 and [r["original"] for r in gone.orderBy("ord").collect()] == ["long gone", "gone", "no", "Ann Lee", "Leo Ann", "Ann"]


def test_restore_and_counts(spark):
    rows = spark.createDataFrame([("x [A_A] [A_A] [B_B] [a_A] [C_C] [B_B]", {"[A_A]": "[B_B]!"}), ("none", {}), (None, {}), ("[A_A]", None)], "t string, m map<string,string>")
    got = [r[0] for r in rows.select(X.restore(F.col("t"), F.col("m"))).collect()]
    assert tuple(got[0]) == ("x [B_B]! [B_B]! [B_B] [a_A] [C_C] [B_B]", 2, ["[B_B]", "[C_C]"])
    assert tuple(got[1]) == ("none", 0, []) and got[2] is None and tuple(got[3]) == ("[A_A]", 0, ["[A_A]"])


def test_recommend(spark):
    texts = spark.createDataFrame([(1, "[A_A] [A_B]"), (2, "[A_A]"), (3, "[Z_Z]"), (4, None)], "id long, text string")
    lookup = spark.createDataFrame([("p", "[A_A]"), ("q", "[A_A]"), ("q", "[A_B]")], "session_id string, code string")
    order = spark.createDataFrame([("p", 0), ("q", 1)], "session_id string, ord long")
    assert {tuple(r) for r in X.recommend(texts, lookup, order).select("id", "session_id", "matches").collect()} == {(1, "q", 2), (2, "p", 1)}


def test_recommend_against_counting(spark):
    random.seed(9)
    codes = [f"[{x}_{y}]" for x in "PQ" for y in "ABCDE"]
    books = {f"s{k}": set(random.sample(codes, random.randint(0, 7))) for k in range(12)}
    texts = [(i, " ".join(random.choices([*codes, "[Z_Z]", "word"], k=random.randint(0, 6)))) for i in range(150)]
    want = {}
    for i, t in texts:
        best = max(((len(held & set(t.split())), -k) for k, held in enumerate(books.values())))
        if best[0]:
            want[i] = (f"s{-best[1]}", best[0])
    lookup = spark.createDataFrame([(s, c) for s, held in books.items() for c in held], "session_id string, code string")
    order = spark.createDataFrame([(s, k) for k, s in enumerate(books)], "session_id string, ord int")
    got = X.recommend(spark.createDataFrame(texts, "id int, text string"), lookup, order)
    assert {r["id"]: (r["session_id"], r["matches"]) for r in got.collect()} == want


def test_recommend_compares_few_sets_with_the_same_result(spark):
    random.seed(4)
    codes = [f"[P_{chr(65 + k)}]" for k in range(20)]
    books = {f"s{k}": set(codes[: random.randint(1, 20)]) | set(random.sample(codes, 2)) for k in range(300)} | {"odd": {"[Q_A]", codes[19]}}
    lookup = spark.createDataFrame([(s, c) for s, held in books.items() for c in held], "session_id string, code string")
    order = spark.createDataFrame([(s, k) for k, s in enumerate(books)], "session_id string, ord int")
    texts = [(i, " ".join(random.choices([*codes, "[Q_A]", "[Z_Z]"], k=random.randint(0, 9)))) for i in range(200)]
    want = {}
    for i, t in texts:
        n, k = max((len(held & set(t.split())), -k) for k, held in enumerate(books.values()))
        if n:
            want[i] = (list(books)[-k], n)
    rows = spark.createDataFrame(texts, "id int, text string")
    for most in (10**6, 0):
        got = X.recommend(rows, lookup, order, most_codes=most)
        assert {r["id"]: (r["session_id"], r["matches"]) for r in got.collect()} == want
    held = lookup.join(order, "session_id").groupBy("ord", "session_id").agg(F.collect_set("code").alias("held"))
    alone = [k for k, (s, h) in enumerate(books.items()) if not any(h <= x for x in list(books.values())[:k])]
    assert sorted(r["ord"] for r in X._sets_to_compare(held).collect()) == alone
    assert set(alone) <= {r["ord"] for r in X._sets_to_compare(held, 7).collect()}


def test_edits_are_inverse(spark):
    text, originals = "a [P_A] b [P_B] c [P_A]", ["Ann Lee", "Bo", "Ann"]
    spans = [(2, 7, "P", "[P_A]"), (10, 15, "P", "[P_B]"), (18, 23, "P", "[P_A]")]
    row = spark.createDataFrame([(text, spans, originals)], f"t string, s {C.CODE_SPANS}, o array<string>")
    back = row.select(E.revert_code(F.col("t"), F.col("s"), F.col("o"), F.lit("[P_A]")).alias("r")).select("r.*")
    r = back.first()
    assert r["text"] == "a Ann Lee b [P_B] c Ann" and r["originals"] == ["Bo"] and [(s["start"], s["end"]) for s in r["code_spans"]] == [(12, 17)]
    again = back.select(E.apply_codes(F.col("text"), F.col("code_spans"), F.col("originals"), F.create_map(F.lit("Ann Lee"), F.lit("[P_A]"), F.lit("Ann"), F.lit("[P_A]"), F.lit("P"), F.lit("[Q_A]"))).alias("r")).select("r.*").first()
    assert again["text"] == text and again["originals"] == originals and [tuple(s) for s in again["code_spans"]] == spans and again["replaced"] == 2


def test_transcripts(spark):
    one = [(2, 7, "P", "[P_A]")]
    replies = spark.createDataFrame([(1, "s", "a [P_A] Bo", one, ["Ann"]), (2, "t", "a [P_A] Bo", one, ["Ann"]), (3, None, "Bo", [], [])], f"id long, session_id string, text string, code_spans {C.CODE_SPANS}, originals array<string>")
    undone = E.unmark_in_transcript(replies, spark.createDataFrame([("s", "[P_A]")], "session_id string, code string"))
    assert {r["id"]: r["text"] for r in undone.collect()} == {1: "a Ann Bo", 2: "a [P_A] Bo", 3: "Bo"}
    marked = E.mark_in_transcript(replies, spark.createDataFrame([("s", {"Bo": "[P_B]", "a [P_A]": "[X_A]"})], "session_id string, values map<string,string>"))
    assert {r["id"]: (r["text"], r["replaced"]) for r in marked.collect()} == {1: ("a [P_A] [P_B]", 1), 2: ("a [P_A] Bo", 0), 3: ("Bo", 0)}
    assert {r["id"]: r["session_id"] for r in E.delete_session(replies, spark.createDataFrame([("s",)], "session_id string")).collect()} == {1: None, 2: "t", 3: None}
    may = spark.createDataFrame([("Bo", "s"), ("Bo", None), (" ", "s"), ("a\nb", "s"), ("x [P_A]", "s")], "t string, s string").select(E.may_mark(F.col("t"), F.col("s"))).collect()
    assert [r[0] for r in may] == [True, False, False, False, False]


def test_html(spark):
    row = spark.createDataFrame([("<a> & b\nc", [(0, 3)])], "t string, s array<struct<start:int,end:int>>")
    assert row.select(E.highlight(F.col("t"), F.col("s"), "red")).first()[0] == '<span style="background-color:red">&lt;a&gt;</span> &amp; b<br>c'


def test_documents_without_a_session_share_no_code_book(spark):
    rows = [(None, 0, 7, "a@x.example"), ("doc:7", 0, 1, "b@x.example"), (None, 0, None, "c@x.example"), (None, 0, None, "d@x.example"), (None, 1, 8, "a@x.example b@x.example")]
    out = D.obfuscate_sessions(spark.createDataFrame(rows, "session_id string, seq long, doc_id long, text string"))
    assert sorted((r["session_id"] or "", r["doc_id"] or 0, r["text"]) for r in out.collect()) == [("", 0, "[EMAIL_A]"), ("", 0, "[EMAIL_A]"), ("", 7, "[EMAIL_A]"), ("", 8, "[EMAIL_A] [EMAIL_B]"), ("doc:7", 1, "[EMAIL_A]")]
    assert {r["session_id"] for r in D.code_book(out).collect()} == {"doc:7"}


def test_letters_of_numbers():
    assert [D.code_letters(n) for n in (0, 25, 26, 701, 702, 18277, 18278)] == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ", "AAAA"]
    assert all(D.letters_number(D.code_letters(n)) == n for n in range(0, 20000, 7))


def test_ranking_of_equal_sets_and_ties(spark):
    from veilstone.operators import restore

    texts = spark.createDataFrame([(1, "[A_A] [A_B] [A_B]"), (2, "[A_B] x [A_A]"), (3, "[A_C]"), (4, "none"), (5, None), (6, "[A_Z]")], "id long, text string")
    lookup = spark.createDataFrame([("q", "[A_A]"), ("q", "[A_B]"), ("p", "[A_A]"), ("p", "[A_B]"), ("r", "[A_A]"), ("r", "[A_C]"), ("r", "[A_A]")], "session_id string, code string")
    order = spark.createDataFrame([("p", 0), ("q", 1), ("r", 2)], "session_id string, ord int")
    assert sorted(map(tuple, restore.recommend(texts, lookup, order).collect())) == [(1, "p", 2), (2, "p", 2), (3, "r", 1)]


def test_large_sessions_are_coded_as_by_the_fold(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("session_id", "seq", "doc_id", "text", "lang_choice", "scope")
    names = sorted({r["name"] for r in spark.read.parquet(f"{data}/given_names.parquet").collect()})
    book = spark.createDataFrame([(r["session_id"], "known value", "[OTHER_C]", 4) for r in docs.select("session_id").distinct().limit(3).collect() if r["session_id"]], "session_id string, original string, code string, ord long")
    ignored = docs.where("session_id is not null").groupBy("session_id").agg(F.first(F.regexp_extract("text", "[A-Za-z0-9.]+@[A-Za-z.]+", 0), True).alias("original")).where("original <> ''").selectExpr("session_id", "original", "'[EMAIL_B]' AS code", "0L AS ord")
    counters = spark.createDataFrame([(r["session_id"], "EMAIL", 3) for r in book.collect()], "session_id string, label string, n long")
    more = docs.unionByName(docs.limit(5))  # delivered again
    one = D.obfuscate_sessions(more, names=names, book=book, ignored=ignored, counters=counters, session_rows=None)
    other = D.obfuscate_sessions(more, names=names, book=book, ignored=ignored, counters=counters, session_rows=1, chunk_rows=3)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(one) == key(other) and one.count() == docs.count()
