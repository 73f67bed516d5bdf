"""Decoders, detector plug-ins, store and stream."""

import hashlib
import itertools
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilstone.operators import decoding as G
from veilstone.operators import detectors as M
from veilstone.operators import fold as D
from veilstone.sources import store as S
from veilstone.streaming import codes as ST


def test_viterbi_against_all_paths():
    tags = ["O", "B-P", "I-P", "E-P", "S-P", "B-Q", "E-Q"]
    rng = np.random.default_rng(1)

    def legal(path):
        split = [tags[i].partition("-")[::2] for i in path]
        if split[0][0] in "IE" or split[-1][0] in "BI":
            return False
        return all((b[0] in "OBS") if a[0] in "OES" else (b[0] in "IE" and a[1] == b[1]) for a, b in zip(split, split[1:]))

    for n in (1, 2, 4):
        scores = rng.normal(size=(n, len(tags)))
        best = max((p for p in itertools.product(range(len(tags)), repeat=n) if legal(p)), key=lambda p: sum(scores[i, t] for i, t in enumerate(p)))
        assert tuple(G.viterbi(scores, tags)) == best


def test_viterbi_of_texts_of_all_lengths_at_once(spark):
    tags = ["O", "B-P", "I-P", "E-P", "S-P"]
    rng = np.random.default_rng(2)
    sizes = np.array([1, 5, 3, 7])
    scores = rng.normal(size=(4, 7, len(tags)))
    together = G.viterbi_batch(scores, sizes, tags)
    assert [p.tolist() for p in together] == [G.viterbi(scores[i, :n], tags) for i, n in enumerate(sizes)]
    rows = spark.createDataFrame([(0, scores[1, :5].tolist()), (1, []), (2, None), (3, scores[0, :1].tolist())], "i int, l array<array<double>>")
    got = [r[0] for r in rows.orderBy("i").select(G.viterbi_tags(F.col("l"), tags, bias=0.0)).collect()]
    assert got[0] == [tags[i] for i in together[1]] and got[1:3] == [[], None] and len(got[3]) == 1


def decode(spark, text, tokens, labels, **kw):
    row = spark.createDataFrame([(text, tokens)], f"t string, k {G.TOKENS}")
    return [(s["start"], s["end"], s["label"], s["text"], round(s["score"], 3)) for s in row.select(G.decode_bio(F.col("t"), F.col("k"), labels, **kw)).first()[0]]


def test_bio(spark):
    labels = {"PER": "PERSON", "LOC": "LOC"}
    text = "Ann Wei-Chuang in Rome"
    tokens = [(None, 0, 0, "O", 1.0), (0, 0, 3, "B-PER", 0.9), (1, 3, 7, "I-PER", 0.5), (2, 7, 8, "O", 0.9), (3, 8, 12, "S-PER", 0.6), (3, 12, 14, "O", 0.1), (4, 15, 17, "O", 0.9), (5, 17, 22, "E-LOC", 0.39)]
    assert decode(spark, text, tokens, labels) == [(0, 14, "PERSON", "Ann Wei-Chuang", 0.6)]
    assert decode(spark, text, tokens, labels, min_score=0.3)[1] == (18, 22, "LOC", "Rome", 0.39)
    assert decode(spark, text, tokens, {"LOC": "LOC"}) == [] and decode(spark, text, [], labels) == []
    assert decode(spark, "a b c", [(0, 0, 1, "I-PER", 0.9), (1, 2, 3, "I-LOC", 0.9), (2, 4, 5, "B-LOC", 0.9)], labels) == [(0, 1, "PERSON", "a", 0.9), (2, 3, "LOC", "b", 0.9), (4, 5, "LOC", "c", 0.9)]


def test_tagging(spark):
    rows = spark.createDataFrame([([[2.0, 1.0, 1.2], [0.0, 3.0, 0.0], [9.0, 0.0, 0.0]],), ([],), (None,)], "l array<array<double>>")
    got = [r[0] for r in rows.select(G.tag_tokens(F.col("l"), ["O", "B-PER", "I-PER"], {"PER": "PERSON"})).collect()]
    assert [x["tag"] for x in got[0]] == ["I-PER", "B-PER", "O"] and got[1:] == [[], None]


def test_windows_pieces_and_dedupe(spark):
    got = spark.createDataFrame([(0,), (510,), (511,), (1000,)], "n int").select(G.token_windows(F.col("n"))).collect()
    assert [[tuple(w) for w in r[0]] for r in got] == [[(0, 0)], [(0, 510)], [(0, 510), (446, 511)], [(0, 510), (446, 956), (892, 1000)]]
    rows = spark.createDataFrame([("aa\nbb\ncccccccc\nd", [2, 2, 9, 1]), ("abc", [1])], "t string, n array<int>")
    assert [r[0] for r in rows.select(G.cut_pieces(F.col("t"), F.col("n"), 4)).collect()] == [["aa\nbb\n", "cccccccc\n", "d"], ["abc"]]
    spans = [(0, 1, "A", "x", 0.1, 0), (2, 3, "A", "y", 0.2, 0), (0, 1, "A", "x", 0.9, 0)]
    one = spark.createDataFrame([(spans,)], f"s {M.SPANS}").select(G.dedupe_windows(F.col("s"))).first()[0]
    assert [(s["start"], s["score"]) for s in one] == [(0, 0.9), (2, 0.2)]


def test_bioes(spark):
    row = spark.createDataFrame([("a Bob Lee z q", [(1, 5, "B-P"), (5, 9, "E-P"), (9, 11, "S-P"), (11, 13, "S-Q"), (0, 1, "B-P")])], "t string, k array<struct<start:int,end:int,tag:string>>")
    assert [(s["start"], s["text"]) for s in row.select(G.emit_bioes(F.col("t"), F.col("k"), {"P": "PERSON"})).first()[0]] == [(2, "Bob Lee"), (10, "z")]


def fake(*values, label="PERSON"):
    def make():
        return lambda text: [(text.index(v), text.index(v) + len(v), label, 0.9) for v in values if v in text]

    return make


def test_routing(spark):
    registry = M.Registry()
    registry.register("pii", fake("Jason", "李建宏 Bob"))
    registry.register("zh", fake("李建宏", "Jason"))
    registry.register("mixed", fake("Jason"))
    rows = spark.createDataFrame([(1, "跟Jason說 李建宏 Bob 好", "auto"), (2, "Jason", "en"), (3, None, "auto"), (4, "Jason 在", "en")], "id long, text string, lang_choice string")
    got = {r["id"]: (sorted((s["start"], s["text"], s["prio"]) for s in r["model_cand"]), r["model_used"]) for r in M.model_spans(rows, registry).collect()}
    assert got[1] == ([(1, "Jason", 50), (1, "Jason", 80), (8, "李建宏", 60), (12, "Bob", 50)], True)
    assert got[2] == ([(0, "Jason", 50)], True) and got[3] == ([], False) and got[4][0] == [(0, "Jason", 50), (0, "Jason", 80)]
    assert not M.model_spans(rows, M.Registry()).where("model_used").count()


def test_model_spans_in_the_fold(spark):
    registry = M.Registry()
    registry.register("pii", fake("Ann Lee"))
    docs = spark.createDataFrame([("s", 0, 0, "Ann Lee is in", "en"), ("s", 1, 1, "and Ann left", "en")], "session_id string, seq long, doc_id long, text string, lang_choice string")
    out = D.obfuscate_sessions(M.model_spans(docs, registry), extra=F.col("model_cand"), model_used=F.col("model_used"))
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(0, "[PERSON_A] is in"), (1, "and [PERSON_A] left")]


def test_latin_parts(spark):
    spans = [(0, 8, "ID", "A-12 對 9", 1.0, 0), (10, 14, "LOC", "Rome市", 1.0, 0), (20, 30, "PERSON", "李建宏 Kevin", 1.0, 0), (40, 43, "ID", "x-1", 1.0, 0)]
    got = spark.createDataFrame([(spans,)], f"s {M.SPANS}").select(M.latin_parts(F.col("s"))).first()[0]
    assert [(s["start"], s["text"]) for s in got] == [(0, "A-12"), (7, "9"), (24, "Kevin"), (40, "x-1")]


SESSION = "id string, label string, created_at string, to_code map<string,string>, counters map<string,bigint>, ignored map<string,string>"


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([("b", "B", "2024-02-01", {"secret value": "[ID_A]"}, {"ID": 1}, {}), ("a", None, "2024-01-01", {}, {}, {"x": "[ID_B]"})], SESSION)
    key, path = S.new_key(), str(tmp_path / "store")
    S.save_sessions(rows, path, key)
    sealed = spark.read.parquet(path)
    assert all(b"secret value" not in r["payload"] for r in sealed.collect()) and len({bytes(r["payload"][:12]) for r in sealed.collect()}) == 2
    back = S.load_sessions(spark, path, key)
    assert [r["id"] for r in back.collect()] == ["a", "b"] and back.where("id='b'").first()["to_code"] == {"secret value": "[ID_A]"}
    assert S.load_sessions(spark, path, S.new_key(), fail=False).count() == 0
    with pytest.raises(Exception):  # noqa: B017
        S.load_sessions(spark, path, S.new_key()).collect()
    other = sealed.withColumn("id", F.lit("c"))
    assert other.where(S.decrypt_session(F.col("id"), F.col("payload"), F.lit(key), fail=False).isNotNull()).count() == 0
    S.save_sessions(S.rename_sessions(rows, spark.createDataFrame([("a", " New "), ("b", "  ")], "id string, label string")), path, key)
    assert {r["id"]: r["label"] for r in S.load_sessions(spark, path, key).collect()} == {"a": "New", "b": "B"}
    assert S.numbered_labels(rows).where("id='a'").first()["label"] == "Session 1"
    assert [r["id"] for r in S.delete_sessions(rows, spark.createDataFrame([("a",), ("zz",)], "id string")).collect()] == ["b"]


def test_json_without_ignored(spark):
    from veilstone.operators.codebook import parse_session

    row = spark.createDataFrame([(json.dumps({"id": "i", "label": "l", "created_at": "t", "to_code": {"a": "[A_A]"}, "counters": {"A": 1}}),)], "j string")
    s = row.select(parse_session(F.col("j"))).first()[0]
    assert s["ignored"] == {} and s["counters"] == {"A": 1}


def test_stale_directories(spark, tmp_path):
    names = ["veilstone-1", "veilstone-22", "veilstone-x", "other-1", "veilstone-app_7", "veilstone-33"]
    running = spark.createDataFrame([("1",), ("33",)], "owner string")
    assert sorted(r["name"] for r in S.stale(spark.createDataFrame([(n,) for n in names], "name string"), running, "33").collect()) == ["veilstone-22", "veilstone-33", "veilstone-app_7"]
    for n in names:
        (tmp_path / n).mkdir()
    assert S.sweep_stale(spark, tmp_path, running, "33") == ["veilstone-22", "veilstone-33", "veilstone-app_7"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["other-1", "veilstone-1", "veilstone-x"] and S.sweep_stale(spark, tmp_path / "none", running, "33") == []


def test_manifest_and_names(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "w.bin").write_bytes(b"abc")
    spec = {"id": "m", "lang": "zh", "name": "n", "source": "s", "license": "l", "labels": {"PER": "PERSON"}, "files": [{"name": "w.bin", "url": "u", "size": 3, "sha256": hashlib.sha256(b"abc").hexdigest()}]}
    (tmp_path / "manifest.json").write_text(json.dumps({"models": [spec, spec | {"id": "k", "kind": "privacy-filter"}]}))
    manifest = S.load_manifest(spark, str(tmp_path / "manifest.json"))
    assert {(r["id"], r["kind"], r["size"]) for r in manifest.collect()} == {("m", "ner", 3), ("k", "privacy-filter", 3)}
    facts = S.file_facts(spark, str(tmp_path / "m")).withColumn("id", F.lit("m"))
    assert {r["id"]: r["installed"] for r in S.installed_models(manifest, facts).collect()} == {"m": True, "k": False}
    (tmp_path / "names.txt").write_text("Ann Bo\n\nBo Cy\n")
    assert sorted(r["name"] for r in S.load_names(spark, str(tmp_path / "names.txt")).collect()) == ["Ann", "Bo", "Cy"]
    shares = spark.createDataFrame([(1939, "Old", 9.0), (1950, "Ann", 1.0), (1960, "Ann", 1.0), (1950, "Bo", 1.5), (1950, "May", 3.0), (1950, "Cy", 0.1)], "year int, name string, percent double")
    assert [r["name"] for r in S.rank_names(shares, ["May"], ["Una"], most=3).collect()] == ["Ann", "Bo", "Una"]


def test_stream_equals_batch(spark, tmp_path):
    schema = "session_id string, seq long, doc_id long, text string"
    parts = [[("s", 0, 0, "mail a@x.example"), ("t", 0, 1, "10.0.0.1")], [("s", 1, 2, "a@x.example b@x.example"), ("t", 1, 3, None), ("s", 2, 4, "b@x.example 10.0.0.1")]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    ST.use_state_store(spark)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    run = ST.obfuscate_stream(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "chk")).trigger(availableNow=True).start()
    run.awaitTermination()
    streamed = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {r["doc_id"]: r["text"] for r in D.obfuscate_sessions(spark.createDataFrame(sum(parts, []), schema)).collect()}
    assert streamed == batch


def run_stream(spark, tmp_path, schema, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    ST.use_state_store(spark)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    ST.obfuscate_stream(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "chk")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_stream_of_edits_and_repeated_deliveries(spark, tmp_path):
    schema = "session_id string, seq long, doc_id long, text string, op string, label string"
    parts = [
        [("s", 0, 0, "a@x.example blue", None, None), (None, 0, 7, "a@x.example", None, None), (None, 0, 8, "b@x.example", None, None)],
        [("s", 0, 0, "a@x.example blue", None, None), ("s", 1, None, "[EMAIL_A]", "unmark", None), ("s", 2, None, "blue", "mark", "OTHER"), ("s", 3, 1, "a@x.example blue b@x.example", None, None)],
        [("s", 4, None, "a@x.example", "mark", "EMAIL"), ("s", 5, 2, "a@x.example c@x.example", None, None)],
    ]
    got = sorted((r["session_id"] or "", r["doc_id"], r["text"]) for r in run_stream(spark, tmp_path, schema, parts))
    assert got == [("", 7, "[EMAIL_A]"), ("", 8, "[EMAIL_A]"), ("s", 0, "[EMAIL_A] blue"), ("s", 1, "a@x.example [OTHER_A] [EMAIL_B]"), ("s", 2, "[EMAIL_A] [EMAIL_C]")]


def test_fetching_goes_on_and_checks(spark, tmp_path):
    body = bytes(range(200))
    spec = {"id": "m", "files": [{"name": "w.bin", "url": "u", "size": 200, "sha256": hashlib.sha256(body).hexdigest()}]}
    asked = []

    def source(url, offset, ranged=True, content=body):
        asked.append(offset)
        at = offset if ranged else 0
        return ranged and offset > 0, [content[i : i + 60] for i in range(at, len(content), 60)]

    left = iter([False, True])
    assert not S.fetch_model(spec, tmp_path, source, stop=lambda: next(left)) and (tmp_path / "m/w.bin.part").stat().st_size == 60
    assert S.fetch_model(spec, tmp_path, source) and asked == [0, 60] and (tmp_path / "m/w.bin").read_bytes() == body
    assert S.fetch_model(spec, tmp_path, source) and len(asked) == 2  # whole files aren't fetched again
    (tmp_path / "m/w.bin").unlink()
    (tmp_path / "m/w.bin.part").write_bytes(b"x" * 300)
    assert S.fetch_model(spec, tmp_path, source) and asked[-1] == 0
    (tmp_path / "m/w.bin").unlink()
    (tmp_path / "m/w.bin.part").write_bytes(body[:50])
    assert S.fetch_model(spec, tmp_path, lambda u, o: source(u, o, ranged=False))
    (tmp_path / "m/w.bin").unlink()
    with pytest.raises(S.ChecksumError):
        S.fetch_model(spec, tmp_path, lambda u, o: source(u, o, content=b"y" * 200))
    assert not (tmp_path / "m/w.bin.part").exists() and not (tmp_path / "m/.installed").exists()
    assert S.fetch_model(spec, tmp_path, source)
    manifest = spark.createDataFrame([("m", [("w.bin", "u", 200, spec["files"][0]["sha256"])]), ("k", [("w.bin", "u", 200, "other")])], "id string, files array<struct<name:string,url:string,size:long,sha256:string>>")
    text = (tmp_path / "m/.installed").read_text()
    facts = spark.createDataFrame([("m", "w.bin", 200), ("k", "w.bin", 200)], "id string, name string, size long")
    got = S.marked_models(manifest, spark.createDataFrame([("m", text), ("k", text)], "id string, text string"), facts)
    assert {r["id"]: r["installed"] for r in got.collect()} == {"m": True, "k": False}
    S.delete_model(tmp_path, "m")
    assert not (tmp_path / "m").exists() and S.models_dir(spark, tmp_path) == tmp_path


def test_licences(spark):
    from veilstone.plans import closure as L

    needs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("a", None), ("c", "d")], "name string, requires string")
    assert sorted(r["name"] for r in L.closure(needs, "a").collect()) == ["b", "c", "d"] and L.closure(needs, "zz").count() == 0
    rows = [("MIT", True), ("GPL-2.0-only", False), ("LGPL-3.0-only OR GPL-2.0-only", True), ("UNKNOWN", False), (None, False), ("gpl-2.0-ONLY", False)]
    got = spark.createDataFrame(rows, "l string, want boolean").select(L.compatible(F.col("l"), ["GPL-2.0-only", "Proprietary"]).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_html_with_anchors(spark):
    from veilstone.operators.edits import highlight

    row = spark.createDataFrame([("a<b>\n'c' & d", [(9, 10), (1, 2)]), ("x", []), (None, [])], "t string, s array<struct<start:int,end:int>>")
    got = [r[0] for r in row.select(highlight(F.col("t"), F.col("s"), "red", "code")).collect()]
    assert got == ['a<a href="code:0"><span style="background-color:red">&lt;</span></a>b&gt;<br>&#x27;c&#x27;<a href="code:1"><span style="background-color:red"> </span></a>&amp; d'.replace("<span style=\"background-color:red\"> </span></a>&amp;", '<span style="background-color:red">&amp;</span></a>').replace("&#x27;<a href", "&#x27; <a href"), "x", None]
    assert "href" not in row.select(highlight(F.col("t"), F.col("s"))).first()[0]


def test_numbered_labels_and_hot_sessions(spark):
    from veilstone.operators import codebook as C

    rows = spark.createDataFrame([("b", None, "2"), ("a", None, "1"), ("c", "mine", None)], "id string, label string, created_at string")
    assert {r["id"]: r["label"] for r in S.numbered_labels(rows).collect()} == {"c": "mine", "a": "Session 2", "b": "Session 3"}
    book = spark.createDataFrame([("s", f"v{i % 7}{'x' * (i % 3)}{i}", "A", f"[A_{D.code_letters(i // 2)}]", i) for i in range(60)], "session_id string, original string, label string, code string, ord long")
    none = spark.createDataFrame([], "session_id string, original string, code string, ord long")
    codes = book.select("session_id", "code").where("ord < 40")
    for f in (lambda n: C.preview(book, n), lambda n: C.unmark(book, none, codes, n)[1]):
        assert sorted(map(str, f(5).collect())) == sorted(map(str, f(10**6).collect()))
