"""Propagation of all known values of a document, against counting in Python."""

import re

from veilstone.plans import catalogue

DOCS = [(1, "Al met Alice, Al-Rashid and Al. 王小明 called 王小明2; mail al@x.example or xal@x.example"), (2, "No. 12 or 120, 12; 北璟市鶴原路3段9號 and 北璟市鶴原路3段9號, Ann Lee, Ann Leeds"), (3, None), (4, "nothing known here")]
VALUES = {1: ["Al", "王小明", "al@x.example", "A", " ", None, "Alice"], 2: ["12", "北璟市鶴原路3段9號", "Ann Lee", "  "], 3: ["Al"], 4: ["absent"]}


def by_hand():
    out = {}
    for doc, text in DOCS:
        for v in VALUES[doc]:
            if text and v and len(v) > 1 and v.strip():
                guards = [g if re.fullmatch("[A-Za-z0-9]", c) else "" for c, g in ((v[0], "(?<![A-Za-z0-9])"), (v[-1], "(?![A-Za-z0-9])"))]
                if n := len(re.findall(guards[0] + re.escape(v) + guards[1], text)):
                    out[doc, v] = n
    return out


def test_every_known_value_is_propagated(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, v) for d, vs in VALUES.items() for v in vs for _ in range(2)], "doc_id long, text string").write.parquet(f"{tmp_path}/spans.parquet")
    got = {(r["doc_id"], r["value"]): r["hits"] for r in catalogue.known_propagation(spark, str(tmp_path)).collect()}
    assert got == by_hand() and len(got) == 7
