"""``python -m veilstone``: the version, and a self-test that codes and restores a few texts."""

from __future__ import annotations

import argparse

from veilstone import __version__


def self_test() -> str:
    """Codes texts in a local session and restores them; raises if a text doesn't come back."""
    from veilstone.operators import codebook, fold, restore
    from veilstone.runtime import build_session

    texts = ["write to kim@shop.example, password: hunter22", "請Emily打 0912-345-678", "kim@shop.example again, from 10.0.0.7"]
    spark = build_session("self-test", "local[2]", **{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false"})
    docs = spark.createDataFrame([("s", i, i, t) for i, t in enumerate(texts)], "session_id string, seq long, doc_id long, text string")
    coded = spark.createDataFrame(fold.obfuscate_sessions(docs).collect(), fold.RESULT)
    lookup = codebook.originals_of_codes(fold.code_book(coded))
    back = {r["id"]: r["text"] for r in restore.restore_table(coded, lookup, "doc_id", "session_id", "text").collect()}
    if [back[i] for i in range(len(texts))] != texts or any(r["text"] == t for r, t in zip(coded.orderBy("seq").collect(), texts)):
        raise AssertionError("the texts didn't come back")
    spark.stop()
    return "self-test passed"


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("veilstone")
    parser.add_argument("--version", action="version", version=__version__)
    parser.add_argument("--self-test", action="store_true", help="code and restore a few texts")
    args = parser.parse_args(argv)
    if args.self_test:
        print(self_test())
    else:
        parser.print_help()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
