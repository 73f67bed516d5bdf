"""Queries of the corpus operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstone.llm import addresses, confusables, encoding, langid, names, packing, sharedspans, splitting, unicode_data
from veilstone.runtime import table


def _looks(spark: SparkSession, d: str) -> DataFrame:
    book = table(spark, d, "codebook").select(F.lit("codebook").alias("source_table"), F.col("session_id").alias("grp"), F.col("entry_id").alias("id"), F.col("original").alias("text"))
    results = table(spark, d, "obfuscate_results").select(F.lit("obfuscate_results").alias("source_table"), F.col("session_id").alias("grp"), F.col("result_id").alias("id"), "text")
    return book.unionByName(results)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "spans").select(F.col("span_id").alias("id"), "text")
    found = addresses.same_place(spans, addresses.gazetteer(table(spark, d, "places")))
    return found.select(F.col("id_a").alias("span_id_a"), F.col("id_b").alias("span_id_b"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "obfuscate_results")
    model = langid.train(rows, "result_id", "text", "lang")
    return langid.relabel(rows, "result_id", "text", "lang", model).select(F.col("id").alias("result_id"), "lang")


def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "obfuscate_results")
    model = langid.train(rows, "result_id", "text", "lang")
    return langid.segment_languages(rows, "result_id", "text", model).distinct().withColumnRenamed("id", "result_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return confusables.same_looking(_looks(spark, d))


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    return _looks(spark, d).select("source_table", "id", confusables.skeleton_column("text", unicode_data.looks(spark)).alias("form"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(table(spark, d, "obfuscate_results"), "result_id", "text").withColumnRenamed("id", "result_id")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_long(table(spark, d, "obfuscate_results"), "result_id", "text").withColumnRenamed("id", "result_id")


def p4_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the pieces: every text covered in order, no piece above the limit, the overlap as asked."""
    rows = table(spark, d, "obfuscate_results")
    pieces = splitting.split_long(rows, "result_id", "text").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "piece_start", "piece_end", "piece"))).alias("p"))
    got = rows.where("text is not null").dropDuplicates(["result_id"]).join(pieces, F.col("id") == F.col("result_id"), "left")
    whole = F.array_join(F.transform("p", lambda x: F.when(x["piece_no"] == 0, x["piece"]).otherwise(F.substr(x["piece"], F.lit(splitting.OVERLAP + 1)))), "")
    steps = F.exists(F.slice("p", 2, F.greatest(F.size("p"), F.lit(1))), lambda x: x["piece_start"] != F.element_at("p", x["piece_no"])["piece_end"] - splitting.OVERLAP)
    count = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(True)).cast("int")), F.lit(0)).cast("int")
    return got.agg(F.count("*").alias("texts"), count(whole != F.col("text")).alias("not_covered"), count(F.exists("p", lambda x: F.length(x["piece"]) > splitting.LIMIT)).alias("too_long"), count(steps).alias("wrong_overlap"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    book = names.once_per_id(table(spark, d, "codebook"), "entry_id", "session_id", "original", "codebook")
    spans = names.first_spans(table(spark, d, "spans"))
    return names.same_names(book.unionByName(spans), names.place_names(table(spark, d, "places")), names.given_names(table(spark, d, "given_names")))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, d, "documents"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    return encoding.decode_ids(encoding.encode_corpus(table(spark, d, "documents")))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.token_counts(table(spark, d, "documents")))


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers: one row, all of it zero but the number of texts."""
    sizes = packing.token_counts(table(spark, d, "documents"))
    placed = packing.pack(sizes)
    loads = placed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("load"), F.max("container_length").alias("most"), F.min("container_length").alias("least"))
    over = loads.agg(F.coalesce(F.sum(F.expr("int(load > most or most <> least or most > 2048)")), F.lit(0)).alias("overfull"))
    own = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("placed"), F.count("*").alias("pieces"))
    wrong = sizes.join(own, "doc_id", "left").agg(
        F.count("*").alias("texts"),
        F.coalesce(F.sum(F.expr("int(coalesce(placed, -1) <> n_tokens)")), F.lit(0)).alias("not_covered"),
        F.coalesce(F.sum(F.expr("int(pieces <> greatest(1, ceil(n_tokens / 2048)))")), F.lit(0)).alias("split"),
    )
    return wrong.crossJoin(over).select("texts", "not_covered", "split", "overfull")  # two single rows


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sharedspans.shared_pairs(table(spark, d, "documents"))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return sharedspans.shared_spans(table(spark, d, "documents")).select("doc_id", F.inline("spans"))


def p8_share(spark: SparkSession, d: str) -> DataFrame:
    return sharedspans.shared_spans(table(spark, d, "documents")).where("n_chars is not null").select("doc_id", "shared_chars", "n_chars")


#: Every run of 200 code points of every text, by hash; exact, and slow where the tables are large.
_GRAMS = (
    "g AS (SELECT doc_id, CAST(unnest(range(1, length(text) - 198)) AS INTEGER) AS s, text FROM documents WHERE length(text) >= 200), h AS (SELECT doc_id, s, md5(substring(text, s, 200)) AS k FROM g), "
    "m AS (SELECT k FROM h GROUP BY k HAVING min(doc_id) <> max(doc_id)), x AS (SELECT h.* FROM h JOIN m USING (k))"
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_segments": p2_segments,
    "p3_found": p3_found,
    "p3_forms": p3_forms,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p4_check": p4_check,
    "p5_found": p5_found,
    "p6_ids": p6_ids,
    "p6_decoded": p6_decoded,
    "p7_containers": p7_containers,
    "p7_check": p7_check,
    "p8_found": p8_found,
    "p8_spans": p8_spans,
    "p8_share": p8_share,
}

ORACLES: dict[str, str] = {
    "p8_found": f"WITH {_GRAMS} SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM x a JOIN x b ON a.k = b.k AND a.doc_id < b.doc_id",
    "p8_share": (
        f"WITH {_GRAMS}, c AS (SELECT doc_id, sum(least(200, coalesce(n - s, 200))) AS shared FROM (SELECT doc_id, s, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS n FROM x) GROUP BY doc_id) "
        "SELECT d.doc_id, CAST(coalesce(c.shared, 0) AS INTEGER) AS shared_chars, CAST(length(d.text) AS INTEGER) AS n_chars FROM documents d LEFT JOIN c USING (doc_id) WHERE d.text IS NOT NULL"
    ),
    "p4_check": "SELECT count(DISTINCT result_id) AS texts, 0 AS not_covered, 0 AS too_long, 0 AS wrong_overlap FROM obfuscate_results WHERE text IS NOT NULL",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p7_check": "SELECT count(*) AS texts, 0 AS not_covered, 0 AS split, 0 AS overfull FROM documents",
    "p8_spans": (
        f"WITH {_GRAMS}, o AS (SELECT doc_id, s, sum(CASE WHEN s <= e THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM (SELECT doc_id, s, coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 200, -1) AS e FROM x)), "
        "r AS (SELECT doc_id, CAST(min(s) - 1 AS INTEGER) AS a, CAST(max(s) + 199 AS INTEGER) AS b FROM o GROUP BY doc_id, run), "
        "SELECT doc_id, a AS span_start, b AS span_end FROM r UNION SELECT doc_id, 0, CAST(length(text) AS INTEGER) FROM documents WHERE length(text) >= 200 AND text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)"
    ),
    "p4_found": "SELECT DISTINCT result_id FROM obfuscate_results WHERE length(text) > 2000",
}
