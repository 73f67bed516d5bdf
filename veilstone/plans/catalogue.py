"""Queries over whole tables, one per operator, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstone.functions import text as T
from veilstone.functions.matching import let
from veilstone.operators import codebook, decoding, detectors, edits, fold, names, restore, rules, spans
from veilstone.plans import closure
from veilstone.runtime import fixed_table, spread, table
from veilstone.sources import store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL where SQL can express it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def texts(spark: SparkSession, d: str) -> DataFrame:
    """The documents that have a text, in enough partitions for work on the text."""
    return spread(documents(spark, d).where("text is not null").select("doc_id", "text"))


def given(spark: SparkSession, d: str) -> list[str]:
    """Given names of a table of fixed size."""
    return sorted({r["name"] for r in fixed_table(table(spark, d, "given_names").select("name").distinct()) if r["name"]})


def book(spark: SparkSession, d: str) -> DataFrame:
    """The code book, each entry once."""
    return table(spark, d, "codebook").dropDuplicates(["entry_id"]).select("session_id", "original", "label", "code", "ord")


def retired(spark: SparkSession, d: str) -> DataFrame:
    """Retired originals of the sessions, in the order of the maps they come in."""
    rows = table(spark, d, "sessions").groupBy("session_id").agg(F.first(F.map_entries("ignored")).alias("e"))
    return rows.select("session_id", F.posexplode("e").alias("ord", "x")).select("session_id", F.col("x.key").alias("original"), F.col("x.value").alias("code"), F.col("ord").cast("long").alias("ord"))


def results(spark: SparkSession, d: str) -> DataFrame:
    """The coded texts, each once."""
    return table(spark, d, "obfuscate_results").dropDuplicates(["result_id"])


def replies(spark: SparkSession, d: str) -> DataFrame:
    """Coded texts with their code spans, as edits take them."""
    code_spans = F.transform("code_spans", lambda s: F.struct(s["span_start"].alias("start"), s["span_end"].alias("end"), s["label"].alias("label"), s["code"].alias("code")))
    return results(spark, d).select("result_id", "session_id", "text", code_spans.alias("code_spans"), "originals")


_BOOK = "book AS (SELECT DISTINCT entry_id, session_id, original, label, code, ord FROM codebook)"
_RESULTS = "res AS (SELECT DISTINCT result_id, session_id, text FROM obfuscate_results)"
_IGNORED = "ses AS (SELECT DISTINCT session_id, ignored FROM sessions), ign AS (SELECT session_id, unnest(map_keys(ignored)) AS original, unnest(map_values(ignored)) AS code, unnest(range(len(map_keys(ignored)))) AS ord FROM ses)"
_LIVE = "live AS (SELECT session_id, code, arg_max(original, (length(original), -ord)) AS original FROM book GROUP BY ALL)"
_LOOKUP = f"{_BOOK}, {_IGNORED}, {_LIVE}, ret AS (SELECT session_id, code, arg_max(original, ord) AS retired FROM ign GROUP BY ALL), lookup AS (SELECT coalesce(l.session_id, r.session_id) AS session_id, coalesce(l.code, r.code) AS code, coalesce(l.original, r.retired) AS original FROM live l FULL JOIN ret r ON l.session_id = r.session_id AND l.code = r.code)"
_CODE = r"\[[A-Z]+_[A-Z]+\]"
_SPACE = r"\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3000}-\x{303F}"
_RUN = r"\x{3000}-\x{303F}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}"


def _letters(n: str) -> str:
    """SQL of the letters of a number below 26 + 26^2 + 26^3 + 26^4."""
    parts = [f"CASE WHEN {n} >= {low} THEN chr(CAST(65 + (({n} - {low}) // {div}) % 26 AS INTEGER)) ELSE '' END" for low, div in ((18278, 17576), (702, 676), (26, 26))]
    return " || ".join([*parts, f"chr(CAST(65 + {n} % 26 AS INTEGER))"])


# --- rules -----------------------------------------------------------------------------------------------------------


def _rule(name: str) -> Query:
    rule = next(r for r in rules.RULES if r.name == name)

    def run(spark: SparkSession, d: str) -> DataFrame:
        found = spread(documents(spark, d).select("doc_id", "text")).select("doc_id", F.inline(rules.rule_matches(F.col("text"), rule)))
        return found.select("doc_id", F.col("start").cast("long").alias("span_start"), F.lit(rule.label).alias("label"), F.col("text").alias("value"))

    return run


def _values(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _rule(name)(spark, d).groupBy("doc_id", "value").agg(F.count("*").alias("hits"))

    return run


def _extracted(pattern: str, group: int = 0, where: str = "true") -> str:
    pattern = pattern.replace("'", "''")
    return f"WITH v AS (SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}', {group})) AS value FROM documents) SELECT doc_id, value, count(*) AS hits FROM v WHERE value <> '' AND {where} GROUP BY ALL"


_ASCII_WORD = "[A-Za-z0-9_]"
_OCT = r"(?:25[0-5]|2[0-4]\p{Nd}|1\p{Nd}\p{Nd}|[1-9]?\p{Nd})"


def _located(label: str, pattern: str, first: str, before: str, after: str = "", keep: str = "true", group: int = 0) -> str:
    """SQL of a rule with offsets, without lookaround: the pattern is tried wherever it may begin, and matches are taken from left to right.

    ``first`` and ``before`` are conditions on the character ``c`` where a match begins and on those before it (``b``, and ``b2`` before
    that), ``after`` is a pattern of what must follow.
    """
    quote = lambda x: x.replace("'", "''")
    return (
        "WITH RECURSIVE t AS (SELECT doc_id, text, regexp_extract_all(text, '(?s).') AS cs FROM documents WHERE text IS NOT NULL), "
        "p AS (SELECT doc_id, text, i, cs[i] AS c, coalesce(cs[i - 1], '') AS b, coalesce(cs[i - 2], '') AS b2 FROM (SELECT doc_id, text, cs, unnest(range(1, len(cs) + 1)) AS i FROM t)), "
        f"q AS (SELECT doc_id, i, regexp_extract(substring(text, i), '^({quote(pattern)})(?:{quote(after)})', 1) AS v, {f"regexp_extract(substring(text, i), '^(?:{quote(pattern)})', {group})" if group else 'NULL'} AS tail FROM p WHERE {first} AND {before}), "
        "o AS (SELECT doc_id, i AS s, i + length(v) AS e, coalesce(tail, v) AS v, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM q WHERE v <> ''), "
        "w AS (SELECT doc_id, k, e, v, true AS kept, e AS last FROM o WHERE k = 1 UNION ALL SELECT o.doc_id, o.k, o.e, o.v, o.s >= w.last, CASE WHEN o.s >= w.last THEN o.e ELSE w.last END FROM w JOIN o ON o.doc_id = w.doc_id AND o.k = w.k + 1) "
        f"SELECT doc_id, CAST(e - length(v) - 1 AS BIGINT) AS span_start, '{label}' AS label, v AS value FROM w WHERE kept AND {keep}"
    )


def _like(column: str, pattern: str) -> str:
    return f"regexp_full_match({column}, '{pattern}')"


_FREE = f"NOT {_like('b', _ASCII_WORD)}"
_ENDS = "[^A-Za-z0-9_]|$"
_WIDE = "translate({}, '０１２３４５６７８９', '0123456789')"
_LUHN = (
    "(SELECT length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN CAST(d[i] AS INTEGER) WHEN CAST(d[i] AS INTEGER) > 4 THEN 2 * CAST(d[i] AS INTEGER) - 9 ELSE 2 * CAST(d[i] AS INTEGER) END)) % 10 = 0 "
    f"FROM (SELECT regexp_replace({_WIDE.format('v')}, '[ -]', '', 'g') AS d))"
)
_TWID = (
    "(SELECT (n // 10 + n % 10 * 9 + list_sum(list_transform(range(1, 10), lambda i: CAST(d[i + 1] AS INTEGER) * CASE WHEN i = 9 THEN 1 ELSE 9 - i END))) % 10 = 0 "
    f"FROM (SELECT upper({_WIDE.format('v')}) AS d, instr('{T.TWID_LETTERS}', upper(v[1])) + 9 AS n))"
)
_GROUPS = "list_filter(string_split(v, ':'), lambda x: x <> '')"
_IPV6 = (
    f"length(v) >= 6 AND NOT contains(v, ':::') AND len(list_filter({_GROUPS}, lambda x: length(x) > 4)) = 0 AND CASE WHEN contains(v, '::') THEN length(v) - length(replace(v, '::', '')) = 2 AND len({_GROUPS}) <= 7 "
    f"AND NOT regexp_matches(v, '^:[^:]') AND NOT regexp_matches(v, '[^:]:$') AND length(v) - length(replace(v, ':', '')) BETWEEN 2 AND 7 ELSE regexp_full_match(v, '(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}') END"
).replace("{{", "{").replace("}}", "}")
_DIGIT = _like("c", r"\p{Nd}")
for _name in (r.name for r in rules.RULES):
    QUERIES[f"rule_{_name}"] = _rule(_name)
_NUM = "(?:[0-9０-９]+|[一二三四五六七八九十百零〇]+)"
_ROAD = r"[^\x{0}-\x{4DFF}\x{A000}-\x{10FFFF}在於到住從往的和與及跟是為至向由近了]"
_KEYWORD = f"(?i)(?:pa[sſ][sſ]word|pa[sſ][sſ]wd|pwd|[sſ]ecret|to[kK]en|api[_-]?[kK]ey|acce[sſ][sſ][_-]?[kK]ey|密碼|密鑰|金鑰)[{_SPACE}]*[:=：][{_SPACE}]*[\"']?([^{_SPACE}\"'，。；;,]{{4,}})"
_URL = f"https?://[^{_SPACE}<>\"'，。、；）」』)\\]]+"
_TW_PLACE = f"(?:{_ROAD}{{2}}[縣市])?(?:{_ROAD}{{1,3}}?[區鄉鎮市])?{_ROAD}{{2,8}}?(?:路|街|大道)(?:[{_SPACE}]*{_NUM}[{_SPACE}]*段)?(?:[{_SPACE}]*{_NUM}[{_SPACE}]*巷)?(?:[{_SPACE}]*{_NUM}[{_SPACE}]*弄)?[{_SPACE}]*{_NUM}(?:[{_SPACE}]*之[{_SPACE}]*{_NUM})?[{_SPACE}]*號(?:[{_SPACE}]*{_NUM}[{_SPACE}]*樓(?:[{_SPACE}]*之[{_SPACE}]*{_NUM})?)?(?:[{_SPACE}]*[0-9０-９]+[{_SPACE}]*室)?"
for _name, _sql in {
    "secret_keyword": _extracted(_KEYWORD, 1),
    "url": _extracted(_URL),
    "email": _extracted(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})(?:[^A-Za-z0-9_]|$)", 1),
    "tw_address": _extracted(_TW_PLACE),
    "ipv4": _extracted(r"(?:^|[^A-Za-z0-9_.]|(?:^|[^\p{Nd}])\.)((?:25[0-5]|2[0-4]\p{Nd}|1\p{Nd}\p{Nd}|[1-9]?\p{Nd})(?:\.(?:25[0-5]|2[0-4]\p{Nd}|1\p{Nd}\p{Nd}|[1-9]?\p{Nd})){3})(?:\.*[^\p{Nd}.]|\.*$)", 1),
}.items():
    QUERIES[f"values_{_name}"] = _values(_name)
    ORACLES[f"values_{_name}"] = _sql


_PHONES = (
    f"\\+886[{_SPACE}-]?9\\p{{Nd}}{{2}}[{_SPACE}-]?\\p{{Nd}}{{3}}[{_SPACE}-]?\\p{{Nd}}{{3}}|09\\p{{Nd}}{{2}}[{_SPACE}-]?\\p{{Nd}}{{3}}[{_SPACE}-]?\\p{{Nd}}{{3}}|\\(0\\p{{Nd}}{{1,2}}\\)[{_SPACE}]?\\p{{Nd}}{{3,4}}[{_SPACE}-]?\\p{{Nd}}{{4}}|0\\p{{Nd}}{{1,2}}-\\p{{Nd}}{{3,4}}-?\\p{{Nd}}{{4}}"
    f"|\\+\\p{{Nd}}{{1,3}}[{_SPACE}-]?\\(?\\p{{Nd}}{{1,4}}\\)?(?:[{_SPACE}-]?\\p{{Nd}}{{2,4}}){{2,3}}|\\(\\p{{Nd}}{{3}}\\)[{_SPACE}]?\\p{{Nd}}{{3}}-\\p{{Nd}}{{4}}|\\p{{Nd}}{{3}}-\\p{{Nd}}{{3}}-\\p{{Nd}}{{4}}"
)
ORACLES |= {
    "rule_secret_keyword": _located("SECRET", _KEYWORD, _like("c", "[PpSsTtAa密金ſ]"), "true", group=1),
    "rule_secret_key": _located("SECRET", rules.KEYS.replace("\\\\", "\\"), _like("c", "[sgAxe]"), _FREE, _ENDS),
    "rule_url": _located("URL", _URL, "c = 'h'", "true"),
    "rule_email": _located("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", _like("c", "[A-Za-z0-9._%+-]"), _FREE, _ENDS),
    "rule_twid": _located("TWID", r"[A-Za-z][1289]\p{Nd}{8}", _like("c", "[A-Za-z]"), _FREE, _ENDS, _TWID),
    "rule_card": _located("CARD", r"\p{Nd}(?:[ -]?\p{Nd}){12,18}", _DIGIT, _FREE, _ENDS, _LUHN),
    "rule_ipv4": _located("IP", _OCT + r"(?:\." + _OCT + "){3}", _DIGIT, _FREE + r" AND NOT (b = '.' AND regexp_full_match(b2, '\p{Nd}'))", r"\.*[^\p{Nd}.]|\.*$"),
    "rule_ipv6": _located("IP", "(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}", _like("c", "[0-9A-Fa-f:]"), f"NOT {_like('b', '[0-9A-Fa-f:]')}", "[^0-9A-Fa-f:]|$", _IPV6),
    "rule_phone": _located("PHONE", _PHONES, _like("c", r"[\p{Nd}+(]"), f"NOT {_like('b', r'[\p{Nd}+]')}", r"[^\p{Nd}]|$"),
    "rule_ssn": _located("SSN", r"\p{Nd}{3}-\p{Nd}{2}-\p{Nd}{4}", _DIGIT, _FREE, _ENDS, "NOT regexp_matches(v, '^(?:000|666|9)') AND v[5:6] <> '00' AND v[8:11] <> '0000'"),
    "rule_tw_address": _located("LOC", _TW_PLACE, _like("c", _ROAD), "true"),
}


@query()
def rules_all(spark: SparkSession, d: str) -> DataFrame:
    found = spread(documents(spark, d).select("doc_id", "text")).select("doc_id", F.inline(rules.rule_spans(F.col("text"))))
    return found.select("doc_id", "start", "end", "label", F.col("text").alias("value"))


@query(
    "WITH c AS (SELECT DISTINCT span_id, text FROM spans WHERE text IS NOT NULL), d AS (SELECT span_id, regexp_replace(text, '[ -]', '', 'g') AS v FROM c), "
    "e AS (SELECT span_id, v, list_sum(list_transform(range(1, length(v) + 1), lambda i: CASE WHEN (length(v) - i) % 2 = 0 THEN CAST(v[i] AS INTEGER) WHEN CAST(v[i] AS INTEGER) > 4 THEN 2 * CAST(v[i] AS INTEGER) - 9 ELSE 2 * CAST(v[i] AS INTEGER) END)) AS s FROM d WHERE regexp_full_match(v, '[0-9]{13,19}')) "
    "SELECT d.span_id, coalesce(e.s % 10 = 0, false) AS valid FROM d LEFT JOIN e USING (span_id)"
)
def card_check(spark: SparkSession, d: str) -> DataFrame:
    cards = table(spark, d, "spans").where("text is not null").dropDuplicates(["span_id"])
    digits = F.regexp_replace("text", "[ -]", "").rlike("^[0-9]{13,19}$")
    return cards.select("span_id", (digits & F.coalesce(T.luhn_ok(F.col("text")), F.lit(False))).alias("valid"))


# --- language and scripts --------------------------------------------------------------------------------------------


@query(
    f"WITH n AS (SELECT doc_id, length(regexp_replace(text, '[^{_HAN}]+', '', 'g')) AS h, length(regexp_replace(text, '[^\\p{{L}}{_HAN}]+', '', 'g')) AS l FROM documents WHERE text IS NOT NULL) "
    "SELECT doc_id, CASE WHEN l > 0 AND CAST(h AS DOUBLE) / l >= 0.2 THEN 'zh' ELSE 'en' END AS detected FROM n"
)
def lang_detect(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("doc_id", T.detect_language(F.col("text")).alias("detected"))


@query(f"SELECT doc_id, regexp_matches(text, '[{_HAN}]') AS zh, regexp_matches(text, '[A-Za-z]{{2}}') AS en FROM documents WHERE text IS NOT NULL")
def langs_in(spark: SparkSession, d: str) -> DataFrame:
    langs = texts(spark, d).select("doc_id", T.languages_in(F.col("text")).alias("l"))
    return langs.select("doc_id", F.array_contains("l", "zh").alias("zh"), F.array_contains("l", "en").alias("en"))


@query(f"SELECT doc_id, regexp_replace(regexp_replace(text, '([{_RUN}])([A-Za-z])', '\\1 \\2', 'g'), '([A-Za-z])([{_RUN}])', '\\1 \\2', 'g') AS spaced FROM documents WHERE text IS NOT NULL")
def script_spacing(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("doc_id", T.space_scripts(F.col("text")).alias("spaced"))


@query(
    f"WITH s AS (SELECT doc_id, length(text) AS n, length(regexp_replace(regexp_replace(text, '([{_RUN}])([A-Za-z])', '\\1 \\2', 'g'), '([A-Za-z])([{_RUN}])', '\\1 \\2', 'g')) AS m FROM documents WHERE text IS NOT NULL) "
    "SELECT doc_id, CAST(m + 1 AS BIGINT) AS entries, CAST(n AS BIGINT) AS last FROM s"
)
def script_spacing_index(spark: SparkSession, d: str) -> DataFrame:
    index = texts(spark, d).select("doc_id", T.space_scripts_index(F.col("text")).alias("i"))
    return index.select("doc_id", F.size("i").cast("long").alias("entries"), F.element_at("i", -1).cast("long").alias("last"))


# --- names -----------------------------------------------------------------------------------------------------------


_WORD = "[A-Z][a-z]+(?:[-'’](?:[A-Z][a-z]+|[a-z]{2,}|[a-rt-z]))*"
_CJK_LINES = (
    f"l AS (SELECT doc_id, k, ls[k] AS line, CAST(list_sum(list_transform(ls[1:k - 1], lambda x: length(x) + 1)) AS BIGINT) AS lo FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE regexp_matches(text, '[{_HAN}]'))) WHERE regexp_matches(ls[k], '[{_HAN}]')), "
    "cl AS (SELECT doc_id, k, line, coalesce(lo, 0) AS lo, regexp_extract_all(line, '(?s).') AS cs FROM l), pl AS (SELECT doc_id, k, line, lo, i, cs[i] AS c, coalesce(cs[i - 1], '') AS b FROM (SELECT *, unnest(range(1, len(cs) + 1)) AS i FROM cl))"
)


def _in_lines(found: str) -> str:
    """SQL of the matches in lines with Chinese, from left to right; ``found`` selects ``doc_id, k, lo, i, n, v, back`` from ``pl``."""
    return (
        f"WITH RECURSIVE {_CJK_LINES}, q AS ({found}), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS j FROM q WHERE v <> ''), "
        "w AS (SELECT *, true AS kept, i + n AS last FROM o WHERE j = 1 UNION ALL SELECT o.*, o.i >= w.last, CASE WHEN o.i >= w.last THEN o.i + o.n ELSE w.last END FROM w JOIN o ON o.doc_id = w.doc_id AND o.k = w.k AND o.j = w.j + 1), "
        "m AS (SELECT doc_id, lo + i - 1 + back AS start, v FROM w WHERE kept) "
    )


@query(
    _in_lines(f"SELECT doc_id, k, lo, i, length(v) AS n, v, 0 AS back FROM (SELECT *, regexp_extract(substring(line, i), '^({_WORD.replace(chr(39), chr(39) * 2)}(?: {_WORD.replace(chr(39), chr(39) * 2)})*)(?:[^A-Za-z0-9_]|$)', 1) AS v FROM pl WHERE {_like('c', '[A-Z]')} AND {_FREE})")
    + ", g AS (SELECT list(DISTINCT name) AS names FROM given_names), r AS (SELECT doc_id, start, ws, list_position(list_transform(ws, lambda x: list_contains(names, x)), true) AS f FROM (SELECT doc_id, start, string_split(v, ' ') AS ws, names FROM m, g)) "
    "SELECT doc_id, CAST(start + coalesce(length(array_to_string(ws[1:f - 1], ' ')), 0) + CASE WHEN f > 1 THEN 1 ELSE 0 END AS INTEGER) AS start, array_to_string(ws[f:f + 2], ' ') AS value FROM r WHERE f > 0"
)
def given_name_hits(spark: SparkSession, d: str) -> DataFrame:
    found = names.given_name_matches(F.col("text"), given(spark, d))
    return spread(documents(spark, d).where(T.has_cjk(F.col("text"))).select("doc_id", "text")).select("doc_id", F.inline(found)).select("doc_id", "start", F.col("text").alias("value"))


@query(
    _in_lines(
        f"SELECT doc_id, k, lo, i, length(a) AS n, v, length(a) - length(v) AS back FROM (SELECT *, regexp_extract(substring(line, i), '^((?:Mr|Mrs|Ms|Miss|Dr|Prof)\\.? ?{_WORD.replace(chr(39), chr(39) * 2)}(?: {_WORD.replace(chr(39), chr(39) * 2)})?)(?:[^A-Za-z0-9_]|$)', 1) AS a, "
        f"regexp_extract(substring(line, i), '^(?:Mr|Mrs|Ms|Miss|Dr|Prof)\\.? ?({_WORD.replace(chr(39), chr(39) * 2)}(?: {_WORD.replace(chr(39), chr(39) * 2)})?)(?:[^A-Za-z0-9_]|$)', 1) AS v FROM pl WHERE {_like('c', '[MDP]')} AND NOT {_like('b', '[A-Za-z]')})"
    )
    + "SELECT doc_id, CAST(start AS INTEGER) AS start, v AS value FROM m"
)
def title_hits(spark: SparkSession, d: str) -> DataFrame:
    found = documents(spark, d).where(T.has_cjk(F.col("text"))).select("doc_id", F.inline(names.titled_matches(F.col("text"))))
    return found.select("doc_id", "start", F.col("text").alias("value"))


@query(
    "WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^[ \\t]*(?:\\[?\\p{Nd}{1,2}:\\p{Nd}{2}(?::\\p{Nd}{2})?\\]?[ \\t]+)?([\\x{3400}-\\x{9FFF}]{2,4}|[A-Z][a-z]+(?: [A-Z][a-z]+){0,2})(?:[ \\t]*[:：]|\\t)', 1)) AS label FROM documents) SELECT doc_id, label, count(*) AS hits FROM s GROUP BY ALL"
)
def speaker_labels(spark: SparkSession, d: str) -> DataFrame:
    found = spread(documents(spark, d).select("doc_id", "text")).select("doc_id", F.inline(names.speaker_labels(F.col("text"))))
    return found.select("doc_id", F.col("text").alias("label")).groupBy("doc_id", "label").agg(F.count("*").alias("hits"))


_LIST = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


@query(
    "WITH l AS (SELECT doc_id, ls[k] AS line, coalesce(CAST(list_sum(list_transform(ls[1:k - 1], lambda x: length(x) + 1)) AS BIGINT), 0) AS lo FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))), "
    "s AS (SELECT doc_id, lo, regexp_extract(line, '^([ \\t]*(?:\\[?\\p{Nd}{1,2}:\\p{Nd}{2}(?::\\p{Nd}{2})?\\]?[ \\t]+)?)(?:[\\x{3400}-\\x{9FFF}]{2,4}|[A-Z][a-z]+(?: [A-Z][a-z]+){0,2})(?:[ \\t]*[:：]|\\t)', 1) AS lead, "
    "regexp_extract(line, '^[ \\t]*(?:\\[?\\p{Nd}{1,2}:\\p{Nd}{2}(?::\\p{Nd}{2})?\\]?[ \\t]+)?([\\x{3400}-\\x{9FFF}]{2,4}|[A-Z][a-z]+(?: [A-Z][a-z]+){0,2})(?:[ \\t]*[:：]|\\t)', 1) AS v FROM l), "
    "p AS (SELECT doc_id, list(DISTINCT text) AS persons FROM spans WHERE label = 'PERSON' GROUP BY doc_id), "
    f"k AS (SELECT doc_id, lo + length(lead) AS start, v, list_contains(persons, v) AS known, CASE WHEN ascii(v) < 128 THEN v NOT IN ({_LIST(T.NOT_SPEAKERS)}) ELSE NOT contains('{T.NOT_NAME_ENDINGS}', right(v, 1)) AND (contains('{T.COMMON_SURNAMES}', v[1]) OR v[1:2] IN ({_LIST(T.COMPOUND_SURNAMES)})) END AS likely "
    "FROM s JOIN p USING (doc_id) WHERE v <> ''), gate AS (SELECT doc_id FROM k GROUP BY doc_id HAVING bool_or(known)) SELECT doc_id, CAST(start AS INTEGER) AS start, v AS speaker FROM k JOIN gate USING (doc_id) WHERE known OR likely"
)
def speaker_gate(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "spans").where("label = 'PERSON'").groupBy("doc_id").agg(F.collect_set("text").alias("persons"))
    joined = documents(spark, d).select("doc_id", "text").join(people, "doc_id")
    return joined.select("doc_id", F.inline(names.speaker_matches(F.col("text"), F.col("persons")))).select("doc_id", "start", F.col("text").alias("speaker"))


_PARTS = (
    "CASE WHEN regexp_full_match(original, '[\\x{3400}-\\x{9FFF}]{3}') THEN [original[2:]] WHEN regexp_full_match(original, '[\\x{3400}-\\x{9FFF}]{4}') THEN CASE WHEN original[1:2] IN ("
    + ", ".join(f"'{x}'" for x in T.COMPOUND_SURNAMES)
    + f") THEN [original[3:]] ELSE [] END ELSE (SELECT CASE WHEN len(w) < 2 THEN [] ELSE list_filter(w, lambda x: regexp_full_match(x, '[A-Z][A-Za-z''’\\-·・]+') AND x NOT IN ('Mr', 'Mrs', 'Ms', 'Miss', 'Dr', 'Prof', 'Sir', 'Madam')) END FROM (SELECT list_filter(regexp_split_to_array(original, '[{_SPACE}]+'), lambda x: x <> '') AS w)) END"
)


@query(f"WITH {_BOOK}, o AS (SELECT DISTINCT original FROM book WHERE label = 'PERSON') SELECT original, unnest({_PARTS}) AS part FROM o")
def name_parts(spark: SparkSession, d: str) -> DataFrame:
    return book(spark, d).where("label = 'PERSON'").select("original").distinct().select("original", F.explode(T.name_parts(F.col("original"))).alias("part"))


@query(
    f"WITH {_BOOK}, o AS (SELECT DISTINCT session_id, original, code FROM book WHERE label = 'PERSON'), p AS (SELECT session_id, code, unnest({_PARTS}) AS part FROM o), "
    "u AS (SELECT session_id, part, min(code) AS code FROM p GROUP BY ALL HAVING count(DISTINCT code) = 1) SELECT u.session_id, u.part, u.code FROM u WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.session_id = u.session_id AND o.original = u.part)"
)
def alias_unique(spark: SparkSession, d: str) -> DataFrame:
    return spans.unique_aliases(book(spark, d).where("label = 'PERSON'"), "session_id", "original", "code").select("session_id", "part", F.col("key").alias("code"))


@query(
    "WITH s AS (SELECT c_name AS name, CAST(round(o_totalprice) AS BIGINT) AS percent FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) >= 1995), t AS (SELECT name, sum(percent) AS share FROM s GROUP BY ALL ORDER BY share DESC, name LIMIT 300) "
    "SELECT name FROM t WHERE name NOT IN ('Customer#000000001') UNION SELECT 'Extra Name'"
)
def name_rank(spark: SparkSession, d: str) -> DataFrame:
    shares = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.year("o_orderdate").alias("year"), F.col("c_name").alias("name"), F.round("o_totalprice").cast("long").alias("percent"))
    return store.rank_names(shares, ["Customer#000000001"], ["Extra Name"], since=1995, most=300)


# --- span algebra ----------------------------------------------------------------------------------------------------

_INTERVALS = "iv AS (SELECT l_orderkey AS doc_id, CAST(l_partkey % 40 AS INTEGER) AS s, CAST(l_partkey % 40 + 1 + l_suppkey % 9 AS INTEGER) AS e, l_linenumber AS prio FROM lineitem)"


def intervals(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping spans of order lines."""
    start = (F.col("l_partkey") % 40).cast("int")
    end = (start + 1 + F.col("l_suppkey") % 9).cast("int")
    one = F.struct(start.alias("start"), end.alias("end"), F.lit("LOC").alias("label"), F.col("l_linenumber").cast("string").alias("text"), F.lit(1.0).alias("score"), F.col("l_linenumber").cast("int").alias("prio"))
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list(one).alias("spans"))


@query(
    f"WITH RECURSIVE {_INTERVALS}, o AS (SELECT doc_id, s, e, prio, row_number() OVER (PARTITION BY doc_id ORDER BY s, e DESC, prio) AS k FROM iv), "
    "w AS (SELECT doc_id, k, s, e, prio, true AS kept, e AS last FROM o WHERE k = 1 UNION ALL SELECT o.doc_id, o.k, o.s, o.e, o.prio, o.s >= w.last, CASE WHEN o.s >= w.last THEN o.e ELSE w.last END FROM w JOIN o ON o.doc_id = w.doc_id AND o.k = w.k + 1) "
    "SELECT doc_id, CAST(s AS INTEGER) AS span_start, CAST(e AS INTEGER) AS span_end, CAST(prio AS INTEGER) AS prio FROM w WHERE kept"
)
def overlap_resolve(spark: SparkSession, d: str) -> DataFrame:
    kept = intervals(spark, d).select("doc_id", F.inline(spans.resolve_overlaps(F.col("spans"))))
    return kept.select("doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "prio")


@query(f"WITH {_IGNORED}, s AS (SELECT DISTINCT span_id, session_id, text FROM spans) SELECT span_id FROM s WHERE NOT EXISTS (SELECT 1 FROM ign WHERE ign.session_id = s.session_id AND ign.original = s.text)")
def ignore_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "spans").dropDuplicates(["span_id"]).select("span_id", "session_id", "text")
    return rows.join(retired(spark, d).select("session_id", F.col("original").alias("text")).distinct(), ["session_id", "text"], "left_anti").select("span_id")


@query("WITH s AS (SELECT DISTINCT s.span_id, s.doc_id, s.label, d.scope FROM spans s JOIN documents d USING (doc_id)) SELECT span_id FROM s WHERE label = 'PERSON' OR scope IS DISTINCT FROM 'names'")
def scope_names(spark: SparkSession, d: str) -> DataFrame:
    one = F.struct(F.col("span_start").alias("start"), F.col("span_end").alias("end"), F.coalesce("label", F.lit("")).alias("label"), "text", "score", "prio", "span_id")
    rows = table(spark, d, "spans").dropDuplicates(["span_id"]).groupBy("doc_id").agg(F.collect_list(one).alias("s")).join(documents(spark, d).select("doc_id", "scope"), "doc_id")
    return rows.select(F.inline(spans.keep_scope(F.col("s"), F.col("scope")))).select("span_id")


def _guarded(value: str, pieces: str) -> str:
    """SQL of the numbers of the gaps in ``pieces``, a text split by a value, at which the value stands for itself.

    Where the value begins or ends with an ASCII letter or digit, none may touch it there. A value that overlaps itself would
    be another case.
    """
    before = f"CASE WHEN {pieces}[i] = '' THEN CASE WHEN i > 1 THEN right({value}, 1) ELSE '' END ELSE right({pieces}[i], 1) END"
    after = f"CASE WHEN {pieces}[i + 1] = '' THEN CASE WHEN i + 1 < len({pieces}) THEN left({value}, 1) ELSE '' END ELSE left({pieces}[i + 1], 1) END"
    word = "'[A-Za-z0-9]'"
    return (
        f"list_filter(range(1, len({pieces})), lambda i: NOT (regexp_full_match(left({value}, 1), {word}) AND regexp_full_match({before}, {word})) AND NOT (regexp_full_match(right({value}, 1), {word}) AND regexp_full_match({after}, {word})))"
    )


@query(
    f"WITH v AS (SELECT DISTINCT doc_id, text AS value FROM spans WHERE length(text) > 1 AND regexp_matches(text, '[^{_SPACE}]')), d AS (SELECT v.doc_id, v.value, string_split(d.text, v.value) AS ps FROM v JOIN documents d USING (doc_id) WHERE contains(d.text, v.value)), "
    f"h AS (SELECT doc_id, value, CAST(len({_guarded('value', 'ps')}) AS BIGINT) AS hits FROM d) SELECT doc_id, value, hits FROM h WHERE hits > 0"
)
def known_propagation(spark: SparkSession, d: str) -> DataFrame:
    """Every known value of a document that is longer than one character, wherever it occurs."""
    values = table(spark, d, "spans").where(F.length("text") > 1).groupBy("doc_id").agg(F.map_from_entries(F.collect_set(F.struct("text", F.lit("PERSON")))).alias("values"))
    joined = documents(spark, d).select("doc_id", "text").join(values, "doc_id")
    joined = joined.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "doc_id")
    found = joined.select("doc_id", F.inline(spans.find_all(F.col("text"), F.col("values"))))
    return found.groupBy("doc_id", F.col("text").alias("value")).agg(F.count("*").alias("hits"))


@query("SELECT label, count(DISTINCT span_id) AS n_spans, count(DISTINCT doc_id) AS n_docs FROM spans GROUP BY label")
def label_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "spans").groupBy("label").agg(F.count_distinct("span_id").alias("n_spans"), F.count_distinct("doc_id").alias("n_docs"))


# --- code books ------------------------------------------------------------------------------------------------------


@query(f"SELECT o_orderkey, {_letters('o_orderkey')} AS letters FROM orders")
def code_letters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", T.letters(F.col("o_orderkey")).alias("letters"))


@query(
    "WITH s AS (SELECT DISTINCT s.session_id, d.seq, s.span_start, s.label, s.text FROM spans s JOIN documents d USING (doc_id) WHERE s.session_id IS NOT NULL AND s.label IS NOT NULL AND s.text IS NOT NULL), "
    "f AS (SELECT session_id, text AS original, min((seq, span_start, label)) AS f FROM s GROUP BY ALL), g AS (SELECT session_id, original, f[3] AS label, f[1] AS seq, f[2] AS st FROM f), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY session_id, label ORDER BY seq, st, original) - 1 AS n, row_number() OVER (PARTITION BY session_id ORDER BY seq, st, original) - 1 AS ord FROM g) "
    f"SELECT session_id, original, label, '[' || label || '_' || {_letters('n')} || ']' AS code, CAST(ord AS BIGINT) AS ord FROM n"
)
def codebook_assign(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "spans").join(documents(spark, d).select("doc_id", "seq"), "doc_id")
    return codebook.assign_codes(rows.select("session_id", "seq", F.col("span_start").alias("start"), "label", "text"))


@query(f"WITH {_BOOK} SELECT DISTINCT code, regexp_extract(code, '^\\[([A-Z]+)_', 1) AS label FROM book")
def label_of_code(spark: SparkSession, d: str) -> DataFrame:
    return book(spark, d).select("code").distinct().select("code", T.label_of_code(F.col("code")).alias("label"))


@query(f"WITH {_BOOK}, {_LIVE} SELECT session_id, code, original FROM live")
def code_originals(spark: SparkSession, d: str) -> DataFrame:
    return codebook.originals_of_codes(book(spark, d))


@query(f"WITH {_LOOKUP} SELECT session_id, code, original FROM lookup")
def restore_lookup(spark: SparkSession, d: str) -> DataFrame:
    return codebook.restore_lookup(book(spark, d), retired(spark, d))


@query(
    f"WITH {_BOOK}, g AS (SELECT session_id, code, list(original ORDER BY length(original) DESC, ord, original) AS o, regexp_extract(code, '^\\[([A-Z]+)_', 1) AS label FROM book GROUP BY session_id, code) "
    "SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY label, length(code), code) AS INTEGER) AS rank, code, array_to_string(o, ' | ') AS originals FROM g"
)
def codebook_preview(spark: SparkSession, d: str) -> DataFrame:
    return codebook.preview(book(spark, d)).withColumn("originals", F.array_join("originals", " | "))


@query(
    f"WITH {_BOOK}, {_IGNORED}, gone AS (SELECT session_id, original, code, row_number() OVER (PARTITION BY session_id ORDER BY code, length(original) DESC, ord) - 1 AS n FROM book WHERE code LIKE '%\\_A]' ESCAPE '\\'), base AS (SELECT session_id, max(ord) + 1 AS b FROM ign GROUP BY session_id) "
    "SELECT session_id, original, code, CAST(n + coalesce(b, 0) AS BIGINT) AS ord FROM gone LEFT JOIN base USING (session_id) UNION ALL SELECT session_id, original, code, CAST(ord AS BIGINT) FROM ign"
)
def codebook_unmark(spark: SparkSession, d: str) -> DataFrame:
    """The ignored originals after the first code of every label is retired in every session."""
    rows = book(spark, d)
    _, ignored = codebook.unmark(rows, retired(spark, d), rows.where(F.col("code").endswith("_A]")).select("session_id", "code"))
    return ignored.select("session_id", "original", "code", "ord")


def stored(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with their code books, as they are stored: entries in their order."""
    entries = F.array_sort(F.collect_list(F.struct("ord", F.col("original").alias("key"), F.col("code").alias("value"))))
    books = book(spark, d).groupBy("session_id").agg(F.map_from_entries(F.transform(entries, lambda x: F.struct(x["key"], x["value"]))).alias("to_code"))
    sessions = table(spark, d, "sessions").dropDuplicates(["session_id"])
    return sessions.join(books, "session_id", "left").withColumn("to_code", F.coalesce("to_code", F.create_map().cast("map<string,string>")))


def _opened(back: DataFrame) -> DataFrame:
    """Every entry of sessions that came back: the code book in its order, the counters, the ignored originals."""
    books = back.select(F.col("id").alias("session_id"), "label", "created_at", F.lit("to_code").alias("part"), F.posexplode("to_code").alias("pos", "key", "value"))
    ignored = back.select(F.col("id").alias("session_id"), "label", "created_at", F.lit("ignored").alias("part"), F.posexplode("ignored").alias("pos", "key", "value"))
    counters = back.select(F.col("id").alias("session_id"), "label", "created_at", F.lit("counters").alias("part"), F.posexplode("counters").alias("pos", "key", "value")).withColumn("value", F.col("value").cast("string"))
    return books.unionByName(ignored).unionByName(counters)


_STORED = (
    f"WITH {_BOOK}, ses AS (SELECT DISTINCT session_id, label, created_at, counters, ignored FROM sessions), b AS (SELECT session_id, original AS key, code AS value, row_number() OVER (PARTITION BY session_id ORDER BY ord, original) - 1 AS pos FROM book) "
    "SELECT s.session_id, s.label, s.created_at, 'to_code' AS part, CAST(b.pos AS INTEGER) AS pos, b.key, b.value FROM ses s JOIN b USING (session_id) "
    "UNION ALL SELECT session_id, label, created_at, 'ignored', CAST(unnest(range(len(map_keys(ignored)))) AS INTEGER), unnest(map_keys(ignored)), unnest(map_values(ignored)) FROM ses "
    "UNION ALL SELECT session_id, label, created_at, 'counters', CAST(unnest(range(len(map_keys(counters)))) AS INTEGER), unnest(map_keys(counters)), CAST(unnest(map_values(counters)) AS VARCHAR) FROM ses"
)


@query(_STORED)
def session_json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    json = codebook.session_json(*map(F.col, ("session_id", "label", "created_at", "to_code", "counters", "ignored")))
    return _opened(stored(spark, d).select(codebook.parse_session(json).alias("s")).select("s.*"))


@query(_STORED)
def aes_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    key = F.lit(bytes(range(32)))
    json = codebook.session_json(*map(F.col, ("session_id", "label", "created_at", "to_code", "counters", "ignored")))
    sealed = stored(spark, d).select("session_id", store.encrypt_session(F.col("session_id"), json, key).alias("payload"))
    return _opened(sealed.select(codebook.parse_session(store.decrypt_session(F.col("session_id"), F.col("payload"), key)).alias("s")).select("s.*"))


# --- restoring, ranking, edits ---------------------------------------------------------------------------------------

_RESTORED = (
    f"WITH {_LOOKUP}, {_RESULTS}, m AS (SELECT session_id, map_from_entries(list((code, original))) AS m FROM lookup GROUP BY session_id), "
    f"p AS (SELECT result_id, coalesce(m, MAP {{}}) AS m, regexp_split_to_array(text, '{_CODE}') AS gaps, regexp_extract_all(text, '{_CODE}') AS codes FROM res LEFT JOIN m USING (session_id) WHERE text IS NOT NULL)"
)


def restored(spark: SparkSession, d: str) -> DataFrame:
    lookup = codebook.restore_lookup(book(spark, d), retired(spark, d))
    return restore.restore_table(results(spark, d).where("text is not null"), lookup, "result_id", "session_id", "text")


@query(_RESTORED + " SELECT result_id, array_to_string(flatten(list_transform(range(1, len(gaps) + 1), lambda i: [gaps[i], coalesce(m[codes[i]], codes[i], '')])), '') AS restored_text FROM p")
def restore_text(spark: SparkSession, d: str) -> DataFrame:
    return restored(spark, d).select(F.col("id").alias("result_id"), F.col("text").alias("restored_text"))


@query(_RESTORED + " SELECT result_id, CAST(len(list_filter(codes, lambda c: m[c] IS NOT NULL)) AS INTEGER) AS restored, CAST(len(list_distinct(list_filter(codes, lambda c: m[c] IS NULL))) AS INTEGER) AS n_unknown FROM p")
def restore_counts(spark: SparkSession, d: str) -> DataFrame:
    return restored(spark, d).select(F.col("id").alias("result_id"), "restored", F.size("unknown").alias("n_unknown"))


_WANTED = f"w AS (SELECT DISTINCT result_id, unnest(regexp_extract_all(text, '{_CODE}')) AS code FROM res)"


@query(
    f"WITH {_LOOKUP}, {_RESULTS}, {_WANTED}, own AS (SELECT DISTINCT w.result_id, w.code FROM w JOIN res USING (result_id) JOIN lookup l ON l.session_id = res.session_id AND l.code = w.code) "
    "SELECT result_id, count(*) AS matches FROM own GROUP BY ALL"
)
def match_count(spark: SparkSession, d: str) -> DataFrame:
    lookup = codebook.restore_lookup(book(spark, d), retired(spark, d)).select("session_id", "code")
    wanted = results(spark, d).select("result_id", "session_id", F.explode(T.codes_in(F.col("text"))).alias("code"))
    return wanted.join(lookup, ["session_id", "code"]).groupBy("result_id").agg(F.count("*").alias("matches"))


@query(
    f"WITH {_LOOKUP}, {_RESULTS}, {_WANTED}, c AS (SELECT DISTINCT session_id, code FROM lookup), n AS (SELECT w.result_id, c.session_id, count(*) AS matches FROM w JOIN c USING (code) GROUP BY ALL), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY matches DESC, session_id) AS r FROM n) SELECT result_id, session_id, matches FROM k WHERE r = 1"
)
def recommend_session(spark: SparkSession, d: str) -> DataFrame:
    codes = codebook.restore_lookup(book(spark, d), retired(spark, d)).select("session_id", "code")
    order = codebook.numbered(codes.select("session_id").distinct().withColumn("one", F.lit(1)), ["one"], ["session_id"], "ord").select("session_id", "ord")
    return restore.recommend(results(spark, d), codes, order, "result_id").withColumnRenamed("id", "result_id")


_REPLIES = "rep AS (SELECT DISTINCT result_id, session_id, text, code_spans, originals FROM obfuscate_results WHERE text IS NOT NULL)"


@query(
    f"WITH {_REPLIES}, g AS (SELECT result_id, text, code_spans, originals, CASE WHEN session_id IS NULL THEN [] ELSE list_filter(range(1, len(code_spans) + 1), lambda i: code_spans[i].code = '[PERSON_A]') END AS k FROM rep) "
    "SELECT result_id, CASE WHEN len(k) = 0 THEN text ELSE array_to_string(list_transform(range(1, len(k) + 1), lambda j: substring(text, CASE WHEN j = 1 THEN 1 ELSE code_spans[k[j - 1]].span_end + 1 END, code_spans[k[j]].span_start - CASE WHEN j = 1 THEN 0 ELSE code_spans[k[j - 1]].span_end END) || originals[k[j]]), '') "
    "|| substring(text, code_spans[k[-1]].span_end + 1) END AS text, CAST(len(code_spans) - len(k) AS INTEGER) AS n_codes FROM g"
)
def unmark_transcript(spark: SparkSession, d: str) -> DataFrame:
    rows = replies(spark, d).where("text is not null")
    codes = rows.select("session_id").distinct().withColumn("code", F.lit("[PERSON_A]"))
    return edits.unmark_in_transcript(rows, codes).select("result_id", "text", F.size("code_spans").alias("n_codes"))


@query(
    f"WITH {_REPLIES}, g AS (SELECT result_id, session_id, text, string_split(text, 'ticket') AS ps FROM rep), h AS (SELECT *, CASE WHEN session_id IS NULL THEN [] ELSE {_guarded(repr('ticket'), 'ps')} END AS ok FROM g) "
    "SELECT result_id, ps[1] || array_to_string(list_transform(range(1, len(ps)), lambda i: CASE WHEN list_contains(ok, i) THEN '[OTHER_ZZ]' ELSE 'ticket' END || ps[i + 1]), '') AS text, CAST(len(ok) AS INTEGER) AS replaced FROM h"
)
def mark_transcript(spark: SparkSession, d: str) -> DataFrame:
    rows = replies(spark, d).where("text is not null")
    marks = rows.select("session_id").distinct().where("session_id is not null").withColumn("values", F.create_map(F.lit("ticket"), F.lit("[OTHER_ZZ]")))
    return edits.mark_in_transcript(rows, marks).select("result_id", "text", "replaced")


@query("SELECT DISTINCT result_id, CASE WHEN session_id = (SELECT min(session_id) FROM sessions) THEN NULL ELSE session_id END AS session_id FROM obfuscate_results")
def session_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "sessions").agg(F.min("session_id").alias("session_id"))
    return edits.delete_session(results(spark, d).select("result_id", "session_id"), gone)


@query()
def obfuscate_text(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(documents(spark, d).select("doc_id", "text").where("text is not null")).withColumn("spans", let(rules.rule_spans(F.col("text")), spans.resolve_overlaps))
    coded = rows.select("doc_id", let(F.col("spans"), lambda s: codebook.obfuscate(F.col("text"), s, codebook.document_codes(s))).alias("o"))
    return coded.select("doc_id", F.col("o.text").alias("text"), F.size("o.code_spans").alias("n_codes"))


@query()
def obfuscate_sessions(spark: SparkSession, d: str) -> DataFrame:
    return fold.obfuscate_sessions(documents(spark, d), names=given(spark, d)).select("session_id", "seq", "doc_id", "text", "lang", F.size("code_spans").alias("n_codes"))


@query()
def session_codebook(spark: SparkSession, d: str) -> DataFrame:
    return fold.code_book(fold.obfuscate_sessions(documents(spark, d), names=given(spark, d)))


@query(
    "WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS best, CASE WHEN event_id % 7 = 0 THEN 'hand' END AS manual FROM events), "
    "p AS (SELECT *, coalesce(manual, CASE WHEN best IS NOT NULL AND best IS DISTINCT FROM lag(best) OVER w THEN best END) AS picked FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) "
    "SELECT event_id, last_value(picked IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS chosen FROM p"
)
def sticky_choice(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_id", "ts", F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("best"), F.when(F.col("event_id") % 7 == 0, F.lit("hand")).alias("manual"))
    return restore.sticky_choice(rows, "user_id", ["ts", "event_id"]).select("event_id", "chosen")


@query(
    "WITH RECURSIVE e AS (SELECT CAST(n_nationkey AS VARCHAR) AS name, CAST((n_nationkey * 2 + k) % 30 AS VARCHAR) AS requires FROM nation, (SELECT unnest([1, 7]) AS k)), "
    "c AS (SELECT requires AS name FROM e WHERE name = '0' UNION SELECT e.requires FROM c JOIN e USING (name)) SELECT name FROM c WHERE name <> '0'"
)
def dependency_closure(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("n_nationkey")
    needs = table(spark, d, "nation").select(key.cast("string").alias("name"), F.explode(F.array(((key * 2 + 1) % 30).cast("string"), ((key * 2 + 7) % 30).cast("string"))).alias("requires"))
    return closure.closure(needs, "0")


@query("SELECT session_id, coalesce(label, 'Session ' || row_number() OVER (ORDER BY created_at, session_id)) AS label FROM (SELECT session_id, any_value(label) AS label, min(created_at) AS created_at FROM (SELECT DISTINCT session_id, label, created_at FROM sessions) GROUP BY session_id)")
def session_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sessions").groupBy(F.col("session_id").alias("id")).agg(F.max("label").alias("label"), F.min("created_at").alias("created_at"))
    return store.numbered_labels(rows).select(F.col("id").alias("session_id"), "label")


@query("SELECT doc_id, text FROM documents")
def sessions_reverted(spark: SparkSession, d: str) -> DataFrame:
    """The coded documents with the original back in place of each code span: the documents themselves."""
    coded = fold.obfuscate_sessions(documents(spark, d), names=given(spark, d))
    before = lambda i: F.coalesce(F.try_element_at("code_spans", i)["end"], F.lit(0))
    parts = F.transform("code_spans", lambda s, i: F.concat(F.substr("text", F.when(i > 0, before(F.greatest(i, F.lit(1)))).otherwise(0) + 1, s["start"] - F.when(i > 0, before(F.greatest(i, F.lit(1)))).otherwise(0)), F.element_at("originals", i + 1)))
    return coded.select("doc_id", F.concat(F.array_join(parts, ""), F.substr("text", before(F.lit(-1)) + 1)).alias("text"))


@query("SELECT 0 AS doubled, 0 AS misnumbered, 0 AS mislabelled, 0 AS gaps")
def codebook_sound(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the code books of a fold, as counts of breaches: originals once, numbers without gaps, labels those of the codes."""
    entries = fold.code_book(fold.obfuscate_sessions(documents(spark, d), names=given(spark, d)))
    number = F.aggregate(F.split(F.regexp_extract("code", "_([A-Z]+)\\]$", 1), ""), F.lit(0).cast("long"), lambda a, c: F.when(c == "", a).otherwise(a * 26 + F.ascii(c) - 64)) - 1
    rows = entries.withColumn("number", number)
    once = rows.groupBy("session_id", "original").agg((F.count("*") - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).cast("int").alias("doubled"))
    labels = rows.agg(F.coalesce(F.sum((T.label_of_code(F.col("code")) != F.col("label")).cast("int")), F.lit(0)).cast("int").alias("mislabelled"))
    numbers = rows.groupBy("session_id", "label").agg((F.max("number") + 1 - F.count_distinct("number")).alias("off")).agg(F.coalesce(F.sum("off"), F.lit(0)).cast("int").alias("misnumbered"))
    order = rows.groupBy("session_id").agg((F.max("ord") + 1 - F.count_distinct("ord")).alias("off")).agg(F.coalesce(F.sum("off"), F.lit(0)).cast("int").alias("gaps"))
    return once.crossJoin(numbers).crossJoin(labels).crossJoin(order)  # single rows


# --- model output ----------------------------------------------------------------------------------------------------


def _listed_detector(found: list[str]):
    def make():
        import re

        pattern = re.compile("|".join(map(re.escape, sorted(found, key=len, reverse=True))))
        return lambda text: [(m.start(), m.end(), "PERSON", 0.9) for m in pattern.finditer(text)]

    return make


@query()
def detector_pipeline(spark: SparkSession, d: str) -> DataFrame:
    registry = detectors.Registry()
    for slot in ("pii", "zh", "mixed"):
        registry.register(slot, _listed_detector(given(spark, d)))
    found = detectors.model_spans(spread(documents(spark, d).select("doc_id", "text", "lang_choice")), registry)
    return found.select("doc_id", "model_used", F.inline("model_cand")).select("doc_id", "model_used", "start", "end", "label", F.col("text").alias("value"), "prio")


@query("SELECT doc_id, CAST(unnest(range(0, greatest(CAST(ceil((n_chars - 510) / 446.0) AS BIGINT), 0) + 1)) * 446 AS INTEGER) AS window_start FROM documents WHERE n_chars IS NOT NULL")
def token_windows(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars").cast("int")
    return documents(spark, d).where("n_chars is not null").select("doc_id", F.inline(decoding.token_windows(n))).select("doc_id", F.col("start").alias("window_start"))


@query(
    "WITH RECURSIVE t AS (SELECT doc_id, text, CASE WHEN length(text) <= 256 THEN [text] ELSE regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') END AS ls FROM documents WHERE text IS NOT NULL), "
    "l AS (SELECT doc_id, k, ls[k] AS line, len(string_split(ls[k], ' ')) AS n FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM t)), "
    "w AS (SELECT doc_id, k, line, n AS size, 0 AS piece_no FROM l WHERE k = 1 UNION ALL SELECT l.doc_id, l.k, l.line, CASE WHEN w.size + l.n > 256 THEN l.n ELSE w.size + l.n END, CASE WHEN w.size + l.n > 256 THEN w.piece_no + 1 ELSE w.piece_no END FROM w JOIN l ON l.doc_id = w.doc_id AND l.k = w.k + 1) "
    "SELECT doc_id, CAST(piece_no AS INTEGER) AS piece_no, string_agg(line, '' ORDER BY k) AS piece FROM w GROUP BY doc_id, piece_no"
)
def piece_cut(spark: SparkSession, d: str) -> DataFrame:
    lines = F.regexp_extract_all("text", F.lit("[^\\n]*\\n|[^\\n]+"), F.lit(0))
    counts = F.transform(lines, lambda x: F.size(F.split(x, " ")))
    return documents(spark, d).where("text is not null").select("doc_id", F.posexplode(decoding.cut_pieces(F.col("text"), counts, 256)).alias("piece_no", "piece"))


@query(
    "WITH s AS (SELECT DISTINCT span_id, text FROM spans), t AS (SELECT span_id, text, unnest(range(0, length(text) // 5)) AS i FROM s WHERE length(text) >= 5), "
    "g AS (SELECT span_id, text, i, ['B-PER', 'I-PER', 'O', 'B-LOC', 'I-LOC'][(i * i + length(text)) % 5 + 1] AS tag FROM t), e AS (SELECT *, right(tag, 3) AS kind, lag(tag) OVER (PARTITION BY span_id ORDER BY i) AS prev FROM g), "
    "f AS (SELECT *, sum(CASE WHEN tag = 'O' OR tag LIKE 'B%' OR prev IS NULL OR prev = 'O' OR right(prev, 3) <> kind THEN 1 ELSE 0 END) OVER (PARTITION BY span_id ORDER BY i) AS no FROM e), "
    "r AS (SELECT span_id, any_value(text) AS text, no, any_value(kind) AS kind, min(i) * 5 AS a, max(i) * 5 + 5 AS b FROM f WHERE tag <> 'O' GROUP BY span_id, no), "
    f"c AS (SELECT *, regexp_replace(substring(text, a + 1, b - a), '^[{_SPACE}]+', '') AS core FROM r), d AS (SELECT span_id, text, no, kind, b - length(core) AS a, b - length(core) + length(regexp_replace(core, '[{_SPACE}]+$', '')) AS b FROM c), "
    "h AS (SELECT *, CASE WHEN lag(kind) OVER w = kind AND substring(text, lag(b) OVER w + 1, a - lag(b) OVER w) IN ('', '-', '‐', chr(39), '’', '·', '・') THEN 0 ELSE 1 END AS fresh FROM d WINDOW w AS (PARTITION BY span_id ORDER BY no)), "
    "j AS (SELECT *, sum(fresh) OVER (PARTITION BY span_id ORDER BY no) AS whole FROM h) "
    "SELECT span_id, CAST(min(a) AS INTEGER) AS start, CAST(max(b) AS INTEGER) AS end, CASE any_value(kind) WHEN 'PER' THEN 'PERSON' ELSE 'LOC' END AS label, substring(any_value(text), CAST(min(a) AS BIGINT) + 1, CAST(max(b) - min(a) AS BIGINT)) AS value FROM j GROUP BY span_id, whole"
)
def bio_decode(spark: SparkSession, d: str) -> DataFrame:
    tags = F.array(*[F.lit(x) for x in ("B-PER", "I-PER", "O", "B-LOC", "I-LOC")])
    words = F.filter(F.transform(F.sequence(F.lit(0), F.greatest((F.length("text") / 5).cast("int") - 1, F.lit(0))), lambda i: i), lambda i: i * 5 + 5 <= F.length("text"))
    tokens = F.transform(words, lambda i: F.struct(i.alias("word_id"), (i * 5).alias("start"), (i * 5 + 5).alias("end"), F.element_at(tags, (F.pmod(i * i + F.length("text"), F.lit(5)) + 1).cast("int")).alias("tag"), F.lit(0.9).alias("score")))
    rows = table(spark, d, "spans").dropDuplicates(["span_id"]).select("span_id", "text", tokens.alias("tokens"))
    return rows.select("span_id", F.inline(decoding.decode_bio(F.col("text"), F.col("tokens"), {"PER": "PERSON", "LOC": "LOC"}))).select("span_id", "start", "end", "label", F.col("text").alias("value"))


_KEYED = "k AS (SELECT l_orderkey AS doc_id, CAST(l_partkey % 5 AS INTEGER) AS s, CAST(l_partkey % 5 + 1 + l_suppkey % 2 AS INTEGER) AS e, CAST(l_linenumber AS INTEGER) AS prio FROM lineitem)"


@query(f"WITH {_KEYED} SELECT doc_id, s AS span_start, e AS span_end, max(prio) AS prio FROM k GROUP BY ALL")
def window_dedupe(spark: SparkSession, d: str) -> DataFrame:
    start = (F.col("l_partkey") % 5).cast("int")
    one = F.struct(start.alias("start"), (start + 1 + F.col("l_suppkey") % 2).cast("int").alias("end"), F.lit("LOC").alias("label"), F.lit("x").alias("text"), F.lit(1.0).alias("score"), F.col("l_linenumber").cast("int").alias("prio"))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list(one).alias("spans"))
    ordered = F.array_sort("spans", lambda a, b: a["prio"] - b["prio"])
    return rows.select("doc_id", F.inline(decoding.dedupe_windows(ordered))).select("doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "prio")


@query(
    "WITH s AS (SELECT DISTINCT span_id, text FROM spans), t AS (SELECT span_id, text, unnest(range(0, length(text) // 3)) AS i FROM s WHERE length(text) >= 3), g AS (SELECT *, ['B-P', 'I-P', 'E-P', 'O', 'S-Q', 'E-Q'][(i * i + length(text)) % 6 + 1] AS tag FROM t), "
    "o AS (SELECT *, max(CASE WHEN left(tag, 1) IN ('B', 'S') THEN i END) OVER w AS opened, max(CASE WHEN left(tag, 1) IN ('E', 'S') THEN i END) OVER (PARTITION BY span_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS closed FROM g WINDOW w AS (PARTITION BY span_id ORDER BY i)), "
    "f AS (SELECT o.span_id, o.text, o.opened * 3 AS a, o.i * 3 + 3 AS b, right(g.tag, 1) AS kind FROM o JOIN g ON g.span_id = o.span_id AND g.i = o.opened WHERE left(o.tag, 1) IN ('E', 'S') AND (o.closed IS NULL OR o.closed < o.opened)), "
    f"c AS (SELECT *, regexp_replace(substring(text, a + 1, b - a), '^[{_SPACE}]+', '') AS core FROM f WHERE kind = 'P'), v AS (SELECT span_id, b - length(core) AS start, regexp_replace(core, '[{_SPACE}]+$', '') AS value FROM c) "
    "SELECT span_id, CAST(start AS INTEGER) AS start, value FROM v WHERE value <> ''"
)
def bioes_emit(spark: SparkSession, d: str) -> DataFrame:
    tags = F.array(*[F.lit(x) for x in ("B-P", "I-P", "E-P", "O", "S-Q", "E-Q")])
    n = F.length("text")
    tokens = F.transform(F.sequence(F.lit(0), F.floor(n / 3).cast("int") - 1), lambda i: F.struct((i * 3).alias("start"), (i * 3 + 3).alias("end"), F.element_at(tags, (F.pmod(i * i + n, F.lit(6)) + 1).cast("int")).alias("tag")))
    rows = table(spark, d, "spans").dropDuplicates(["span_id"]).where(n >= 3).select("span_id", "text", tokens.alias("tokens"))
    return rows.select("span_id", F.inline(decoding.emit_bioes(F.col("text"), F.col("tokens"), {"P": "PERSON"}))).select("span_id", "start", F.col("text").alias("value"))


@query(
    "WITH s AS (SELECT DISTINCT span_id, doc_id, span_start, span_end, coalesce(label, 'OTHER') AS label, text FROM spans WHERE length(text) > 1) SELECT doc_id, text AS value, arg_max(label, (span_start, span_end, span_id)) AS label FROM s GROUP BY doc_id, text"
)
def known_values(spark: SparkSession, d: str) -> DataFrame:
    one = F.struct("span_start", "span_end", "span_id", F.coalesce("label", F.lit("OTHER")).alias("label"), "text")
    rows = table(spark, d, "spans").where("text is not null").dropDuplicates(["span_id"]).groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("spans"))
    return rows.select("doc_id", F.explode(spans.known_values(F.col("spans"))).alias("value", "label"))


_TICKET = r"(?:ticket|case) #?[0-9]{2,}"


@query(_located("CASE", _TICKET, "c IN ('t', 'c')", _FREE, "[^0-9]|$"))
def custom_rule(spark: SparkSession, d: str) -> DataFrame:
    rule = rules.Rule("case", "CASE", f"(?<![A-Za-z0-9_]){_TICKET}(?![0-9])")
    found = spread(documents(spark, d).select("doc_id", "text")).select("doc_id", F.inline(rules.rule_spans(F.col("text"), (rule,))))
    return found.select("doc_id", F.col("start").cast("long").alias("span_start"), "label", F.col("text").alias("value"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Codes all sessions of the documents; the coded text, the codes in it and how many."""
    return obfuscate_sessions(spark, d)
