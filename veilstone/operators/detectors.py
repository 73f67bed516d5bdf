"""Model detectors as plug-ins: routing by language, application by line or with scripts spaced, and cutting of their spans.

A detector is a function from a text to ``[(start, end, label, score)]``, made by a factory that runs once per Python
worker, so that a model is loaded where and when it is first used.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstone.functions.text import CJK_RUN, has_cjk, languages_in
from veilstone.operators.rules import SPANS

Found = list[tuple[int, int, str, float]]
Factory = Callable[[], Callable[[str], Found]]

_JOIN = re.compile("(?<=[　-〿㐀-鿿豈-﫿＀-￯])(?=[A-Za-z])|(?<=[A-Za-z])(?=[　-〿㐀-鿿豈-﫿＀-￯])")


@dataclass
class Registry:
    """``pii`` reads every text; ``models`` has a detector by language, and ``mixed`` for Latin names in Chinese text."""

    pii: Factory | None = None
    models: dict[str, Factory] = field(default_factory=dict)

    def register(self, slot: str, factory: Factory) -> None:
        """Puts a factory into the slot ``pii``, ``mixed`` or a language."""
        if slot == "pii":
            self.pii = factory
        else:
            self.models[slot] = factory


def by_line(detect: Callable[[str], Found], text: str) -> Found:
    """What is found in each line that isn't blank, with offsets in the text."""
    return [(s + m.start(), e + m.start(), label, score) for m in re.finditer("[^\n]+", text) if m[0].strip() for s, e, label, score in detect(m[0])]


def with_spaced_scripts(detect: Callable[[str], Found], text: str) -> Found:
    """What is found in the text with a space where scripts touch, with offsets in the text itself."""
    cuts = [m.start() for m in _JOIN.finditer(text)]
    if not cuts:
        return detect(text)
    spaced = "".join(text[a:b] + " " for a, b in zip([0, *cuts], cuts)) + text[cuts[-1] :]
    places = [c + k for k, c in enumerate(cuts)]  # of the inserted spaces

    def back(at: int) -> int:
        return at - bisect.bisect_left(places, at)

    return [(back(s), back(e), label, score) for s, e, label, score in detect(spaced)]


def _spans_udf(factory: Factory, how: str, prio: int) -> Callable[[Column], Column]:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        detect = factory()
        apply = {"plain": lambda t: detect(t), "line": lambda t: by_line(detect, t), "spaced": lambda t: with_spaced_scripts(detect, t)}[how]

        def one(t):
            if t is None:
                return None
            return [{"start": s, "end": e, "label": label, "text": t[s:e], "score": float(score), "prio": prio} for s, e, label, score in apply(t)] if t.strip() else []

        for s in batches:
            yield s.map(one)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, SPANS)


def detector_spans(text: Column, factory: Factory, how: str = "plain", prio: int = 50) -> Column:
    """A detector's spans; ``how`` is ``plain``, ``line`` or ``spaced``."""
    return _spans_udf(factory, how, prio)(text)


def latin_parts(spans: Column) -> Column:
    """Spans cut at Chinese runs: places with Chinese are dropped; of others the pieces with a digit stay, or with two Latin letters for people."""
    from veilstone.functions.matching import matches

    def pieces(s: Column) -> Column:
        keep = lambda t: F.when(s["label"] == "PERSON", t.rlike("[A-Za-z]{2}")).otherwise(t.rlike("(?U)\\d"))

        def core(m: Column) -> Column:
            lead = F.length(m["text"]) - F.length(F.regexp_replace(m["text"], "^[ \\t:;,.]+", ""))
            value = F.regexp_replace(m["text"], "^[ \\t:;,.]+|[ \\t:;,.]+\\z", "")
            start = s["start"] + m["start"] + lead
            return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), s["label"].alias("label"), value.alias("text"), s["score"].alias("score"), s["prio"].alias("prio"))

        return F.filter(F.transform(matches(s["text"], f"[^{CJK_RUN}]+"), core), lambda x: keep(x["text"]))

    chinese = lambda s: s["text"].rlike(f"[{CJK_RUN}]")
    return F.flatten(F.transform(spans, lambda s: F.when(~chinese(s), F.array(s)).when(s["label"] == "LOC", F.array().cast(SPANS)).otherwise(pieces(s))))


def model_spans(documents: DataFrame, registry: Registry) -> DataFrame:
    """``documents(text[, lang_choice])`` with ``model_cand`` and ``model_used``.

    Without a choice of language the models of every language in the text are used, else that of the choice alone; the
    general detector is always used, the one for mixed text on text with Chinese, for people only. Texts that a detector
    isn't meant for reach it as null, so that it does no work on them.
    """
    text = F.col("text")
    choice = F.col("lang_choice") if "lang_choice" in documents.columns else F.lit(None).cast("string")
    routed = F.when(choice.isin("en", "zh"), F.array(choice)).otherwise(languages_in(text))
    out = documents.withColumn("__langs", routed)
    parts: list[str] = []

    def add(name: str, column: Column, after: Callable[[Column], Column]) -> None:
        nonlocal out
        out = out.withColumn(f"__{name}_raw", column)  # a projection of its own: the function runs once
        out = out.withColumn(f"__{name}", F.coalesce(after(F.col(f"__{name}_raw")), F.array().cast(SPANS)))
        parts.append(f"__{name}")

    if registry.pii:
        add("pii", detector_spans(text, registry.pii, "spaced", 50), latin_parts)
    for k, lang in enumerate(x for x in registry.models if x != "mixed"):
        chinese = (lambda c: F.filter(c, lambda s: s["text"].rlike(f"[{CJK_RUN}]"))) if lang == "zh" else (lambda c: c)
        add(lang, detector_spans(F.when(F.array_contains("__langs", lang), text), registry.models[lang], "line", 60 + k), chinese)
    if "mixed" in registry.models:
        add("mixed", detector_spans(F.when(has_cjk(text), text), registry.models["mixed"], "spaced", 80), lambda c: F.filter(latin_parts(c), lambda s: s["label"] == "PERSON"))
    have = [x for x in registry.models if x != "mixed"]
    used = F.lit(registry.pii is not None) & F.forall("__langs", lambda x: (x == "en") | x.isin(*have) if have else x == "en")
    spans = F.concat(*[F.col(p) for p in parts]) if parts else F.array().cast(SPANS)
    return out.withColumn("model_cand", spans).withColumn("model_used", F.coalesce(used, F.lit(False))).select(*documents.columns, "model_cand", "model_used")
