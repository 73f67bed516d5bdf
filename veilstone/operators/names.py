"""Names by lists and position: given names in Chinese text, names after titles, speakers of chat logs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilstone.functions import text as T
from veilstone.functions.matching import matches
from veilstone.operators.rules import spans_of

PERSON = "PERSON"
#: Given names that the detector knows if no list is given; a list from a table or a file is the usual case.
SEED_NAMES = tuple(
    "Alice Amy Andrew Anna Annie Anthony Benson Betty Brian Carol Charles Chris Cindy Daisy Daniel David Emily Emma Eric Eva Frank Grace Harry Helen Henry Ivy Jack James Jane Jason Jenny Jerry Jessica "
    "Jim John Joyce Judy Julia Karen Kate Kelly Kevin Laura Leo Linda Lisa Lucy Mark Mary Michael Mike Nancy Nick Olivia Oscar Patricia Paul Peter Rachel Richard Robert Ryan Sam Sandy Sarah Simon Sophia "
    "Stephen Steven Susan Thomas Tim Tina Tom Tony Victor Vincent Vivian Wendy William Zoe".split()
)
# Capitalised words, how many may follow a given name, titles, speaker labels at the start of a line.
WORD = "[A-Z][a-z]+(?:[-'’][A-Z]?[a-z]+(?<![-'’]s))*"
WORDS = f"(?<![A-Za-z0-9_]){WORD}(?: {WORD})*(?![A-Za-z0-9_])"
MAX_SURNAMES = 2
TITLED = f"(?<![A-Za-z])(?:Mr|Mrs|Ms|Miss|Dr|Prof)\\.? ?({WORD}(?: {WORD})?)(?![A-Za-z0-9_])"
SPEAKER = "(?Udm)^[ \\t]*(?:\\[?\\d{1,2}:\\d{2}(?::\\d{2})?\\]?[ \\t]+)?([\\x{3400}-\\x{9FFF}]{2,4}|[A-Z][a-z]+(?: [A-Z][a-z]+){0,2})(?=[ \\t]*[:：]|\\t)"
#: Order of the detectors in ties, after the rules.
PRIO_NAMES, PRIO_TITLES = 40, 41


def _cjk_lines(text: Column) -> Column:
    return F.filter(matches(text, "[^\\n]+"), lambda line: T.has_cjk(line["text"]))


def given_name_matches(text: Column, names: Iterable[str] = SEED_NAMES) -> Column:
    """In lines with Chinese: the first listed name of each run of capitalised words, with up to two words after it."""
    listed = sorted(set(names))

    def run(line: Column, m: Column) -> Column:
        words = F.split(m["text"], " ")
        first = F.array_position(F.transform(words, lambda w: w.isin(*listed) if listed else F.lit(False)), True).cast("int")
        before = F.array_join(F.slice(words, 1, first - 1), " ")
        start = line["start"] + m["start"] + F.length(before) + F.when(first > 1, 1).otherwise(0)
        value = F.array_join(F.slice(words, first, F.lit(1 + MAX_SURNAMES)), " ")
        return F.when(first > 0, F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("text")))

    found = F.flatten(F.transform(_cjk_lines(text), lambda line: F.transform(matches(line["text"], WORDS), lambda m: run(line, m))))
    return F.filter(found, lambda x: x.isNotNull())


def titled_matches(text: Column) -> Column:
    """In lines with Chinese: the one or two capitalised words after a title."""
    shift = lambda line: lambda m: F.struct((m["start"] + line["start"]).alias("start"), (m["end"] + line["start"]).alias("end"), m["text"].alias("text"))
    return F.flatten(F.transform(_cjk_lines(text), lambda line: F.transform(matches(line["text"], TITLED, 1), shift(line))))


def name_spans(text: Column, names: Iterable[str] = SEED_NAMES) -> Column:
    """Given names and names after titles as spans; only texts with Chinese are read."""
    both = F.concat(spans_of(given_name_matches(text, names), PERSON, PRIO_NAMES), spans_of(titled_matches(text), PERSON, PRIO_TITLES))
    return F.when(text.isNull(), None).when(T.has_cjk(text), both).otherwise(F.array().cast("array<struct<start:int,end:int,label:string,text:string,score:double,prio:int>>"))


def speaker_labels(text: Column) -> Column:
    """``ARRAY<STRUCT<start, end, text, likely>>``: labels at the start of a line, and whether each looks like a name."""
    return F.transform(matches(text, SPEAKER, 1), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), T.looks_like_name(m["text"]).alias("likely")))


def speaker_matches(text: Column, persons: Column) -> Column:
    """The speakers of a chat log, if at least one label is among ``persons`` (an array of names); else none."""
    labels = speaker_labels(text)
    kept = F.filter(labels, lambda m: F.array_contains(persons, m["text"]) | m["likely"])
    return F.when(F.exists(labels, lambda m: F.array_contains(persons, m["text"])), kept).otherwise(F.filter(labels, lambda m: F.lit(False)))
