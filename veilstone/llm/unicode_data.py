"""Public character data, read once on the driver from the ICU library that Spark ships.

Workers get it as plain tables of a fixed size, whatever the data: look-alike letters, pronunciations of
Chinese characters, simplified forms.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from dataclasses import dataclass

from pyspark.sql import SparkSession

# Hyphens, dashes of hyphen width and minus signs that stand for "-".
HYPHENS = "˗֊۔‐‑‒–⁃−➖Ⲻ﹘"
# Invisible characters outside the category Cf (fillers, joiners, variation selectors).
UNSEEN = "͏ᅟᅠ឴឵ㅤﾠ" + "".join(map(chr, (*range(0x180B, 0x180F), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0))))
# Prototype, then letters for which a letter of the same case is to be preferred to that of the public table.
SAME_CASE = "l ӏ|y γ|o σ|Y У|F Ϝ|G Ꮐ|n ո|j յ|L Լ|Q Ԛ"

#: Characters of Chinese and Japanese writing.
_EAST = re.compile("[⺀-⿟々-〇぀-ヿㄅ-ㄯ㇀-ㇿ㐀-鿿豈-﫿]")
#: Characters beyond the basic plane: rare, and a class that holds them isn't compiled to a bitmap.
_HIGH = re.compile("[\U00010000-\U0010ffff]")


@dataclass(frozen=True)
class Looks:
    """What each character becomes in a skeleton; hashed and pickled as its table."""

    table: tuple[tuple[str, str], ...]

    @functools.cached_property
    def replaced(self) -> dict[str, str]:
        return dict(self.table)

    @functools.cached_property
    def _low(self) -> re.Pattern:
        """The characters of the basic plane that are replaced or removed."""
        return re.compile("[" + re.escape("".join(c for c, _ in self.table if c <= "\uffff")) + "]")

    def __reduce__(self):
        return Looks, (self.table,)

    def skeleton(self, text: str | None) -> str | None:
        """Compatibility decomposition, replacement by prototypes, decomposition again; null stays null."""
        if text is None or text.isascii():
            return text
        table = self.replaced
        plain = self._low.sub(lambda m: table[m[0]], unicodedata.normalize("NFKD", text))
        return unicodedata.normalize("NFKD", _HIGH.sub(lambda m: table.get(m[0], m[0]), plain))


def _by_icu(spark: SparkSession, chars: list[str]) -> dict[str, str]:
    """The prototype of each character in the public table of confusables."""
    check = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    return dict(zip(chars, check.getSkeleton("\n".join(chars)).split("\n")))


def _prototype(char: str, found: str) -> str:
    """The prototype of a letter without what the public table folds but the eye tells apart: I, l and 1, O and 0, m and rn."""
    upper = unicodedata.category(char) == "Lu"
    found = found.replace("rn", "m").replace("''", '"')
    if found == "l":
        return "I" if upper else "l"
    return found


@functools.cache
def _tables() -> dict:
    return {}


def looks(spark: SparkSession, east: bool = True) -> Looks:
    """The look-alike letters; ``east`` includes those between Chinese characters and kana.

    Digits, case, accents and punctuation stay as they are; so do Chinese characters that resemble each other.
    """
    held = _tables()
    if ("looks", east) not in held:
        letters = [c for c in map(chr, range(0x80, 0x20000)) if unicodedata.category(c)[0] == "L" and not 0xAC00 <= ord(c) <= 0xD7A3 and unicodedata.normalize("NFKD", c) == c]
        table: dict[str, str] = {}
        found = _by_icu(spark, letters)
        is_han = lambda c: unicodedata.name(c, "").startswith("CJK UNIFIED")
        han_of = {s: c for c, s in found.items() if is_han(c)}
        han_of |= {s: s for s in han_of if is_han(s)}
        for c, s in found.items():
            to = _prototype(c, unicodedata.normalize("NFKD", s))
            if _EAST.search(c):
                to = han_of.get(s, c) if east and not is_han(c) and len(s) == 1 else c
            elif any(_EAST.search(x) or unicodedata.category(x)[0] == "N" for x in to):
                continue
            if to != c:
                table[c] = to
        table |= {c: x.split()[0] for x in SAME_CASE.split("|") for c in x.split()[1]}
        for c in table:  # a prototype may itself be replaced
            seen = {c}
            while (n := "".join(table.get(x, x) for x in table[c])) != table[c] and n not in seen:
                seen.add(n)
                table[c] = n
        table |= dict.fromkeys(HYPHENS, "-") | dict.fromkeys(UNSEEN, "") | {"\u2044": "/", "\u2215": "/", "\u1680": " "}
        table |= {c: "" for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) == "Cf"}
        table.pop(" ", None)
        held["looks", east] = Looks(tuple(sorted(table.items())))
    return held["looks", east]


@dataclass(frozen=True)
class Han:
    """Chinese characters: their simplified forms and their pronunciation with its tone."""

    simple: dict[str, str]
    sound: dict[str, str]

    def plain(self, text: str) -> str:
        """``text`` in simplified characters."""
        return "".join(self.simple.get(c, c) for c in text)


def han(spark: SparkSession) -> Han:
    """The characters of the basic plane, by the public transliteration tables."""
    held = _tables()
    if "han" not in held:
        get = spark._jvm.com.ibm.icu.text.Transliterator.getInstance
        chars = [chr(c) for c in range(0x3400, 0xA000)]
        block = "\n".join(chars)
        simple = dict(zip(chars, get("Traditional-Simplified").transliterate(block).split("\n")))
        sound = dict(zip(chars, get("Han-Latin").transliterate(block).split("\n")))
        held["han"] = Han({c: s for c, s in simple.items() if c != s and len(s) == 1}, {c: s for c, s in sound.items() if c != s})
    return held["han"]
