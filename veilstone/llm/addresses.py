"""Address records that denote one location, however they are written.

Each record is read into its house number, the digits that belong to the location, the words of its street and its
town; floors, units and rooms are left out. Then numbers first: records are blocked on their sorted digit tokens, their
town and one rare word of the street, equal or misspelt; the street words of the two are intersected, and a pair is
accepted by the rarity-weighted share of the words in common and the edit distance of those that are left. Locations
are classes: what is linked through others is linked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstone.llm.names import Writing, bare, fold, lcs, writing
from veilstone.runtime import cut, fixed_table

#: Share of the rarity of all street words that must be in common or within :data:`EDITS` of a word of the other side.
OVERLAP = 0.8
#: Edits (insertions, deletions, replacements) by which words of 6 letters or more may differ; shorter ones by half.
EDITS = 2

# Kinds of street and how they are written.
KINDS = {
    "en": "street st str|avenue ave av|boulevard blvd boul|road rd|drive dr|lane ln|court ct|terrace ter terr|parkway pkwy pky|place pl|square sq|highway hwy|circle cir|way wy|trail trl",
    "fr": "rue r|avenue av ave|boulevard bd boul blvd|chemin ch|place pl|impasse imp|allee all|quai|cours|route rte",
    "es": "calle c cl|avenida av avda|paseo po p pso pseo|plaza pl pza|camino cno|carretera ctra|travesia trav|ronda rda",
    "de": "",
}
# Compass points, articles and number words, and abbreviations in names of towns.
POINTS = {"n": "n", "north": "n", "s": "s", "south": "s", "e": "e", "east": "e", "w": "w", "west": "w", "ne": "ne", "nw": "nw", "se": "se", "sw": "sw"}
FILLERS = frozenset("de la las los el del des du d l le les aux au a the of nr no num numero number hausnummer n".split())
TOWN_SHORT = {"st": "saint", "ste": "sainte", "sta": "santa", "sto": "santo", "ft": "fort", "mt": "mount", "n": "north", "s": "south", "e": "east", "w": "west", "pt": "port", "pte": "puente", "jct": "junction", "lk": "lake"}
# Parts of an address inside the building.
UNITS = re.compile(
    r"#\s*[a-z0-9]+|\b(?:apt|apartment|suite|ste|unit|appt|appartement|bat|batiment|piso|puerta|pta|escalera|esc|wohnung|whg|room|rm|floor|fl|etage|planta)\b\.?\s*(?:no\.?\s*|#\s*)?\d+\s?[a-z]?\b"
    r"|\b\d+\s?[ao]\.?\s*(?:planta|piso)\b|\b\d+(?:\.|er|e|eme|re|st|nd|rd|th)?\s*(?:og|stock|etage|obergeschoss|floor)\b|\b(?:eg|erdgeschoss|rdc)\b|\b\d+o\.?\s+(?:[a-z]\b|izq\b|dcha\b)"
)
# Ordinal numbers that name streets.
ORDINALS = {x: str(i) for i, x in enumerate("first second third fourth fifth sixth seventh eighth ninth tenth".split(), 1)}

_DIGITS = dict(zip("零〇一二三四五六七八九", (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9)))
_NUMBER = "[0-9零〇一二两三四五六七八九十百千]+"
# in simplified characters; the first character of a street may be one that ends a town or district
_CHINESE = re.compile(
    rf"^(?:\d{{3,6}}-?)?(?P<city>[^市县区\d]{{2,3}}[市县])?(?P<district>[^区路街\d]{{2,3}}区)?(?P<street>[市县区]?[^\d段巷弄号市县区]{{1,6}}?(?:大道|路|街))"
    rf"(?:(?P<section>{_NUMBER})段)?(?:(?P<lane>{_NUMBER})巷)?(?:(?P<alley>{_NUMBER})弄)?(?P<house>{_NUMBER})(?:[之-](?P<sub>{_NUMBER}))?号(?:之(?P<sub2>{_NUMBER})(?![楼fF]))?"
)

#: Parts that a record may lack.
PARTS = ("kind", "point", "district", "town")
_OWN = ["num", "dig", "style", "kind", "point", "district", "town", "words"]
FORM = "num string, dig string, style string, kind string, point string, district string, town string, words array<string>"


@dataclass(frozen=True)
class Gazetteer:
    """The towns of a table of fixed size, as addresses are read against them, and the tables by which text is read."""

    writing: Writing
    by_code: dict[str, tuple[str, str]] = field(default_factory=dict)  # postcode: (style, town)
    towns: dict[str, str] = field(default_factory=dict)  # folded name: style
    districts: dict[str, str] = field(default_factory=dict)  # Chinese district: city
    regions: dict[str, list[list[str]]] = field(default_factory=dict)  # first word: words of the regions that begin with it
    by_word: dict[str, list[str]] = field(default_factory=dict)  # last word of a town, whole and less a letter: towns


def gazetteer(places: DataFrame) -> Gazetteer:
    """Reads ``places(address_style, city, district, region_name, region_code, postcode)``; a table of fixed size."""
    g = Gazetteer(writing(places.sparkSession))
    look, regions = g.writing.looks.skeleton, set()
    for r in fixed_table(places.distinct()):
        style, city = r["address_style"], r["city"]
        if not city or not style:
            continue
        if style == "zh":
            city = _chinese(city, g)
            if r["district"]:
                g.districts[_chinese(r["district"], g)] = city
        else:
            city = " ".join(re.split(r"[\s\-]+", bare(look(city))))
            g.towns[city] = style
            if r["postcode"]:
                g.by_code[r["postcode"]] = (style, city)
        regions |= {bare(look(x)) for x in (r["region_name"], r["region_code"]) if x}
    for region in sorted(regions):
        g.regions.setdefault(region.split()[0], []).append(region.split())
    for town in sorted(g.towns):
        for key in _town_keys(town.split()[-1]):
            g.by_word.setdefault(key, []).append(town)
    return g


def _town_keys(word: str) -> set[str]:
    """A word and what is left of it without a letter: words that are a slip apart have one of these in common."""
    word = fold(word)
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


def _chinese(text: str, g: Gazetteer) -> str:
    return g.writing.han.plain(re.sub(r"[\s,、]", "", text)).replace("巿", "市")


def chinese_number(text: str) -> int:
    """The value of Arabic or Chinese numerals, positional (一五五) or with units (一百五十五)."""
    if text.isdigit() and text.isascii():
        return int(text)
    text = text.replace("两", "二").replace("兩", "二")
    if not re.search("[十百千]", text):
        return int("".join(c if c.isascii() else str(_DIGITS[c]) for c in text))
    total = digit = 0
    for c in text:
        if c in "十百千":
            total += (digit or 1) * {"十": 10, "百": 100, "千": 1000}[c]
            digit = 0
        else:
            digit = int(c) if c.isascii() else _DIGITS[c]
    return total + digit


def _parse_chinese(text: str, g: Gazetteer) -> dict | None:
    m = _CHINESE.match(_chinese(text, g))
    if not m:
        return None
    v = {k: chinese_number(x) for k in ("section", "lane", "alley", "house", "sub", "sub2") if (x := m[k])}
    num = "/".join(str(v.get(k, "")) for k in ("section", "lane", "alley", "house")) + "-" + str(v.get("sub", v.get("sub2", "")))
    district = m["district"] or ""
    town = m["city"] or g.districts.get(district, "")
    return {"num": num, "dig": " ".join(sorted(map(str, v.values()))), "style": "zh", "kind": "", "point": "", "district": district, "town": town, "words": [m["street"]]}


def _near(a: str, b: str) -> bool:
    a, b = fold(a), fold(b)
    longer = max(len(a), len(b))
    return a == b or (longer >= 5 and abs(len(a) - len(b)) <= 1 and (a[:2] == b[:2] or a[-2:] == b[-2:]) and lcs(a, b) >= longer - 1)


def _find_town(toks: list[str], town: str, near: bool) -> tuple[int, int] | None:
    want = town.split()
    for i in range(len(toks) - len(want), -1, -1):
        got = toks[i : i + len(want)]
        if all(x == y or TOWN_SHORT.get(x) == y or fold(x) == fold(y) or (near and _near(x, y)) for x, y in zip(got, want)):
            return i, i + len(want)
    return None


def _towns_in(toks: list[str], g: Gazetteer) -> set[str]:
    """Towns whose last word stands in the text, whole, shortened or with a slip."""
    keys = {k for t in toks for x in (t, TOWN_SHORT.get(t, "")) if x for k in _town_keys(x)}
    return {town for k in keys for town in g.by_word.get(k, ())}


def parse(text: str, g: Gazetteer) -> dict | None:
    """What identifies the location of one address; null if the text isn't the address of a building.

    An address has a house number, at least one word or number of a street, and a kind of street, a town or a
    postcode. Where neither town nor postcode is known, the street of an English address follows its number. A range of
    numbers is one of its own; numbered streets are told apart by their digits.
    """
    plain = g.writing.looks.skeleton(text)
    if re.search("[號号]", plain):
        return _parse_chinese(plain, g)
    plain = bare(plain).replace("№", "no ").replace("c/", "calle ").replace("p.o ", "paseo ")
    plain = re.sub(r"(?<=[a-z])\.(?=[a-z]\b)", "", plain)
    plain = re.sub(r"\b(\d{5})-\d{4}\b", r"\1", re.sub(r"\bd-(?=\d{5}\b)", "", plain))
    plain = UNITS.sub(" , ", plain)
    ordinals = re.findall(r"\b(\d{1,3})(?:st|nd|rd|th)\b", plain)
    plain = re.sub(r"\b\d{1,3}(?:st|nd|rd|th)\b", " nth ", plain)
    fives = re.findall(r"(?<![\d\w])\d{5}(?!\d)", plain)
    codes = [c for c in fives if c in g.by_code]
    if not codes and fives and re.search(r"(?<![\w.:/])(?!\d{5}(?!\d))\d{1,6}[a-z]?(?![\w.:/]*\d)", plain):
        codes = fives  # another number is the house's
    elif not codes and fives:
        codes = fives[1:] if re.match(r"\W*\d{5}(?!\d)", plain) else fives  # a leading one is the house's
    style, town = next((g.by_code[c] for c in codes if c in g.by_code), ("", ""))
    for c in codes:
        plain = re.sub(rf"(?<!\d){c}(?!\d)(?!.*(?<!\d){c}(?!\d))" if fives.count(c) > codes.count(c) else rf"(?<!\d){c}(?!\d)", " , ", plain)
    house = re.search(r"(?<![\w.:/])(\d{1,6})(?:\s?(bis|ter|quater|[a-z])(?![\w.]))?(?![\w:./]*\d)", plain)
    if not house:
        return None
    number, after = house[1], plain[house.start(2) if house[2] else house.end() :]
    if (upto := re.match(r"\s?-\s?(\d{1,6})(?!\d)", after)) and int(upto[1]) > int(number):
        number, after = f"{number}-{upto[1]}", after[upto.end() :]
    before = re.findall(r"[^\W\d_]+", plain[: house.start()])
    toks = before + re.findall(r"[^\W\d_]+", after)
    if not toks:
        return None
    toks_all, spot, ahead = toks, None, len(before)
    if town:
        spot = _find_town(toks, town, False) or _find_town(toks, town, True)
    else:
        around = _towns_in(toks, g)
        for near in (False, True):
            hits = [(b - a, name, (a, b)) for name in around if (at := _find_town(toks, name, near)) for a, b in [at]]
            if hits:
                _, town, spot = max(hits)
                style = g.towns[town]
                break
    if spot:
        toks = toks[: spot[0]] + toks[spot[1] :]
        ahead -= max(0, min(spot[1], ahead) - spot[0])
    i = 0
    while i < len(toks):
        for part in g.regions.get(toks[i], ()):
            if toks[i : i + len(part)] == part and (part != ["el"] or style in ("", "en")):
                style = style or "en"
                toks = toks[:i] + toks[i + len(part) :]
                ahead -= len(part) if i < ahead else 0
                break
        else:
            i += 1
    if not style:
        style = "es" if set(toks) & {"calle", "cl", "avenida", "avda", "paseo", "pso"} else "de" if any(re.search("(strasse|str|weg|gasse|allee|platz)$", t) and len(t) > 6 for t in toks) else "fr" if set(toks) & {"rue", "bd"} or set(toks_all) & {"du", "des", "aux"} else "en"
    if style == "en" and not town and not codes:
        toks = toks[max(0, ahead) :]
    letter = house[2] or ""
    if style == "en" and letter and (letter in POINTS or house[0][-len(letter) - 1].isspace()):
        letter = ""  # a compass point or a word of the street
    elif letter:
        toks = toks.copy()
        for i, t in enumerate(toks):
            if t == letter:
                del toks[i]
                break
    kinds = {x: names.split()[0] for names in KINDS[style].split("|") if names for x in names.split()}
    kind = point = ""
    words = []
    for i, t in enumerate(toks):
        if style == "de":
            if t in ("strasse", "str") and words:
                words[-1] += "strasse"
            elif len(t) > 2 and t not in FILLERS:
                words.append(re.sub("(strasse|str)$", "strasse", t))
        elif t in kinds and not kind:
            kind = kinds[t]
        elif style == "en" and t in POINTS and not point:
            point = POINTS[t]
        elif style == "en" and t in ORDINALS and i + 1 < len(toks) and toks[i + 1] in kinds:
            ordinals.append(ORDINALS[t])
            words.append("nth")
        elif t not in FILLERS and len(t) > 1:
            words.append(t)
    long = max(map(len, words), default=0) >= 4
    if not words or not (kind if not long else town or kind or codes):
        return None
    digits = sorted([number, *ordinals])
    return {"num": number + letter + "".join("/" + x for x in ordinals), "dig": " ".join(digits), "style": style, "kind": kind, "point": point, "district": "", "town": town, "words": sorted(set(map(fold, words)))}


def _forms(g: Gazetteer):
    names = [x.split()[0] for x in FORM.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, dict | None] = {}
        for b in batches:
            got = []
            for t in b.column("text").to_pylist():
                if t not in memo:
                    if len(memo) > 200_000:
                        memo.clear()
                    memo[t] = parse(t, g)
                got.append(memo[t])
            keep = pa.array([i for i, p in enumerate(got) if p], pa.int32())
            rows = [p for p in got if p]
            cols = [b.column("id").take(keep)] + [pa.array([p[n] for p in rows], pa.list_(pa.string()) if n == "words" else pa.string()) for n in names]
            yield pa.RecordBatch.from_arrays(cols, ["id", *names])

    return run


def read_addresses(records: DataFrame, g: Gazetteer) -> DataFrame:
    """``(id, num, dig, style, kind, point, district, town, words)`` of the records that are addresses.

    ``records`` has ``id, text``; null ids and texts, bare place names and other texts are left out. Ids delivered again
    count once.
    """
    shape = F.col("text").rlike(r"\p{Nd}|[號号]") & F.col("text").rlike(r"\p{L}{2,}|[路街道]") & ~F.col("text").rlike(r"@|://|\p{Nd}年") & (F.length("text") >= 5)
    src = records.where(F.col("id").isNotNull() & shape).select(F.col("id").cast("long").alias("id"), "text").dropDuplicates(["id"])
    return src.mapInArrow(_forms(g), "id long, " + FORM)


def _agree(column: str) -> F.Column:
    a, b = F.col(f"a.{column}"), F.col(f"b.{column}")
    return (a == b) | (a == "") | (b == "")


def _allowed(word: F.Column, edits: int) -> F.Column:
    """Edits by which a street word may differ from one of the other side."""
    return F.when(F.length(word) >= 6, F.lit(edits)).otherwise(F.when(F.length(word) >= 4, F.lit(edits // 2)).otherwise(F.lit(0)))


def _words_fit(edits: int, overlap: float) -> F.Column:
    """Rarity-weighted share of street words that are in common or nearly so, on the side where it is less."""

    def share(own: str, other: str) -> F.Column:
        w, o = F.col(f"{own}.weighted"), F.col(f"{other}.words")
        rest = F.array_except(o, F.array_intersect(F.col("a.words"), F.col("b.words")))
        good = F.filter(w, lambda x: F.array_contains(o, x["word"]) | F.exists(rest, lambda y: F.levenshtein(x["word"], y) <= _allowed(x["word"], edits)))
        total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x["weight"])
        return total(good) / total(w)

    return F.least(share("a", "b"), share("b", "a")) >= overlap


def link_forms(forms: DataFrame, edits: int = EDITS, overlap: float = OVERLAP) -> DataFrame:
    """``(fa, fb)`` with ``fa < fb``: distinct forms that are compared and fit.

    ``forms`` has ``f`` (its number) and the columns of :data:`FORM`. Where a form lacks the kind of
    street, the compass point, the district or the town, and the forms that fit it differ in that, it
    stays apart from all that bear it.
    """
    words = forms.select("f", F.explode("words").alias("word"))
    df = words.groupBy("word").agg(F.count("*").alias("df"))
    weighted = words.join(df, "word").withColumn("weight", 1.0 / (1.0 + F.log1p("df"))).groupBy("f").agg(F.collect_list(F.struct("word", "weight")).alias("weighted"))
    rich = cut(forms.join(weighted, "f")).select("f", F.struct(*PARTS, "words", "weighted").alias("x"))
    pairs = cut(_blocks(forms, edits))
    pairs = pairs.join(rich.select(F.col("f").alias("fa"), F.col("x").alias("a")), "fa").join(rich.select(F.col("f").alias("fb"), F.col("x").alias("b")), "fb")
    fits = _agree("kind") & _agree("point") & _agree("district") & _agree("town")
    links = pairs.where(fits & _words_fit(edits, overlap)).select("fa", "fb", *[F.struct(F.col(f"a.{c}").alias("a"), F.col(f"b.{c}").alias("b")).alias(c) for c in PARTS])
    links = cut(links)
    missing = [F.struct(F.col(mine).alias("f"), F.when(F.col(f"{c}.{side}") == "", F.lit(c)).alias("what"), F.col(f"{c}.{other}").alias("value")) for mine, side, other in (("fa", "a", "b"), ("fb", "b", "a")) for c in PARTS]
    filled = links.select(F.inline(F.array(*missing))).where("what is not null and value <> ''")
    unclear = filled.groupBy("f", "what").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo <> hi").groupBy("f").agg(F.collect_set("what").alias("unclear"))
    for mine, side, other in (("fa", "a", "b"), ("fb", "b", "a")):
        hit = F.array(*[F.when((F.col(f"{c}.{side}") == "") & (F.col(f"{c}.{other}") != ""), F.lit(c)) for c in PARTS])
        links = links.join(unclear.withColumnRenamed("f", mine), mine, "left").where(F.col("unclear").isNull() | ~F.arrays_overlap("unclear", F.filter(hit, lambda x: x.isNotNull()))).drop("unclear")
    return links.select("fa", "fb")


def classes(links: DataFrame) -> DataFrame:
    """``(f, place)`` of the linked forms: each form takes the least number that it reaches, over links of links.

    Rounds double the distance (a form also takes the label of its label), so few are needed, and each is a join of
    numbers only.
    """
    ways = cut(links.select(F.inline(F.array(F.struct(F.col("fa").alias("f"), F.col("fb").alias("o")), F.struct(F.col("fb").alias("f"), F.col("fa").alias("o"))))))
    labels = cut(ways.groupBy("f").agg(F.least(F.min("o"), F.first("f")).alias("place")))
    while True:
        near = ways.join(labels.select(F.col("f").alias("o"), "place"), "o").groupBy("f").agg(F.min("place").alias("near"))
        step = labels.join(near, "f").select("f", "place", F.least("place", "near").alias("low"))
        jump = step.join(labels.select(F.col("f").alias("low"), F.col("place").alias("lower")), "low", "left")
        after = cut(jump.select("f", F.least("low", F.coalesce("lower", "low")).alias("new"), "place"))
        labels = after.select("f", F.col("new").alias("place"))
        if not after.where("new <> place").take(1):
            return labels


def _shortened(word: F.Column, edits: int) -> F.Column:
    """``word`` and all that is left of it after deletions, as many as any word that fits it may call for.

    Two words of which one allows ``edits`` to the other have one of these in common.
    """
    n = F.length(word)
    depth = F.when(n >= 6, F.lit(edits)).otherwise(F.greatest(F.lit(0), F.lit(edits // 2) - F.greatest(F.lit(0), 4 - n), n + (edits - 6)))
    without = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(w.substr(F.lit(1), i - 1), w.substr(i + 1, F.length(w))))
    level = out = F.array(word)
    for k in range(1, edits + 1):
        level = F.when(depth >= k, F.array_distinct(F.flatten(F.transform(F.filter(level, lambda w: F.length(w) > 0), without)))).otherwise(F.array().cast("array<string>"))
        out = F.concat(out, level)
    return F.array_distinct(out)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of the words ``w`` that follow each other under one ``key``, of rows sorted by it."""
    keys, words = np.empty(0, np.int64), np.empty(0, np.int64)
    for b in batches:
        key, w = (b.column(i).to_numpy() for i in (0, 1))
        old = len(keys)  # rows of the last key so far, paired already
        keys, words = np.concatenate([keys, key]), np.concatenate([words, w])
        step, at = 1, np.arange(len(keys))
        while len(at := at[at + step < len(keys)]) and len(at := at[keys[at] == keys[at + step]]):
            if len(fresh := at[at + step >= old]):
                for i in range(0, len(fresh), 10_000):
                    x, y = words[fresh[i : i + 10_000]], words[fresh[i : i + 10_000] + step]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["w", "o"])
            step += 1
        if len(keys):
            last = np.searchsorted(keys, keys[-1])
            keys, words = keys[last:], words[last:]


def _slips(words: DataFrame, edits: int) -> DataFrame:
    """``(dig, num, style, word, other)``, both ways: different words of a number that are within the edits allowed.

    They are found by what is left of them after deletions. Of that only 64-bit hashes are shuffled, with numbers for the
    words; the words decide.
    """
    on = ["dig", "num", "style"]
    words = cut(words.select(*on, "word").distinct().withColumn("w", F.monotonically_increasing_id()))
    rests = words.select(*on, "w", F.explode(_shortened(F.col("word"), edits)).alias("rest"))
    keys = rests.select(F.xxhash64(*on, "rest").alias("key"), "w").repartition("key").sortWithinPartitions("key")
    met = cut(keys.mapInArrow(_runs, "w long, o long").distinct())
    other = words.select(F.col("w").alias("o"), F.col("word").alias("other"), F.struct(*on).alias("there"))
    fit = F.levenshtein("word", "other") <= F.greatest(_allowed(F.col("word"), edits), _allowed(F.col("other"), edits))
    near = met.join(words, "w").join(other, "o").where((F.struct(*on) == F.col("there")) & (F.col("word") != F.col("other")) & fit)
    return near.select(*on, F.inline(F.array(F.struct("word", "other"), F.struct(F.col("other").alias("word"), F.col("word").alias("other")))))


def _blocks(forms: DataFrame, edits: int) -> DataFrame:
    """``(fa, fb)``: pairs of forms with the same digits, towns that agree, and a street word that is equal or nearly so.

    Of the words of any pair that fits, two are equal or within the edits allowed. A form with a town meets those of its
    town and those without; so neither a frequent number in many towns nor a town with many streets makes a block of all
    pairs. One join has it all: a form looks with its words and those near them, in its town and among those without;
    it is found by its own words in its own town. Only numbers of forms are paired.
    """
    on = ["dig", "num", "style"]
    side = cut(forms.select("f", *on, "town", F.explode("words").alias("word")))
    near = side.join(cut(_slips(side, edits)), [*on, "word"]).drop("word").withColumnRenamed("other", "word")
    looks = side.unionByName(near).withColumn("at", F.explode(F.array_distinct(F.array("town", F.lit("")))))
    found = side.select(*on, F.col("town").alias("at"), "word", F.col("f").alias("o"))
    once = (F.col("town") != F.col("at")) | (F.col("f") < F.col("o"))  # from within a town, or without one, both look
    return looks.join(found, [*on, "at", "word"]).where(once).select(F.least("f", "o").alias("fa"), F.greatest("f", "o").alias("fb")).distinct()


def same_place(records: DataFrame, g: Gazetteer, edits: int = EDITS, overlap: float = OVERLAP) -> DataFrame:
    """``(id_a, id_b)``: records that are addresses of one location, the smaller id first.

    Ids delivered again count once. Records of the same form are linked without comparison; locations are the
    classes of linked forms, and each class is expanded to its pairs of records once.
    """
    read = cut(read_addresses(records, g))
    forms = read.groupBy(*_OWN).agg(F.min("id").alias("f"))
    forms = cut(forms)
    labels = classes(link_forms(forms, edits, overlap))
    place = read.select(*_OWN, "id").join(forms, _OWN).select("id", "f").join(labels, "f", "left").select("id", F.coalesce("place", "f").alias("place"))
    place = cut(place)
    return place.withColumnRenamed("id", "id_a").join(place.withColumnRenamed("id", "id_b"), "place").where("id_a < id_b").select("id_a", "id_b")
