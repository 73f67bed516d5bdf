"""Linking of the variant spellings of persons and organisations within a session or document.

Suffix blocking: every token of a name is indexed by its suffix of a minimum length (a shorter token as a whole, a Chinese
name by the sound of its last character), always together with the group it stands in; tokens that share a
longer suffix share that one too. A suffix that is common within its group isn't discarded but refined by the
name's other tokens. A surname with initials also meets the full names of its group that have the initial and a letter at
the surname's ends in common. Names that share a block are compared token by token by the ratio of their
longest common subsequence, with initials, nicknames, titles, abbreviations, acronyms, legal forms and romanised
Chinese understood. Simplified forms and pronunciations of all Chinese characters come from public data.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstone.functions.text import COMPOUND_SURNAMES, TITLES
from veilstone.llm.unicode_data import Han, Looks, han, looks
from veilstone.runtime import cut, fixed_table

#: Letters of a suffix key.
SUFFIX = 4
#: Ratio of the longest common subsequence, twice its length over both lengths, from which tokens are close; that of one
#: letter in the longer token is enough.
CLOSE = 0.85
#: Names of one group that may share a suffix before it is refined by the other tokens.
COMMON = 400

# Nicknames and the given names they stand for.
NICKNAMES = """
bob robert|bobby robert|rob robert|bill william|will william|billy william|liz elizabeth|betty elizabeth|beth elizabeth|lizzie elizabeth|lisa elisabeth|meg margaret|peggy margaret|maggie margaret
kate katherine|kathy katherine|kit katherine christopher|kathi katharina|mike michael|mick michael|tom thomas tomas|dick richard|rick richard|rich richard|ed edward|eddie edward|ted edward theodore|ned edward
jim james|jimmy james|jamie james|chuck charles|charlie charles|alex alexander|sandy alexander|andy andrew|drew andrew|tony anthony antonia|ben benjamin|benny benjamin|chris christopher|dan daniel|danny daniel
debbie deborah|deb deborah|dot dorothy|dolly dorothy|ellie eleanor|nell eleanor|fred frederick|freddie frederick|fritz friedrich|greg gregory|hank henry|harry henry|jake jacob|jenny jennifer|jen jennifer
larry lawrence|len leonard|leo leonard|lenny leonard|matt matthew|nate nathaniel|nat nathaniel|nick nicholas|pat patricia|trish patricia|patty patricia|phil philip|becky rebecca|becca rebecca|sam samuel
steve stephen|steph stephane stephen|theo theodore|tess theresa|terry theresa|tim timothy|vicky victoria|vince vincent|ginny virginia|zach zachary|zack zachary|liv olivia|ollie olivia|mimi miriam
pepe jose|paco francisco|nacho ignacio inacio|lola dolores|concha concepcion conceicao|charo rosario|lupe guadalupe|chus jesus|moncho ramon|bego begona|moni monica|basti sebastian|sebas sebastian|wolf wolfgang
uli ulrike|max maximilian|maxi maximilian|heinz heinrich|hans johannes|hannes johannes|jochen joachim|achim joachim|elli elisabeth|sepp joseph|ze joao jose|lu lucia luisa|fredo frederique|fanfan francois|gus augustus
jon jonathan|katie katherine|gabe gabriel|sue susan|don donald|ron ronald|josh joshua|ken kenneth|jeff jeffrey|ray raymond|art arthur|bert albert|dave david|doug douglas|walt walter|cathy catherine|cindy cynthia
sally sarah|abby abigail|angie angela|barb barbara|bernie bernard|carrie caroline|ernie ernest|fran frances|gene eugene|gerry gerald|jerry gerald jerome|gil gilbert|hal harold|izzy isabel|jackie jacqueline
jess jessica|joe joseph|judy judith|lou louis|mandy amanda|marty martin|mitch mitchell|nan nancy|norm norman|pam pamela|pete peter|reg reginald|russ russell|stan stanley|stu stuart|tina christina|val valerie|vic victor
"""  # fmt: skip

# Legal forms, each with the spellings it is written in.
LEGAL = """
ltd limited|inc incorporated|corp corporation|co company|sl sociedad-limitada|sarl|gmbh gesellschaft-mbh gesellschaft-mit-beschraenkter-haftung|llc limited-liability-company|plc|ag aktiengesellschaft|sa sociedad-anonima
srl|kg kommanditgesellschaft|bv|nv|oy|ab|sas|spa|lda limitada|ohg|pty-ltd|llp|gmbh-&-co-kg gmbh-und-co-kg gmbh-co-kg|ag-&-co-kg ag-und-co-kg
"""
# Forms of address and degrees besides those of the core, and parts that tell generations apart.
MORE_TITLES = frozenset("herr frau sra srta mme mlle monsieur madame senor senora senorita dra dott ing hon rev capt".split())
GENERATIONS = {"jr": "jr", "junior": "jr", "sr": "sr", "senior": "sr", "ii": "ii", "iii": "iii", "iv": "iv"}
# Fixed values, in simplified characters: prefixes of familiar names, ends of place names, inner parts of addresses.
FAMILIAR = "小阿老"
PLACE_ENDS = "市县区路街巷号楼道段镇乡村里"
# How the initials and the finals of the common romanisation are spelled in the older one, without its marks.
OLD_INITIALS = {"zh": "ch", "ch": "ch", "sh": "sh", "b": "p", "p": "p", "d": "t", "t": "t", "g": "k", "k": "k", "j": "ch", "q": "ch", "x": "hs", "z": "ts", "c": "ts", "r": "j"}
OLD_WHOLE = {"zi": "tzu", "ci": "tzu", "si": "ssu", "zhi": "chih", "chi": "chih", "shi": "shih", "ri": "jih", "er": "erh", "you": "yu", "yan": "yen", "ye": "yeh", "yue": "yueh", "ge": "ko", "ke": "ko", "he": "ho", "e": "o", "gui": "kuei", "kui": "kuei", "guo": "kuo", "kuo": "kuo", "huo": "huo", "shuo": "shuo", "yong": "yung"}
OLD_FINALS = {"ian": "ien", "ie": "ieh", "ue": "ueh", "uo": "o", "ong": "ung", "iong": "iung"}

_CJK = re.compile("[㐀-鿿]")
_ACRONYM = re.compile(r"(?:[A-Z]\.?){3,}")
_PARTICLES = {"and": "&", "und": "&", "et": "&", "y": "&", "e": "&", "&": "&"}


@functools.cache
def _nicknames() -> dict[str, tuple[str, ...]]:
    rows = [x.split() for x in NICKNAMES.replace("\n", "|").split("|") if x.strip()]
    return {fold(nick): tuple(map(fold, full)) for nick, *full in rows}


@functools.cache
def _legal() -> dict[str, str]:
    rows = [x.split() for x in LEGAL.replace("\n", "|").split("|") if x.strip()]
    return {spelling.replace("-", " "): names[0] for names in rows for spelling in names}


@dataclass(frozen=True)
class Writing:
    """Tables of a fixed size by which names are read."""

    looks: Looks
    han: Han
    compound: frozenset[str]  # Chinese surnames of two characters, in simplified ones


def writing(spark: SparkSession) -> Writing:
    h = han(spark)
    return Writing(looks(spark, east=False), h, frozenset(map(h.plain, COMPOUND_SURNAMES)))


@functools.cache
def _old(syllable: str) -> str:
    """The older romanisation of a syllable of the common one."""
    if syllable in OLD_WHOLE:
        return OLD_WHOLE[syllable]
    first = next((x for x in (syllable[:2], syllable[:1]) if x in OLD_INITIALS), "")
    final = syllable[len(first) :]
    return OLD_INITIALS.get(first, "") + OLD_FINALS.get(final, final)


def _spoken(chars: str, h: Han) -> list[str]:
    """Chinese characters in both romanisations, without tones."""
    plain = [bare(h.sound.get(c, c)) for c in chars]
    return ["".join(map(_old, plain)), "".join(plain)]


def bare(token: str) -> str:
    """Lower case without accents."""
    if token.isascii():
        return token.lower()
    plain = "".join(c for c in unicodedata.normalize("NFKD", token.lower()) if not unicodedata.combining(c))
    return plain.replace("ß", "ss").replace("ø", "o").replace("æ", "ae").replace("ł", "l")


@functools.lru_cache(1 << 16)
def fold(token: str) -> str:
    """Lower case without accents; ae, oe and ue count as a, o and u."""
    return re.sub("([aou])e", r"\1", bare(token))


def _parse_chinese(text: str, w: Writing) -> dict | None:
    h = w.han
    text = h.plain(re.sub(r"[\s·・]", "", text))
    m = re.fullmatch(r"(.+?)(股份有限公司|股份\(有\)公司|\(股\)公司|有限公司|\(有\)公司|股份公司|公司)", text)
    core, legal = (m[1], {"股": "股份", "有": "有限"}.get(m[2].lstrip("(")[0], "")) if m else (text, "")
    if not re.fullmatch("[㐀-鿿]{2,}", core) or (not m and (core[-1] in PLACE_ENDS or re.search("[路街巷弄号楼]", core))):
        return None
    double = core[:2] in w.compound
    if m or len(core) > 4 or (len(core) == 4 and not double):
        return {"norm": core + "/" + legal, "kind": "zorg", "toks": [core], "legal": legal, "keys": ["c:" + core[-4:]]}
    sound = bare(h.sound.get(core[-1], core[-1]))
    if len(core) == 2:
        kind = "zfam" if core[0] in FAMILIAR else "zgiven"
        return {"norm": core, "kind": kind, "toks": [core[1:] if kind == "zfam" else core], "keys": ["z:" + sound]}
    cut_at = 2 if double else 1
    surname, given = core[:cut_at], core[cut_at:]
    spoken = [fold(x) for pair in zip(_spoken(surname, h), _spoken(given, h)) for x in pair]
    syllables = ",".join(bare(h.sound.get(c, c)) for c in given)
    keys = ["z:" + sound, *("p:" + x[-SUFFIX:] for x in spoken)]
    return {"norm": core, "kind": "zperson", "toks": [surname, given, syllables, *spoken], "keys": list(dict.fromkeys(keys))}


@functools.cache
def _titles() -> frozenset[str]:
    return MORE_TITLES | {fold(x) for x in TITLES}


def parse(text: str, w: Writing) -> list[dict]:
    """What is compared of one text, in each way it can be read; nothing if it can't name a person or an organisation."""
    plain = unicodedata.normalize("NFC", w.looks.skeleton(text) or "").strip(" \t\r\n,;.'\"")
    if not plain:
        return []
    if _CJK.search(plain):
        found = _parse_chinese(plain, w)
        return [found] if found else []
    raw = [x for x in re.split(r"[\s,;]+", plain) if x]
    if not raw or not all(re.fullmatch(r"&|[^\W\d_]+(?:['’.\-][^\W\d_]+)*\.?", x) for x in raw):
        return []
    legal, table = "", _legal()
    for n in (5, 4, 3, 2, 1):
        tail = " ".join(fold(x).replace(".", "") for x in raw[-n:])
        if len(raw) > n and tail in table:
            legal, raw = table[tail], raw[:-n]
            break
    if len(raw) == 1 and _ACRONYM.fullmatch(raw[0]) and (legal or "." in raw[0]):
        return [_acronym(raw[0], legal)]
    generation = ""
    for k in range(len(raw) - 1, 0, -1):
        if (g := GENERATIONS.get(fold(raw[k]).rstrip("."))) and len(raw) > 2:
            generation, raw = g, raw[:k] + raw[k + 1 :]
            break
    for k, x in enumerate(raw):
        if len(raw) > 1 and (fold(x).rstrip(".") in _titles() or (k == 0 and fold(x) == "sr.")):
            raw = raw[:k] + raw[k + 1 :]
            break
    toks, inits = [], ""
    for x in raw:
        if x.lower() in _PARTICLES and len(raw) > 2:
            toks.append("&")
        elif re.fullmatch(r"(?:[^\W\d_]\.?)+", x) and (len(x.rstrip(".")) == 1 or re.fullmatch(r"(?:[^\W\d_]\.)+", x)):
            inits += fold(x.replace(".", ""))
        else:
            dotted = "." if x.endswith(".") and len(raw) > 1 else ""
            toks.append(re.sub("['’.-]", "", bare(x)) + dotted)
    words = [t for t in toks if t != "&"]
    if not words or (len(words) == 1 and not inits and (legal or len(words[0]) < 3)):
        return []
    kind = "single" if len(words) == 1 and not inits else "name"
    acr = "".join(t[0] for t in words) if len(words) >= 3 and not inits else ""
    keys = ["s:" + fold(t.rstrip("."))[-SUFFIX:] for t in words] + ["a:" + acr] * bool(acr) + _initial_keys(words, toks, inits)
    norm = " ".join(sorted(map(fold, toks))) + "|" + inits + "/" + legal + ("^" + generation) * bool(generation)
    found = [{"norm": norm, "kind": kind, "toks": toks, "inits": inits, "legal": legal, "acr": acr, "gen": generation, "keys": list(dict.fromkeys(keys))}]
    if kind == "single" and len(raw) == 1 and _ACRONYM.fullmatch(raw[0]):
        found.append(_acronym(raw[0], ""))
    return found


def _acronym(text: str, legal: str) -> dict:
    letters = text.replace(".", "").lower()
    return {"norm": letters + "./" + legal, "kind": "acronym", "toks": [letters], "legal": legal, "acr": letters, "keys": ["a:" + letters]}


def _end_letters(token: str) -> set[str]:
    """Letters at the ends of a token, so many that two tokens that are equal or a slip apart have one in common.

    Of the letters that such tokens don't share, one at least is at the end, or the last letters are equal.
    """
    out = set()
    for x in (token, fold(token)):
        many = max(2, int(round((1 - CLOSE) * (2 * len(x) + 2), 6)))
        out |= {"^" + c for c in x[:many]} | {"$" + x[-1:]}
    return out


def _initial_keys(words: list[str], toks: list[str], inits: str) -> list[str]:
    """``i:`` keys of a surname with initials, ``f:`` keys of a full name: the initial and a letter of the surname."""
    plain = [t.rstrip(".") for t in toks]
    if len(words) == 1 and inits:
        return sorted(f"i:{inits[0]}{c}" for c in _end_letters(plain[toks.index(words[0])]))
    if len(toks) != 2 or "&" in toks:
        return []
    firsts = [{x[0] for x in (fold(t), *_nicknames().get(fold(t), ())) if x} for t in toks]
    return sorted({f"f:{x}{c}" for i in (0, 1) for x in firsts[1 - i] for c in _end_letters(plain[i])})


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    if len(a) < len(b):
        a, b = b, a
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _token(a: str, b: str, known: frozenset[str]) -> str | None:
    """How two tokens fit: equal, nick, short (abbreviated) or slip (one typing error); else null."""
    if a == b or (fold_a := fold(a)) == (fold_b := fold(b)):
        return "equal"
    dot_a, dot_b = a.endswith("."), b.endswith(".")
    if dot_a or dot_b:
        short, long = (a, b) if dot_a else (b, a)
        short, long = short.rstrip("."), long.rstrip(".")
        if short == long:
            return "equal"
        rest = iter(long)
        return "short" if len(short) >= 2 and short[0] == long[0] and all(c in rest for c in short) else None
    nick = _nicknames()
    if nick.keys() & {fold_a, fold_b} and set(nick.get(fold_a, (fold_a,))) & set(nick.get(fold_b, (fold_b,))):
        return "nick"
    if fold_a in known and fold_b in known:
        return None
    for x, y in {(a, b), (fold_a, fold_b)}:
        longer = max(len(x), len(y))
        if longer >= 4 and 2 * lcs(x, y) >= min(CLOSE, 1 - 1 / longer) * (len(x) + len(y)):
            return "slip"
    return None


def _initial_fits(initial: str, token: str) -> bool:
    token = fold(token)
    return any(x.startswith(initial) for x in (token, *_nicknames().get(token, ())))


def same(a: dict, b: dict, known: frozenset[str] = frozenset()) -> str | None:
    """``"yes"``, ``"owner:<other part>"`` where b bears a alone or part of a (to be unique), or null."""
    kinds = {a["kind"], b["kind"]}
    if any(a[x] and b[x] and a[x] != b[x] for x in ("legal", "gen")):
        return None
    if "zorg" in kinds:
        return "yes" if kinds == {"zorg"} and a["toks"] == b["toks"] else None
    if "acronym" in kinds:
        return "yes" if a["acr"] and a["acr"] == b["acr"] else None
    if kinds == {"zperson"}:
        (sa, ga, ta), (sb, gb, tb) = a["toks"][:3], b["toks"][:3]
        if sa != sb or ta != tb:
            return None
        return "yes" if len(ga) == len(gb) and sum(x != y for x, y in zip(ga, gb)) == 1 else None  # one character typed for another of the same syllable
    if "zperson" in kinds and kinds & {"zgiven", "zfam"}:
        part, whole = (a, b) if b["kind"] == "zperson" else (b, a)
        surname, given = whole["toks"][:2]
        if part["kind"] == "zgiven":
            return f"owner:{surname}" if part["toks"][0] == given else None
        return f"owner:{whole['norm'][:-1]}" if given[-1] == part["toks"][0] else None
    if kinds & {"zgiven", "zfam"}:
        return None
    if "zperson" in kinds:
        zh, other = (a, b) if a["kind"] == "zperson" else (b, a)
        got = sorted(other["toks"])
        if other["inits"] or len(got) != 2:
            return None
        for spoken in (zh["toks"][3:5], zh["toks"][5:7]):
            fits = [_token(x, y, frozenset()) for x, y in zip(sorted(spoken), got)]
            if fits in (["equal", "equal"], ["equal", "slip"], ["slip", "equal"]):
                return "yes"
        return None
    if "single" in kinds:
        if kinds == {"single"} or "&" in a["toks"] + b["toks"]:
            return None
        part, whole = (a, b) if a["kind"] == "single" else (b, a)
        if part["toks"][0] not in whole["toks"] or len(whole["toks"]) > 2 or whole["legal"]:
            return None
        rest = [t for t in whole["toks"] if t != part["toks"][0]]
        other = _nicknames().get(fold(rest[0]), rest)[0][0] if rest else whole["inits"][:1]
        return f"owner:{other}"
    ta, tb, ia, ib = a["toks"], b["toks"], a["inits"], b["inits"]
    if len(ta) == len(tb):
        if len(ta) == 1:  # both with initials
            return "yes" if ta[0] == tb[0] and ia[0] == ib[0] and (len(ia) != len(ib) or ia == ib) else None
        if ia and ib and ia != ib:
            return None
        orders = [tb] if len(ta) > 2 else [tb, tb[::-1]]
        for order in orders:
            fits = [_token(x, y, known) for x, y in zip(ta, order)]
            if None not in fits and "equal" in fits and all(fits.count(k) <= 1 for k in ("slip", "nick", "short")):
                return "yes"
        return None
    short, long = (a, b) if len(ta) < len(tb) else (b, a)
    if len(short["toks"]) == 1 and len(long["toks"]) == 2 and "&" not in long["toks"]:
        name, first, middle = short["toks"][0], short["inits"][0], short["inits"][1:]
        for i in (0, 1):
            fit = _token(name, long["toks"][i], known)
            if fit in ("equal", "slip") and _initial_fits(first, long["toks"][1 - i]) and not (middle and long["inits"] and middle != long["inits"]):
                return "yes"
    return None


def _pack(source: str, p: dict) -> str:
    return "\t".join((source, p["kind"], p.get("legal", ""), p.get("inits", ""), p.get("acr", ""), p["norm"], p.get("gen", ""), *p["toks"]))


def _unpack(form: str) -> dict:
    source, kind, legal, inits, acr, norm, gen, *toks = form.split("\t")
    return {"source": source, "kind": kind, "legal": legal, "inits": inits, "acr": acr, "norm": norm, "gen": gen, "toks": toks}


def _names(known_places: frozenset[str], w: Writing):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[tuple[str, str], list[tuple[str, list[str]]]] = {}

        def of(source: str, text: str) -> list[tuple[str, list[str]]]:
            if (source, text) not in memo:
                if len(memo) > 200_000:
                    memo.clear()
                memo[source, text] = [(_pack(source, p), p["keys"]) for p in parse(text, w) if not _is_place(p, known_places)]
            return memo[source, text]

        for b in batches:
            got = [(i, f, k) for i, (s, t) in enumerate(zip(b.column("source_table").to_pylist(), b.column("text").to_pylist())) for f, k in of(s, t)]
            at = pa.array([i for i, _, _ in got], pa.int32())
            cols = [b.column(c).take(at) for c in ("g", "id")] + [pa.array([f for _, f, _ in got], pa.string()), pa.array([k for _, _, k in got], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, ["g", "id", "form", "keys"])

    return run


def _less_one(name: str) -> set[str]:
    """What is left of a name without one of its letters."""
    return {name[:i] + name[i + 1 :] for i in range(len(name))}


@functools.lru_cache(4)
def _nearly(places: frozenset[str]) -> frozenset[str]:
    return frozenset(x for place in places for x in _less_one(place))


def _is_place(p: dict, places: frozenset[str]) -> bool:
    """Bare place names aren't names; one typing error and the usual abbreviations are allowed for."""
    if p["kind"] not in ("name", "single") or p.get("legal") or p.get("inits"):
        return False
    full = {"st": "saint", "ste": "sainte", "ft": "fort", "mt": "mount", "n": "north", "w": "west", "pt": "port", "jct": "junction", "lk": "lake"}
    name = fold(" ".join(full.get(t.rstrip("."), t.rstrip(".")) for t in p["toks"]))
    if name in places:
        return True
    near = _nearly(places)
    return name in near or any(x in near or x in places for x in _less_one(name))  # all but one letter in common


def place_names(places: DataFrame) -> frozenset[str]:
    """Folded names of the places, a table of fixed size."""
    table = looks(places.sparkSession, east=False)
    rows = fixed_table(places.select("city").distinct())
    return frozenset(fold(table.skeleton(r["city"])).replace("-", "") for r in rows if r["city"] and not _CJK.search(r["city"]))


def given_names(names: DataFrame) -> frozenset[str]:
    """Folded given names, a table of fixed size."""
    table = looks(names.sparkSession, east=False)
    return frozenset(fold(table.skeleton(r["name"])) for r in fixed_table(names.select("name").distinct()) if r["name"])


def _compare(known: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, (x, y) in enumerate(zip(b.column("a").to_pylist(), b.column("b").to_pylist())):
                p, q = _unpack(x), _unpack(y)
                if v := same(p, q, known):
                    out.append((i, p["norm"], p["kind"], q["norm"], q["kind"], v, p["source"]))
            at, *cols = list(zip(*out)) or [[]] * 7
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(c).take(at) for c in ("g", "ids_a", "ids_b")] + [pa.array(c, pa.string()) for c in cols], ["g", "ids_a", "ids_b", "norm_a", "kind_a", "norm_b", "kind_b", "verdict", "source_table"])

    return run


def _other_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What else forms of one suffix have in common if they fit: letters at the ends of another token, or all of a lone one.

    Of the tokens one has the suffix, and the others fit those of the other form, so that they have one of
    :func:`_end_letters` in common, or those of the names they are short for. Initials have their letter. A lone
    token is equal in both forms. Chinese names have the surname, the given name or its last character in common.
    """
    nick = _nicknames()
    for b in batches:
        out = []
        for key, form in zip(b.column("key").to_pylist(), b.column("form").to_pylist()):
            p = _unpack(form)
            kind, toks = p["kind"], [t.rstrip(".") for t in p["toks"] if t != "&"]
            if key[0] in "ac":
                own = {"="}
            elif key[0] == "z":
                own = {"s" + toks[0], "g" + toks[1], "l" + toks[1][-1]} if kind == "zperson" else {("l" if kind == "zfam" else "g") + toks[0]}
            else:
                own = {"^" + c for c in p["inits"]}
                for i, t in enumerate(toks):
                    if fold(t)[-SUFFIX:] != key[2:]:
                        continue
                    own.add("=" + fold(t))
                    for other in toks[:i] + toks[i + 1 :]:
                        for x in (other, *nick.get(fold(other), ())):
                            own |= _end_letters(x)
            out.append(sorted(own))
        yield pa.RecordBatch.from_arrays([b.column(c) for c in ("g", "k", "form", "ids")] + [pa.array(out, pa.list_(pa.string()))], ["g", "k", "form", "ids", "letters"])


def _candidates(forms: DataFrame, common: int) -> DataFrame:
    """``(g, a, ids_a, b, ids_b)``: pairs of forms of one group that share a suffix, or the initial and a letter of the surname.

    Suffix blocks of more than ``common`` forms are refined by what their forms must have in common besides the suffix
    if they fit, which loses no link (:func:`_other_letters`).
    """
    initials = F.col("key").rlike("^[ifp]:")
    blocks = forms.select("g", F.explode("keys").alias("key"), "form", "ids").where(~initials).withColumn("k", F.xxhash64("key"))
    hot = cut(blocks.groupBy("g", "k").agg(F.count("*").alias("n")).where(F.col("n") > common).select("g", "k"))

    def pairs(side: DataFrame, on: list[str]) -> DataFrame:
        right = side.select(*on, F.col("form").alias("b"), F.col("ids").alias("ids_b"))
        return side.select(*on, F.col("form").alias("a"), F.col("ids").alias("ids_a")).join(right, on).where("a < b").select("g", "a", "ids_a", "b", "ids_b")

    by_initial = _by_initial(forms)
    if hot.isEmpty():
        return pairs(blocks.drop("key"), ["g", "k"]).unionByName(by_initial)
    refined = blocks.join(hot, ["g", "k"], "left_semi").select("g", "k", "key", "form", "ids").mapInArrow(_other_letters, "g long, k long, form string, ids array<long>, letters array<string>")
    refined = refined.withColumn("fine", F.explode("letters")).drop("letters")
    return pairs(blocks.join(hot, ["g", "k"], "left_anti").drop("key"), ["g", "k"]).unionByName(pairs(refined, ["g", "k", "fine"])).unionByName(by_initial)


def _by_initial(forms: DataFrame) -> DataFrame:
    """``(g, a, ids_a, b, ids_b)``: short forms and the full names of their group that may be theirs.

    Short forms are surnames with initials (by the initial and a letter of the surname; pairs with a common suffix are
    candidates already) and Chinese names (by the suffix of their surname or given name, as romanised). Full names travel
    only where their group has such a form.
    """
    of = lambda kind, to: F.transform(F.filter("keys", lambda k: k.startswith(kind)), lambda k: F.concat(F.lit(to), F.substr(k, F.lit(3))))
    suffixes = F.filter("keys", lambda k: k.startswith("s:"))
    none = F.array().cast("array<string>")
    own = F.concat(of("i:", "i"), of("p:", "p"))
    short = forms.select("g", own.alias("own"), F.when(F.exists("keys", lambda k: k.startswith("i:")), suffixes).otherwise(none).alias("s_x"), F.col("form").alias("x"), F.col("ids").alias("ids_x")).where(F.size("own") > 0)
    groups = short.groupBy("g").agg(F.max(F.col("own")[0].startswith("i")).alias("initials"), F.max(F.col("own")[0].startswith("p")).alias("chinese"))
    parts = F.split("form", "\t")
    two = (parts[1] == "name") & (parts[3] == "") & (F.size(parts) == 9)
    full = forms.select("g", of("f:", "i").alias("f"), F.when(two, of("s:", "p")).otherwise(none).alias("p"), suffixes.alias("s_y"), F.col("form").alias("y"), F.col("ids").alias("ids_y")).where((F.size("f") > 0) | (F.size("p") > 0))
    full = full.join(groups, "g").select("g", F.explode(F.concat(F.when(F.col("initials"), F.col("f")).otherwise(none), F.when(F.col("chinese"), F.col("p")).otherwise(none))).alias("key"), F.when(F.col("initials"), F.col("s_y")).otherwise(none).alias("s_y"), "y", "ids_y")
    met = short.select("g", F.explode("own").alias("key"), "s_x", "x", "ids_x").join(full, ["g", "key"]).where(~F.arrays_overlap("s_x", "s_y"))
    swap = F.col("x") < F.col("y")
    return met.select("g", F.least("x", "y").alias("a"), F.when(swap, F.col("ids_x")).otherwise(F.col("ids_y")).alias("ids_a"), F.greatest("x", "y").alias("b"), F.when(swap, F.col("ids_y")).otherwise(F.col("ids_x")).alias("ids_b"))


def same_names(records: DataFrame, places: frozenset[str] = frozenset(), known: frozenset[str] = frozenset(), common: int = COMMON) -> DataFrame:
    """``(source_table, id_a, id_b)``: records of one group that name the same person or organisation.

    ``records`` has ``source_table, grp, id, text``, each id once (:func:`once_per_id`, :func:`first_spans`).
    Records without group, id or a name-like text are left out; the smaller id comes first. Records whose
    texts fold to the same form are linked without comparison; the ids of a form, one per spelling, travel with it.
    """
    shape = ~F.col("text").rlike(r"[\p{N}@/:_#*+=<>\[\]{}|~^%$!?]") & F.col("text").rlike(r"\p{L}")
    src = records.where(F.col("grp").isNotNull() & F.col("id").isNotNull() & shape)
    src = src.select("source_table", F.xxhash64("source_table", "grp").alias("g"), F.col("id").cast("long").alias("id"), "text")
    parsed = src.mapInArrow(_names(places, writing(records.sparkSession)), "g long, id long, form string, keys array<string>")
    forms = parsed.withColumn("norm", F.split("form", "\t")[5]).groupBy("g", "norm").agg(F.min(F.struct("form", "keys")).alias("f"), F.collect_list("id").alias("ids"))
    forms = cut(forms.select("g", "f.form", "f.keys", "ids"))
    schema = "g long, ids_a array<long>, ids_b array<long>, norm_a string, kind_a string, norm_b string, kind_b string, verdict string, source_table string"
    found = cut(_candidates(forms, common).mapInArrow(_compare(known), schema).dropDuplicates(["g", "norm_a", "norm_b"]))

    sure = found.where("verdict = 'yes'")
    part_kinds = ("single", "zgiven", "zfam")
    owned = found.where("verdict <> 'yes'").withColumn("part", F.when(F.col("kind_a").isin(*part_kinds), F.col("norm_a")).otherwise(F.col("norm_b")))
    unique = owned.groupBy("g", "part").agg(F.countDistinct("verdict").alias("n")).where("n = 1").select("g", "part")
    owned = owned.join(unique, ["g", "part"], "left_semi")
    pair = ["source_table", "ids_a", "ids_b"]
    edges = sure.unionByName(owned.drop("part"))
    across = edges.select(*pair).unionByName(_through_full_names(edges).select(*pair))
    across = across.withColumn("x", F.explode("ids_a")).select("source_table", "x", F.explode("ids_b").alias("y")).where("x <> y")

    parts = F.split("form", "\t")
    several = forms.where(F.size("ids") > 1).select("g", parts[0].alias("source_table"), parts[1].alias("kind"), parts[5].alias("norm"), "ids")
    whole = several.where(~F.col("kind").isin(*part_kinds)).unionByName(several.where(F.col("kind").isin(*part_kinds)).join(unique.withColumnRenamed("part", "norm"), ["g", "norm"], "left_semi").select(*several.columns))
    within = whole.select("source_table", F.explode("ids").alias("x"), "ids").select("source_table", "x", F.explode("ids").alias("y")).where("x < y")
    return across.unionByName(within).select("source_table", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def _through_full_names(edges: DataFrame) -> DataFrame:
    """``(source_table, ids_a, ids_b)`` of two forms that are linked to the same full name, parts of it included.

    A full name is Chinese, or has no initials and stands between names in letters only: forms with initials,
    acronyms and romanisations may stand for several people and link nobody to anybody, and a name without its
    generation doesn't link a junior to a senior. The pairs are the result's own, so a hub of many forms has many.
    """
    one = F.struct(F.col("norm_a").alias("hub"), F.col("kind_a").alias("k"), F.col("norm_b").alias("end"), F.col("kind_b").alias("e"), F.col("ids_b").alias("ids"))
    two = F.struct(F.col("norm_b").alias("hub"), F.col("kind_b").alias("k"), F.col("norm_a").alias("end"), F.col("kind_a").alias("e"), F.col("ids_a").alias("ids"))
    ways = edges.select("source_table", "g", F.explode(F.array(one, two)).alias("w")).select("source_table", "g", "w.*")
    full = F.col("hub").contains("|/") & (F.col("hub").contains(" ") | F.col("hub").rlike(r"\|/."))
    ways = ways.where((F.col("k") == "zperson") | ((F.col("k") == "name") & full & (F.col("e") != "zperson")))
    other = ways.select("g", "hub", F.col("end").alias("other"), F.col("ids").alias("ids_b"))
    return ways.withColumnRenamed("ids", "ids_a").join(other, ["g", "hub"]).where("end < other").where(_one_generation("end", "other"))


def _one_generation(a: str, b: str) -> F.Column:
    of = lambda c: F.regexp_extract(c, r"\^(\w+)$", 1)
    return (of(a) == of(b)) | (of(a) == "") | (of(b) == "")


def once_per_id(rows: DataFrame, id_col: str, grp_col: str, text_col: str, source: str) -> DataFrame:
    """``(source_table, grp, id, text)`` with each id once, however often it was delivered."""
    got = rows.select(F.col(id_col).cast("long").alias("id"), F.col(grp_col).cast("string").alias("grp"), F.col(text_col).alias("text")).where("text is not null")
    return got.dropDuplicates(["id"]).select(F.lit(source).alias("source_table"), "grp", "id", "text")


def first_spans(spans: DataFrame) -> DataFrame:
    """``(source_table, grp, id, text)``: the first span of each exact text in its document."""
    once = spans.where("doc_id is not null and text is not null").select("doc_id", "text", "span_start", "span_id")
    first = once.groupBy("doc_id", "text").agg(F.min(F.struct("span_start", "span_id")).alias("f"))
    return first.select(F.lit("spans").alias("source_table"), F.col("doc_id").cast("string").alias("grp"), F.col("f.span_id").alias("id"), "text")
