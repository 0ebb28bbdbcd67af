"""Variant spellings of the names of persons and houses, linked.

Distinct spellings are parsed into forms (given and family parts of persons; kind, subject and own words of houses).  Family
names and own words go through MinHash banding over padded q-grams; the numbers of bands and rows come from the collision
curve for a wanted recall.  Candidate forms are verified by a Monge-Elkan similarity whose inner measure knows initials, short
forms and slips of the keyboard, and star clustering joins forms to the fullest and best connected form near them.

No curve reaches the recall for short words, so every word, of any length, meets its one-slip variants by its deletion neighbourhood as well; bands that
very many words share are left to it, which changes no result.  Forms of one or two near family names are compared only if their given
names share a key too (the name, its formal names, its own deletion neighbourhood, or the letter of an initial), so a family name that many bear is no hot group.

Defined results: null and blank names, and names without any letter, take part in no link; spellings count once however
many rows hold them; a name known by its initials only goes to the nearest fuller name, the more frequent one on ties.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

# Words that say nothing about who a person is, parts that belong to a family name, and short forms of given names.
TITLES = set("dr dr. prof prof. rev rev. sir dame lord lady mr mr. mrs mrs. ms ms. herr frau mme mme. m.d. phd ph.d. ph.d md jr jr. sr sr. dipl.-ing. ing. hon. fr. st.".split())
ROLES = set("ed ed. eds eds. editor author hrsg hrsg. hg. herausgeber übers. uebers. transl. trans. tr. illus. autor auteur dir. coord. comp. et al al. and others u.a.".split())
PARTICLES = set("von van de del der den di da du des la le las los dos ten ter zu zur af av el".split())
NICKNAMES = {
    "alexander": "alex sasha xander", "alfons": "alf fons", "amalia": "mali", "andres": "andy", "anselm": "selmo", "arturo": "turo arthur", "benjamin": "ben benny", "bernhard": "bernd berni", "bettina": "tina betty",
    "carlos": "charly", "cecile": "cissy", "charles": "charlie chuck", "christine": "chris tina christl", "cornelius": "conny cor", "daniel": "dan danny", "dolores": "lola", "dorothea": "thea dora doro",
    "edith": "edie", "edward": "ed eddie ned ted", "elena": "lena nelly", "elizabeth": "liz beth betty lizzie eliza", "ernestine": "erna tine", "esteban": "stevie", "fernande": "nande", "francisco": "paco pancho kiko", "frederic": "fred", "friedrich": "fritz fred friedl",
    "gabriel": "gabe", "georg": "schorsch", "gertrude": "trudy gert trude", "gregory": "greg", "gunther": "gunni", "hannah": "hanna", "heinrich": "heinz heiner henry", "ignacio": "nacho", "irene": "reni", "isabella": "bella isa", "jacob": "jake jack", "joaquin": "quino ximo",
    "johannes": "hans hannes johann", "jose": "pepe", "josefine": "josie fine", "jurgen": "jorgen", "karoline": "karo lina", "katherine": "kate kathy katie kat", "konrad": "konni kurt", "leonora": "nora leni", "leopold": "leo poldi", "liselotte": "lilo lotte liesl", "lorenz": "enz", "louise": "lou lulu",
    "lucia": "lucy", "magdalena": "lena magda leni", "marcel": "marc", "margaret": "maggie peggy meg greta", "martin": "marty", "matthew": "matt", "michael": "mike mick", "monica": "moni", "nathaniel": "nate nat", "nicolas": "nico nick", "oskar": "ossi", "patricia": "pat trish patty", "pauline": "paula",
    "philippe": "phil", "rafael": "rafa", "raymond": "ray", "rebecca": "becky becca", "richard": "rick dick rich", "robert": "bob rob bobby", "roland": "roli", "rosalind": "rosa ros linda", "samuel": "sam sammy", "sebastian": "basti seb", "simone": "simi", "stella": "stell", "susanna": "sue susi susie",
    "theodore": "ted theo", "therese": "resi", "thomas": "tom tommy", "tobias": "tobi", "ulrich": "uli ulli", "ursula": "uschi ulla", "valentin": "val", "veronica": "vero vroni", "victor": "vic", "vincent": "vince vinny", "walter": "walt", "wilhelmine": "minna mina wilma helmi", "william": "bill will billy", "yvonne": "vonni", "zacharias": "zach",
}
_NOT_DECOMPOSED = str.maketrans({"ß": "ss", "ø": "o", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "’": "'", "‐": "-", "‑": "-", "–": "-"})
FORMAL: dict[str, tuple[str, ...]] = {}
for _formal, _short in NICKNAMES.items():
    for _s in _short.split():
        FORMAL[_s] = (*FORMAL.get(_s, ()), _formal)


def fold(s: str) -> str:
    """Case and accents removed, blanks made single."""
    s = unicodedata.normalize("NFKD", s.casefold().translate(_NOT_DECOMPOSED))
    return " ".join("".join(ch for ch in s if not unicodedata.combining(ch)).split())


def person(name: str) -> tuple[list[str], list[str], bool]:
    """(given parts, family parts, whether the order is certain) of a person's name as typed."""
    s = re.sub(r"[(\[{][^)\]}]*[)\]}]?", " ", fold(name))
    s = re.sub(r"[;:\"“”„]", " ", s)
    parts = [[w for w in p.replace(".", ". ").split()] for p in s.split(",")]
    parts = [[w for w in p if w not in TITLES and w not in ROLES and w.strip(".-'")] for p in parts]
    parts = [p for p in ([w.strip("'") for w in q] for q in parts) if p]
    initial = lambda w: len(w.rstrip(".")) == 1
    clean = lambda ws: [w.rstrip(".") for w in ws if w != "."]
    if not parts:
        return [], [], True
    if len(parts) > 1:
        return clean([w for p in parts[1:] for w in p if w not in PARTICLES]), clean(parts[0]), True
    ws = parts[0]
    if len(ws) == 1:
        return [], clean(ws), True
    first = next((i for i, w in enumerate(ws) if w in PARTICLES), None)
    if initial(ws[-1]) and not initial(ws[0]):
        k = next(i for i in range(len(ws)) if all(initial(w) for w in ws[i:]))
        return clean(ws[k:]), clean(ws[:k]), True
    if first:
        return clean(ws[:first]), clean(ws[first:]), True
    if first == 0:  # the particle opens a reversed name
        k = next((i for i, w in enumerate(ws) if w not in PARTICLES), len(ws) - 1)
        return clean(ws[k + 1 :]), clean(ws[: k + 1]), True
    return clean(ws[:-1]), clean(ws[-1:]), initial(ws[0])


# Words of a house's kind, and words that every house may carry.
HOUSE_KINDS = {
    "university": "university univ universitat universite universidad u.p up", "lithographic": "lithographic lithogr lith", "institute": "institute inst institut instituto", "verlag": "verlag verl vlg verlags",
    "editions": "editions edition", "editorial": "editorial edit editorialis", "books": "books bks book", "pub": "publishing publishers publisher publ pub house verlagshaus", "press": "press pr presse prensa",
}
HOUSE_NOISE = set("the of for f und and et y e by du de des la le les el & + co company gmbh kg ag inc ltd llc s.a sa s.l sl studies studien sons sohne fils hijos".split())
_KIND = {w: k for k, words in HOUSE_KINDS.items() for w in words.split()}


def house(name: str) -> tuple[str, str, list[str]]:
    """(kind, subject, own words) of a house's name as typed; kind and subject may be unknown."""
    accented = " ".join(re.sub(r"[(){}\[\],;:\"“”„&+/-]", " ", name.casefold()).split())
    french = bool(re.search(r"(?:^| )éds?(?:\.|$| )", unicodedata.normalize("NFC", accented)))
    words = [w.rstrip(".") if not re.fullmatch(r"(?:\w\.)+", w) else w.rstrip(".") for w in fold(accented).split()]
    kinds = [_KIND[w] for w in words if w in _KIND]
    if "ed" in words or "eds" in words:
        kinds.append("editions" if french else "editorial" if "s.a" in words else "editions editorial")
    own, subject = [], ""
    for i, w in enumerate(words):
        if w in _KIND or w in HOUSE_NOISE or w in ("ed", "eds") or not re.search(r"\w", w):
            continue
        if i + 1 < len(words) and words[i + 1] in ("studies", "studien"):
            subject = w
        else:
            own.append(w)
    order = ["university", "lithographic", "institute", "verlag", "editions", "editorial", "editions editorial", "books", "pub", "press"]
    return next((k for k in order if k in kinds), ""), subject, sorted(own)


_KEYS = {ch: (row, col + (0, 0.25, 0.75)[row]) for row, keys in enumerate(("qwertyuiop", "asdfghjkl", "zxcvbnm")) for col, ch in enumerate(keys)}


def _near(a: str, b: str) -> bool:
    """Whether two letters are neighbours on the keyboard (z and y also change places)."""
    if {a, b} == {"y", "z"}:
        return True
    return a in _KEYS and b in _KEYS and abs(_KEYS[a][0] - _KEYS[b][0]) <= 1 and abs(_KEYS[a][1] - _KEYS[b][1]) <= 1


def slip(a: str, b: str) -> bool:
    """Whether one slip of the keyboard leads from one word to the other: a neighbouring key, a swap (past a doubled letter too), a letter left out or typed twice."""
    if a == b or min(len(a), len(b)) < 3:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        if a[i + 1 :] == b[i + 1 :]:
            return _near(a[i], b[i])
        k = 3 if len(a) > i + 2 and a[i + 1] in (a[i], a[i + 2]) and a[i + 1] == b[i + 1] else 2  # past a doubled letter
        return a[i : i + k] == b[i : i + k][::-1] and a[i + k :] == b[i + k :]
    if abs(len(a) - len(b)) > 1:
        return False
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return long[i + 1 :] == short[i:]


def _plain(w: str) -> str:
    return w.replace("ae", "a").replace("oe", "o").replace("ue", "u")


def inner(a: str, b: str) -> float:
    """Similarity of two words of names: equal 1, transcribed 0.98, short form 0.95, initial 0.9, slip 0.85, else 0."""
    if a == b:
        return 1.0
    if _plain(a) == _plain(b):
        return 0.98
    if {a, *FORMAL.get(a, ())} & {b, *FORMAL.get(b, ())}:
        return 0.95
    if "-" in a and b in a.split("-") and len(b) > 1 or "-" in b and a in b.split("-") and len(a) > 1:
        return 0.95
    short, long = sorted((a, b), key=len)
    if len(short) == 1:
        return 0.9 if long.startswith(short) or any(f.startswith(short) for f in FORMAL.get(long, ())) else 0.0
    if "-" in short or "-" in long:  # J-P and J.-P. stand for both parts
        ps, pl = short.split("-"), long.split("-")
        if len(ps) == len(pl) and all(len(x) == 1 and y.startswith(x) for x, y in zip(ps, pl, strict=True)):
            return 0.9
    return 0.85 if slip(_plain(a), _plain(b)) or slip(a, b) else 0.0


def monge_elkan(a: list[str], b: list[str]) -> tuple[float, int]:
    """Mean over the shorter list of the best inner similarity in the longer one, and the number of slips used."""
    if len(a) > len(b):
        a, b = b, a
    left, total, slips = list(b), 0.0, 0
    for w in a:
        best = max(left, key=lambda x: inner(w, x), default=None)
        s = inner(w, best) if best is not None else 0.0
        if s == 0.0:
            return 0.0, slips
        slips += s == 0.85
        total += s
        left.remove(best)
    return (total / len(a) if a else 0.0), slips


def same_person(a: tuple[list[str], list[str]], b: tuple[list[str], list[str]]) -> float:
    """Similarity of two (given, family) forms, 0 if they cannot be one person."""
    (ga, fa), (gb, fb) = a, b
    if not ga or not gb:
        return 0.0
    pa, pb = [w for w in fa if w in PARTICLES], [w for w in fb if w in PARTICLES]
    if pa and pb and pa != pb:
        return 0.0
    ca, cb = [w for w in fa if w not in PARTICLES], [w for w in fb if w not in PARTICLES]
    if len(ca) != len(cb) or not ca or any(len(x) == 1 for x in (*ca, *cb)):
        return 0.0
    fam = [1.0 if x == y else 0.98 if _plain(x) == _plain(y) else 0.85 if slip(x, y) else 0.0 for x, y in zip(ca, cb, strict=True)]
    if 0.0 in fam:
        return 0.0
    slips, first = fam.count(0.85), inner(ga[0], gb[0])
    if first == 0.0 or (slips := slips + (first == 0.85)) > 1:
        return 0.0
    middle = 1.0
    if ga[1:] and gb[1:]:
        middle, more = monge_elkan(ga[1:], gb[1:])
        if middle == 0.0 or slips + more > 1:
            return 0.0
    return (2 * min(fam) + first) / 3 - (0.02 if len(ga) != len(gb) else 0.0) - 0.02 * (1 - middle)


def same_house(a: tuple[str, str, list[str]], b: tuple[str, str, list[str]]) -> float:
    (ka, sa, wa), (kb, sb, wb) = a, b
    if not wa or len(wa) != len(wb) or sa and sb and sa != sb:
        return 0.0
    if ka and kb and ka != kb and not (set(ka.split()) & set(kb.split())) and {ka, kb} != {"pub", "press"}:
        return 0.0
    best, slips = 0.0, 0
    left = list(wb)
    for w in wa:
        near = next((x for x in left if x == w), None) or next((x for x in left if slip(w, x)), None)
        if near is None:
            return 0.0
        slips += near != w
        best += 1.0 if near == w else 0.85
        left.remove(near)
    return 0.0 if slips > 1 else best / len(wa) - 0.01 * ((ka != kb) + (sa != sb))


#: Width of the q-grams, and the similarity from which the wanted share of pairs must meet in a band: that of one slip in a word of 8 letters.
Q, LEAST_JACCARD, RECALL = 3, 0.5, 0.97
#: Rows of a band; words above which a band is left to the deletion neighbourhoods.
BAND_ROWS, CROWDED = 3, 256


@cache
def bands_for(similarity: float = LEAST_JACCARD, recall: float = RECALL, rows: int = BAND_ROWS) -> int:
    """Number of bands at which 1 - (1 - s**rows)**bands reaches the recall."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))


@cache
def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240)
    return rng.integers(1, 1 << 31, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 31, n, dtype=np.uint64)


def signature(word: str, bands: int, rows: int = BAND_ROWS, q: int = Q) -> list[int]:
    """One hash a band of the word's padded q-grams."""
    padded = "^" * (q - 1) + word + "$" * (q - 1)
    grams = np.array(sorted({zlib.crc32(padded[i : i + q].encode()) for i in range(len(padded) - q + 1)}), dtype=np.uint64)
    a, b = _coefficients(bands * rows)
    low = ((grams[:, None] * a + b) >> np.uint64(13) & np.uint64(0x7FFFFFFF)).min(axis=0).reshape(bands, rows)
    h = low[:, 0]
    for k in range(1, rows):
        h = h * np.uint64(0x9E3779B97F4A7C15) + low[:, k]
    return h.astype(np.int64).tolist()


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for field, name, n in zip(b.field_name, b.name, b.n, strict=True):
            if field == "publisher":
                kind, subject, own = house(name)
                rows.append((field, name, n, kind, subject, [], own, True))
            else:
                given, family, sure = person(name)
                rows.append((field, name, n, "", "", given, family, sure))
        yield pd.DataFrame(rows, columns=["field_name", "name", "n", "kind", "subject", "given", "family", "sure"])


_PARSED = "field_name string, name string, n bigint, kind string, subject string, given array<string>, family array<string>, sure boolean"


def forms(names: DataFrame) -> DataFrame:
    """Parsed distinct spellings (field_name, name, n) with the order of uncertain names set by how their words are used elsewhere."""
    parsed = stored(names.select("field_name", "name", "n").where(F.col("name").rlike(r"(?U)\w")).mapInPandas(_parse, _PARSED), "parsed")
    people = parsed.where("field_name <> 'publisher'")
    votes = people.select(F.explode(F.concat(F.transform("given", lambda w: F.struct(w.alias("w"), F.lit(1).alias("g"))), F.transform("family", lambda w: F.struct(w.alias("w"), F.lit(0).alias("g"))))).alias("v"))
    votes = votes.groupBy("v.w").agg(((F.sum("v.g") + 0.5) / (F.count(F.lit(1)) + 1.0)).alias("p"))
    swappable = (~F.col("sure")) & (F.size("family") == 1) & (F.size("given") > 0)
    x = parsed.withColumns({"_f": F.when(swappable, F.get("given", F.lit(0))), "_l": F.when(swappable, F.get("family", F.lit(0)))})
    pending = x.where("_f is not null").join(votes.select(F.col("w").alias("_f"), F.col("p").alias("_pf")), "_f").join(votes.select(F.col("w").alias("_l"), F.col("p").alias("_pl")), "_l")
    turned = F.col("_pl") > F.col("_pf")
    pending = pending.withColumns({
        "family": F.when(turned, F.array("_f")).otherwise(F.col("family")),
        "given": F.when(turned, F.concat(F.array("_l"), F.slice("given", F.lit(2), F.size("given")))).otherwise(F.col("given")),
    })
    cols = ["field_name", "name", "n", "kind", "subject", "given", "family"]
    both = x.where("_f is null").select(cols).unionByName(pending.select(cols))
    form = F.concat_ws("|", "field_name", "kind", "subject", F.array_join("given", " "), F.array_join("family", " "))
    return stored(both.where("size(family) > 0").withColumn("form", form), "forms")


_M, _B = (1 << 61) - 1, 1_000_003


def deletion_keys(word: str) -> set[int]:
    """Hashes of a word and of all forms of it with one letter left out; two words one slip apart share one."""
    n = len(word)
    before, after, power = [0] * (n + 1), [0] * (n + 1), 1
    for i, ch in enumerate(word):
        before[i + 1] = (before[i] * _B + ord(ch) + 1) % _M
    found = {before[n]}
    for i in range(n - 1, -1, -1):  # before[i] shifted by the letters after i, and those
        found.add((before[i] * power + after[i + 1]) % _M)
        after[i] = (after[i + 1] + (ord(word[i]) + 1) * power) % _M
        power = power * _B % _M
    return found


def _hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "replace"), digest_size=7).digest())


def _neighbourhoods(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every word under its deletion keys; the words of a house under those of each word, beside the sum of the others."""
    for b in batches:
        rows = []
        for field, word in zip(b.field_name, b.word, strict=True):
            parts = word.split(" ") if field == "publisher" else [word]
            whole = sum(map(_hash, parts)) if len(parts) > 1 else 0
            for w in set(parts):
                rest = (whole - _hash(w)) * _B + len(parts) if len(parts) > 1 else 0
                rows += [(field, word, (k + rest) % _M) for k in deletion_keys(w)]
        yield pd.DataFrame(rows, columns=["field_name", "word", "rest"])


def given_keys(first: str) -> list[tuple[str, bool, bool]]:
    """(key, leads, exact) under which a given name meets its variants.

    Two names meet if they share a key and at least one of them leads by it.  Initials lead by their letter, which full names only follow.
    The keys that are not exact are the deletion neighbourhood, for names that differ by a slip.
    """
    parts = [p for p in first.split("-") if p]
    names = {first, _plain(first), *FORMAL.get(first, ())} | {p for p in parts if len(p) > 1}
    initial = all(len(p) == 1 for p in parts)
    letters = {first[0], *(f[0] for f in FORMAL.get(first, ())), *(p[0] for p in parts)}
    keys = [(f"={x}", True, True) for x in names if len(x) > 1] + [(x, initial, True) for x in letters]
    return keys + [(f"~{k}", True, False) for x in {first, _plain(first)} if len(x) > 2 for k in deletion_keys(x)]


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words under which a form may meet its variants, with the keys of its given name."""
    for b in batches:
        rows = []
        for form, field, given, family in zip(b.form, b.field_name, b.given, b.family, strict=True):
            if field == "publisher":
                rows.append((form, field, " ".join(sorted(family)), "", True, True))
            elif len(given):
                word = "".join(w for w in family if w not in PARTICLES)
                rows += [(form, field, w, *k) for w in {word, _plain(word)} for k in given_keys(given[0])]
        yield pd.DataFrame(rows, columns=["form", "field_name", "word", "key", "leads", "exact"])


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n = bands_for()
    for b in batches:
        yield b.assign(bands=[signature(w, n) for w in b.word])


def _near_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of family names that lie one slip apart; words of houses are compared with their forms."""
    for b in batches:
        yield b[[f == "publisher" or slip(x, y) for f, x, y in zip(b.field_name, b.a, b.b, strict=True)]]


def word_pairs(words: DataFrame) -> DataFrame:
    """(field_name, a, b): different words (field_name, word), a < b, that share a band or a deletion key and may be one slip apart."""
    words = words.select("field_name", "word").distinct()
    signed = words.mapInPandas(_sign, "field_name string, word string, bands array<bigint>").select("field_name", "word", F.posexplode("bands").alias("band", "h"))
    spots = stored(signed.select("field_name", "word", F.xxhash64("band", "h").alias("rest")), "spots")
    shared = spots.groupBy("field_name", "rest").agg(F.count(F.lit(1)).alias("c")).where(f"c between 2 and {CROWDED}").select("field_name", "rest")
    forms_ = stored(words.mapInPandas(_neighbourhoods, "field_name string, word string, rest bigint"), "deletions")
    side = lambda df, c: df.select("field_name", "rest", F.col("word").alias(c))
    pairs = [side(x, "a").join(side(x, "b"), ["field_name", "rest"]).where("a < b").select("field_name", "a", "b") for x in (spots.join(shared, ["field_name", "rest"], "left_semi"), forms_)]
    near = (F.col("field_name") == "publisher") | (F.levenshtein(F.col("a"), F.col("b"), 2) >= 0)
    return pairs[0].unionByName(pairs[1]).where(near).distinct().mapInPandas(_near_words, "field_name string, a string, b string")


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        sims = []
        for r in b.itertuples(index=False):
            if r.field_name == "publisher":
                sims.append(same_house((r.kind_a, r.subject_a, list(r.family_a)), (r.kind_b, r.subject_b, list(r.family_b))))
            else:
                sims.append(same_person((list(r.given_a), list(r.family_a)), (list(r.given_b), list(r.family_b))))
        b = b.assign(sim=sims)
        yield b[b.sim > 0][["form_a", "form_b", "sim"]]


def links(spellings: DataFrame) -> DataFrame:
    """(form_a, form_b, sim) of verified forms, form_a < form_b."""
    each = spellings.groupBy("form").agg(*[F.first(c).alias(c) for c in ("field_name", "kind", "subject", "given", "family")])
    keys = stored(each.select("form", "field_name", "given", "family").mapInPandas(_keys, "form string, field_name string, word string, key string, leads boolean, exact boolean"), "keys")
    pairs = stored(word_pairs(keys.select("field_name", "word")), "words")
    pairs = pairs.unionByName(pairs.select("field_name", F.col("b").alias("a"), F.col("a").alias("b")))
    leading, all_ = keys.where("leads").select("field_name", "word", "key", F.col("form").alias("form_a")), keys.select("field_name", "word", "key", F.col("form").alias("form_b"))
    same = leading.join(all_, ["field_name", "word", "key"])
    to = keys.where("exact").select("field_name", F.col("word").alias("b"), "key", F.col("form").alias("form_b"))
    slipped = keys.where("leads and exact").select("field_name", F.col("word").alias("a"), "key", F.col("form").alias("form_a")).join(pairs, ["field_name", "a"]).join(to, ["field_name", "b", "key"])
    cand = same.select("form_a", "form_b").unionByName(slipped.select("form_a", "form_b"))
    cand = cand.where("form_a <> form_b").select(F.least("form_a", "form_b").alias("form_a"), F.greatest("form_a", "form_b").alias("form_b")).distinct()
    part = lambda c: each.select(F.col("form").alias(f"form_{c}"), *([F.col("field_name")] if c == "a" else []), *[F.col(x).alias(f"{x}_{c}") for x in ("kind", "subject", "given", "family")])
    return cand.join(part("a"), "form_a").join(part("b"), "form_b").mapInPandas(_verify, "form_a string, form_b string, sim double")


def star_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(form, center): greedy star clustering.

    ``nodes`` has form, fullness and weight.  A form whose rank (fullness, degree, weight) beats all its open neighbours is a
    center and closes them; rounds go on while forms are open, which gives the same centers as one ordered pass.  Every other form
    joins its most similar center, the more frequent one on ties.
    """
    both = edges.select(F.col("form_a").alias("u"), F.col("form_b").alias("v"), "sim").unionByName(edges.select(F.col("form_b").alias("u"), F.col("form_a").alias("v"), "sim"))
    degree = both.groupBy(F.col("u").alias("form")).agg(F.sum("sim").alias("degree"))
    ranked = nodes.join(degree, "form").select("form", "weight", F.struct("fullness", F.round("degree", 6).alias("degree"), "weight", "form").alias("rank"))
    r = lambda c: ranked.select(F.col("form").alias(c), F.col("rank").alias(f"r{c}"), F.col("weight").alias(f"w{c}"))
    graph = stored(both.join(r("u"), "u").join(r("v"), "v"), "star")
    live, centers = graph.select("u", "v", "ru", "rv"), None
    while True:  # the graph of open forms shrinks from round to round
        new = stored(live.groupBy(F.col("u").alias("form")).agg(F.max("rv").alias("top"), F.max("ru").alias("own")).where("own > top").select("form"), "centers")
        closed = live.join(new.select(F.col("form").alias("v")), "v", "left_semi").select(F.col("u").alias("form"))
        gone = stored(new.unionByName(closed).distinct(), "gone")
        left = live.join(gone.select(F.col("form").alias("u")), "u", "left_anti")
        rest = stored(left.join(gone.select(F.col("form").alias("v")), "v", "left_anti"), "live")
        alone = left.select(F.col("u").alias("form")).distinct().join(rest.select(F.col("u").alias("form")), "form", "left_anti")  # all its neighbours are closed
        for found in (new, alone):
            centers = found if centers is None else centers.unionByName(found)
        live = rest
        if live.isEmpty():
            break
    centers = stored(centers, "all_centers")
    to = graph.join(centers.select(F.col("form").alias("v")), "v", "left_semi").join(centers.select(F.col("form").alias("u")), "u", "left_anti")
    best = to.groupBy(F.col("u").alias("form")).agg(F.max_by("v", F.struct(F.round("sim", 3), "wv", "v")).alias("center"))
    return best.unionByName(centers.select("form", F.col("form").alias("center")))


def entities(names: DataFrame) -> DataFrame:
    """(field_name, name, n, entity): the entity of every distinct spelling (field_name, name, n)."""
    spellings = forms(names)
    first = F.get("given", F.lit(0))
    fullness = F.when(F.size("given") == 0, 2).when(F.length(first) == 1, 0).when(first.isin(*FORMAL), 1).otherwise(2)
    nodes = spellings.groupBy("form").agg(F.max(fullness).alias("fullness"), F.sum("n").alias("weight"))
    stars = star_clusters(nodes, stored(links(spellings), "links"))
    return spellings.join(stars, "form", "left").select("field_name", "name", "n", F.coalesce("center", "form").alias("entity"))


def variant_pairs(names: DataFrame) -> DataFrame:
    """(field_name, name_a, name_b): pairs of spellings of one entity, name_a < name_b by code points."""
    e = stored(entities(names), "entities")
    a, b = e.select("field_name", "entity", F.col("name").alias("name_a")), e.select("field_name", "entity", F.col("name").alias("name_b"))
    return a.join(b, ["field_name", "entity"]).where("name_a < name_b").select("field_name", "name_a", "name_b")


def distinct_names(books: DataFrame) -> DataFrame:
    """Distinct spellings of creators (by element) and publishers, counted before the shuffle."""
    c = books.select(F.lit("creators").alias("field_name"), F.explode("creators").alias("name"))
    p = books.select(F.lit("publisher").alias("field_name"), F.col("publisher").alias("name"))
    return c.unionByName(p).where("name is not null").groupBy("field_name", "name").agg(F.count(F.lit(1)).alias("n"))
