"""Repair of texts from scanned pages: divided words, misread characters, running headers and page numbers.

Lines are classified per text; the words of all text lines make a frequency lexicon of the corpus.  A symmetric-delete index
over the lexicon (every word under the forms of its first letters with up to two left out) brings rare words together with frequent ones; a
weighted edit distance of the whole words, cheap only for the pairs a scanner confuses, keeps the candidates, and counts of the words and of their
bigrams with both neighbours pick the repair.  Words that are frequent themselves are repaired only where the bigrams speak for the
other word.  A word divided at a line's end is joined when the corpus knows the whole rather than the compound.

A word is a run of letters and digits of any length, so misreadings that put another sign into a word (l as !, c as a bracket) are not looked for.

Defined results: null, empty and blank texts have no lines to repair; of several equally good repairs the more frequent, then the
first in order, counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import parts, stored
from . import layout

# What is printed and what the scanner reads, letter by letter; then accents that get lost.
CONFUSIONS = """e c|c e|n ri|ri n|r i|i r|a o|o a|s 5|t f|f t|d cl|cl d|o 0|i l|l i|i j|j i|l 1|i 1|t l|l t|h li|li h|h b|b h|u ii|ii u|ü ii|m rn|rn m|g 9|q 9|b 6|v y|y v|w vv|vv w|é 6|ó 6
n u|u n|b 8|s 8|g 6|z 2|g q|q g|tt n|m nn|m in|in m|ni m|o c|c o|o e|e o|ß b|ß 8|o 6|a e|e a|d ol|k lc|fi fl|h ii|n ii|u ll|f l|t i|i t|y 7|a 4|e 3|t 7|d 0""".replace("\n", "|").split("|")
ACCENTS = "ä a|ö o|ü u|é e|è e|ê e|à a|á a|â a|í i|ó o|ô o|ú u|û u|ñ n|ø o|ç c|ß s".split("|")
_PAIRS: list[tuple[str, str, float]] = [(*p.split(" "), 0.3) for p in CONFUSIONS] + [(*p.split(" "), 0.4) for p in ACCENTS]
#: First letters of a word that are indexed, letters left out of them, and the most letters of words that lose only one.
PREFIX, LEFT_OUT, SHORT = 10, 2, 4
#: A target must occur LEAST times and RATIO times as often as the word it replaces, and that word no more often than scanners
#: err: SLACK times, and once in every PER_ERROR of the target.  The rate counts from LEAST other words that show it.
RATIO, LEAST, SLACK, PER_ERROR = 8, 4, 3, 250
#: Or no more often than the scanner's own rate for that confusion leads to expect, so many deviations above it included.
SPREAD = 4
#: By how many times the bigrams must speak for the other word where both words are frequent.
CONTEXT_RATIO = 20

_TOKEN = re.compile(r"[^\W_]+(?:[’'](?=[^\W\d_]))?")
_SIGNS = "-‐‑¬\xad"
_FIRST = re.compile(r"\W*[^\W_]")
_SOFT = "\xad\u200b\u200c\u200d\u2060\ufeff"
_CLEAN = str.maketrans({ch: None for ch in _SOFT})
_BLANKS = " \t\r\f\xa0"


@lru_cache(200_000)
def weighted(read: str, printed: str) -> float:
    """Cost of reading ``printed`` as ``read``: confusions 0.3, lost accents 0.4, at most two of them; else infinite."""
    inf = float("inf")
    if abs(len(read) - len(printed)) > 2:
        return inf
    n, m = len(printed), len(read)
    ahead: list[dict[tuple[int, int], float]] = [{} for _ in range(n + 1)]  # after i letters printed: (letters read, confusions) at the least cost
    ahead[0][0, 0] = 0.0
    for i in range(n):
        for (j, used), cost in ahead[i].items():
            if j < m and printed[i] == read[j] and cost < ahead[i + 1].get((j + 1, used), inf):
                ahead[i + 1][j + 1, used] = cost
            if used < 2:
                for a, b, more in _STARTING.get(printed[i], ()):
                    if printed.startswith(a, i) and read.startswith(b, j) and cost + more < ahead[i + len(a)].get((j + len(b), used + 1), inf):
                        ahead[i + len(a)][j + len(b), used + 1] = cost + more
        ahead[i] = {}
    return min((cost for (j, _), cost in ahead[n].items() if j == m), default=inf)


_STARTING: dict[str, list[tuple[str, str, float]]] = {}
for _pair in _PAIRS:
    _STARTING.setdefault(_pair[0][0], []).append(_pair)


def _break(line: str) -> tuple[str, str] | None:
    """The word part and the sign at a line's end."""
    if not line or line[-1] not in _SIGNS:
        return None
    i = end = len(line) - 1
    while i and line[i - 1].isalnum():
        i -= 1
    return (line[i:end], line[end]) if i < end else None


def _words(line: str) -> list[str]:
    found = _TOKEN.findall(line)
    return [w.rstrip("’'") for w in found] if "'" in line or "’" in line else found


def _clean_lines(text: str) -> list[str]:
    """The lines without invisible characters, but for a soft hyphen that ends a line."""
    lines = text.split("\n")
    if any(ch in text for ch in _SOFT):
        lines = [x.translate(_CLEAN) if (end := x.rstrip())[-1:] != "\xad" else end.translate(_CLEAN) + "\xad" for x in lines]
    return [x.strip(_BLANKS) for x in lines]


def scan_text(text: str, known: list[str]) -> tuple[list[str], list[tuple], list[tuple], list[tuple]]:
    """(kinds of the lines, words, breaks, compounds) of one text, line numbers from 1.

    Words are (line, words in lower case, first and last + 1 of those that stand whole in it); breaks are (line, line of the rest, left, right, sign, before, after).
    """
    kinds = layout.classify(text, known)
    lines = _clean_lines(text)
    flow = [i for i, k in enumerate(kinds) if k in (layout.BODY, layout.HEADING)]
    words, breaks, compounds, carried = [], [], [], False
    for n, i in enumerate(flow):
        line = lines[i]
        found = _words(line.lower())
        if any(sign in line for sign in "-‐‑"):
            spots = [(m.group().rstrip("’'"), m.start(), m.end()) for m in _TOKEN.finditer(line)]
            compounds += [(a[0].lower(), b[0].lower()) for a, b in zip(spots, spots[1:], strict=False) if b[1] - a[2] == 1 and line[a[2]] in "-‐‑"]
        cut = False
        if kinds[i] == layout.BODY and (m := _break(line)):
            left, sign = m
            if n + 1 == len(flow):  # the text ends inside a word
                breaks.append((i + 1, 0, left, "", sign, "", ""))
            elif kinds[flow[n + 1]] == layout.BODY and _FIRST.match(following := lines[flow[n + 1]]):
                rest = _words(following)
                if rest and found and found[-1] == left.lower():
                    cut = True
                    breaks.append((i + 1, flow[n + 1] + 1, left, rest[0], sign, found[-2] if len(found) > 1 else "", rest[1].lower() if len(rest) > 1 else ""))
        if found:
            words.append((i + 1, found, int(carried), len(found) - cut))
        carried = cut
    return kinds, words, breaks, compounds


_SCANNED = "book_id bigint, what string, line_no int, line2 int, a string, b string, sign string, before string, after string, n bigint, words array<string>, lo int, hi int"
_LETTERS = {layout.BLANK: "_", layout.BODY: "b", layout.HEADING: "h", layout.HEADER: "H", layout.PAGE_NUMBER: "p"}


#: Rows of an Arrow batch that the scan hands to the JVM, and bytes of its input that a task takes.
SCAN_ROWS, SCAN_BYTES = 8_192, 16 << 20


def _scan(batches: Iterator) -> Iterator:
    """Arrow batches of (book_id, text, known) as rows of lines, words and breaks, handed over in batches of even size."""
    import pyarrow as pa

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    names, types = zip(*[(c.split()[0], kinds[c.split()[1]]) for c in _SCANNED.split(", ")], strict=True)
    rows: list[tuple] = []
    none = (None, 0, 0)

    def batch():
        columns = zip(*rows, strict=True) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    for part in batches:
        compounds: Counter[tuple[str, str]] = Counter()
        for book, text, known in zip(*(part.column(c).to_pylist() for c in ("book_id", "text", "known")), strict=True):
            kinds_, words, breaks, pairs = scan_text(text, [k for k in known or () if k])
            compounds.update(pairs)
            rows.append((book, "kinds", 0, 0, "".join(map(_LETTERS.get, kinds_)), "", "", "", "", 0, *none))
            rows += [(book, "words", i, 0, "", "", "", "", "", 0, w, lo, hi) for i, w, lo, hi in words]
            rows += [(book, "break", i, j, a, b, s, p, n, 0, *none) for i, j, a, b, s, p, n in breaks]
            if len(rows) >= SCAN_ROWS:
                yield batch()
                rows.clear()
        rows += [(None, "compound", 0, 0, a, b, "", "", "", n, *none) for (a, b), n in compounds.items()]
    yield batch()


def scan(texts: DataFrame) -> DataFrame:
    """Lines, words and breaks of (book_id, text, known), stored once; texts are spread evenly, by their bytes, as each costs CPU."""
    x = texts.select("book_id", "text", "known").where(F.col("text").rlike(r"(?U)\S"))
    return stored(x.repartition(parts(x, SCAN_BYTES), "book_id").mapInArrow(_scan, _SCANNED), "scan", ["what"])


def furniture(scanned: DataFrame) -> DataFrame:
    """(book_id, line_no, issue) of the running headers and page numbers."""
    kinds = scanned.where("what = 'kinds'").select("book_id", F.posexplode(F.split("a", "")).alias("i", "k")).where(F.col("k").isin("H", "p"))
    return kinds.select("book_id", (F.col("i") + 1).alias("line_no"), F.when(F.col("k") == "H", layout.HEADER).otherwise(layout.PAGE_NUMBER).alias("issue"))


def whole_words(scanned: DataFrame) -> DataFrame:
    """(book_id, line_no, w, p, q): every word that stands whole in its line, with the words before and after it there."""
    x = scanned.where("what = 'words'").select("book_id", "line_no", "words", "lo", "hi", F.posexplode("words").alias("i", "w")).where("i >= lo and i < hi")
    beside = lambda k: F.coalesce(F.when(F.col("i") + k >= 0, F.get("words", F.col("i") + k)), F.lit(""))
    return x.select("book_id", "line_no", "w", beside(-1).alias("p"), beside(1).alias("q"))


def deletes(w: str) -> set[str]:
    """The first letters of a word with none, one or (in longer words) two left out, never all."""
    forms = new = {w[:PREFIX]}
    for _ in range(LEFT_OUT if len(w) > SHORT else 1):
        new = {f[:i] + f[i + 1 :] for f in new for i in range(len(f)) if len(f) > 1}
        forms = forms | new
    return forms


def reversals(w: str) -> set[str]:
    """What a short word may be misread from by one confusion, or by two if digits stand in it; its letters are too few to leave out two."""
    found: set[str] = set()
    if len(w) <= SHORT + 2:
        last = {w}
        for _ in range(2 if any(map(str.isdigit, w)) else 1):
            last = {x[:i] + a + x[i + len(b) :] for x in last for a, b, _ in _PAIRS for i in range(len(x)) if x.startswith(b, i)}
            found |= last
    return found


def _index(both: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(w, n, f) for w, n in zip(b.w, b.n, strict=True) for f in (deletes(w) | reversals(w) if both else deletes(w))]
            yield pd.DataFrame(rows, columns=["w", "n", "rest"])

    return each


def confusion(read: str, printed: str) -> str | None:
    """The one confusion, as in the table, that makes ``read`` of ``printed``; null if it takes more."""
    for a, b, _ in _PAIRS:
        i = printed.find(a)
        while i >= 0:
            if printed[:i] + b + printed[i + len(a) :] == read:
                return f"{a} {b}"
            i = printed.find(a, i + 1)
    return None


def _weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b = b.assign(cost=[weighted(w, v) for w, v in zip(b.w, b.v, strict=True)])
        b = b[b.cost < 1]
        pair = [confusion(w, v) for w, v in zip(b.w, b.v, strict=True)]
        yield b.assign(pair=pair, times=[v.count(p.split(" ")[0]) if p else 0 for v, p in zip(b.v, pair, strict=True)])


def _printed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How often the letters of each confusion are printed; one row each for a batch."""
    letters = sorted({a for a, _, _ in _PAIRS})
    for b in batches:
        yield pd.DataFrame([(a, sum(w.count(a) * n for w, n in zip(b.w, b.n, strict=True))) for a in letters], columns=["letters", "m"])


def rates(found: DataFrame, words: DataFrame) -> DataFrame:
    """(pair, read, kinds, printed): how often each confusion happens in all words, in how many different ones, and to how many letters it might."""
    single = found.where(f"pair is not null and n > 0 and nv >= {RATIO} * n").groupBy("pair", "w").agg(F.max("n").alias("n"))
    read = single.groupBy("pair").agg(F.sum("n").alias("read"), F.count(F.lit(1)).alias("kinds")).withColumn("letters", F.substring_index("pair", " ", 1))
    return read.join(words.mapInPandas(_printed, "letters string, m bigint").groupBy("letters").agg(F.sum("m").alias("printed")), "letters").drop("letters")


def lexicon(scanned: DataFrame) -> DataFrame:
    """(w, n): how often each word, in lower case, stands whole in a text line; combined before the shuffle."""
    words = scanned.where("what = 'words'").select(F.explode(F.slice("words", F.col("lo") + 1, F.greatest(F.col("hi") - F.col("lo"), F.lit(0)))).alias("w"))
    return stored(words.groupBy("w").agg(F.count(F.lit(1)).alias("n")), "lexicon")


def candidates(lex: DataFrame, whole: DataFrame) -> DataFrame:
    """(w, n, v, nv, cost): words of ``lex`` or ``whole`` (joined words) with what they may be misread from.

    Either the printed word is much more frequent, or both are frequent and only the bigrams can tell.
    """
    joined = whole.select("w").distinct().join(lex, "w", "left_anti").select("w", F.lit(0).cast("bigint").alias("n"))
    words = lex.unionByName(joined).where((F.length("w") >= 2) & F.col("w").rlike(r"\p{L}") & ~F.col("w").rlike("^[ivx]+$"))
    left = words.mapInPandas(_index(True), "w string, n bigint, rest string")
    right = words.where(f"n >= {LEAST}").where(F.col("w").rlike(r"^\D+$")).mapInPandas(_index(False), "w string, n bigint, rest string").select("rest", F.col("w").alias("v"), F.col("n").alias("nv"))
    pairs = left.join(right, "rest").where((F.col("w") != F.col("v")) & (F.abs(F.length("w") - F.length("v")) <= 2) & (F.col("nv") * 50 >= F.col("n")))
    pairs = pairs.where(F.levenshtein("w", "v", 4) >= 0)  # what two confusions can make of a word
    pairs = pairs.select("w", "n", "v", "nv").distinct()
    found = stored(pairs.mapInPandas(_weigh, "w string, n bigint, v string, nv bigint, cost double, pair string, times int"), "weighed")
    found = found.join(rates(found, words), "pair", "left")
    own = F.col("nv") * F.col("times")  # a word is no witness for itself
    expected = F.when((F.col("kinds") > LEAST) & (F.col("printed") > own), own * F.greatest(F.col("read") - F.col("n"), F.lit(0)) / (F.col("printed") - own))
    found = found.withColumn("most", F.coalesce(expected + SPREAD * F.sqrt(expected), F.lit(0.0)))
    found = found.withColumn("rare", (F.col("nv") >= RATIO * F.col("n")) & (F.col("n") <= SLACK + F.greatest(F.col("nv") / PER_ERROR, "most")))
    return stored(found.where("rare or cost <= 0.3").select("w", "n", "v", "nv", "cost", "rare"), "candidates")


def repairs(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word repairs, joined breaks).

    Word repairs: (book_id, line_no, w, v), one for each misread word of a line.  Joined breaks: (book_id, line_no, line2, a, b, w), the
    words that were divided only because the line ended.
    """
    lex = lexicon(scanned)
    breaks = scanned.where("what = 'break'").select("book_id", "line_no", "line2", "a", "b", "sign", "before", "after")
    forms = breaks.groupBy(F.lower("a").alias("l"), F.lower("b").alias("r"), F.col("b").rlike(r"^\p{Lu}").alias("capital"), F.col("sign").isin("¬", "\xad").alias("soft")).agg(F.count(F.lit(1)).alias("k"))
    forms = stored(forms.withColumn("w", F.concat("l", "r")), "breaks")
    cand = candidates(lex, forms)

    # what the corpus knows of the joined word, of its halves and of the compound
    best = cand.where("rare").groupBy("w").agg(F.max_by("v", F.struct(-F.col("cost"), "nv", "v")).alias("v"), F.max_by("nv", F.struct(-F.col("cost"), "nv", "v")).alias("nv"))
    best = stored(best, "best")
    compounds = stored(scanned.where("what = 'compound'").groupBy(F.col("a").alias("cl"), F.col("b").alias("cr")).agg(F.sum("n").alias("nc")), "compounds")
    known = lambda c: lex.select(F.col("w").alias(c), F.col("n").alias(f"n_{c}"))
    fixed = lambda c: best.select(F.col("w").alias(c), F.col("v").alias(f"v_{c}"), F.col("nv").alias(f"nv_{c}"))
    d = forms
    for c in ("w", "l", "r"):
        d = d.join(known(c), c, "left").join(fixed(c), c, "left")
    d = d.withColumn("cl", F.coalesce("v_l", "l")).withColumn("cr", F.coalesce("v_r", "r")).join(compounds, ["cl", "cr"], "left")
    plain = compounds.select(F.col("cl").alias("l"), F.col("cr").alias("r"), F.col("nc").alias("np"))
    d = d.join(plain, ["l", "r"], "left")
    as_one = F.greatest(F.coalesce("n_w", F.lit(0)), F.coalesce("nv_w", F.lit(0)))
    as_two = F.greatest(F.coalesce("nc", F.lit(0)), F.coalesce("np", F.lit(0)))
    both_known = (F.coalesce("n_l", F.lit(0)) >= LEAST) & (F.coalesce("n_r", F.lit(0)) >= LEAST)
    divided = F.when(F.col("r") == "", F.col("soft") | (F.coalesce("n_l", F.lit(0)) < LEAST)).when(as_one > as_two, True).when(as_two > 0, False).when(F.col("capital"), False).when(F.col("soft"), True).otherwise(~both_known)
    d = stored(d.select("l", "r", "capital", "soft", "w", divided.alias("divided")), "decisions")
    b = breaks.withColumns({"l": F.lower("a"), "r": F.lower("b"), "capital": F.col("b").rlike(r"^\p{Lu}"), "soft": F.col("sign").isin("¬", "\xad")})
    b = b.join(d, ["l", "r", "capital", "soft"])
    joined = b.where("divided").select("book_id", "line_no", "line2", "a", "b", "w")

    # all occurrences of words with a candidate: whole ones, joined ones, and the halves of compounds
    occ = whole_words(scanned).select("book_id", "line_no", F.lit(0).alias("line2"), F.lit(0).alias("at"), "w", "p", "q")
    b = b.where("b <> ''")
    one = b.where("divided").select("book_id", "line_no", "line2", F.length("a").alias("at"), "w", F.col("before").alias("p"), F.col("after").alias("q"))
    two = b.where("not divided").select("book_id", F.explode(F.array(F.struct("line_no", F.col("l").alias("w"), F.col("before").alias("p"), F.col("r").alias("q")), F.struct(F.col("line2").alias("line_no"), F.col("r").alias("w"), F.col("l").alias("p"), F.col("after").alias("q")))).alias("h"))
    two = two.select("book_id", F.col("h.line_no").alias("line_no"), F.lit(0).alias("line2"), F.lit(0).alias("at"), F.col("h.w").alias("w"), F.col("h.p").alias("p"), F.col("h.q").alias("q"))
    suspects = stored(cand.select("w").distinct(), "suspects")
    seen = stored(occ.unionByName(one).unionByName(two).join(suspects, "w", "left_semi"), "seen")

    # bigrams of the words in question only
    targets = stored(cand.select(F.col("v").alias("w")).unionByName(cand.select("w")).distinct(), "targets")
    text = whole_words(scanned).select("w", "p", "q").join(targets, "w", "left_semi")
    sides = text.select("w", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("p").alias("x")), F.struct(F.lit(1).alias("side"), F.col("q").alias("x")))).alias("s"))
    grams = stored(sides.where("s.x <> ''").groupBy("w", F.col("s.side").alias("side"), F.col("s.x").alias("x")).agg(F.count(F.lit(1)).alias("c")), "bigrams")
    before, after = grams.where("side = 0").select(F.col("w").alias("v"), F.col("x").alias("p"), "c"), grams.where("side = 1").select(F.col("w").alias("v"), F.col("x").alias("q"), "c")
    spots = seen.groupBy("w", "p", "q").agg(F.count(F.lit(1)).alias("k"))
    tried = spots.join(cand, "w")
    score = lambda x, col, tag: x.join(before.select(F.col("v").alias(col), "p", F.col("c").alias(f"{tag}0")), [col, "p"], "left").join(after.select(F.col("v").alias(col), "q", F.col("c").alias(f"{tag}1")), [col, "q"], "left")
    tried = score(score(tried, "v", "v"), "w", "w").fillna(0, ["v0", "v1", "w0", "w1"])
    ours, theirs = F.greatest(F.col("w0") + F.col("w1") - 2, F.lit(0)), F.col("v0") + F.col("v1")
    speaks = (F.col("v0") > 0) & (F.col("v1") > 0) & (theirs >= CONTEXT_RATIO * (ours + 1))
    kept = tried.where(F.col("rare") | speaks)
    rank = F.struct(F.log1p(theirs.cast("double")) - 6 * F.col("cost"), "nv", "v")
    picked = kept.groupBy("w", "p", "q").agg(F.max_by("v", rank).alias("v"))
    picked = stored(picked, "picked")
    fixes = seen.join(picked, ["w", "p", "q"])

    # a joined word's repair belongs to the line that holds the changed letters
    same = lambda x, y: F.array_position(F.zip_with(F.split(x, ""), F.split(y, ""), lambda a, b: a.eqNullSafe(b)), F.lit(False)) - 1  # letters before the first that differs
    least = F.least(F.length("w"), F.length("v"))
    fixes = fixes.withColumn("_front", F.least(same(F.col("w"), F.col("v")), least)).withColumn("_back", F.least(same(F.reverse("w"), F.reverse("v")), least - F.col("_front"))).withColumn("_end", F.length("w") - F.col("_back"))
    line = F.when((F.col("line2") == 0) | (F.col("_front") < F.col("at")), F.array("line_no")).otherwise(F.array())
    line2 = F.when((F.col("line2") > 0) & (F.col("_end") > F.col("at")), F.array("line2")).otherwise(F.array())
    fixes = fixes.select("book_id", F.explode(F.concat(line, line2)).alias("line_no"), "w", "v")
    return fixes, joined


def found(texts: DataFrame) -> DataFrame:
    """(book_id, line_no, issue) of (book_id, text, known), one row per line and issue."""
    scanned = scan(texts)
    fixes, joined = repairs(scanned)
    lines = joined.select("book_id", "line_no", F.lit("hyphen").alias("issue")).unionByName(fixes.select("book_id", "line_no", F.lit("misread").alias("issue"))).distinct()
    return furniture(scanned).unionByName(lines)


def _like_case(word: str, repaired: str) -> str:
    if word.isupper() and len(word) > 1:
        return repaired.upper()
    return repaired[:1].upper() + repaired[1:] if word[:1].isupper() else repaired


def _apply(line: str, fixes: dict[str, str]) -> str:
    """A line with its misread words replaced, in the case they had."""
    return _TOKEN.sub(lambda m: _like_case(m.group(), fixes[k]) if (k := m.group().lower()) in fixes else m.group(), line) if fixes else line


def assemble(text: str, kinds: str, fixes: list[tuple[int, str, str]], joined: list[tuple[int, int, str, str]]) -> str:
    """Continuous paragraphs: furniture left out, divided words joined, misread words replaced, lines of a paragraph run on.

    ``kinds`` has a letter for each line.  Where no word was divided and most lines end a sentence, each line is a paragraph.
    """
    by_line: dict[int, dict[str, str]] = {}
    for i, w, v in fixes:
        by_line.setdefault(i, {})[w] = v
    cuts = {i: (j, a, b) for i, j, a, b in joined}
    raw, lines = text.split("\n"), [x.translate(_CLEAN).strip(_BLANKS) for x in text.split("\n")]
    body = [x for x, k in zip(lines, kinds, strict=True) if k == "b" and x]
    unbroken = not joined and 5 * sum(_CLOSED.search(x) is not None for x in body) >= 4 * len(body)
    following = BLANK = _LETTERS[layout.BLANK]
    after = [following := k if k != BLANK else following for k in reversed(kinds)][::-1]  # kind of this line or, if blank, of the next that is not
    out: list[str] = []
    parts: list[str] = []
    skip_first: str | None = None

    def close() -> None:
        if any(parts):
            out.append("".join(parts))
        parts.clear()

    for i, (line, kind) in enumerate(zip(lines, kinds, strict=True), 1):
        if kind in "Hp":
            continue
        ended = next((_CLOSED.search(x) is not None for x in reversed(parts) if x), False)
        if kind == BLANK:
            if ended and after[i - 1] not in "Hp":
                close()
            continue
        if skip_first is not None and line.lower().startswith(skip_first.lower()):
            line = line[len(skip_first) :].lstrip()
        skip_first = None
        indented = len(raw[i - 1]) - len(raw[i - 1].lstrip(" \t\f")) >= 2
        alone = kind == _LETTERS[layout.HEADING] or unbroken or layout._LIST_ITEM.search(line) is not None
        if alone or indented and ended:
            close()
        fixed = by_line.get(i, {})
        if i in cuts:
            _, a, b = cuts[i]
            stem = line.rstrip(_SIGNS)
            k = len(stem)
            while k and stem[k - 1].isalnum():
                k -= 1
            whole = fixed.get((a + b).lower()) or by_line.get(cuts[i][0], {}).get((a + b).lower())
            line = _apply(stem[:k], fixed) + (_like_case(a, whole) if whole else a + b)
            skip_first = b
        else:
            line = _apply(line, fixed)
        if line:
            before = next((x for x in reversed(parts) if x), "")
            if before and not _HYPHENATED.search(before):
                parts.append(" ")
            parts.append(line)
        if alone:
            close()
    close()
    return "\n\n".join(out)


_CLOSED = re.compile(r"[.!?:”“»\"…]\Z")
_HYPHENATED = re.compile(r"[^\W_][-‐‑]\Z")


def repaired(texts: DataFrame) -> DataFrame:
    """(book_id, text): the repaired paragraphs of every text; a text's repairs, bounded by its own words, meet it once."""
    texts = texts.select("book_id", "text", "known")
    scanned = scan(texts)
    fixes, joined = repairs(scanned)
    f = fixes.distinct().groupBy("book_id").agg(F.collect_list(F.struct("line_no", "w", "v")).alias("fixes"))
    j = joined.groupBy("book_id").agg(F.collect_list(F.struct("line_no", "line2", "a", "b")).alias("joined"))
    k = scanned.where("what = 'kinds'").select("book_id", F.col("a").alias("kinds"))
    x = texts.join(k, "book_id", "left").join(f, "book_id", "left").join(j, "book_id", "left")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if r.kinds is None:  # null, or nothing to read
                    out.append((r.book_id, None if r.text is None else ""))
                    continue
                fx = [] if r.fixes is None else [(q["line_no"], q["w"], q["v"]) for q in r.fixes]
                jn = [] if r.joined is None else [(q["line_no"], q["line2"], q["a"], q["b"]) for q in r.joined]
                out.append((r.book_id, assemble(r.text, r.kinds, fx, jn)))
            yield pd.DataFrame(out, columns=["book_id", "text"])

    return x.select("book_id", "text", "kinds", "fixes", "joined").mapInPandas(each, "book_id bigint, text string")


def book_texts(books: DataFrame) -> DataFrame:
    """(book_id, text, known): scanned texts with the titles and makers a running header may name."""
    known = F.concat(F.array("title", "title_sort", "short_title", "short_folder"), F.coalesce("creators", F.array().cast("array<string>")))
    return books.where("doc_text is not null").select("book_id", F.col("doc_text").alias("text"), known.alias("known"))
