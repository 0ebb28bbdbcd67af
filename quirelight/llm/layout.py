"""What each line of a scanned text is: page number, running header, heading, text or blank.

What a line says of its page does not depend on how long lines are, and a line is compared only with those at most ``SPAN`` to twice ``SPAN`` lines (six
pages and more) away, as pages follow each other; so the work grows with the text, however many of its lines could be headers.
"""

from __future__ import annotations

import difflib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable
from functools import lru_cache
from itertools import pairwise

BLANK, BODY, HEADING, HEADER, PAGE_NUMBER = "blank", "body", "heading", "header", "page_number"

#: Most lines of a page, most pages that a chain of numbers may leap, and the lines that these make.
PAGE_LINES, LEAP = 75, 6
SPAN = PAGE_LINES * LEAP + 10

# Signs around page numbers, and what stands before and between them.
_ORNAMENT = " \t\r\f\v\xa0\u3000\ufeff~[](){}<>=_*·•.:–—‐‑-"
_PAGE_NUMBER = re.compile(r"(page|seite|pagina|página|p\.|s\.|pág\.)?\s*([0-9oOlIiSsBgz|]{1,5}|[ivxlcjIVXLCJ1]{1,9})(\s*(?:/|of|von|de|sur)\s*[0-9oOlISB]{1,5})?", re.IGNORECASE)
_NUMBER_BEGINS, _NUMBER_ENDS = set("0123456789oOlIiSsBgGzZ|pPvVxXcCjJbL"), set("0123456789oOlIiSsBgGzZ|vVxXcCjJbL")
_LONGEST_NUMBER = 26  # characters that the pattern can span where blanks are single
_HEADING = re.compile(r"^(?:(?:chapter|kapitel|chapitre|cap[ií]tulo|teil|part|partie|parte|book|buch|livre|libro)\s+[\dIVXLl]+\b|§\s*[\dl]+|[\dlI]{1,2}\.\s+\S|(?:II|III|IV|VI|VII|VIII|IX|XI|XII)\.\s+\S)", re.IGNORECASE)
_EDGE_NUMBER = re.compile(r"^(?:([\dlOoSIB]{1,4}|[ivxlc]{1,8})(?:\s{2,}|\s*[|·•–—]\s*))?(.*?)(?:(?:\s{2,}|\s*[|·•–—]\s*)([\dlOoSIB]{1,4}|[ivxlc]{1,8}))?$")
_LIST_ITEM = re.compile(r"^[–•*·-]\s.*\.{3,}\s*\d+$|\.{4,}")
_EDGE_SIGN = re.compile(r"\s{2}|[|·•–—]")
_TWO_LETTERS = re.compile(r"[^\W\d_]{2}")
_SENTENCE_GOES_ON = re.compile(r"\w{3}[.!?;:]”? ")
_ENDS_TEXT = set(".!?;,»”“\"…")
_AS_DIGIT = str.maketrans("oOlIiSsBgz|", "00111558921")


def _strip(line: str) -> str:
    return line.strip(" \t\r\f\v\xa0 \u3000\ufeff")


def plain(s: str) -> str:
    """Letters and digits of a text, line by line, in a form that misread characters do not change much."""
    s = (s if s.isascii() else unicodedata.normalize("NFKD", s)).casefold()
    for ch in set(s):
        if not ch.isalnum() and ch != "\n":
            s = s.replace(ch, "")
        elif ord(ch) in _LOOSE:
            s = s.replace(ch, _LOOSE[ord(ch)])
    return s


# Letters that a scanner takes for each other, as one letter.
_LOOSE = str.maketrans({"1": "i", "l": "i", "j": "i", "r": "i", "t": "f", "5": "s", "0": "o", "a": "o", "6": "b", "h": "b", "9": "g", "y": "v", "e": "c"})


@lru_cache(4096)
def _grams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 2] for i in range(len(s) - 1))


@lru_cache(4096)
def _joined(s: str) -> str:
    """A plain form in which the letters that a scanner splits in two are one again."""
    for a, b in (("vv", "w"), ("in", "m"), ("ci", "d"), ("ii", "h")):
        s = s.replace(a, b)
    return s


def like(a: str, b: str, least: float = 0.84) -> bool:
    """Whether two lines in plain form say the same."""
    if abs(len(a) - len(b)) > 0.35 * max(len(a), len(b)) + 1:
        return False
    return _near(a, b, least) or _near(_joined(a), _joined(b), least)


def _near(a: str, b: str, least: float) -> bool:
    if a == b:
        return bool(a)
    if not a or not b or abs(len(a) - len(b)) > 0.2 * max(len(a), len(b)) + 1:
        return False
    gb = _grams(b)
    shared = sum(map(a.__contains__, gb))  # pairs of letters of both
    if shared < 0.55 * len(gb) or shared < 0.55 * len(_grams(a)):  # far apart: spares the alignment
        return False
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() >= least


def fits(line: int, name: int) -> bool:
    """Whether a line is of a length to say a name."""
    return name * 0.3 <= line <= name * 1.6 + 2


def repeats(line: str, name: str) -> bool:
    """Whether a line says a name, whole or cut at the page's width; both in plain form."""
    if not fits(len(line), len(name)):
        return False
    return like(line, name) or 8 <= len(line) < len(name) <= 3 * len(line) and like(line, name[: len(line)])


def roman(s: str) -> int | None:
    s = s.casefold().replace("j", "i").replace("1", "l")
    if not re.fullmatch(r"c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,4})", s) or not s:
        return None
    of = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    v = [of[ch] for ch in s]
    return sum(-a if a < b else a for a, b in pairwise([*v, 0]))


def page_value(line: str) -> tuple[str, int, bool] | None:
    """(script, number, ornamented) of a line that could hold only a page's number."""
    for signs in (_ORNAMENT, _ORNAMENT + "|"):  # an upright may be an ornament or a digit
        core = line.strip(signs)
        if core[:1] not in _NUMBER_BEGINS or core[-1:] not in _NUMBER_ENDS:
            continue
        if len(core) > _LONGEST_NUMBER:
            core = " ".join(core.split())
        m = _PAGE_NUMBER.fullmatch(core) if 0 < len(core) <= _LONGEST_NUMBER else None
        if not m:
            continue
        word, num, total = m.groups()
        at = line.find(core[0])
        ornamented = bool(word or total or (line[:at].strip() and line.rstrip()[::-1].split(core[-1], 1)[0].strip(" .:")))
        digits = sum(ch.isdigit() for ch in num)
        if digits and (digits * 2 >= len(num) or len(num) > 2):
            value = num.translate(_AS_DIGIT)
            return ("arabic", int(value), ornamented) if value.isdigit() else None
        r = roman(num)
        if r is None and len(num) > 1 and set(num) <= set("oOlI|"):  # every digit misread
            return "arabic", int(num.translate(_AS_DIGIT)), ornamented
        return None if r is None else ("roman", r, ornamented)
    return None


def _sequence(found: list[tuple[int, str, int, bool]]) -> set[int]:
    """Line indexes of the candidates that count pages: the longest chain of growing numbers at even distances."""
    best: list[tuple[int, int | None]] = []
    holders: dict[tuple[str, int], list[int]] = {}
    for k, (i, script, v, _) in enumerate(found):
        length, link = 1, None
        for step in range(1, LEAP + 1):
            for j in reversed(holders.get((script, v - step), ())):  # the nearest first, no further than so many pages allow
                gap = i - found[j][0]
                if gap > PAGE_LINES * step + 10:
                    break
                if gap >= 8 * step and (best[j][0] + 1 > length or best[j][0] + 1 == length and link is not None and j < link):
                    length, link = best[j][0] + 1, j
        best.append((length, link))
        holders.setdefault((script, v), []).append(k)
    if not best:
        return set()
    k = max(range(len(best)), key=lambda x: (best[x][0], found[x][3]))
    if best[k][0] < 2:
        return set()
    chain: set[int] = set()
    at: int | None = k
    while at is not None:
        chain.add(found[at][0])
        at = best[at][1]
    return chain


class _Near:
    """Names that hold everywhere, and names that hold near the lines that bear them."""

    def __init__(self, everywhere: list[str]):
        self.everywhere, self.by_length, self.blocks = everywhere, {}, {}

    def add(self, i: int, name: object, back: bool = True) -> None:
        for k in range(i // SPAN - back, i // SPAN + 2):
            self.blocks.setdefault(k, {})[id(name)] = name

    def at(self, i: int) -> list:
        return list(self.blocks.get(i // SPAN, {}).values())

    def targets(self, n: int) -> list[tuple]:
        """What a line of ``n`` letters may say, with the pairs of letters in it and how many of them the line must share, in both plain forms."""
        found = []
        for name in self.everywhere:
            if fits(n, len(name)):
                for t in {name, name[:n]} if 8 <= n < len(name) <= 3 * n else {name}:
                    if abs(n - len(t)) <= 0.35 * max(n, len(t)) + 1:
                        g, j = _grams(t), _grams(_joined(t))
                        found.append((t, g, 0.55 * len(g), j, 0.55 * len(j)))
        return found

    def known(self, line: str) -> bool:
        """Whether the line says one of the names that hold everywhere."""
        n = len(line)
        if n not in self.by_length:
            self.by_length[n] = self.targets(n)
        if not (targets := self.by_length[n]):
            return False
        has, has_joined = line.__contains__, _joined(line).__contains__
        return any((sum(map(has, g)) >= least or sum(map(has_joined, j)) >= joined) and like(line, t) for t, g, least, j, joined in targets)


def classify(text: str, known: list[str] = ()) -> list[str]:
    """Kind of each line of ``text``, lines ended by a line feed; ``known`` are the book's title and makers."""
    lines = text.split("\n")
    bare = [_strip(x) for x in lines]
    kinds = [BODY if b else BLANK for b in bare]
    filled = [i for i, b in enumerate(bare) if b]
    if not filled:
        return kinds
    width = sorted(len(bare[i]) for i in filled)[int(len(filled) * 0.9)]
    _number_pages(lines, bare, kinds)

    place = {i: k for k, i in enumerate(filled)}

    def at_top(i: int) -> bool:
        k = place[i]
        return "\f" in lines[i] or k > 0 and kinds[filled[k - 1]] == PAGE_NUMBER or k + 1 < len(filled) and kinds[filled[k + 1]] == PAGE_NUMBER

    # headers: lines that repeat far apart, or repeat the title, a maker or an earlier heading
    near = _Near([p for p in {plain(q) for k in known for q in (k, *k.split(" - "))} if len(p) > 3])
    short = []
    for i, (b, whole) in enumerate(zip(bare, plain(text).split("\n"), strict=True)):
        if kinds[i] != BODY or len(b) > 1.6 * width or "..." in b and _LIST_ITEM.search(b):
            continue
        core, numbered, form = b, False, whole
        if _EDGE_SIGN.search(b) and (m := _EDGE_NUMBER.match(b)):
            numbered = bool(m.group(1) or m.group(3))
            if m.group(2) and m.group(2) != b:
                core = m.group(2)
                form = plain(core)
        if _TWO_LETTERS.search(core):
            short.append((i, b, form, whole, numbered))

    mixed = lambda i: not bare[i].isupper() and not bare[i].islower()
    headings: list[list[tuple[int, str]]] = []
    for i, b, _, whole, _ in short:
        if _HEADING.match(b) and not (b[-1] in _ENDS_TEXT and len(b) > 0.7 * width):
            if b[0] in "Il" and any(like(whole, n) for n in near.everywhere):  # an initial, no number
                kinds[i] = HEADER
                continue
            group = next((g for g in near.at(i) if repeats(whole, g[0][1]) or repeats(g[0][1], whole)), None)
            if group is None:
                headings.append(group := [])
            group.append((i, whole))
            near.add(i, group, back=False)
    styled = any(mixed(i) for g in headings for i, _ in g)
    first_text = next((i for i in filled if kinds[i] != PAGE_NUMBER), len(lines))
    for g in headings:  # one line of a group is the heading, all others run at the tops of pages
        own = [i for i, _ in g if mixed(i)] if styled else [i for i, _ in g]
        members = set(own)
        following = lambda i: filled[place[i] + 1] if place[i] + 1 < len(filled) else None
        first = next((i for i in own if not at_top(i) or i <= first_text and following(i) not in members), own[0] if own else None)
        for i, _ in g:
            kinds[i] = HEADING if i == first else HEADER
            near.add(i, g)
    ends = {k[-1] for k in map(_strip, known) if k and k[-1] in _ENDS_TEXT}
    for i, b, core, whole, numbered in short:
        if kinds[i] != BODY or not numbered and b[-1] in _ENDS_TEXT and b[-1] not in ends and b[-1] != ",":
            continue
        if near.known(core) or core != whole and near.known(whole):
            kinds[i] = HEADER
        elif (group := next((g for g in near.at(i) if fits(len(whole), len(g[0][1])) and repeats(whole, g[0][1])), None)) is not None:
            kinds[i] = HEADER
            near.add(i, group)
    _repeated(short, bare, kinds, width, at_top)
    return kinds


def _number_pages(lines: list[str], bare: list[str], kinds: list[str]) -> None:
    """Mark the lines that hold only the page's number.

    Numbers count in a chain, or with ornament.  Where no numbers make a chain, one at a page's top or in its middle counts, unless it may be a year.
    """
    found = [(i, *v) for i, b in enumerate(bare) if b and (v := page_value(lines[i]))]
    chain = _sequence(found)
    for i, _, v, ornamented in found:
        fresh = "\f" in lines[i] or i == 0 or len(lines[i]) - len(lines[i].lstrip(" ")) >= 10
        if i in chain or ornamented or not chain and fresh and not 1400 <= v <= 2100 and not bare[i].endswith("."):
            kinds[i] = PAGE_NUMBER


def _repeated(short: list[tuple], bare: list[str], kinds: list[str], width: int, at_top: Callable[[int], bool]) -> None:
    """Mark lines that look like headers and return, much the same, some lines later; a line found so is looked for again from its own place."""
    loose = [x for x in short if kinds[x[0]] == HEADER or kinds[x[0]] == BODY and not (x[1][-1] in _ENDS_TEXT and not x[4])]
    at, lengths = [x[0] for x in loose], [len(x[2]) for x in loose]
    bits: dict[str, int] = {}
    masks: list[tuple[int, int, int, int] | None] = [None] * len(loose)

    def mask(k: int) -> tuple[int, int, int, int]:
        """The pairs of letters of a line, in both plain forms, as bits, and their numbers."""
        made = []
        for s in (loose[k][2], _joined(loose[k][2])):
            m = 0
            for i in range(len(s) - 1):
                m |= 1 << bits.setdefault(s[i : i + 2], len(bits))
            made += [m, m.bit_count()]
        masks[k] = tuple(made)
        return masks[k]

    returned: set[int] = set()
    for a, (i, b, core, _, numbered) in enumerate(loose):
        if len(core) <= 4:
            continue
        if i not in returned:
            if kinds[i] == HEADER:
                continue
            looks = b.isupper() or at_top(i) and len(b) <= (0.6 if b[0].islower() else 0.85) * width
            if not numbered and (not looks or _SENTENCE_GOES_ON.search(b) and b[0].islower()):
                continue
        n = len(core)
        least, most = 0.65 * n - 1, (n + 1) / 0.65
        pa, na, qa, oa = masks[a] or mask(a)
        for k in range(bisect_right(at, i + 7), bisect_right(at, i + SPAN)):
            if least <= lengths[k] <= most:
                pb, nb, qb, ob = masks[k] or mask(k)
                if (pa & pb).bit_count() < 0.55 * (na if na > nb else nb) and (qa & qb).bit_count() < 0.55 * (oa if oa > ob else ob):
                    continue
                if like(core, loose[k][2], 0.88):
                    kinds[i] = kinds[at[k]] = HEADER
                    returned.add(at[k])
