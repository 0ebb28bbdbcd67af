"""Text functions as column expressions; chains of replacements keep their order and run once, left to right."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that file names must not hold, article endings, and the Markdown of simple tags.
NOTE_NAME_BAD = "\\/:*?\"<>|.`'\n\r\t[]{}()&^%$#@!~"
FILE_NAME_BAD = '<>:"/\\|?*'
ARTICLE_ENDINGS = (("Der", "Die", "Das", "Ein", "Eine"), ("The", "A", "An"))
TAG_TEXT = (
    ("<h1>", "&num; "), ("<h2>", "&num;&num; "), ("<h3>", "&num;&num;&num; "), ("<h4>", "&num;&num;&num;&num; "),
    ("</h1>", "\n\n"), ("</h2>", "\n\n"), ("</h3>", "\n\n"), ("</h4>", "\n\n"), ("<em>", " *"), ("</em>", "* "),
    ("<strong>", "**"), ("</strong>", "** "), ("<p>", ""), ("</p>", "\n\n"), ("<br>", "\n\n"), ("<br/>", "\n\n"),
    ("<br />", "\n\n"), ("<li>", "- "), ("</li>", "\n"), ("  ", " "), ("  ", " "),
)
TITLE_MAX, TITLE_MIN = 70, 30


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for a body that uses it several times, so that expressions do not multiply."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def replace_all(c: Column, pairs: tuple[tuple[str, str], ...] | list[tuple[str, str]]) -> Column:
    """Replacements in order, each a single pass."""
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def strip(c: Column) -> Column:
    """Remove white space of every kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def note_name(c: Column) -> Column:
    """A name usable for a note's file."""
    bad = F.translate(c, NOTE_NAME_BAD, "_" * len(NOTE_NAME_BAD))
    return replace_all(bad, (("__", "_"), (" _ ", ", "), ("_ ", ", "), (" _", " ")))


def nfc(c: Column | str) -> Column:
    """Composed Unicode form; the JVM has no expression for it, so batches go through Arrow."""

    @F.pandas_udf("string")
    def each(s: pd.Series) -> pd.Series:
        return s.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFC", v))

    return each(c)


def file_name(c: Column, compose: Callable[[Column], Column] | None = None) -> Column:
    """A name usable for a document's file; pass ``nfc`` as ``compose`` where names may hold combining marks."""
    c = F.translate(c, FILE_NAME_BAD, "," * len(FILE_NAME_BAD))
    c = strip(replace_all(c, (("__", "_"), (" _ ", ", "), ("_ ", ", "), ("  ", " "), ("  ", " "), (",,", ","), (" ,", " "), ("  ", " "), ("  ", " "))))
    return compose(c) if compose else c


def is_number(c: Column) -> Column:
    """Whether a word is all Arabic digits or all Roman numeral letters; true for the empty word."""
    return strip(c).rlike("^(?:[0-9]*|[IVXLCDM]*)$")


def remove_footnotes(c: Column, numeric_only: bool = True, single_letter: bool = True) -> Column:
    """Drop ``[12]`` and ``[a]``, or every bracketed part."""
    if not numeric_only:
        return F.regexp_replace(c, r"\[.*?\]", "")
    c = F.regexp_replace(c, r"(?U)\[\d+\]", "")
    return F.regexp_replace(c, r"(?U)\[\w\]", "") if single_letter else c


def strip_articles(c: Column) -> Column:
    """Drop a trailing article such as ``, The``, once for each language."""
    for words in ARTICLE_ENDINGS:
        c = F.regexp_replace(c, f", (?:{'|'.join(words)})$", "")
    return c


def short_title(title: Column, title_sort: Column, creators: Column, compose: Callable[[Column], Column] | None = None) -> Column:
    """A title cut at a natural place within 70 characters, with its volume number and first author.

    Missing parts count as empty and a missing author as ``Unknown``.
    """
    title, sort = F.coalesce(title, F.lit("")), F.coalesce(title_sort, F.lit(""))
    counts = lambda w: is_number(w) & (strip(w) != "")
    words = F.split(title, " ")
    last = F.element_at(F.split(sort, " "), -1)
    volume = F.coalesce(
        F.when(counts(F.get(words, F.lit(0))), F.get(words, F.lit(0))), F.when(counts(last), last), F.get(F.filter(words, counts), F.lit(0)), F.lit("")
    )

    def cut(s: Column) -> Column:
        found = [F.when(F.locate(ch, s) > 0, F.locate(ch, s, TITLE_MIN + 1) - 1) for ch in (",", ".", "-", ":", ";")]
        at = F.coalesce(F.least(*found), F.lit(-1))
        space, tsheg = F.locate(" ", s, TITLE_MIN + 1) - 1, F.locate("་", s, TITLE_MIN + 1) - 1
        inside = lambda p: (p >= TITLE_MIN) & (p < TITLE_MAX)
        n = F.when((at > TITLE_MIN) & (at < TITLE_MAX), at).when(inside(space), space).when(inside(tsheg), tsheg + 1).otherwise(TITLE_MAX)
        return strip(F.when(F.length(s) > TITLE_MAX, F.substring(s, F.lit(1), n)).otherwise(s))

    head = let(let(file_name(sort, compose), cut), lambda s: F.when((volume != "") & ~F.contains(s, volume), F.concat_ws(" ", s, volume)).otherwise(s))
    author = F.coalesce(F.get(creators, F.lit(0)), F.lit("Unknown"))
    return F.concat(strip(head), F.lit(" - "), file_name(author, compose))


def unescape(c: Column | str) -> Column:
    """Character references of HTML decoded, by Arrow batches."""

    @F.pandas_udf("string")
    def each(s: pd.Series) -> pd.Series:
        return s.map(lambda v: v if v is None or "&" not in v else html.unescape(v))

    return each(c)


def tags_to_text(c: Column) -> Column:
    """Simple tags as Markdown, all others dropped; character references stay."""
    return F.regexp_replace(replace_all(c, TAG_TEXT), "<[^>]+>", "")


def html_to_quote(c: Column) -> Column:
    """An HTML description as a Markdown quotation."""
    return F.concat(F.lit("> "), F.replace(unescape(tags_to_text(c)), F.lit("\n"), F.lit("\n> ")), F.lit("\n"))


def compress_blanks(c: Column, mode: str = "light") -> Column:
    """``light``: runs of blanks and of line feeds become one; ``full``: pairs of line feeds become a blank; ``none``: as it is."""
    if mode == "light":
        return F.regexp_replace(F.regexp_replace(c, " {2,}", " "), "\n{2,}", "\n")
    if mode == "full":
        return F.regexp_replace(F.regexp_replace(c, "(?:\n\n)+", " "), " {2,}", " ")
    if mode != "none":
        raise ValueError(f"unknown mode {mode!r}")
    return c


def tag_name(c: Column) -> Column:
    return F.replace(strip(c), F.lit(" "), F.lit("_"))


def model_folder(c: Column) -> Column:
    """A model's name as one folder name."""
    return F.replace(c, F.lit("/"), F.lit("-"))


def home_relative(c: Column, home: str) -> Column:
    """Paths below the home folder begin with a tilde."""
    h = home.rstrip("/")
    return F.when((c == h) | c.startswith(h + "/"), F.concat(F.lit("~"), F.substring(c, F.lit(len(h) + 1), F.length(c)))).otherwise(c)


def deep_link(library: Column, book_id: Column) -> Column:
    return F.concat(F.lit("calibre://show-book/_hex_-"), F.lower(F.hex(library)), F.lit("/"), book_id.cast("string"))


def table_domain(path: Column, columns: Column, root: str = "") -> Column:
    """The domain that a table of dates gets from its note's path below ``root`` and its second column; null for other tables."""
    r = root.rstrip("/") + "/" if root else ""
    below = F.substring(path, F.lit(len(r) + 1), F.length(path)) if r else path
    stem = F.regexp_replace(below, r"(?<=[^/])\.[^./]*$", "")
    s = F.concat_ws("/", stem, F.get(columns, F.lit(1)))
    s = F.replace(F.replace(F.translate(s, " #+$.,:", "_______"), F.lit("*"), F.lit("")), F.lit("__"), F.lit("_"))
    ok = (F.size(columns) > 1) & (F.get(columns, F.lit(0)) == "Date")
    return F.when(ok & (path.startswith(r) if r else F.lit(True)), F.regexp_replace(s, "_$", ""))


def snippet(text: Column, offset: Column, before: int = 50, after: int = 20) -> Column:
    """Text around an offset from 0, kept inside the text, on one line."""
    start = F.greatest(offset - before, F.lit(0))
    return F.translate(F.substring(text, (start + 1).cast("int"), (offset + after - start).cast("int")), "\n\r\t", "   ")


def progress_bar(done: Column, total: Column, width: int = 40) -> Column:
    """A bar of ``width`` cells."""
    n = F.floor(F.when(total > 0, done / total).otherwise(0.0) * width).cast("int")
    n = F.greatest(F.lit(0), F.least(F.lit(width), n))
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), F.lit(width) - n))
