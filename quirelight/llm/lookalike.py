"""One consistent form for texts that look the same.

The skeleton of a text: decompose it, replace every character by the prototype of its look-alikes, decompose again.  Texts
with equal skeletons look the same.  Width, kind of blank and invisible characters vanish; letters, accents, digits, marks,
case, raised or lowered position, the number of blanks inside a line and line breaks stay.

Defined results: null gives a null skeleton; a text without any visible character, or without id, takes part in no group.
"""

from __future__ import annotations

import hashlib
import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

# Letters of other scripts, and signs, that are drawn like the ones before them, script by script (Unicode code charts).
_DRAWN_ALIKE = {
    "greek small": "oο vν pρ uυ cϲ jϳ ıι ĸκ",
    "greek capital": "AΑ BΒ EΕ ZΖ HΗ IΙ KΚ MΜ NΝ OΟ PΡ TΤ YΥ XΧ CϹ MϺ FϜ JͿ",
    "cyrillic small": "aа cс dԁ eе hһ iі jј lӏ oо pр qԛ sѕ vѵ wԝ xх yу ĸк",
    "cyrillic capital": "AА BВ CС EЕ GԌ HН IІ IӀ JЈ KК MМ OО PР QԚ SЅ TТ VѴ WԜ XХ YҮ",
    "armenian": "oօ nո uս hհ jյ gց qզ OՕ SՏ UՍ LԼ",
    "coptic": "cⲥ oⲟ pⲣ AⲀ BⲂ CⲤ HⲎ IⲒ KⲔ MⲘ NⲚ OⲞ PⲢ TⲦ XⲬ YⲨ ZⲌ",
    "cherokee": "AᎪ BᏴ CᏟ DᎠ EᎬ GᏀ HᎻ JᎫ KᏦ LᏞ MᎷ PᏢ RᏒ SᏚ TᎢ VᏙ WᎳ YᎩ ZᏃ bᏏ dᏧ hᏂ iᎥ",
    "lisu": "Aꓮ Bꓐ Cꓚ Dꓓ Eꓰ Fꓝ Gꓖ Hꓧ Iꓲ Jꓙ Kꓗ Lꓡ Mꓟ Nꓠ Oꓳ Pꓑ Rꓣ Sꓢ Tꓔ Uꓴ Vꓦ Wꓪ Xꓫ Yꓬ Zꓜ",
    "roman numeral": "cⅽ dⅾ iⅰ lⅼ mⅿ vⅴ xⅹ CⅭ DⅮ IⅠ LⅬ MⅯ VⅤ XⅩ",
    "phonetic": "gɡ zᴢ",
    "sign": "!ǃ :꞉ :։ :∶ -‐ -‑ -﹣ |∣ |ǀ 'ʹ ,‚",
}
LOOKALIKES = {pair[1]: pair[0] for pairs in _DRAWN_ALIKE.values() for pair in pairs.split()}
#: Wide, narrow and font variants and no-break forms differ from their parts only in looks that do not count.
_PLAIN_TAGS = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<small>"}
#: Of the compatibility characters only those that are drawn as their parts side by side.
_DRAWN_AS_PARTS = ("LIGATURE", "ROMAN NUMERAL", "DIGRAPH", "LETTER DZ", "LETTER LJ", "LETTER NJ")
_LINE_BREAKS = "\x0b\x0c\x85\u2028\u2029"
_JOINER = "\u200d"


def _ignorable(ch: str) -> bool:
    """Characters that are never drawn."""
    o, cat = ord(ch), unicodedata.category(ch)
    if ch in "\n\t":
        return False
    if cat == "Cf":
        return not (0x600 <= o <= 0x605 or o in (0x6DD, 0x70F, 0x8E2, 0x110BD, 0x110CD))
    return cat == "Cc" or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or 0x180B <= o <= 0x180F or o in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, 0x2800)


@cache
def table() -> dict[int, str | None]:
    """Prototype of every character that has another one, derived from the Unicode database and the fixed look-alikes."""
    proto: dict[int, str | None] = {ord(ch): p for ch, p in LOOKALIKES.items()}
    for o in range(128, sys.maxunicode + 1):
        if o in proto or 0xD800 <= o <= 0xDFFF or 0xAC00 <= o <= 0xD7A3:
            continue
        ch = chr(o)
        if unicodedata.category(ch) == "Zs":
            proto[o] = " "
            continue
        parts = unicodedata.decomposition(ch).split()
        if parts and parts[0] in _PLAIN_TAGS or parts and parts[0] == "<compat>" and any(w in unicodedata.name(ch, "") for w in _DRAWN_AS_PARTS):
            whole = "".join(chr(int(x, 16)) for x in parts[1:])
            proto[o] = "".join((proto[ord(x)] or "") if ord(x) in proto else x for x in unicodedata.normalize("NFD", whole)) or None
        elif _ignorable(ch) and ch not in _LINE_BREAKS:
            proto[o] = None
    proto |= {ord(ch): "\n" for ch in _LINE_BREAKS} | {9: " "}
    proto |= {o: None for o in (*range(9), *range(14, 32), 127)}
    return proto


def _pictured(text: str) -> str:
    """Drop joiners except between pictographs, where one changes the picture."""
    if _JOINER not in text:
        return text
    drawn, out = lambda c: unicodedata.category(c) in ("So", "Sk") or 0xFE0F == ord(c), []
    for i, ch in enumerate(text):
        if ch == _JOINER and not (0 < i < len(text) - 1 and drawn(text[i - 1]) and drawn(text[i + 1])):
            continue
        out.append("" if ch == _JOINER else ch)  # a private mark that the table leaves alone
    return "".join(out)


@cache
def _keys() -> frozenset[str]:
    return frozenset(map(chr, table()))


def skeleton(text: str | None) -> str | None:
    """The form that all texts of the same look share."""
    if text is None:
        return None
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not text.isascii():
        text = unicodedata.normalize("NFD", _pictured(text))
    proto = table()
    for ch in _keys().intersection(text):  # the few different ones, each in one pass; no prototype holds a character that has one
        text = text.replace(ch, proto[ord(ch)] or "")
    if not text.isascii():
        text = unicodedata.normalize("NFD", text)
    return "\n".join(line.rstrip(" ") for line in text.split("\n")).rstrip("\n")


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def ascii_skeleton(text: Column) -> Column:
    """The form of an ASCII text, in the JVM."""
    proto = table()
    changed = [o for o in range(128) if o in proto and o != 13]
    changed.sort(key=lambda o: proto[o] is None)  # characters without a counterpart are removed
    s = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    s = F.translate(s, "".join(map(chr, changed)), "".join(proto[o] for o in changed if proto[o]))
    return F.rtrim(F.regexp_replace(s, r"(?<! ) ++(?=\n|\z)", ""), F.lit("\n"))


def skeletons(text: Column | str) -> Column:
    """Column function: the consistent form of a text column; only texts that are not ASCII go to Python."""
    text = F.col(text) if isinstance(text, str) else text

    @F.pandas_udf("string")
    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([skeleton(t) for t in texts], dtype=object)

    return F.when(is_ascii(text), ascii_skeleton(text)).otherwise(each(F.when(~is_ascii(text), text)))


def looks(text: Column) -> Column:
    """16-byte hash of the consistent form; null where nothing is visible."""

    def digest(s: str | None) -> bytes | None:
        return hashlib.md5(s.encode(), usedforsecurity=False).digest() if s and not s.isspace() else None

    @F.pandas_udf("binary")
    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([digest(skeleton(t)) for t in texts], dtype=object)

    plain = ascii_skeleton(text)
    return F.coalesce(F.when(is_ascii(text) & plain.rlike(r"\S"), F.unhex(F.md5(plain.cast("binary")))), each(F.when(~is_ascii(text), text)))


def with_skeleton(df: DataFrame, text: str = "text", out: str = "skeleton") -> DataFrame:
    """``df`` with the consistent form of ``text``; one narrow pass."""
    return df.withColumn(out, skeletons(F.col(text)))


def same_look(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, look, spelling), stored: hashes of the skeleton and of the stored text of every document with a visible character.

    The filter is put on the stored table, as above the function it would run Python once more.
    """
    s = df.select(id_column, F.unhex(F.md5(F.col(text).cast("binary"))).alias("spelling"), looks(F.col(text)).alias("look"))
    return stored(s, "looks").where(F.col("look").isNotNull() & F.col(id_column).isNotNull()).select(id_column, "look", "spelling")


def same_look_pairs(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs of documents that look the same but are stored with different characters.

    Spellings of a look are counted first; only looks with several spellings go on, so a look that a third of the documents
    share in one spelling costs nothing.  Pairs are made between spellings and then expanded to the documents, so that no
    pair of exact copies is ever formed.
    """
    keyed = same_look(df, id_column, text)
    spellings = keyed.select("look", "spelling").distinct()
    varied = spellings.groupBy("look").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("look")
    kept = spellings.join(varied, "look", "left_semi")
    a, b = kept.select("look", F.col("spelling").alias("sa")), kept.select("look", F.col("spelling").alias("sb"))
    links = a.join(b, "look").where("sa < sb")
    members = keyed.join(varied, "look", "left_semi")
    left = members.select(F.col(id_column).alias("ia"), "look", F.col("spelling").alias("sa"))
    right = members.select(F.col(id_column).alias("ib"), "look", F.col("spelling").alias("sb"))
    pairs = links.join(left, ["look", "sa"]).join(right, ["look", "sb"])
    return pairs.select(F.least("ia", "ib").alias(f"{id_column}_a"), F.greatest("ia", "ib").alias(f"{id_column}_b"))
