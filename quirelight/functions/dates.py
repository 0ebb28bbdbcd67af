"""Cleaning of messy historical dates as column expressions; results that have two parts are struct(date, remark)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .julian import event_date_text, range_to_jd
from .text import let, remove_footnotes, replace_all, strip

# Words that make a date vague, in the order they are looked for; ordinal endings; English months.
QUALIFIERS = (
    "ca.", "c.", "circa", "fl.", "born", "died in", "Died", "died", "buried", "early", "or later", "later", "late", "mid", "or before", "before",
    "after", "around", "approximately", "~", ">", "<", "≈", "≥", "≤", "(?)", "?",
)
ORDINALS = ("st", "nd", "rd", "th")
MONTHS = "january february march april may june july august september october november december".split()
_CLEANING = (
    ("–", " - "), ("—", "-"), ("\xa0", " "), ("\u2009", " "), (" to ", " - "), (",", ""), ("  ", " "),
    ("AD", ""), ("BCE", "BC"), ("  ", " "), (" mya", " ma bp"),
)
ERAS = (("B.C.", "BC"), ("A.D.", "AD"), ("3rd Millennium BC", "3000 BC - 2001 BC"))


def pair(date: Column, remark: Column) -> Column:
    return F.struct(date.alias("date"), remark.alias("remark"))


def pre_clean(c: Column) -> Column:
    """Footnotes out, dashes, blanks and eras in one form."""
    return strip(replace_all(remove_footnotes(c), _CLEANING))


def date_remarks(c: Column) -> Column:
    """Vague words, alternatives, plural and tolerance taken off a date; the last one found is the remark."""

    def step(acc: Column, word: Column) -> Column:
        bare = strip(F.replace(acc["date"], word, F.lit("")))
        return F.when(F.contains(acc["date"], word), pair(bare, F.when(bare != "", word).otherwise(acc["remark"]))).otherwise(acc)

    s = F.aggregate(F.array(*map(F.lit, QUALIFIERS)), pair(c, F.lit("")), step)
    s = let(s, lambda a: F.when(F.contains(a["date"], F.lit(" or ")), pair(F.substring_index(a["date"], " or ", 1), F.substring(a["date"], F.locate(" or ", a["date"]) + 1, F.length(a["date"])))).otherwise(a))
    s = let(s, lambda a: F.when(F.endswith(a["date"], F.lit("s")), pair(F.substring(a["date"], F.lit(1), F.length(a["date"]) - 1), a["date"])).otherwise(a))

    def tolerance(a: Column) -> Column:
        parts = F.split(a["date"], "±")
        first, tail = strip(F.get(parts, F.lit(0))), strip(F.get(parts, F.lit(1)))
        words = F.split(tail, " ")
        return F.when(
            F.size(parts) > 1,
            F.when(F.size(words) > 1, pair(F.concat_ws(" ", first, F.get(words, F.lit(1))), F.concat(F.lit("±"), F.get(words, F.lit(0))))).otherwise(pair(first, F.concat(F.lit("±"), tail))),
        ).otherwise(a)

    return let(let(s, tolerance), lambda a: pair(F.replace(a["date"], F.lit("  "), F.lit(" ")), a["remark"]))


def century(c: Column) -> Column:
    """``5th century BC`` as a range of years with the original as remark; other dates unchanged with an empty remark."""
    ordinal = "|".join(ORDINALS)
    s = F.when(F.contains(c, F.lit(" century BC")), c).otherwise(F.replace(c, F.lit("c. "), F.lit("")))
    n = F.nullif(F.regexp_extract(s, rf"^\s*(\d+)\s*(?:{ordinal})\s*century(?: BC)?\s*$", 1), F.lit("")).try_cast("int")
    bc = F.contains(c, F.lit(" century BC"))

    def spans(k: Column) -> Column:
        early = F.when(k == 1, F.lit("100 BC - 1 BC")).otherwise(F.format_string("%d00 BC - %d00 BC", k, k - 1))
        late = F.when(k == 1, F.lit("1 - 100")).otherwise(F.format_string("%d00 - %d00", k - 1, k))
        return F.when(k.isNotNull(), pair(F.when(bc, early).otherwise(late), c)).otherwise(pair(c, F.lit("")))

    return let(n, spans)


def with_alternative(c: Column) -> Column:
    """``1362/3`` as 1362 with the remark ``Alt.: 1363``."""

    def of(p: Column) -> Column:
        a, b = strip(F.get(p, F.lit(0))), strip(F.get(p, F.lit(1)))
        other = F.concat(F.substring(a, F.lit(1), F.greatest(F.length(a) - F.length(b), F.lit(0))), b)
        return F.when(F.size(p) > 1, pair(a, F.concat(F.lit("Alt.: "), other))).otherwise(pair(F.get(p, F.lit(0)), F.lit("")))

    return let(F.split(c, "/"), of)


def clean_date(c: Column, default_scale: str | None = None, normalise: bool = True) -> Column:
    """All cleaning steps on each end of a range; a scale missing on the left comes from the right; remarks are joined.

    Dates written with hyphens alone stay as they are.
    """

    def end(x: Column) -> Column:
        return let(date_remarks(x), lambda q: let(century(q["date"]), lambda z: let(with_alternative(z["date"]), lambda w: pair(w["date"], F.array_join(F.filter(F.array(q["remark"], z["remark"], w["remark"]), lambda r: r != ""), ", ")))))

    def is_exact(d: Column) -> Column:
        n = F.size(F.split(d, "-"))
        return (n == 3) | ((n == 2) & ~F.contains(d, F.lit(" - ")) & d.rlike("^[0-9]*-[0-9]*$"))

    def whole(d: Column) -> Column:
        hyphens, exact = F.split(d, "-"), is_exact(d)
        if default_scale is not None:
            scaled = F.array_join(F.transform(hyphens, lambda x: F.concat(strip(x), F.lit(f" {default_scale}"))), " - ")
            return F.when(exact, pair(d, F.lit(""))).otherwise(pair(scaled, F.lit("")))

        def joined(ends: Column) -> Column:
            dates = F.transform(ends, lambda e: e["date"])
            remark = F.array_join(F.filter(F.transform(ends, lambda e: e["remark"]), lambda r: r != ""), ", ")
            left, right = F.split(F.get(dates, F.lit(0)), " "), F.split(F.get(dates, F.lit(1)), " ")
            text = F.when((F.size(dates) == 2) & (F.size(left) == 1) & (F.size(right) == 2), F.concat(F.get(left, F.lit(0)), F.lit(" "), F.get(right, F.lit(1)), F.lit(" - "), F.get(dates, F.lit(1)))).otherwise(F.array_join(dates, " - "))
            return pair(text, remark)

        return F.when(exact, pair(d, F.lit(""))).otherwise(let(F.transform(F.split(d, " - "), end), joined))

    out = let(pre_clean(c), whole)
    if not normalise:
        return out
    return let(out, lambda o: let(range_to_jd(o["date"]), lambda j: F.when(j.isNotNull() & ~is_exact(o["date"]), pair(event_date_text(j["jd_start"], j["jd_end"]), o["remark"])).otherwise(o)))


def clean_column(df: DataFrame, raw: str, out: str = "cleaned", default_scale: str | None = None, normalise: bool = True) -> DataFrame:
    """``df`` with ``clean_date`` of a column, worked out once for each different text and joined back; null stays null."""
    texts = df.select(F.col(raw).alias("_raw")).where("_raw is not null").distinct()
    cleaned = texts.select("_raw", clean_date(F.col("_raw"), default_scale, normalise).alias(out))
    kept = [c for c in df.columns if c != out]
    return df.select(*kept).join(cleaned, F.col(raw) == F.col("_raw"), "left").drop("_raw")


def merge_date(year: Column, rest: Column) -> Column:
    """A year and ``Month``, ``D Month`` or ``Month D`` as ``Y-MM[-DD][ era]``; the bare year if the month is none."""

    def of(parts: Column) -> Column:
        a, b = strip(F.get(parts, F.lit(0))), strip(F.get(parts, F.lit(1)))
        day_first = b.isNotNull() & a.rlike(r"^\d+$")
        name = F.lower(F.when(F.size(parts) == 1, a).when(day_first, b).otherwise(a))
        day = F.when(F.size(parts) == 1, F.lit(None).cast("int")).when(day_first, a.try_cast("int")).otherwise(b.try_cast("int"))
        month = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), name), F.lit(0))
        y = pre_clean(year)
        head, era = F.substring_index(y, " ", 1), F.when(F.contains(y, F.lit(" ")), F.substring(y, F.locate(" ", y), F.length(y))).otherwise("")
        usable = month.isNotNull() & ((F.size(parts) == 1) | day.isNotNull())
        return F.when(usable, F.concat(head, F.format_string("-%02d", month), F.when(day.isNotNull(), F.format_string("-%02d", day)).otherwise(""), era)).otherwise(y)

    return let(F.split(remove_footnotes(strip(F.coalesce(rest, F.lit("")))), " "), of)


def spread_unit(c: Column) -> Column:
    """``4.5 - 4 Ma`` as ``4.5 Ma - 4 Ma``, and ``ka`` as ``kya BP``."""
    c = F.regexp_replace(c, r"^\s*([\d.]+)\s*-\s*([\d.]+)\s*(Ga|Ma|ka)\b", "$1 $3 - $2 $3")
    return F.regexp_replace(c, r"\bka\b", "kya BP")


def tolerance_to_range(value: Column, unit: str) -> Column:
    """``12 ± 2`` as ``14 unit - 10 unit`` (the older end first)."""
    v = F.regexp_extract(value, r"^\s*([\d.]+)\s*±\s*([\d.]+)", 1).try_cast("double")
    t = F.regexp_extract(value, r"^\s*([\d.]+)\s*±\s*([\d.]+)", 2).try_cast("double")
    num = lambda x: F.regexp_replace(F.format_string("%.4f", x), r"\.?0+$", "")
    return F.when(v.isNotNull() & t.isNotNull(), F.concat(num(v + t), F.lit(f" {unit} - "), num(v - t), F.lit(f" {unit}"))).otherwise(value)


def scale_age(value: Column, factor: float) -> Column:
    """An age in other units, as a plain number."""
    return F.regexp_replace(F.format_string("%.6f", value.cast("double") * factor), r"\.?0+$", "")


def eras(c: Column) -> Column:
    return replace_all(c, ERAS)


def fossil_date(c: Column) -> Column:
    """Ages of fossils as written in tables: cut after ``ka,``, leading ``ca.``, brackets and question marks off, decimal point, ``mya`` as ``Ma BP``."""
    c = F.when(F.contains(c, F.lit("ka,")), F.concat(F.substring_index(c, "ka,", 1), F.lit("ka"))).otherwise(c)
    c = F.regexp_replace(strip(c), r"^(?:ca\. ?|\(|\?)+", "")
    c = F.regexp_replace(c, r"(\d),(\d{1,2})(?!\d)", "$1.$2")
    c = F.regexp_replace(c, r"^([\d.]+)\s*[–-]\s*([\d.]+)\s*(?:mya|Mya|Ma)\b.*$", "$1 Ma BP - $2 Ma BP")
    return strip(F.regexp_replace(c, r"\s*(?:mya|Mya)\b", " Ma BP"))


# Phrases of one page's dates.
PHRASES = (("30th century BC", "3000 BC - 2901 BC"), ("end of the 13th century", "1280 - 1299"), ("End of the 16th century", "1580 - 1599"))


def phrase(c: Column) -> Column:
    """Phrases as dates; otherwise ``Around `` and a last ``s`` off, and eras in capitals."""
    c = F.regexp_replace(F.replace(c, F.lit("Around "), F.lit("")), "s$", "")
    out = F.when(c == "post-1945", "1945 - 1963").otherwise(F.replace(F.replace(c, F.lit("bc"), F.lit("BC")), F.lit("ad"), F.lit("AD")))
    for said, date in reversed(PHRASES):
        out = F.when(F.contains(c, F.lit(said)), date).otherwise(out)
    return out


def tolerant_span(c: Column) -> Column:
    """struct(date, remark) of dates with a tolerance, which is kept as remark: ``1250 ± 20``, and ``1200 to 1250`` as 1250 with ±50.

    The second form counts the span on from its first number, as the page's readers expect it.
    """
    c = replace_all(c, (("c. ", ""), ("c.", ""), ("–", "-"), (",", ""), ("?", ""), ("BCE", "BC"), ("CE", "")))
    c = strip(F.substring_index(c, "[", 1))
    number = lambda x: F.regexp_extract(x, r"^\s*(\d+)\s*(?:BC)?\s*$", 1).try_cast("bigint")
    half, ends = F.split(c, "±"), F.split(c, " to ")
    bc = lambda x: F.when(F.contains(x, F.lit("BC")), " BC").otherwise("")
    a, b = number(F.get(ends, F.lit(0))), number(F.get(ends, F.lit(1)))
    width = number(F.get(half, F.lit(1)))
    tolerant = pair(F.concat(strip(F.get(half, F.lit(0))), bc(F.get(half, F.lit(1)))), F.concat(F.lit("±"), width.cast("string")))
    spanned = pair(F.concat((a + F.abs(a - b)).cast("string"), bc(F.get(ends, F.lit(0)))), F.concat(F.lit("±"), F.abs(a - b).cast("string")))
    return F.when((F.size(half) == 2) & width.isNotNull(), tolerant).when((F.size(ends) == 2) & a.isNotNull() & b.isNotNull(), spanned).otherwise(pair(c, F.lit("")))


def impact_age(c: Column) -> Column:
    """Ages of impacts as dates: years in brackets, BC and AD years, and millions of years alone, as a span, or with a tolerance."""
    c = F.regexp_replace(c, r"[?<>]", "")
    inside = strip(F.replace(F.regexp_extract(c, r"\(([^)]*)\)", 1), F.lit("AD"), F.lit("")))
    years = strip(F.replace(c, F.lit("AD"), F.lit("")))
    spread = lambda x: F.concat((_tolerance(x, 1) - _tolerance(x, 2)).cast("bigint").cast("string"), F.lit(" - "), (_tolerance(x, 1) + _tolerance(x, 2)).cast("bigint").cast("string"))
    with_years = lambda x: F.when(_tolerance(x, 2).isNotNull(), spread(x)).otherwise(x)
    plain = strip(F.substring_index(F.replace(c, F.lit("–"), F.lit("-")), "[", 1))
    ends = F.split(plain, "-")
    age = F.concat(scale_age(plain.try_cast("double"), 1000.0), F.lit(" kya BP"))
    aged = F.concat(scale_age(_tolerance(plain, 1) + _tolerance(plain, 2), 1000.0), F.lit(" kya BP - "), scale_age(_tolerance(plain, 1) - _tolerance(plain, 2), 1000.0), F.lit(" kya BP"))
    return (
        F.when(F.contains(c, F.lit("(")), with_years(inside)).when(F.contains(F.upper(c), F.lit("BC")), F.upper(strip(c))).when(F.contains(c, F.lit("AD")), with_years(years))
        .when(F.size(ends) == 2, F.concat(strip(F.get(ends, F.lit(1))), F.lit(" Ma BP - "), strip(F.get(ends, F.lit(0))), F.lit(" Ma BP"))).when(_tolerance(plain, 2).isNotNull(), aged).when(age.isNotNull(), age).otherwise(plain)
    )


def _tolerance(c: Column, k: int) -> Column:
    """The number before (1) or behind (2) the sign of tolerance."""
    return F.regexp_extract(c, r"^\s*([\d.]+)\s*±\s*([\d.]+)\s*$", k).try_cast("double")
