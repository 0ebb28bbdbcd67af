"""Timelines from the tables of web pages, described by what their columns hold instead of by scripts."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, julian
from ..functions.text import remove_footnotes, strip
from ..operators import ordered
from . import curated

#: Rows of a table in the order over all rows.
TABLE_ROWS = 1_000_000


@dataclass(frozen=True)
class Page:
    """Which tables of a page hold dated rows, and how a row gives date and text.

    tables: inclusive ranges of table indexes.  date, rest, end: columns of the date or year, of day and month, and of the end.  text: columns
    joined to the event.  kept: further columns, by name.  prepare: applied to each raw date.  scale: unit of bare numbers; factor: for
    tables from ``factor_from`` on.  suffix: an era that all dates have.  header: a date that marks a repeated header row.  fill: missing dates come from the
    row before.  curated: exact raw dates with their (date, remark).  clean: the cleaning in place of the common one, to struct(date, remark).  bracket: the
    name of a column for what the text has in brackets, which leave it.  order: ``page``, ``time`` or ``reverse``.
    """

    tables: tuple[tuple[int, int], ...]
    date: int = 0
    rest: int | None = None
    end: int | None = None
    text: tuple[int, ...] = (1,)
    kept: dict[str, int] = field(default_factory=dict)
    prepare: Callable[[Column], Column] | None = None
    scale: str | None = None
    factor: float = 1.0
    factor_from: int = 0
    suffix: str = ""
    header: tuple[str, ...] = ("Year", "Date")
    fill: bool = False
    curated: dict[str, tuple[str, str]] = field(default_factory=dict)
    clean: Callable[[Column], Column] | None = None
    bracket: str = ""
    separator: str = ", "
    distinct: bool = False
    order: str = "page"


def _cell(i: int) -> Column:
    c = strip(F.get("cells", F.lit(i)))
    return F.when(c.isin("", "nan", "NaN", "None"), F.lit(None)).otherwise(c)


def build(rows: DataFrame, page: Page | tuple[Page, ...]) -> DataFrame:
    """(pos, date, remark, event, jd_start, jd_end, kept columns) of a page's rows (table_idx, row_idx, cells).

    Rows without date or event, and repeated header rows, are left out.  Remarks lead the event.  Several layouts of one page are united in the order of
    the first.
    """
    if isinstance(page, tuple):
        x = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [build(rows, p) for p in page])
        return x.orderBy("jd_start", F.coalesce("jd_end", "jd_start"), "pos") if page[0].order == "time" else x.orderBy("pos")
    inside = F.lit(False)
    for a, b in page.tables:
        inside = inside | F.col("table_idx").between(a, b)
    x = rows.where(inside).withColumn("pos", F.col("table_idx").cast("bigint") * TABLE_ROWS + F.col("row_idx"))
    x = x.withColumns({"_d": remove_footnotes(_cell(page.date)), "_r": remove_footnotes(_cell(page.rest)) if page.rest is not None else F.lit(None).cast("string"), "_e": remove_footnotes(_cell(page.end)) if page.end is not None else F.lit(None).cast("string")})
    x = x.withColumn("_t", remove_footnotes(F.concat_ws(page.separator, *[_cell(i) for i in page.text])))
    x = x.where((F.col("_d").isNull() | ~F.col("_d").isin(*page.header)) & ~F.coalesce(F.col("_d").startswith("^"), F.lit(False)))
    if page.end is not None:
        x = x.where(F.col("_d").isNull() | F.col("_e").isNull() | (F.col("_d") != F.col("_e")))  # a header says the same twice
    note = F.lit("")
    if page.fill:
        x = ordered.forward_fill(x, "pos", {"_fd": "_d", "_ft": "_t"}, F.col("_d").isNotNull() & ~F.col("_d").isin("", "??"), TABLE_ROWS)
        missing = F.col("_d").isNull() | F.col("_d").isin("", "??")
        note = F.when(missing, F.concat(F.lit("<NA>, date from previous table entry "), F.coalesce("_ft", F.lit("<unknown>")), F.lit(" used!"))).otherwise("")
        x = x.withColumn("_note", note).withColumn("_d", F.coalesce("_fd", F.lit("<unknown>")))
    else:
        x = x.withColumn("_note", note)
    x = x.where("_d is not null and _t <> ''")
    raw = F.col("_d")
    if page.prepare is not None:
        raw = page.prepare(raw)
    if page.factor != 1.0:
        raw = F.when((F.col("table_idx") >= page.factor_from) & raw.try_cast("double").isNotNull(), dates.scale_age(raw.try_cast("double"), page.factor)).otherwise(raw)
    if page.suffix:
        raw = F.regexp_replace(F.regexp_replace(raw, r"\s*[–-]\s*", f" {page.suffix} - "), r"$", f" {page.suffix}")
    if page.rest is not None:
        raw = dates.merge_date(raw, F.col("_r"))
    if page.end is not None:
        raw = F.concat_ws(" - ", raw, page.prepare(F.col("_e")) if page.prepare else F.col("_e"))
    x = x.withColumn("_raw", raw)
    if page.curated:
        known = rows.sparkSession.createDataFrame([(k.replace("\u2009", " "), *v) for k, v in page.curated.items()], "_raw string, _cd string, _cr string")
        x = x.withColumn("_key", F.replace("_raw", F.lit("\u2009"), F.lit(" "))).join(known.withColumnRenamed("_raw", "_key"), "_key", "left")
    else:
        x = x.withColumns({"_cd": F.lit(None).cast("string"), "_cr": F.lit(None).cast("string")})
    x = x.withColumn("_c", page.clean(F.col("_raw")) if page.clean else dates.clean_date(F.col("_raw"), page.scale))
    x = x.withColumn("date", F.coalesce("_cd", "_c.date")).withColumn("remark", F.array_join(F.filter(F.array("_note", F.coalesce("_cr", "_c.remark")), lambda r: r != ""), ", "))
    x = x.withColumn("_jd", julian.range_to_jd(F.col("date")))
    bracket = []
    if page.bracket:
        x = x.withColumns({"_b": F.col("_t"), "_t": strip(F.substring_index("_t", "(", 1))})
        bracket = [F.regexp_extract("_b", r"\(([^)]*)", 1).alias(page.bracket)]
    event = F.when(F.col("remark") != "", F.concat(F.lit("Date: "), F.col("remark"), F.lit(", "), F.col("_t"))).otherwise(F.col("_t"))
    out = x.select("pos", "date", "remark", event.alias("event"), F.col("_jd.jd_start").alias("jd_start"), F.col("_jd.jd_end").alias("jd_end"), *bracket, *[_cell(i).alias(n) for n, i in page.kept.items()])
    if page.distinct:
        # equal dates are neighbours in the order of time, so only rows of one time can repeat the one before
        at = Window.partitionBy("jd_start", F.coalesce("jd_end", "jd_start")).orderBy("pos")
        out = out.withColumn("_p", F.lag(F.struct("date", "event")).over(at)).where(~F.struct("date", "event").eqNullSafe(F.col("_p"))).drop("_p") if page.order == "time" else ordered.drop_repeats(out, "pos", ["date", "event"], TABLE_ROWS)
    if page.order == "time":
        return out.orderBy("jd_start", F.coalesce("jd_end", "jd_start"), "pos")
    return out.orderBy(F.col("pos").desc() if page.order == "reverse" else F.col("pos"))


def markdown(timeline: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """The rows of a timeline as lines of a Markdown table."""
    return timeline.withColumn("line", F.concat(F.lit("| "), F.concat_ws(" | ", "date", "event", *[F.coalesce(F.col(k), F.lit("")) for k in kept]), F.lit(" |")))


def titled(timeline: DataFrame, titles: DataFrame) -> DataFrame:
    """A timeline with the title of each row's table; ``titles`` has table_idx and title, small ones are broadcast by their measured size."""
    t = timeline.withColumn("table_idx", F.floor(F.col("pos") / TABLE_ROWS).cast("int"))
    return t.join(titles.select("table_idx", "title"), "table_idx", "left")


def terms_and_births(rows: DataFrame, person: int = 2, term: int = 3) -> tuple[DataFrame, DataFrame]:
    """Two timelines of one table: (name, date) of terms of office, and of births and deaths.

    Persons are written ``Name (b. May 1, 1900)`` or ``Name (1900–1970)``, terms ``May 1, 1900 – May 2, 1904``.
    """
    x = rows.select(remove_footnotes(_cell(person)).alias("_p"), remove_footnotes(_cell(term)).alias("_t")).where("_p is not null and _t is not null")
    day = lambda c: F.when(F.contains(c, F.lit(",")), dates.merge_date(strip(F.substring_index(c, ",", -1)), strip(F.substring_index(c, ",", 1)))).otherwise(strip(c))
    name = strip(F.substring_index("_p", "(", 1))
    life = strip(F.replace(F.regexp_extract("_p", r"\(([^)]*)", 1), F.lit("b. "), F.lit("")))
    ends = F.split(F.regexp_replace("_t", r"\s*–\s*", " - "), " - ")
    until = F.get(ends, F.lit(1))
    span = F.concat_ws(" - ", day(F.get(ends, F.lit(0))), F.when(until.isNotNull() & (strip(until) != "Incumbent"), day(until)))
    lived = F.when(F.contains(life, F.lit(",")), day(life)).otherwise(F.regexp_replace(life, r"\s*–\s*", " - "))
    return x.select(name.alias("name"), span.alias("date")), x.select(name.alias("name"), lived.alias("date"))


def missions(rows: DataFrame) -> DataFrame:
    """(date, event) of launches: an English date and a sentence made of the columns."""
    launch = remove_footnotes(_cell(3))
    text = F.concat(F.lit("Mission: "), F.concat_ws(", ", _cell(0), _cell(1)), F.lit(", spacecraft: "), remove_footnotes(_cell(2)), F.lit(" on "), _cell(8), F.lit(" by "), _cell(4), F.lit(", mission type: "), _cell(5), F.lit(" resulted in "), _cell(6))
    x = rows.select(F.date_format(F.try_to_timestamp(launch, F.lit("d MMMM yyyy")), "yyyy-MM-dd").alias("date"), F.concat_ws(". ", text, remove_footnotes(_cell(7))).alias("event"))
    return x.where("date is not null and event is not null")


def _history(first: int, last: int, **k) -> Page:
    return Page(tables=((first, last),), rest=1, text=(2,), **k)


def _c_dot(c: Column) -> Column:
    return F.substring_index(F.regexp_replace(c, r"^c\.\s*", ""), " ", 1)


def _year_range(c: Column) -> Column:
    """``1279-1368 reign`` as ``1279 - 1368``, and ``960 about`` as ``960``."""
    return F.regexp_replace(F.regexp_replace(c, r"^(\d+)[^-]*?-\s*(\d+)(?!\d|-).*$", "$1 - $2"), r"^(\d+) (?!BC\b|-).*$", "$1")


#: The pages whose tables the engine knows.
PAGES: dict[str, Page | tuple[Page, ...]] = {
    "biblical_chronology": Page(((8, 19),), text=(1, 2), prepare=_c_dot, suffix="BC", header=("no",)),
    "chinese_history": (Page(tables=((11, 11),), prepare=_year_range), _history(12, 54, prepare=_year_range)),
    "volcanic_eruptions": Page(((1, 6),), date=4, text=(1, 2, 5), kept={"vei": 0, "volume": 3}, scale="kya BP", factor=1000.0, factor_from=5, prepare=lambda c: F.replace(c, F.lit("+"), F.lit("")), order="reverse"),
    "holocene_eruptions": Page(((0, 2),), date=5, text=(1, 2, 6), kept={"vei": 0, "volume": 3}, prepare=lambda c: dates.tolerance_to_range(F.regexp_replace(c, r"c\.\s*|\?| CE$", ""), "BP"), order="reverse"),
    "impact_structures": Page(((1, 1),), date=4, text=(0, 1, 2), kept={"diameter": 3, "confirmed": 5}, prepare=dates.impact_age, order="time"),
    "environmental_history": Page(((0, 31),), date=0, end=1, text=(2,), prepare=dates.phrase, clean=dates.tolerant_span),
    "geologic_time": Page(((1, 4),), date=1, text=(0,), kept={"duration": 2, "etymology": 3}, prepare=lambda c: F.replace(F.replace(F.translate(c, ",~", ""), F.lit("to"), F.lit("Ma BP -")), F.lit(" million years ago"), F.lit(" Ma BP")), order="time"),
    "evolution_of_life": Page(((23, 25), (27, 27), (29, 29), (31, 31)), prepare=dates.spread_unit),
    "human_evolution_taxonomy": Page(((0, 0),), date=3, text=(2,), kept={"rank": 0, "name": 1}, scale="Ma BP"),
    "human_evolution_events": Page(((39, 47),), prepare=lambda c: F.replace(c, F.lit("after "), F.lit(""))),
    "german_history": _history(0, 20, prepare=dates.eras),
    "italian_history": _history(2, 35, prepare=dates.eras),
    "irish_history": _history(0, 22, order="time"),
    "british_history": _history(0, 22),
    "iranian_history": _history(0, 32),
    "egyptian_pyramids": Page(((12, 12),), date=1, text=(0,), bracket="pharaoh", kept={"field": 2, "height": 3}),
    "egyptian_dynasties": Page(((12, 12),), date=2, end=3, text=(0,), kept={"seat": 1, "duration": 4, "first": 5, "last": 6}),
    "bond_events": Page(((0, 0),), date=2, text=(4,), kept={"id": 0}),
    "anatolian_history": (
        Page(((0, 6),), date=1, text=(0,), prepare=lambda c: F.regexp_replace(F.replace(c, F.lit("–present"), F.lit("")), r"^\((.*)\)$|[();].*$", "$1"), order="time", distinct=True),
        _history(8, 30, order="time", distinct=True),
    ),
    "romanian_history": _history(3, 28),
    "spanish_history": _history(1, 16),
    "portuguese_history": _history(0, 19),
    "indian_history": _history(0, 44),
    "roman_history": _history(0, 21),
    "post_classical_history": Page(((3, 12),), rest=1, text=(2, 3), separator=" "),
    "buddhist_history": Page(((4, 29),)),
    "renaissance_composers": Page(((3, 3),), date=1, text=(0,), kept={"nationality": 2, "works": 3}, curated=curated.table(curated.RENAISSANCE_COMPOSERS), order="time"),
    "medieval_composers": Page(((3, 3),), date=1, text=(0,), kept={"nationality": 2, "works": 3}, curated=curated.table(curated.MEDIEVAL_COMPOSERS), order="time"),
    "byzantine_composers": Page(((0, 0),), date=1, text=(0,), kept={"works": 2}, curated=curated.table(curated.BYZANTINE_COMPOSERS), order="time"),
    "hominin_fossils": Page(((0, 4),), date=1, text=(0,), kept={"species": 2, "place": 3}, prepare=dates.fossil_date, fill=True, order="time"),
}


def transposed(rows: DataFrame) -> DataFrame:
    """A table turned over: (name, one column a row of the table), its first column giving the names of the new columns."""
    n = rows.agg(F.max(F.size("cells")).alias("n")).first().n or 0
    x = rows.select(F.coalesce(_cell(0), F.lit("")).alias("_k"), *[_cell(i).alias(f"c{i:04d}") for i in range(1, n)])
    return x.transpose(F.col("_k")).withColumnRenamed("key", "name")
