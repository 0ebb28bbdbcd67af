"""Events on one numeric time axis: interval classes, queries, events from tables and from years in texts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.julian import EPOCH_JD, days_from_civil, range_of, range_to_jd
from ..functions.text import snippet, strip
from .keywords import domain_filter, event_text, keyword_filter

INSIDE, SURROUNDING, PARTIAL = "inside", "surrounding", "partial"
YEAR = r"\b((?:18|19|20)\d{2})\b"


def time_class(start: Column, end: Column, query_start: Column, query_end: Column) -> Column:
    """How an event lies to a query: inside, surrounding, partial, or null.  A null end makes a point, of the event as of the query.

    Touching an end point only is no match, and a point query is never partial.
    """
    es, ee, qs, qe = start, F.coalesce(end, start), query_start, F.coalesce(query_end, query_start)
    over = (es >= qs) & (es < qe) & (ee > qe) | (ee <= qe) & (ee > qs) & (es < qs)
    return F.when((es >= qs) & (ee <= qe), INSIDE).when((es < qs) & (ee > qe), SURROUNDING).when(over, PARTIAL)


def order_by_time(events: DataFrame) -> DataFrame:
    """By start, then end (a point ends where it starts), then input order."""
    return events.orderBy("jd_start", F.coalesce("jd_end", "jd_start"), *(["seq"] if "seq" in events.columns else []))


def search_events(
    events: DataFrame, time: str | None = None, domains: Iterable[str] = (), keywords: Iterable[str] = (), classes: Iterable[str] = (INSIDE, SURROUNDING, PARTIAL)
) -> DataFrame:
    """Events that fit a time text, domains and keywords, with their ``time_class``; cheap predicates come first.

    One pass serves all classes.  A time text outside the grammar gives no rows.
    """
    x = events
    if time is not None:
        q = range_of(events.sparkSession, time)
        start, end = q or (None, None)
        x = x.withColumn("time_class", time_class(F.col("jd_start"), F.col("jd_end"), F.lit(start).cast("double"), F.lit(end).cast("double"))).where(F.col("time_class").isin(*classes))
    if list(domains):
        x = x.where(domain_filter(F.col("metadata")["domain"], domains))
    if list(keywords):
        x = x.where(keyword_filter(event_text(F.col("eventdata"), F.col("metadata")), keywords))
    return x


def timeline(events: DataFrame, time: str | None = None, domains: str = "", keywords: str = "") -> DataFrame:
    """The command line's query: specs split at blanks; with a time, surrounding, partial and inside events follow each other."""
    x = search_events(events, time, domains.split(), keywords.split())
    if time is None:
        return order_by_time(x)
    part = F.when(F.col("time_class") == SURROUNDING, 0).when(F.col("time_class") == PARTIAL, 1).otherwise(2)
    return x.orderBy(part, "jd_start", F.coalesce("jd_end", "jd_start"), *(["seq"] if "seq" in x.columns else []))


def order_rejected(table: list[str], pos: str, start: str = "jd_start", end: str = "jd_end") -> Column:
    """Whether a row of a table breaks its time order: it starts before an earlier row, or starts with one and ends before it.

    Two running maxima decide it, as a row rejected for order never starts later than the last accepted one.
    """
    w1 = Window.partitionBy(*table).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    w2 = Window.partitionBy(*table, start).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    last, last_end = F.max(start).over(w1), F.max(end).over(w2)
    return F.coalesce(F.col(start) < last, F.lit(False)) | (last_end.isNotNull() & (F.col(end).isNull() | (F.col(end) < last_end)))


def eligible_tables(tables: DataFrame) -> DataFrame:
    """Tables of dated events: two columns or more, rows of the same width, first column ``Date``, a domain not claimed before.

    ``tables`` has table_id (its order), columns, rows, metadata.
    """
    width = F.size("columns")
    fit = tables.where((width >= 2) & F.forall("rows", lambda r: F.size(r) == width) & (F.get("columns", F.lit(0)) == "Date") & F.col("metadata")["domain"].isNotNull())
    first = F.row_number().over(Window.partitionBy(F.col("metadata")["domain"]).orderBy("table_id"))
    return fit.withColumn("_r", first).where("_r = 1").drop("_r")


def table_events(tables: DataFrame, check_order: bool = True) -> DataFrame:
    """Events of the rows of dated tables: (table_id, pos, jd_start, jd_end, eventdata, metadata, skip_reason); accepted rows have no reason."""
    each = eligible_tables(tables).select("table_id", "columns", "metadata", F.posexplode("rows").alias("pos", "row"))
    date = strip(F.get("row", F.lit(0)))
    x = each.withColumn("_jd", range_to_jd(date)).withColumns({"jd_start": F.col("_jd.jd_start"), "jd_end": F.col("_jd.jd_end")})
    names = F.slice("columns", F.lit(2), F.size("columns") - 1)
    data = F.map_from_entries(F.array_distinct(F.arrays_zip(names.alias("key"), F.slice("row", F.lit(2), F.size("row") - 1).alias("value"))))
    reason = F.when((date == "Date") | date.rlike("^:?-+:?$"), "header").when(F.col("_jd").isNull(), "date").when(F.col("jd_end") < F.col("jd_start"), "reversed")
    x = x.withColumn("eventdata", data).withColumn("skip_reason", reason).drop("_jd", "columns", "row")
    if not check_order:
        return x
    valid = x.where("skip_reason is null").withColumn("_rejected", order_rejected(["table_id"], "pos"))
    valid = valid.withColumn("skip_reason", F.when(F.col("_rejected"), "order")).drop("_rejected")
    return valid.unionByName(x.where("skip_reason is not null"))


def proposed_order(events: DataFrame) -> DataFrame:
    """The rows of each table in the order their times call for."""
    return events.orderBy("table_id", "jd_start", F.coalesce("jd_end", "jd_start"), "pos")


def year_events(entries: DataFrame, text: str = "doc_text", title: str = "title") -> DataFrame:
    """One event for each year from 1800 to 2099 in a text: all of the entry's columns, position_offset, jd_start and eventdata.

    Offsets come from the lengths of the parts between the years, so that no text leaves the JVM.
    """
    pieces = F.split(F.col(text), YEAR)
    years = F.regexp_extract_all(F.col(text), F.lit(YEAR), F.lit(1))
    x = entries.withColumn("_p", pieces).select(*[F.col(c) for c in entries.columns], "_p", F.posexplode(years).alias("_i", "year"))
    before = F.aggregate(F.slice("_p", F.lit(1), F.col("_i") + 1), F.lit(0), lambda a, p: a + F.length(p))
    x = x.withColumn("position_offset", before + F.col("_i") * 4)
    data = F.create_map(F.lit("Title"), F.col(title), F.lit("Text_snip"), snippet(F.col(text), F.col("position_offset")))
    jd = days_from_civil(F.col("year").cast("bigint"), F.lit(1), F.lit(1)) + F.lit(EPOCH_JD)
    return x.withColumns({"jd_start": jd, "jd_end": F.lit(None).cast("double"), "eventdata": data}).drop("_p", "_i")


def event_counts(events: DataFrame) -> DataFrame:
    """Events added, and skipped by reason."""
    return events.groupBy(F.coalesce("skip_reason", F.lit("added")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
