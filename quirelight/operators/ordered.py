"""Operators whose result depends on an order over all rows, in levels so that no task holds the whole order.

Rows go into buckets of neighbouring order keys; a window runs within each bucket, one row of each bucket carries over, and those rows go into buckets in
turn.  At the default width the topmost window holds one row of every four thousand million keys.  Order keys are whole numbers; ``width`` keys make
a bucket.  Ties fall to ``tie``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

WIDTH, LEVELS = 65_536, 2


def _before(df: DataFrame, key: str, value: str, out: str, width: int, tie: list[str], levels: int = LEVELS) -> DataFrame:
    """``df`` with the last value that is not null in the rows before each."""
    rows = lambda w: w.orderBy(key, *tie).rowsBetween(Window.unboundedPreceding, -1)
    if not levels:
        return df.withColumn(out, F.last(value, ignorenulls=True).over(rows(Window.partitionBy())))
    b, own, last, carried = f"_b{levels}", f"_own{levels}", f"_last{levels}", f"_carried{levels}"
    x = df.withColumn(b, F.floor(F.col(key) / width))
    x = x.withColumn(own, F.last(value, ignorenulls=True).over(rows(Window.partitionBy(b))))
    ends = x.groupBy(b).agg(F.max_by(F.when(F.col(value).isNotNull(), F.col(value)), F.when(F.col(value).isNotNull(), F.struct(key, *tie))).alias(last))
    ends = _before(ends, b, last, carried, width, [], levels - 1).select(b, carried)
    return x.join(ends, b).withColumn(out, F.coalesce(own, carried)).drop(b, own, carried)


def forward_fill(df: DataFrame, key: str, values: dict[str, str], given: Column, width: int = WIDTH, tie: list[str] | None = None) -> DataFrame:
    """Columns ``values`` (new name: source) of the last row at or before this one where ``given`` holds; null before the first."""
    x = df.withColumn("_v", F.when(given, F.struct(*[F.col(s).alias(n) for n, s in values.items()])))
    x = _before(x, key, "_v", "_p", width, tie or []).withColumn("_f", F.coalesce("_v", "_p"))
    return x.select(*[F.col(c) for c in df.columns], *[F.col(f"_f.{n}").alias(n) for n in values])


def running_total(df: DataFrame, key: str, value: str, out: str, width: int = WIDTH, tie: list[str] | None = None, levels: int = LEVELS) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before this one."""
    total = lambda w: F.sum(value).over(w.orderBy(key, *(tie or [])).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    if not levels:
        return df.withColumn(out, total(Window.partitionBy()))
    b, inside, s, before = f"_b{levels}", f"_in{levels}", f"_s{levels}", f"_before{levels}"
    x = df.withColumn(b, F.floor(F.col(key) / width))
    x = x.withColumn(inside, total(Window.partitionBy(b)))
    sums = running_total(x.groupBy(b).agg(F.sum(value).alias(s)), b, s, before, width, None, levels - 1).select(b, before)
    return x.join(sums, b).withColumn(out, F.col(before) + F.col(inside)).drop(b, inside, before)


def drop_repeats(df: DataFrame, key: str, same: list[str], width: int = WIDTH, tie: list[str] | None = None) -> DataFrame:
    """Rows that differ in ``same`` from the row just before them; nulls are equal."""
    x = _before(df.withColumn("_s", F.struct(*same)), key, "_s", "_p", width, tie or [])
    return x.where(~F.col("_s").eqNullSafe(F.col("_p"))).select(*[F.col(c) for c in df.columns])


def first_wins(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key; rows with a null key form one group.

    Kept by a minimum that is combined before the shuffle, so a hot key costs one row a task.
    """
    whole = F.struct(*[F.col(c) for c in (*order, *[x for x in df.columns if x not in order])])
    best = df.groupBy(key.alias("_k")).agg(F.min_by(whole, F.struct(*order)).alias("_w"))
    return best.select(*[F.col(f"_w.{c}").alias(c) for c in df.columns])


def duplicate_keys(df: DataFrame, key: Column) -> DataFrame:
    """(key, n) of keys that several rows claim."""
    return df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def ordered_list(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """(group, out): the values of each group as a list in order."""
    x = df.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))).alias("_l"))
    return x.select(*group, F.transform("_l", lambda s: s["_v"]).alias(out))


def reverse_within(df: DataFrame, group: list[str], pos: str) -> DataFrame:
    """Groups in order, each one's rows from the last to the first."""
    return df.orderBy(*group, F.col(pos).desc())


def accepted_notes(notes: DataFrame) -> DataFrame:
    """Notes that keep their place when an earlier one may hold their title or uuid: (…, accepted).

    ``notes`` has pos (unique), title_key and uuid.  The rule is one of order: a note that is turned down claims neither its title nor its uuid; null
    uuids claim nothing, null titles are one title.  In rounds, the notes that are first of the open ones both by title and by uuid are
    accepted, and all that share a title or uuid with them are closed.  First ones come from minima that are combined before the shuffle, so that a title that a
    third of the notes bear costs one row a task, and is closed after one round.
    """
    opened, accepted = notes.select("pos", "title_key", "uuid"), None
    while True:
        by_title = opened.groupBy("title_key").agg(F.min("pos").alias("pos"), F.min_by("uuid", "pos").alias("uuid"))
        by_uuid = opened.where("uuid is not null").groupBy("uuid").agg(F.min("pos").alias("first"))
        new = stored(by_title.join(by_uuid, "uuid", "left").where("uuid is null or pos = first").select("pos", "title_key", "uuid"), "accepted")
        accepted = new if accepted is None else accepted.unionByName(new)
        titles, uuids = new.select(F.col("title_key").alias("_t")), new.where("uuid is not null").select("uuid")
        opened = stored(opened.join(titles, F.col("title_key").eqNullSafe(F.col("_t")), "left_anti").join(uuids, "uuid", "left_anti").select("pos", "title_key", "uuid"), "open")
        if opened.isEmpty():
            break
    return notes.join(accepted.select("pos", F.lit(True).alias("accepted")), "pos", "left").select(*notes.columns, F.coalesce("accepted", F.lit(False)).alias("accepted"))
