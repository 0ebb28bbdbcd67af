"""Joins of points and intervals with intervals by bucketed equi-joins instead of nested loops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored


def _buckets(lo: Column, hi: Column, width: float) -> Column:
    return F.sequence(F.floor(lo / width), F.floor(hi / width))


def overlap_join(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], width: float, most_buckets: int = 64) -> DataFrame:
    """Pairs whose closed intervals meet.  Both ends must be given and in order; null or reversed intervals meet nothing.

    An interval has the lowest of four levels at which it touches at most ``most_buckets`` buckets; the buckets of each level are
    ``most_buckets`` squared times as wide as those below, from ``width`` on.  Two intervals meet in the buckets of the higher of their levels, in one equi-join, and count
    only in the first bucket that both touch, so no pair comes twice and long intervals multiply nothing.  Both sides are stored once, as which of the four levels
    occur is looked up first, so that usually each row is listed once.
    """
    (ls, le), (rs, re) = left_range, right_range
    widths = _widths(width, most_buckets)
    lx, rx = (stored(df.where(F.col(s) <= F.col(e)).withColumn(c, _level(F.col(e) - F.col(s), widths, most_buckets)), "intervals") for df, s, e, c in ((left, ls, le, "_ll"), (right, rs, re, "_rl")))
    here, there = _levels(lx, "_ll"), _levels(rx, "_rl")

    def listed(df: DataFrame, s: str, e: str, name: str, own: list[int], other: list[int], out: str) -> DataFrame:
        spots = F.array().cast("array<struct<m:int,b:bigint>>")
        for a in own:
            at = [F.transform(_buckets(F.col(s), F.col(e), widths[m]), _spot(m)) for m in sorted({max(a, b) for b in other})]
            if at:
                spots = F.when(F.col(name) == a, F.concat(*at)).otherwise(spots)
        return df.withColumn(out, F.explode(spots))

    x, y = listed(lx, ls, le, "_ll", here, there, "_x"), listed(rx, rs, re, "_rl", there, here, "_y")
    wide = F.element_at(F.array(*map(F.lit, widths)), F.col("_x.m") + 1)
    same = (F.col("_x.m") == F.col("_y.m")) & (F.col("_x.b") == F.col("_y.b"))
    meet = (F.col(ls) <= F.col(re)) & (F.col(rs) <= F.col(le)) & (F.greatest("_ll", "_rl") == F.col("_x.m")) & (F.col("_x.b") == F.floor(F.greatest(ls, rs) / wide))
    return x.join(y, same & meet).drop("_x", "_y", "_ll", "_rl")


def _widths(width: float, most_buckets: int) -> list[float]:
    return [float(width) * most_buckets ** (2 * k) for k in range(4)]


def _level(length: Column, widths: list[float], most_buckets: int) -> Column:
    """The lowest level at which an interval touches few buckets."""
    level = F.lit(3)
    for k in (2, 1, 0):
        level = F.when(length <= widths[k] * most_buckets, k).otherwise(level)
    return level


def _levels(df: DataFrame, name: str) -> list[int]:
    """Which of the four levels occur; four rows at most come to the driver."""
    return sorted(r[0] for r in df.select(name).distinct().collect())


def _spot(m: int) -> Callable[[Column], Column]:
    return lambda b: F.struct(F.lit(m).alias("m"), b.alias("b"))


def point_in_range(points: DataFrame, ranges: DataFrame, point: str, lo: str, hi: str, width: int, most_buckets: int = 64) -> DataFrame:
    """Points with the ranges ``lo <= point < hi`` that hold them.

    A range is listed in the buckets of its own level only, so a long one multiplies nothing; a point is listed once for each level that occurs.
    """
    widths = _widths(width, most_buckets)
    y = stored(ranges.where(F.col(lo) < F.col(hi)).withColumn("_l", _level(F.col(hi) - F.col(lo), widths, most_buckets)), "ranges")
    levels = _levels(y, "_l")
    if not levels:
        levels = [0]
    w = F.element_at(F.array(*map(F.lit, widths)), F.col("_l") + 1)
    y = y.withColumn("_c", F.explode(F.sequence(F.floor(F.col(lo) / w), F.floor((F.col(hi) - 1) / w))))
    x = points.withColumn("_x", F.explode(F.array(*[_spot(m)(F.floor(F.col(point) / widths[m])) for m in levels])))
    same = (F.col("_x.m") == F.col("_l")) & (F.col("_x.b") == F.col("_c"))
    return x.join(y, same & (F.col(point) >= F.col(lo)) & (F.col(point) < F.col(hi))).drop("_x", "_l", "_c")
