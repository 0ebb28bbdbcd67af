"""Time texts and Julian days, from geological ages to the present, by integer arithmetic on BIGINT.

Proleptic Gregorian; 1 BC is year 0; BP counts back from 1950; a year is its 1 January and a month its first day; the end of a range
is the start of what is written there.  Texts outside the grammar give null.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .text import let, strip

#: Julian day of 1970-01-01 00:00.
EPOCH_JD = 2_440_587.5
_CIVIL = r"(?i)^(\d{1,7})(?:-(\d{1,2}))?(?:-(\d{1,2}))?(?:\s+(BCE|BC|AD|CE))?$"
_SCALED = r"(?i)^(\d+(?:\.\d+)?)\s*(kya|ka|mya|ma|bya|ga)(?:\s+BP)?$"
_BP = r"(?i)^(\d+(?:\.\d+)?)\s*BP$"
#: Years before this one are written as ages.
OLDEST_CIVIL = -9999


def _div(a: Column, b: int) -> Column:
    """Floor division of whole numbers."""
    return F.when(a >= 0, _int_div(a, b)).otherwise(-_int_div(-a + (b - 1), b))


def _int_div(a: Column, b: int) -> Column:
    return F.call_function("div", a.cast("bigint"), F.lit(b).cast("bigint"))


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a civil date with astronomical years of any size."""

    def of(yy: Column) -> Column:
        def in_era(era: Column) -> Column:
            yoe = yy - era * 400
            mp = F.when(m > 2, m - 3).otherwise(m + 9)
            doy = _int_div(mp * 153 + 2, 5) + d - 1
            return era * 146_097 + yoe * 365 + _int_div(yoe, 4) - _int_div(yoe, 100) + doy - 719_468

        return let(_div(yy, 400), in_era)

    return let((y - F.when(m <= 2, 1).otherwise(0)).cast("bigint"), of)


def civil_from_days(z: Column) -> Column:
    """struct(y, m, d) of days since 1970-01-01."""

    def of(days: Column) -> Column:
        def in_era(era: Column) -> Column:
            doe = days - era * 146_097

            def year(yoe: Column) -> Column:
                doy = doe - (yoe * 365 + _int_div(yoe, 4) - _int_div(yoe, 100))

                def month(mp: Column) -> Column:
                    m = F.when(mp < 10, mp + 3).otherwise(mp - 9)
                    y = yoe + era * 400 + F.when(m <= 2, 1).otherwise(0)
                    return F.struct(y.alias("y"), m.alias("m"), (doy - _int_div(mp * 153 + 2, 5) + 1).alias("d"))

                return let(_int_div(doy * 5 + 2, 153), month)

            yoe = _int_div(doe - _int_div(doe, 1460) + _int_div(doe, 36_524) - _int_div(doe, 146_096), 365)
            return let(yoe, year)

        return let(_div(days, 146_097), in_era)

    return let((z + 719_468).cast("bigint"), of)


def _year_start(y: Column) -> Column:
    return days_from_civil(y.cast("bigint"), F.lit(1), F.lit(1)) + F.lit(EPOCH_JD)


def point_to_jd(text: Column) -> Column:
    """Julian day of one point in time."""

    def civil(s: Column) -> Column:
        num = lambda k: F.nullif(F.regexp_extract(s, _CIVIL, k), F.lit(""))
        bc = F.upper(F.regexp_extract(s, _CIVIL, 4)).isin("BC", "BCE")
        parts = F.struct(num(1).try_cast("bigint").alias("y"), F.coalesce(num(2).try_cast("int"), F.lit(1)).alias("m"), F.coalesce(num(3).try_cast("int"), F.lit(1)).alias("d"), bc.alias("bc"))

        def day(p: Column) -> Column:
            ay = F.when(p["bc"], 1 - p["y"]).otherwise(p["y"])
            leap = (F.pmod(ay, F.lit(4)) == 0) & ((F.pmod(ay, F.lit(100)) != 0) | (F.pmod(ay, F.lit(400)) == 0))
            longest = F.when(p["m"] == 2, F.when(leap, 29).otherwise(28)).when(p["m"].isin(4, 6, 9, 11), 30).otherwise(31)
            return F.when(p["m"].between(1, 12) & p["d"].between(1, longest) & ~(p["bc"] & (p["y"] == 0)), days_from_civil(ay, p["m"], p["d"]) + F.lit(EPOCH_JD))

        return let(parts, day)

    def age(s: Column) -> Column:
        num = lambda rx: F.nullif(F.regexp_extract(s, rx, 1), F.lit("")).try_cast("double")
        unit = F.lower(F.substring(F.regexp_extract(s, _SCALED, 2), 1, 1))
        years = F.coalesce(num(_SCALED) * F.when(unit == "k", 1e3).when(unit == "m", 1e6).otherwise(1e9), num(_BP))
        return let(F.lit(1950) - F.round(years).cast("bigint"), _year_start)

    return let(strip(text), lambda s: F.when(s.rlike(_CIVIL), civil(s)).when(s.rlike(_SCALED) | s.rlike(_BP), age(s)))


def range_to_jd(text: Column) -> Column:
    """struct(jd_start, jd_end) of a point (end null) or of a range written with `` - ``; null if any part is no time."""

    def of(days: Column) -> Column:
        start, end = F.get(days, F.lit(0)), F.get(days, F.lit(1))
        whole = (F.size(days) <= 2) & start.isNotNull() & ((F.size(days) == 1) | end.isNotNull())
        return F.when(whole, F.struct(start.alias("jd_start"), end.alias("jd_end")))

    return let(F.transform(F.split(text, " - "), point_to_jd), of)


def range_of(spark: SparkSession, text: str) -> tuple[float, float | None] | None:
    """A range as plain numbers, for queries about one period: worked out once instead of in every row."""
    r = spark.range(1).select(range_to_jd(F.lit(text)).alias("r")).first().r
    return None if r is None else (r.jd_start, r.jd_end)


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(F.format_string("%.6f", x), r"\.?0+$", "")


def jd_to_text(jd: Column) -> Column:
    """The shortest text of the grammar that gives the day: ``1815-06-18``, ``753 BC``, ``10 ka BP``."""

    def of(c: Column) -> Column:
        y, m, d = c["y"], c["m"], c["d"]
        rest = F.when((m == 1) & (d == 1), F.lit("")).when(d == 1, F.format_string("-%02d", m)).otherwise(F.format_string("-%02d-%02d", m, d))
        age = (F.lit(1950) - y).cast("double")
        old = F.when(age >= 1e9, F.concat(_trimmed(age / 1e9), F.lit(" Ga BP"))).when(age >= 1e6, F.concat(_trimmed(age / 1e6), F.lit(" Ma BP"))).otherwise(F.concat(_trimmed(age / 1e3), F.lit(" ka BP")))
        return F.when(y < OLDEST_CIVIL, old).when(y <= 0, F.concat((1 - y).cast("string"), rest, F.lit(" BC"))).otherwise(F.concat(y.cast("string"), rest))

    return let(civil_from_days(F.floor(jd - F.lit(EPOCH_JD)).cast("bigint")), of)


def event_date_text(jd_start: Column, jd_end: Column) -> Column:
    """``a`` or ``a - b``."""
    return F.concat_ws(" - ", jd_to_text(jd_start), jd_to_text(jd_end))


def timestamp_to_jd(ts: Column) -> Column:
    """Julian day of a timestamp with or without zone (then by the session's zone), with the time of day as a fraction."""
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts).cast("double")
    return F.unix_date(F.to_date(ts)) + seconds / F.lit(86_400.0) + F.lit(EPOCH_JD)
