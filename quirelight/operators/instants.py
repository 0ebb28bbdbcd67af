"""Mixed timestamp texts to unambiguous UTC instants.

Distinct (text, zone, locale) triples form a dictionary that is parsed once and joined back to the rows, so the cost of
parsing follows the number of different texts, not the number of rows.  Parsing is a chain of JVM expressions.

Defined results: null, blank, placeholder and impossible texts give a null instant; so do years before 1400, the
year 9999 and a wall-clock time in an unknown or missing zone.  A null locale counts as day first.
"""

from __future__ import annotations

import zlib
import zoneinfo
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import exists, shared_dir

#: Month names (full and abbreviated) of the four languages the tools write.
MONTHS = {
    1: "january jan januar jänner jän janvier janv enero ene",
    2: "february feb februar février févr fév febrero",
    3: "march mar märz mär mrz mars marzo",
    4: "april apr avril avr abril abr",
    5: "may mai mayo",
    6: "june jun juni juin junio",
    7: "july jul juli juillet juil julio",
    8: "august aug août aoû agosto ago",
    9: "september sep sept septembre septiembre setiembre",
    10: "october oct oktober okt octobre octubre",
    11: "november nov novembre noviembre",
    12: "december dec dezember dez décembre déc diciembre dic",
}
#: Offsets in minutes of the zone abbreviations.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "JST": 540, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
#: The one spelling that needs no normalising.
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\+00:00$"

_WITH_TIME = (
    r"^(.+?)(?:(?:[Tt]|,? )(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?: ?([AaPp]\.?[Mm]\.?|[Uu]hr)(?![A-Za-z]))?"
    r" ?([Zz]|[A-Za-z]{2,5}|(?:UTC|GMT)?[+-]\d{2}(?::?\d{2})?|[A-Za-z_]+(?:/[A-Za-z0-9_+-]+)+)?(?:\[([^\]]+)\])?)?$"
)
_DAY = 86_400_000_000


def _int(c: Column) -> Column:
    return F.when(c != "", c).try_cast("int")


def known_zones(spark: SparkSession) -> list[str]:
    """Zone names the JVM can resolve."""
    try:
        return sorted(str(z) for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds())
    except AttributeError:  # a remote session has no JVM handle
        return sorted(zoneinfo.available_timezones())


def with_instant(df: DataFrame, raw: str = "raw", zone: str = "zone", locale: str = "locale", out: str = "epoch_us") -> DataFrame:
    """Parse ``raw`` of every row into microseconds since 1970-01-01 UTC, further digits cut.

    All other columns pass through under any name; a column named ``out`` is replaced.
    """
    kept = [c for c in df.columns if c != out]
    df = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(raw).alias("_raw"), F.col(zone).alias("_zone"), F.col(locale).alias("_locale"))
    raw, zone, locale = "_raw", "_zone", "_locale"
    month_of = F.create_map(*chain.from_iterable((F.lit(w), F.lit(m)) for m, names in MONTHS.items() for w in names.split()))
    offset_of = F.create_map(*chain.from_iterable((F.lit(a), F.lit(m)) for a, m in ABBREVIATIONS.items()))

    s = F.regexp_replace(F.regexp_replace(F.col(raw), r"(?U)\s+", " "), r"^ | $", "")
    s = F.regexp_replace(s, r"(?U)^\p{L}+\.?, (?=\d)", "")  # a weekday says nothing new
    s = F.regexp_replace(s, r"^(\d{8})[Tt](\d{2})(\d{2})(\d{2})(?=\D|$)", "$1T$2:$3:$4")
    x = df.withColumn("_s", s)
    part = lambda k: F.regexp_extract("_s", _WITH_TIME, k)
    x = x.withColumns({f"_t{k}": part(k) for k in range(1, 9)})
    date = F.col("_t1")
    ex = lambda rx, k: F.regexp_extract(date, rx, k)
    ymd, dmy = r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})$", r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4})$"
    day_name, name_day = r"(?U)^(\d{1,2})(?:\.|st|nd|rd|th)? (?:de )?(\p{L}+)\.? (?:de )?(\d{4})$", r"(?U)^(\p{L}+)\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})$"
    name_year, year_month, month_year, year, packed = r"(?U)^(\p{L}+)\.?,?(?: de)? (\d{4})$", r"^(\d{4})[-/.](\d{1,2})$", r"^(\d{1,2})[/.](\d{4})$", r"^(\d{4})$", r"^(\d{4})(\d{2})(\d{2})$"
    month_first = F.coalesce(F.col(locale) == "en-US", F.lit(False)) & (ex(dmy, 2) == "/")
    named = lambda c: F.element_at(month_of, F.lower(c))
    triple = lambda y, m, d: F.struct(_int(y).alias("y"), (m if m is not None else F.lit(1)).cast("int").alias("m"), d.cast("int").alias("d"))
    one = F.lit(1)
    x = x.withColumn(
        "_d",
        F.when(date.rlike(ymd), triple(ex(ymd, 1), _int(ex(ymd, 3)), _int(ex(ymd, 4))))
        .when(date.rlike(dmy), triple(ex(dmy, 4), F.when(month_first, _int(ex(dmy, 1))).otherwise(_int(ex(dmy, 3))), F.when(month_first, _int(ex(dmy, 3))).otherwise(_int(ex(dmy, 1)))))
        .when(date.rlike(packed), triple(ex(packed, 1), _int(ex(packed, 2)), _int(ex(packed, 3))))
        .when(date.rlike(day_name), triple(ex(day_name, 3), named(ex(day_name, 2)), _int(ex(day_name, 1))))
        .when(date.rlike(name_day), triple(ex(name_day, 3), named(ex(name_day, 1)), _int(ex(name_day, 2))))
        .when(date.rlike(name_year), triple(ex(name_year, 2), named(ex(name_year, 1)), one))
        .when(date.rlike(year_month), triple(ex(year_month, 1), _int(ex(year_month, 2)), one))
        .when(date.rlike(month_year), triple(ex(month_year, 2), _int(ex(month_year, 1)), one))
        .when(date.rlike(year), triple(ex(year, 1), one, one)),
    )
    y, m, d = F.col("_d.y"), F.col("_d.m"), F.col("_d.d")
    first = F.when(y.between(1400, 9998) & m.between(1, 12), F.make_date(y, m, F.lit(1)))
    days = F.when(d.between(1, F.dayofmonth(F.last_day(first))), F.unix_date(first) + d - 1).cast("bigint")

    # no time of day: midnight UTC of that day
    hour, minute, second = _int(F.col("_t2")), _int(F.col("_t3")), F.coalesce(_int(F.col("_t4")), F.lit(0))
    micros = F.rpad(F.substring(F.coalesce(F.col("_t5"), F.lit("")), 1, 6), 6, "0").try_cast("bigint")
    half = F.lower(F.substring("_t6", 1, 1))
    hour = F.when(half.isin("a", "p"), F.when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))).otherwise(hour)
    in_day = F.when(hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59), ((hour * 60 + minute) * 60 + second).cast("bigint") * 1_000_000 + micros)
    wall = days * _DAY + in_day

    named_zone = F.regexp_replace("_t7", "^(?:UTC|GMT)(?=[+-])", "")
    digits = F.regexp_replace(named_zone, "[^0-9]", "")
    minutes = F.when(
        named_zone.rlike(r"^[+-]"),
        F.when(F.substring(named_zone, 1, 1) == "-", -1).otherwise(1) * (_int(F.substring(digits, 1, 2)) * 60 + F.coalesce(_int(F.substring(digits, 3, 2)), F.lit(0))),
    ).when(named_zone != "", F.element_at(offset_of, F.upper(named_zone)))
    minutes = F.when(F.abs(minutes) <= 18 * 60, minutes)
    region = (
        F.when(minutes.isNotNull(), F.lit(None))
        .when(named_zone.contains("/"), named_zone)
        .when(named_zone != "", F.lit(None))
        .when(F.col("_t8") != "", F.col("_t8"))
        .otherwise(F.col(zone))
    )
    x = x.withColumn("_wall", wall).withColumn("_minutes", minutes).withColumn("_region", F.when(region.isin(*known_zones(df.sparkSession)), region))
    # the JVM resolves a doubled wall time to its first occurrence and moves a skipped one forward by the gap
    zoned = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("_wall"), F.coalesce(F.col("_region"), F.lit("UTC"))))
    clocked = F.when(F.col("_minutes").isNotNull(), F.col("_wall") - F.col("_minutes").cast("bigint") * 60_000_000).when(F.col("_region").isNotNull(), zoned)

    # seconds, milliseconds, microseconds or nanoseconds since 1970
    epoch = r"^(-?)(\d{9,10})(?:[.,](\d+))?$"
    sign = F.when(F.regexp_extract("_s", epoch, 1) == "-", -1).otherwise(1)
    since = F.when(
        F.col("_s").rlike(epoch),
        sign * (F.regexp_extract("_s", epoch, 2).try_cast("bigint") * 1_000_000 + F.rpad(F.substring(F.regexp_extract("_s", epoch, 3), 1, 6), 6, "0").try_cast("bigint")),
    ).when(F.col("_s").rlike(r"^\d{12,13}$"), F.col("_s").try_cast("bigint") * 1000).when(F.col("_s").rlike(r"^\d{15,16}$"), F.col("_s").try_cast("bigint")).when(
        F.col("_s").rlike(r"^\d{18,19}$"), F.floor(F.col("_s").try_cast("bigint") / F.lit(1000))
    )
    found = F.when(since.isNotNull(), since).when(F.col("_t2") == "", days * _DAY).otherwise(clocked)
    return x.select("_row.*", found.cast("bigint").alias(out))


#: Raise it whenever the reading of texts changes, so that a kept dictionary is not used beyond it.
RULES = 2


def kept_at(spark: SparkSession) -> str:
    """Path of the dictionary that all runs share: by the version of the rules and of the zone data."""
    zones = zlib.crc32(" ".join(known_zones(spark)).encode())
    return f"{shared_dir(spark)}/quirelight/instants-{RULES}-{zones:08x}"


def unseen(rows: DataFrame, path: str) -> DataFrame:
    """Distinct (raw, zone, locale) of ``rows`` that the dictionary at ``path`` lacks."""
    spark = rows.sparkSession
    keys = rows.where(F.col("raw").isNotNull()).select("raw", "zone", "locale").distinct()
    if not exists(spark, f"{path}/_SUCCESS"):
        return keys
    k, old = keys.alias("k"), spark.read.schema(_DICTIONARY).parquet(path).alias("o")
    return k.join(old, F.col("k.raw").eqNullSafe(F.col("o.raw")) & F.col("k.zone").eqNullSafe(F.col("o.zone")) & F.col("k.locale").eqNullSafe(F.col("o.locale")), "left_anti")


_DICTIONARY = "raw string, zone string, locale string, epoch_us bigint"


def dictionary(rows: DataFrame, path: str) -> DataFrame:
    """Extend the dictionary at ``path`` by the texts of ``rows`` that it lacks, and return it whole.

    Only unseen triples are parsed; each call that meets any appends one batch of files, so a repeated call parses and adds nothing.  Two calls at
    a time may add a triple twice, with the same instant: the returned table holds it once.
    """
    spark = rows.sparkSession
    with_instant(unseen(rows, path)).write.mode("append").parquet(path)
    return spark.read.schema(_DICTIONARY).parquet(path).distinct()


def normalise(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` (raw, zone, locale and any others, which pass through; an ``epoch_us`` is replaced) with ``epoch_us``, joined from the dictionary kept at ``path``.

    The join is an ordinary equi-join: small dictionaries are broadcast by their measured size, larger ones meet the rows
    in a sort-merge join whose hot texts adaptive execution splits.
    """
    d = dictionary(rows, path)
    kept = [c for c in rows.columns if c != "epoch_us"]
    r = rows.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col("raw").alias("_raw"), F.col("zone").alias("_zone"), F.col("locale").alias("_locale"))
    same = F.col("_raw").eqNullSafe(F.col("raw")) & F.col("_zone").eqNullSafe(F.col("zone")) & F.col("_locale").eqNullSafe(F.col("locale"))
    return r.join(d, same, "left").select("_row.*", "epoch_us")
