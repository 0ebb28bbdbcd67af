import datetime as dt
import zoneinfo

import pytest
from pyspark.sql import functions as F

from quirelight.operators import instants

DICT = "raw string, zone string, locale string"


def us(*a, tz=dt.UTC):
    return int(round((dt.datetime(*a, tzinfo=tz) - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)).total_seconds() * 1e6))


CASES = [
    ("2019-11-28T00:00:00+05:30", None, None, us(2019, 11, 27, 18, 30)), ("2019-11-28T00:00:00.1234567Z", None, None, us(2019, 11, 28, 0, 0, 0, 123456)), ("1992-01-17", "Asia/Tokyo", "en-GB", us(1992, 1, 17)),
    ("03/09/1936", "Europe/Paris", "fr-FR", us(1936, 9, 3)), ("03/09/1936", "America/New_York", "en-US", us(1936, 3, 9)), ("03/09/1936", None, None, us(1936, 9, 3)), ("26.12.2000", None, None, us(2000, 12, 26)),
    ("février 1939", None, "fr-FR", us(1939, 2, 1)), ("Nov 22, 1929", None, None, us(1929, 11, 22)), ("21. Mai 1964", None, "de-DE", us(1964, 5, 21)), ("2004-02", None, None, us(2004, 2, 1)), ("2010", None, None, us(2010, 1, 1)),
    ("19521123", None, None, us(1952, 11, 23)), ("20190212T105418Z", None, None, us(2019, 2, 12, 10, 54, 18)), ("1652733328", None, None, 1652733328 * 10**6), ("1509063920778", None, None, 1509063920778000), ("1676024352.624244", None, None, 1676024352624244),
    ("Sun, 02 Jul 2023 06:54:17 +0100", None, None, us(2023, 7, 2, 5, 54, 17)), ("4/17/2020 12:57:18 AM", "America/New_York", "en-US", us(2020, 4, 17, 4, 57, 18)), ("6/1/2020 12:00 PM", "UTC", "en-US", us(2020, 6, 1, 12)),
    ("2016-03-16 22:43:59 America/New_York", "Asia/Tokyo", None, us(2016, 3, 17, 2, 43, 59)), ("2012-04-08 14:20:09 CEST", None, None, us(2012, 4, 8, 12, 20, 9)), ("2018-09-17T21:44:03+01:00[Europe/London]", None, None, us(2018, 9, 17, 20, 44, 3)),
    ("26.9.2016, 00:29 Uhr", "Europe/Berlin", "de-DE", us(2016, 9, 25, 22, 29)), ("30 de marzo de 2025 01:01:11", "Europe/Madrid", "es-ES", us(2025, 3, 30, 0, 1, 11)), (" 1992-01-17 ", None, None, us(1992, 1, 17)),
    ("2021-10-31 02:30:00", "Europe/Berlin", None, us(2021, 10, 31, 0, 30)), ("2021-03-28 02:30:00", "Europe/Berlin", None, us(2021, 3, 28, 1, 30)), ("2015-10-04 02:15", "Australia/Adelaide", None, us(2015, 10, 3, 16, 45)),
    ("2021-01-01 10:00", None, None, None), ("2021-01-01 10:00", "Mars/Base", None, None), ("2021-01-01 10:00 XYZ", "UTC", None, None), ("31.04.2018", None, None, None), ("2019-13-04", None, None, None), ("29 February 2019", None, None, None),
    ("0000-00-00", None, None, None), ("0101-01-01T00:00:00+00:00", None, None, None), ("1399-12-31", None, None, None), ("1400-01-01", None, None, us(1400, 1, 1)), ("unknown", None, None, None), ("", None, None, None), ("   ", None, None, None), (None, "UTC", None, None),
    ("2020-01-01 25:00", "UTC", None, None), ("13/13/2020", None, "en-US", None), ("x" * 100_000, None, None, None), ("9999-12-31", None, None, None),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "i int, " + DICT)
    got = {r.i: r.epoch_us for r in instants.with_instant(df).collect()}
    assert {i: (CASES[i][0], v) for i, v in got.items()} == {i: (c[0], c[3]) for i, c in enumerate(CASES)}


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Asia/Kolkata", "Australia/Adelaide"])
def test_wall_clock_against_zoneinfo(spark, zone):
    z = zoneinfo.ZoneInfo(zone)
    walls = [dt.datetime(2021, 1, 1) + dt.timedelta(minutes=97 * i) for i in range(5500)]
    df = spark.createDataFrame([(i, w.strftime("%Y-%m-%d %H:%M:%S"), zone, None) for i, w in enumerate(walls)], "i int, " + DICT)
    got = {r.i: r.epoch_us for r in instants.with_instant(df).collect()}
    for i, w in enumerate(walls):  # fold=0: the first of two, and forward over a gap
        assert got[i] == int(w.replace(tzinfo=z).timestamp()) * 10**6


def test_dictionary_grows_by_new_texts_only(spark, tmp_path):
    path = f"file://{tmp_path}/dictionary"
    a = spark.createDataFrame([("2010", None, None), ("2010", None, None), ("x", "UTC", None)], DICT)
    assert instants.dictionary(a, path).count() == 2
    b = spark.createDataFrame([("2010", None, None), ("2011", None, None)], DICT)
    assert instants.dictionary(b, path).count() == 3
    assert instants.dictionary(b, path).count() == 3


def test_rows_keep_columns_of_any_name(spark, tmp_path):
    df = spark.createDataFrame([(1, "2010", None, None, 7, 8, 9), (2, None, None, None, 7, 8, 9), (1, "2010", None, None, 7, 8, 9)], "i int, " + DICT + ", _s int, _raw int, epoch_us int")
    out = instants.normalise(df, f"file://{tmp_path}/d")
    rows = sorted((r.i, r.epoch_us, r._s, r._raw) for r in out.where("i = 1").collect())
    assert rows == [(1, us(2010, 1, 1), 7, 8)] * 2 and out.where("i = 2").first().epoch_us is None
    assert instants.with_instant(df).columns == ["i", "raw", "zone", "locale", "_s", "_raw", "epoch_us"]


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], DICT)
    assert instants.normalise(df, f"file://{tmp_path}/d").count() == 0


def test_found_leaves_out_canonical(spark):
    assert spark.range(1).select(F.lit("2019-11-28T00:00:00+00:00").rlike(instants.CANONICAL).alias("x")).first().x


def test_second_run_parses_nothing(spark):
    from quirelight.plans import problems

    d = "/root/testdata/sf0.001"
    first = sorted(map(tuple, problems.p1_found(spark, d).collect()))
    assert instants.unseen(problems.p1_values(spark, d), instants.kept_at(spark)).count() == 0
    assert sorted(map(tuple, problems.p1_found(spark, d).collect())) == first


def test_texts_added_twice_join_once(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    a = spark.createDataFrame([("2010", None, None)], DICT)
    instants.dictionary(a, path)
    instants.with_instant(a.select("raw", "zone", "locale")).write.mode("append").parquet(path)
    assert instants.normalise(a, path).count() == 1
