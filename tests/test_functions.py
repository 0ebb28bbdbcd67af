import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirelight.functions import dates, hashes, julian, text


def apply(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in sorted(df.select("i", f(F.col("v")).alias("x")).collect())]


def test_note_and_file_names(spark):
    assert apply(spark, text.note_name, ["a: b / c (d)", "x__y", None]) == ["a, b, c d_", "x_y", None]
    assert apply(spark, text.file_name, ["a: b", " a  b ", "x,,y", None]) == ["a, b", "a b", "x,y", None]
    assert apply(spark, lambda c: text.file_name(c, text.nfc), ["é"]) == ["é"]


def test_is_number(spark):
    assert apply(spark, text.is_number, ["12", "XIV", "", "1a", "x"]) == [True, True, True, False, False]


def test_short_title(spark):
    long = "A Very Long Title, With Many Words And Much Punctuation: That Goes On And On"
    f = lambda c: text.short_title(c, c, F.array(F.lit("Jane Doe")))
    assert apply(spark, f, [long, "Book II", "Maps", "w" * 40 + " " + "v" * 40, "w" * 90]) == [
        "A Very Long Title, With Many Words And Much Punctuation - Jane Doe", "Book II - Jane Doe", "Maps - Jane Doe", "w" * 40 + " - Jane Doe", "w" * 70 + " - Jane Doe",
    ]
    assert apply(spark, lambda c: text.short_title(c, F.lit(None).cast("string"), F.lit(None).cast("array<string>")), [None]) == [" - Unknown"]


def test_articles_and_blanks(spark):
    assert apply(spark, text.strip_articles, ["Hobbit, The", "Turm, Der", "A, An"]) == ["Hobbit", "Turm", "A"]
    assert apply(spark, text.compress_blanks, ["a   b\n\n\nc"]) == ["a b\nc"]
    assert apply(spark, lambda c: text.compress_blanks(c, "full"), ["a\n\nb  c\n\n\n\nd"]) == ["a b c d"]
    with pytest.raises(ValueError):
        text.compress_blanks(F.lit("x"), "other")


def test_html(spark):
    assert apply(spark, text.html_to_quote, ["<p>a &amp; <b>b</b></p><li>c</li>"]) == ["> a & b\n> \n> - c\n> \n"]


def test_domain_and_snippet(spark):
    f = lambda c: text.table_domain(c, F.array(F.lit("Date"), F.lit("My Event.")), "/n")
    assert apply(spark, f, ["/n/a b/c.md", "/x/c.md"]) == ["a_b/c/My_Event", None]
    assert apply(spark, lambda c: text.snippet(c, F.lit(3)), ["abc\ndef"]) == ["abc def"]
    assert apply(spark, lambda c: text.home_relative(c, "/home/u"), ["/home/u/x", "/home/user"]) == ["~/x", "/home/user"]
    assert apply(spark, lambda c: text.deep_link(F.lit("Lib"), c), ["7"]) == ["calibre://show-book/_hex_-4c6962/7"]
    assert apply(spark, lambda c: text.progress_bar(c, F.lit(4), 4), [0, 2, 9], "int") == ["░░░░", "██░░", "████"]


def test_footnotes(spark):
    assert apply(spark, text.remove_footnotes, ["a[12]b[x]c[ä]d[xy]"]) == ["abcd[xy]"]
    assert apply(spark, lambda c: text.remove_footnotes(c, False), ["a[12]b[xy]"]) == ["ab"]


def test_time_points(spark):
    got = apply(spark, julian.point_to_jd, ["2000-01-01", "1 BC", "1970", "1950 bp", "4.5 Ga BP", "10 ka", "x", "2001-02-29", "0 BC", None, "1815-06"])
    assert got == [2451544.5, 1721059.5, 2440587.5, 1721059.5, got[4], got[5], None, None, None, None, 2384125.5]
    assert got[5] == apply(spark, julian.point_to_jd, ["8051 BC"])[0]


def test_time_texts_round_trip(spark):
    texts = ["2000", "1815-06-18", "753 BC", "44-03-15 BC", "4.5 Ga BP", "66.04 Ma BP", "300 ka BP", "0001", "1 BC"]
    jd = apply(spark, julian.point_to_jd, texts)
    assert apply(spark, julian.point_to_jd, apply(spark, lambda c: julian.jd_to_text(julian.point_to_jd(c)), texts)) == jd


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-2_000_000_000, 3_000_000), min_size=1, max_size=40))
def test_days_round_trip(spark, days):
    f = lambda c: (lambda d: julian.days_from_civil(d["y"], d["m"], d["d"]))(julian.civil_from_days(c))
    assert apply(spark, f, days, "bigint") == days


def test_ranges(spark):
    r = apply(spark, julian.range_to_jd, ["753 BC - 509 BC", "1815", "a - b", "1 - 2 - 3"])
    assert r[0].jd_end > r[0].jd_start and r[1].jd_end is None and r[2] is None and r[3] is None


def test_dates(spark):
    pairs = lambda rows: [tuple(r) for r in rows]
    assert pairs(apply(spark, dates.century, ["1st century", "1st century BC", "5th century", "5th century BC", "1815"])) == [
        ("1 - 100", "1st century"), ("100 BC - 1 BC", "1st century BC"), ("400 - 500", "5th century"), ("500 BC - 400 BC", "5th century BC"), ("1815", ""),
    ]
    assert pairs(apply(spark, dates.date_remarks, ["ca. 1200", "1200 or 1201", "1500s", "100 ± 3 BC", "before 1300"])) == [("1200", "ca."), ("1200", "or 1201"), ("1500", "1500s"), ("100 BC", "±3"), ("1300", "before")]
    assert apply(spark, lambda c: dates.merge_date(F.lit("1815"), c), ["18 June", "June 18", "June", "spring", "", None]) == ["1815-06-18", "1815-06-18", "1815-06", "1815", "1815", "1815"]
    assert apply(spark, lambda c: dates.merge_date(c, F.lit("15 March")), ["44 BC"]) == ["44-03-15 BC"]
    assert pairs(apply(spark, dates.clean_date, ["c. 1362/3", "500 – 400 BC", "1815-06-18", "1990-1991"])) == [("1362", "c., Alt.: 1363"), ("500 BC - 400 BC", ""), ("1815-06-18", ""), ("1990-1991", "")]
    assert pairs(apply(spark, lambda c: dates.clean_date(c, "Ma BP"), ["3", "4 - 3"])) == [("3 Ma BP", ""), ("4 Ma BP - 3 Ma BP", "")]
    assert apply(spark, dates.spread_unit, ["4.5 - 4 Ma"]) == ["4.5 Ma - 4 Ma"]
    assert apply(spark, lambda c: dates.tolerance_to_range(c, "ka BP"), ["12 ± 2", "5"]) == ["14 ka BP - 10 ka BP", "5"]
    assert apply(spark, dates.fossil_date, ["ca. 1.8 mya", "3,5–3,2 Ma"]) == ["1.8 Ma BP", "3.5 Ma BP - 3.2 Ma BP"]
    df = spark.createDataFrame([(1, "ca. 5 BC"), (2, None), (3, "ca. 5 BC")], "i int, raw string")
    assert sorted((r.i, r.cleaned.date if r.cleaned else None) for r in dates.clean_column(df, "raw").collect()) == [(1, "5 BC"), (2, None), (3, "5 BC")]
    assert apply(spark, dates.eras, ["5 B.C."]) == ["5 BC"]


def test_hashes(spark):
    blobs = [b"", b"a", b"x" * 4096, bytes(range(256)) * 70, None]

    def crc(b):
        out = 0
        for i in range(0, len(b), 4096):
            out ^= zlib.crc32(b[i : i + 4096])
        return out

    def sparse(b):
        return hashlib.md5(b"".join(b[o : o + 1024] for o in [0, *(1024 << (2 * i) for i in range(11))])).hexdigest()

    assert apply(spark, hashes.block_crc32, blobs, "binary") == [None if b is None else crc(b) for b in blobs]
    assert apply(spark, hashes.sparse_md5, blobs, "binary") == [None if b is None else sparse(b) for b in blobs]
    assert apply(spark, lambda c: hashes.digest(c, "sha256"), [b"a"], "binary") == [hashlib.sha256(b"a").hexdigest()]
