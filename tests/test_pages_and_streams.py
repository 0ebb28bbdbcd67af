from pyspark.sql import functions as F

from quirelight.functions import dates
from quirelight.plans import curated, pages
from quirelight.streaming import events

ROWS = "table_idx int, row_idx int, cells array<string>"


def build(spark, rows, page, *cols):
    return [tuple(r) for r in pages.build(spark.createDataFrame(rows, ROWS), page).select(*cols).collect()]


def test_year_and_day(spark):
    rows = [(0, 0, ["Year", "Date", "Event"]), (0, 1, ["1815", "18 June", "Battle[3]"]), (0, 2, ["44 BC", "15 March", "Murder"]), (0, 3, ["1815", None, None]), (0, 4, ["nan", "x", "y"]), (1, 0, ["c. 100", "", "Wall"]), (9, 0, ["1", "", "other table"])]
    got = build(spark, rows, pages.Page(((0, 1),), rest=1, text=(2,)), "date", "event")
    assert got == [("1815-06-18", "Battle"), ("44-03-15 BC", "Murder"), ("100", "Date: c., Wall")]


def test_order_fill_and_curated(spark):
    rows = [(0, 0, ["10 ka BP", "a"]), (0, 1, [None, "b"]), (1, 0, ["??", "c"]), (1, 1, ["5 BC", "d"])]
    page = pages.Page(((0, 1),), fill=True, curated={"5 BC": ("4 BC", "by hand")}, order="time")
    got = build(spark, rows, page, "date", "event")
    assert got[0] == ("8051 BC", "a") and got[1][1] == "Date: <NA>, date from previous table entry a used!, b" and got[3] == ("4 BC", "Date: by hand, d")
    assert [r[1] for r in build(spark, rows[:1] + rows[3:], pages.Page(((0, 1),), order="reverse"), "date", "event")] == ["d", "a"]


def test_ends_suffix_scale_and_repeats(spark):
    assert build(spark, [(0, 0, ["Start", "Start", "h"]), (0, 1, ["753 BC", "509 BC", "Kings"])], pages.Page(((0, 0),), end=1, text=(2,)), "date", "event") == [("753 BC - 509 BC", "Kings")]
    assert build(spark, [(0, 0, ["1446–1406", "x"])], pages.Page(((0, 0),), suffix="BC"), "date") == [("1446 BC - 1406 BC",)]
    assert build(spark, [(0, 0, ["2", "x"]), (5, 0, ["2", "y"])], pages.Page(((0, 9),), scale="ka BP", factor=1000.0, factor_from=5), "date") == [("51 BC",), ("2 Ma BP",)]
    assert build(spark, [(0, 0, ["1", "x"]), (0, 1, ["1", "x"])], pages.Page(((0, 0),), distinct=True), "pos") == [(0,)]
    assert build(spark, [(0, 0, ["ca. 1.8 mya", "x"])], pages.Page(((0, 0),), prepare=dates.fossil_date), "date") == [("1.8 Ma BP",)]


def test_every_page_builds(spark):
    rows = [(t, i, ["1815", "18 June", "Battle", "3", "12", "x", "y", "z", "w"]) for t in range(0, 56, 3) for i in range(2)]
    df = spark.createDataFrame(rows, ROWS)
    for name in ("chinese_history", "hominin_fossils", "egyptian_dynasties", "volcanic_eruptions", "geologic_time", "biblical_chronology"):
        assert pages.build(df, pages.PAGES[name]).columns[:4] == ["pos", "date", "remark", "event"], name


def test_titles(spark):
    x = pages.build(spark.createDataFrame([(8, 0, ["1 BC", "x", "ref"]), (9, 0, ["2 BC", "y", "ref"])], ROWS), pages.Page(((8, 9),)))
    t = pages.titled(x, spark.createDataFrame([(8, "Kings")], "table_idx int, title string"))
    assert {r.event: r.title for r in t.collect()} == {"x": "Kings", "y": None}


def test_special_tables(spark):
    p = spark.createDataFrame([(0, 0, ["1", "", "Ann Doe (b. May 1, 1900)[2]", "March 4, 1940 – Incumbent"]), (0, 1, ["2", "", "Max Low (1800–1870)", "March 4, 1840 – March 4, 1844"])], ROWS)
    terms, births = pages.terms_and_births(p)
    assert [tuple(r) for r in terms.collect()] == [("Ann Doe", "1940-03-04"), ("Max Low", "1840-03-04 - 1844-03-04")]
    assert [tuple(r) for r in births.collect()] == [("Ann Doe", "1900-05-01"), ("Max Low", "1800 - 1870")]
    m = spark.createDataFrame([(0, 0, ["1", "M1", "S[1]", "5 May 2018", "Op", "Lander", "Success", None, "Rocket"])], ROWS)
    assert tuple(pages.missions(m).first()) == ("2018-05-05", "Mission: 1, M1, spacecraft: S on Rocket by Op, mission type: Lander resulted in Success")
    t = pages.transposed(spark.createDataFrame([(0, 0, ["a", "1", "2"]), (0, 1, ["b", "3", "4"])], ROWS))
    assert [r.asDict() for r in t.orderBy("name").collect()] == [{"name": "c0001", "a": "1", "b": "3"}, {"name": "c0002", "a": "2", "b": "4"}]
    line = pages.markdown(spark.createDataFrame([("1815", "x", None)], "date string, event string, k string"), ("k",)).first().line
    assert line == "| 1815 | x |  |"


def test_streams(spark, tmp_path):
    src, root = f"{tmp_path}/in", f"file://{tmp_path}/out"
    kind = "k int, at timestamp, v string"
    put = lambda rows: spark.createDataFrame(rows, "k int, at string, v string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(src)
    go = lambda: events.keep_latest(spark.readStream.schema(kind).parquet(src), root, ["k"], ["at", "v"]).trigger(availableNow=True).start().awaitTermination()
    put([(1, "2024-01-01", "a"), (1, "2024-01-03", "b"), (2, "2024-01-01", "c")])
    go()
    put([(1, "2024-01-02", "late"), (2, "2024-01-05", "d"), (3, "2024-01-01", "e")])
    go()
    go()
    assert sorted((r.k, r.v) for r in events.versions(spark, root).collect()) == [(1, "b"), (2, "d"), (3, "e")]
    assert max(map(len, events._held(spark, root).values())) <= 2  # older versions are removed
    counts = events.run_once(events.windowed_counts(spark.readStream.schema(kind).parquet(src), "at", ["k"]), ["start", "k"])
    assert {(r.k, r.start.day): r.n for r in counts.collect()}[2, 5] == 1


def test_curated_dates_of_composers(spark):
    rows = [(3, 0, ["A", "born 1565, fl. 1585", "It", "m"]), (3, 1, ["B", "1468 – 10 April 1548", "It", "m"]), (3, 2, ["C", "c. 1577 – between 1614–33", "En", "m"]), (3, 3, ["D", "1500", "En", "m"])]
    got = {r.event: (r.date, r.remark) for r in pages.build(spark.createDataFrame(rows, ROWS), pages.PAGES["renaissance_composers"]).collect()}
    assert got == {
        "Date: born 1565, fl. 1585, A": ("1565 - 1585", "born 1565, fl. 1585"), "B": ("1468 - 1548-04-10", ""), "Date: c. 1577 - between 1614-33, C": ("1577 - 1633", "c. 1577 - between 1614-33"), "D": ("1500", ""),
    }
    assert [len(curated.table(x)) for x in (curated.RENAISSANCE_COMPOSERS, curated.MEDIEVAL_COMPOSERS, curated.BYZANTINE_COMPOSERS)] == [26, 27, 3]


def test_dates_with_tolerance_and_phrases(spark):
    texts = ["1250 ± 20", "c. 300 ± 50 BC", "1200 to 1250", "Around 1300s", "end of the 13th century", "post-1945", "1500[3]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(dates.tolerant_span(dates.phrase(F.col("t"))).alias("x"))
    assert [tuple(r.x) for r in df.collect()] == [("1250", "±20"), ("300 BC", "±50"), ("1250", "±50"), ("1300", ""), ("1280 - 1299", ""), ("1945 - 1963", ""), ("1500", "")]


def test_ages_of_impacts(spark):
    texts = ["x (~1954 AD)", "1490 BC", "1947 AD", "100 ± 5", "2–3", "0.05", "0.006 (4000 ± 100)", "35[2]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(dates.impact_age(F.col("t")).alias("x"))
    assert [r.x for r in df.collect()] == ["~1954", "1490 BC", "1947", "105000 kya BP - 95000 kya BP", "3 Ma BP - 2 Ma BP", "50 kya BP", "3900 - 4100", "35000 kya BP"]


def test_layouts_of_one_page(spark):
    rows = [(11, 0, ["1279-1368", "an era"]), (12, 0, ["960", "4 February", "a dynasty"]), (12, 1, ["1044 about", None, "a book"])]
    got = [(r.date, r.event) for r in pages.build(spark.createDataFrame(rows, ROWS), pages.PAGES["chinese_history"]).collect()]
    assert got == [("1279 - 1368", "an era"), ("960-02-04", "a dynasty"), ("1044", "a book")]
    pyramid = pages.build(spark.createDataFrame([(12, 0, ["Great (Khufu)", "2580 BC", "Giza", "146 m"])], ROWS), pages.PAGES["egyptian_pyramids"]).first()
    assert (pyramid.event, pyramid.pharaoh, pyramid.field) == ("Great", "Khufu", "Giza")
