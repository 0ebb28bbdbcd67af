import random

from pyspark.sql import functions as F

from quirelight.operators import snapshots

ENTRY = "g string, s bigint, k string, at int, id int, title string, tags array<string>, docs array<struct<name:string,size:bigint,mod:double>>"


def run(spark, entries, manifest):
    e = spark.createDataFrame(entries, ENTRY)
    m = spark.createDataFrame(manifest, "g string, s bigint")
    out = snapshots.snapshot_changes(e, m, group="g", seq="s", key=snapshots.canonical_uuid(F.col("k")), content=snapshots.content_hash(e, ["title", "tags", "docs"], {"docs": ["name", "size"]}), recency=["at", "id"])
    return sorted(tuple(r) for r in out.collect())


U = [f"{i:08x}-0000-0000-0000-000000000000" for i in range(6)]


def test_notations_order_null_and_superseded(spark):
    e = [
        ("a", 1, U[0], 1, 1, "t", ["x", "y"], None), ("a", 3, "{" + U[0].upper() + "}", 1, 2, "t", ["y", "x"], []), ("a", 1, U[1], 1, 3, None, None, None), ("a", 3, "urn:uuid:" + U[1], 1, 4, "", [], None),
        ("a", 1, U[2], 1, 5, "t", None, [("n", 1, 1.0)]), ("a", 3, U[2].replace("-", ""), 1, 6, "t", None, [("n", 1, 2.0)]), ("a", 1, U[3], 2, 7, "new", None, None), ("a", 1, U[3], 1, 8, "old", None, None), ("a", 3, " " + U[3], 1, 9, "old", None, None),
        ("a", 3, None, 1, 10, "z", None, None), ("a", 3, "", 1, 11, "z", None, None), ("a", 3, "not one", 1, 12, "z", None, None), ("a", 2, U[4], 1, 13, "unlisted", None, None), ("b", 1, U[0], 1, 14, "first", None, None),
    ]
    assert run(spark, e, [("a", 1), ("a", 3), ("a", 3), ("b", 1), ("a", 9)]) == sorted([("a", 3, U[3], "changed"), *[("a", 9, u, "removed") for u in U[:4]]])


def test_moved_value_is_a_change(spark):
    e = [("a", 1, U[0], 1, 1, "x", [], None), ("a", 2, U[0], 1, 2, None, ["x"], None)]
    assert run(spark, e, [("a", 1), ("a", 2)]) == [("a", 2, U[0], "changed")]


def test_empty(spark):
    assert run(spark, [], []) == []
    assert run(spark, [], [("a", 1), ("a", 2)]) == []


def test_against_brute_force(spark):
    rng = random.Random(4)
    e = [("g%d" % rng.randint(0, 2), rng.randint(1, 5), rng.choice(U), rng.randint(0, 3), i, rng.choice("abc"), None, None) for i in range(300)]
    m = [(g, s) for g in ("g0", "g1", "g2") for s in (1, 2, 4, 5)]
    last = {}
    for r in sorted(e, key=lambda r: (r[3], r[4])):
        last[r[0], r[1], r[2]] = r[5]
    want = []
    for g in ("g0", "g1", "g2"):
        for a, b in ((1, 2), (2, 4), (4, 5)):
            for u in U:
                x, y = last.get((g, a, u)), last.get((g, b, u))
                if x != y:
                    want.append((g, b, u, "added" if x is None else "removed" if y is None else "changed"))
    assert run(spark, e, m) == sorted(want)
