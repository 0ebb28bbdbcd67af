import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelight.operators import diff, intervals, ordered, search, timeline
from quirelight.operators.keywords import domain_filter, keyword_filter


def test_time_classes(spark):
    cases = [
        (2, 3, 1, 4, "inside"), (1, 4, 1, 4, "inside"), (0, 5, 1, 4, "surrounding"), (3, 6, 1, 4, "partial"), (0, 2, 1, 4, "partial"), (0, 1, 1, 4, None), (4, 6, 1, 4, None), (2, None, 1, 4, "inside"), (4, None, 1, 4, "inside"),
        (0, 5, 2, None, "surrounding"), (2, None, 2, None, "inside"), (2, 5, 2, None, None), (5, 6, 1, 4, None),
    ]
    df = spark.createDataFrame([(i, *map(lambda v: None if v is None else float(v), c[:4])) for i, c in enumerate(cases)], "i int, a double, b double, c double, d double")
    got = {r.i: r.k for r in df.select("i", timeline.time_class(*map(F.col, "abcd")).alias("k")).collect()}
    assert got == {i: c[4] for i, c in enumerate(cases)}


def test_search_events(spark):
    e = spark.createDataFrame([(1, 2451544.5, None, {"Event": "Old garden"}, {"domain": "a/b"}), (2, 2451544.5, None, {"Event": "river"}, {}), (3, 1721059.5, None, {"Event": "garden"}, {"domain": "c"})], "seq int, jd_start double, jd_end double, eventdata map<string,string>, metadata map<string,string>")
    ids = lambda x: [r.seq for r in x.collect()]
    assert ids(timeline.timeline(e, "1999 - 2001", "", "garden")) == [1]
    assert ids(timeline.timeline(e)) == [3, 1, 2]
    assert ids(timeline.timeline(e, domains="!a")) == [3, 2]
    assert ids(timeline.timeline(e, "nonsense")) == []
    assert ids(timeline.timeline(e, keywords="!garden")) == []


def test_keywords_against_plain_python(spark):
    texts = ["The old garden", "gardens of stone", "no match", "Old river Garden", None, "überall gärten", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for keys in (["garden"], ["garden*", "!river"], ["old|stone"], ["*arden"], ["g*n"], ["!x"], ["gärten"], []):

        def hit(t):
            if not keys:
                return True
            if t is None or all(k.startswith("!") for k in keys):
                return False
            pat = lambda w: (("" if w[0] == "*" else r"\b") + w.strip("*").replace("*", ".*") + ("" if w[-1] == "*" else r"\b")).lower()
            return all(any(re.search(pat(a), t.lower()) for a in k.split("|")) if k[0] != "!" else not re.search(pat(k[1:]), t.lower()) for k in keys)

        assert {r.i for r in df.where(keyword_filter(F.col("t"), keys)).collect()} == {i for i, t in enumerate(texts) if hit(t)}, keys


def test_domains(spark):
    df = spark.createDataFrame([(1, "History/Rome"), (2, "art/rome/x"), (3, None), (4, "b")], "i int, d string")
    ids = lambda *s: {r.i for r in df.where(domain_filter(F.col("d"), s)).collect()}
    assert ids("rome") == {1, 2} and ids("!rome") == {3, 4} and ids("art/#") == {2} and ids("history/+") == {1} and ids("rome", "!art") == {1} and ids() == {1, 2, 3, 4}


def test_order_check_against_fold(spark):
    rng = random.Random(2)
    rows = [(t, i, float(rng.randint(0, 6)), None if rng.random() < 0.4 else float(rng.randint(6, 9))) for t in range(30) for i in range(25)]
    want, last = {}, {}
    for t, i, a, b in rows:
        if t in last and (a < last[t][0] or a == last[t][0] and last[t][1] is not None and (b is None or b < last[t][1])):
            want[t, i] = True
        else:
            want[t, i] = False
            last[t] = (a, b if b is not None or t not in last or last[t][0] != a else last[t][1] if last[t][0] == a and last[t][1] is not None else b)
    df = spark.createDataFrame(rows, "t int, i int, jd_start double, jd_end double")
    got = {(r.t, r.i): r.x for r in df.select("t", "i", timeline.order_rejected(["t"], "i").alias("x")).collect()}
    assert got == want


def test_table_events(spark):
    rows = [["753 BC", "Founding"], ["Date", "Event"], ["bad", "x"], ["10 - 5", "y"], ["800 BC", "late"], ["509 BC - 27 BC", "Republic"]]
    t = [(1, ["Date", "Event"], rows, {"domain": "d"}), (2, ["Date", "Event"], [["1", "x"]], {"domain": "d"}), (3, ["Day", "Event"], [["1", "x"]], {"domain": "e"}), (4, ["Date", "Event"], [["1"]], {"domain": "f"}), (5, ["Date", "Event"], [["1", "x"]], {})]
    df = spark.createDataFrame(t, "table_id int, columns array<string>, rows array<array<string>>, metadata map<string,string>")
    got = {r.pos: (r.skip_reason, r.eventdata) for r in timeline.table_events(df).collect()}
    assert {k: v[0] for k, v in got.items()} == {0: None, 1: "header", 2: "date", 3: "reversed", 4: "order", 5: None}
    assert got[0][1] == {"Event": "Founding"}


def test_year_events(spark):
    s = "Built 1875, lost 1999. Not 1799 or 21000; 2001"
    df = spark.createDataFrame([(1, "T", s), (2, "U", None), (3, "V", "")], "i int, title string, doc_text string")
    got = [(r.i, r.position_offset, r.year) for r in timeline.year_events(df).orderBy("i", "position_offset").collect()]
    assert got == [(1, m.start(), m.group(1)) for m in re.finditer(timeline.YEAR, s)]


def test_overlap_join(spark):
    rng = random.Random(5)
    ivs = lambda n, far: [(i, float(a := rng.randint(-50, 500)), float(a + rng.choice([0, 3, 40, far]))) for i in range(n)]
    left, right = ivs(80, 5000), ivs(60, 9_000_000)
    left.append((99, 5.0, 1.0))
    a, b = spark.createDataFrame(left, "i int, a double, b double"), spark.createDataFrame(right, "j int, c double, d double")
    got = sorted((r.i, r.j) for r in intervals.overlap_join(a, b, ("a", "b"), ("c", "d"), 1.0, 8).collect())
    assert got == sorted((x[0], y[0]) for x in left for y in right if x[1] <= x[2] and y[1] <= y[2] and x[1] <= y[2] and y[1] <= x[2])


def test_chunks_cover_text(spark):
    texts = ["", None, "a", "x" * 100, "".join(map(str, range(300)))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for size, overlap in ((10, 0), (10, 3), (10, 10), (7, 6)):
        step = size - search.effective_overlap(size, overlap)
        got = {}
        for r in search.chunk(df, "t", size, overlap).collect():
            got.setdefault(r.i, {})[r.chunk_no] = r.chunk
        assert set(got) == {i for i, t in enumerate(texts) if t}
        for i, parts in got.items():
            assert [parts[k] for k in sorted(parts)] == [texts[i][k * step : k * step + size] for k in range((len(texts[i]) - 1) // step + 1)]


def test_top_k_per_query_is_exact(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(230, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id bigint, embedding array<float>")
    got = {}
    for r in search.top_k_per_query(df, df.where("vec_id % 20 = 0"), 4, block=50).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    f = v.astype(np.float32).astype(np.float64)
    for q in range(0, 230, 20):
        s = f @ f[q]
        assert [x for _, x in sorted(got[q])] == [i for i in sorted(range(230), key=lambda i: (-round(s[i], 9), i)) if i != q][:4]


def test_incremental_index(spark):
    encode, kind = search.hashing_embedder(8), "desc string, text string"
    old = spark.createDataFrame([("a", "one two three"), ("b", "four five"), ("c", "six")], kind)
    new = spark.createDataFrame([("a", "one two three"), ("b", "changed text here"), ("d", "new")], kind)
    hashed = lambda x: x.select("desc", F.md5("text").alias("text_hash"))
    index = search.embed(search.chunk(old, "text", 6, 2), encode).select("desc", "chunk_no", "embedding")
    changes = search.index_changes(hashed(old), hashed(new))
    assert {r.desc: r.action for r in changes.collect()} == {"a": "keep", "b": "replace", "c": "remove", "d": "add"}
    after = search.update_index(index, changes, new, encode, 6, 2)
    assert search.index_is_whole(after, new, 6, 2).count() == 0 and search.index_is_whole(index, new, 6, 2).count() > 0
    hit = search.search(after, new, encode(["new"])[0], 6, 2, 1).collect()
    assert [(r.desc, r.text) for r in hit] == [("d", "new")]
    assert search.highlight(new, ["desc"], "text", encode(["new"])[0], encode, 4, 2).count() == 3
    hits, todo = search.cached_texts(spark.createDataFrame([("a", 1), ("b", 2)], "desc string, file_size int"), spark.createDataFrame([("a", 1, "t"), ("b", 3, "u")], "desc string, file_size int, text string"))
    assert [r.desc for r in hits.collect()] == ["a"] and [r.desc for r in todo.collect()] == ["b"]


def test_merge_hits(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.9), ("a", 5, 0.1), ("b", 3, 0.2)], "desc string, chunk_no int, cosine double")
    got = sorted(tuple(r) for r in search.merge_hits(df, ["desc"]).select("desc", "first_chunk", "n_chunks", "cosine").collect())
    assert got == [("a", 1, 2, 0.9), ("a", 5, 1, 0.1), ("b", 3, 1, 0.2)]


def test_orders_over_all_rows(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "", "x", "y"]), rng.randint(0, 9)) for i in sorted(rng.sample(range(5000), 700))]
    df = spark.createDataFrame(rows, "k int, v string, n int")
    filled, last = {}, None
    for k, v, _ in rows:
        last = v if v else last
        filled[k] = last
    assert {r.k: r.f for r in ordered.forward_fill(df, "k", {"f": "v"}, F.col("v") != "", 64).collect()} == filled
    total, sums = 0, {}
    for k, _, n in rows:
        sums[k] = total
        total += n
    assert {r.k: r.s for r in ordered.running_total(df, "k", "n", "s", 64).collect()} == sums
    kept = {r[0] for p, r in zip([None, *rows], rows, strict=False) if p is None or p[1] != r[1]}
    assert {r.k for r in ordered.drop_repeats(df, "k", ["v"], 64).collect()} == kept
    first = {}
    for r in rows:
        first.setdefault(r[1], r[0])
    assert {r.v: r.k for r in ordered.first_wins(df, F.col("v"), ["k"]).collect()} == first


def test_accepted_notes_in_order(spark):
    rng = random.Random(6)
    rows = [(i, f"t{rng.randint(0, 60)}", None if rng.random() < 0.2 else f"u{rng.randint(0, 80)}") for i in range(120)]
    titles, uuids, want = set(), set(), {}
    for i, t, u in rows:
        want[i] = t not in titles and (u is None or u not in uuids)
        if want[i]:
            titles.add(t)
            uuids.add(u)
    got = ordered.accepted_notes(spark.createDataFrame(rows, "pos bigint, title_key string, uuid string"))
    assert {r.pos: r.accepted for r in got.collect()} == want


def test_plans(spark):
    d = spark.createDataFrame([("a", "s/a", "1", "crc32"), ("b", "s/b", "2", "crc32"), ("c", "s/c", "3", "md5")], "path string, src string, hash string, hash_algo string")
    t = spark.createDataFrame([("a", "1", "crc32"), ("b", "x", "crc32"), ("c", "3", "sha256"), ("z", "9", "crc32")], "path string, hash string, hash_algo string")
    assert {r.path: r.action for r in diff.export_plan(d, t).collect()} == {"a": "unchanged", "b": "changed", "c": "changed", "z": "debris"}
    e, n = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", "C"), ("5", "X")], "uuid string, name string"), spark.createDataFrame([("1", "A"), ("2", "Old"), ("4", "X")], "uuid string, name string")
    assert {r.uuid: r.action for r in diff.note_plan(e, n).collect()} == {"1": "keep", "2": "rename", "3": "create", "4": "orphan", "5": "blocked"}
    assert [r.action for r in diff.delete_plan(t.limit(1)).collect()] == ["report"]


def test_rename_links(spark):
    notes = spark.createDataFrame([("p", "see [[old (x)]] and [[Old (x)|alias]], [[older]]"), ("q", "none")], "path string, content string")
    links = spark.createDataFrame([("p", "old (x)"), ("p", "older")], "path string, target string")
    out = diff.rename_links(notes, links, spark.createDataFrame([("Old (x)", "New $1")], "old string, new string")).collect()
    assert [(r.path, r.content) for r in out] == [("p", "see [[New $1]] and [[New $1|alias]], [[older]]")]


def test_upsert(spark):
    a, b = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(tuple(r) for r in diff.upsert(a, b, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_bad_width(spark):
    from quirelight.sinks import render

    e = spark.createDataFrame([(2451544.5, None, {"a": "b"})], "jd_start double, jd_end double, eventdata map<string,string>")
    with pytest.raises(ValueError):
        render.ascii_lines(e, 20)
