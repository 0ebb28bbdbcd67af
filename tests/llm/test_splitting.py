import random

import pytest
from pyspark.sql import functions as F

from quirelight.llm import splitting as S

KIND = "id int, text string"


def noisy(seed, n):
    rng = random.Random(seed)
    words = ["alpha", "béta", "гамма", "dé", "。", "x" * 40, "end.", "Next", "\n", "\n\n", "é", "👩‍🏫", " ", "\r\n"]
    return " ".join(rng.choice(words) for _ in range(n))


def pieces(spark, texts, size, overlap, **k):
    got = {}
    for r in S.split_texts(spark.createDataFrame(list(enumerate(texts)), KIND), "id", "text", F.lit(size), F.lit(overlap), **k).collect():
        got.setdefault(r.id, []).append((r.piece_no, r.begin, r.end, r.piece))
    return {i: [p[1:] for p in sorted(v)] for i, v in got.items()}


@pytest.mark.parametrize(("size", "overlap"), [(50, 0), (200, 30), (200, 200), (7, 3), (1, 0)])
def test_pieces_hold_the_rules(spark, size, overlap):
    texts = [noisy(i, 120) for i in range(6)] + ["", None, "short", "z" * 1000, " " * 300, "\u0301" * 80]
    over = overlap if overlap < size else size // 3
    got = pieces(spark, texts, size, overlap)
    assert set(got) == {i for i, t in enumerate(texts) if t}
    for i, ps in got.items():
        assert ps[0][0] == 0 and ps[-1][1] == len(texts[i])
        assert all(p[2] == texts[i][p[0] : p[1]] and 0 < p[1] - p[0] <= size for p in ps)
        assert all(b[0] == a[1] - over for a, b in zip(ps, ps[1:], strict=False))


def test_many_ranges_give_the_same_pieces(spark):
    texts = [noisy(i, 700) for i in range(5)] + ["z" * 5000, "a b\n" * 900]
    assert pieces(spark, texts, 200, 30, range_chars=700) == pieces(spark, texts, 200, 30)


def test_files_by_byte_ranges(spark, tmp_path):
    texts = {str(tmp_path / f"{i}.txt"): t for i, t in enumerate([noisy(9, 900), "ß" * 5000, "", "tiny"])}
    for p, t in texts.items():
        open(p, "w", newline="").write(t)
    got = {}
    files = S.files_of(spark, f"file://{tmp_path}").withColumns({"size": F.lit(200), "overlap": F.lit(30)})
    for r in S.split_files(files, range_bytes=1500).withColumn("path", F.replace("path", F.lit("file:"), F.lit(""))).collect():
        got.setdefault(r.path, []).append((r.piece_no, r.begin, r.end, r.piece))
    for p, t in texts.items():
        a, b, _ = S.cuts(t, 200, 30)
        assert [x[1:] for x in sorted(got.get(p, []))] == [(i, j, t[i:j]) for i, j in zip(a, b, strict=True)]


def test_natural_places():
    cut = lambda t, n: [t[a:b] for a, b in zip(*S.cuts(t, n, 0)[:2], strict=True)]
    assert cut("One two three. Four five six seven.", 20) == ["One two three. ", "Four five six seven."]
    assert cut("aaaa bbbb\n\ncccc dddd", 14) == ["aaaa bbbb\n\n", "cccc dddd"]
    assert cut("abcdefghij", 4) == ["abcd", "efgh", "ij"]
    assert cut("abce\u0301d", 4) == ["abc", "e\u0301d"]
    assert cut("a" * 9 + "/" + "b" * 9, 12)[0] == "a" * 9 + "/"


def test_longest_stretch_over_ranges(spark):
    t = "ab " + "x" * 3000 + " cd"
    plan = S.split_summary(spark.createDataFrame([(1, t)], KIND), "id", "text", F.lit(100), F.lit(0), range_chars=500)
    assert tuple(plan.first()) == (1, 100, len(S.cuts(t, 100, 0)[0]), 3000) and S.cuts(t, 100, 0)[2] == 3000


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "abc def", 9, 8, None), (1, "abc def", 9, 8, -1)], KIND + ", key int, piece int, sz int")
    assert S.split_texts(df, "id", "text", F.col("sz"), F.lit(1)).count() == 0
    assert S.split_texts(df, "id", "text", F.lit(5), F.lit(None)).columns == ["id", "piece_no", "begin", "end", "piece"]
    assert S.split_texts(spark.createDataFrame([], KIND), "id", "text", F.lit(5), F.lit(1)).count() == 0
    again = [(1, "abc def"), (1, "abc def"), (1, "xyz uvw"), (None, "abc def"), (2, "ab"), (2, "ab")]
    got = sorted((str(r.id), r.piece_no, r.piece) for r in S.split_texts(spark.createDataFrame(again, KIND), "id", "text", F.lit(5), F.lit(0)).collect())
    assert got == sorted([("1", 0, "abc "), ("1", 1, "def")] * 2 + [("1", 0, "xyz "), ("1", 1, "uvw"), ("None", 0, "abc "), ("None", 1, "def")] + [("2", 0, "ab")] * 2)


def test_a_giant_text(spark):
    import time

    t = noisy(3, 220_000)
    assert len(t) > 1_000_000
    df = spark.createDataFrame([(1, t)], KIND)
    S.split_texts(df, "id", "text", F.lit(500), F.lit(50)).count()
    began = time.time()
    got = sorted((r.begin, r.end, r.piece) for r in S.split_texts(df, "id", "text", F.lit(500), F.lit(50)).collect())
    assert time.time() - began < 20  # about 2 s, where cutting every piece from the text's start took 6
    assert got == [(a, b, t[a:b]) for a, b in zip(*S.cuts(t, 500, 50)[:2], strict=True)]
