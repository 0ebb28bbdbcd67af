import itertools
import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quirelight.llm import lookalike as L

SAME = [
    ("Cafe\u0301", "Caf\u00e9"), ("\uff21\uff22\uff23\u3000\uff11\uff12", "ABC 12"), ("\u0440\u0430yp\u0430l", "paypal"), ("zero\u200bwidth\u00ad", "zerowidth"), ("a\u00a0b\tc", "a b c"), ("\ufb01ne \ufb02ag", "fine flag"), ("\u212aelvin", "Kelvin"),
    ("a\r\nb\rc\u2028d", "a\nb\nc\nd"), ("w\u0430it\u037e", "wait;"), ("\u216f\u217c\u2179", "Mlx"), ("\u03bf\u1f50", "o\u1f50"), ("a\u0308\u0323", "\u1ea1\u0308"), ("x\u2010y\u2011z", "x-y-z"), ("line  \nend \n", "line\nend"),
]
OTHER = [("cafe", "café"), ("Fig", "fig"), ("m²", "m2"), ("1 2", "12"), ("a  b", "a b"), ("a, b", "a b"), ("groß", "gross"), ("a\nb", "a b"), ("l", "1"), ("O", "0"), ("½", "1/2"), ("\u0439", "\u0438"), ("👨\u200d👩\u200d👧", "👨👩👧"), ("H₂O", "H2O")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_look(a, b):
    assert a != b and L.skeleton(a) == L.skeleton(b)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other_look(a, b):
    assert L.skeleton(a) != L.skeleton(b)


@given(st.text(max_size=60))
def test_skeleton_is_stable(s):
    k = L.skeleton(s)
    assert L.skeleton(k) == k and L.skeleton(unicodedata.normalize("NFC", s)) == L.skeleton(unicodedata.normalize("NFD", s))


def test_null():
    assert L.skeleton(None) is None


def test_pairs_against_brute_force(spark):
    texts = [x for p in SAME + OTHER for x in p] + ["", None, " ", "\u200b", " ", "café", "Café", "x" * 50_000]
    rows = [(i, t, 1, 2) for i, t in enumerate(texts)] + [(len(texts) + i, t, 1, 2) for i, t in enumerate(texts[:9])]
    got = L.same_look_pairs(spark.createDataFrame(rows, "doc_id int, text string, look int, spelling int"))
    visible = [(i, t) for i, t, *_ in rows if t and L.skeleton(t).strip()]
    want = sorted((a, b) for (a, s), (b, t) in itertools.combinations(visible, 2) if s != t and L.skeleton(s) == L.skeleton(t))
    assert sorted(tuple(r) for r in got.collect()) == want and got.columns == ["doc_id_a", "doc_id_b"]


def test_hot_copies_and_empty(spark):
    rows = [(i, "same text") for i in range(2000)] + [(5000, "ѕame text")]
    assert L.same_look_pairs(spark.createDataFrame(rows, "doc_id int, text string")).count() == 2000
    assert L.same_look_pairs(spark.createDataFrame([], "doc_id int, text string")).count() == 0
    assert L.same_look_pairs(spark.createDataFrame([(None, "a"), (1, "а")], "doc_id int, text string")).count() == 0
    kept = L.with_skeleton(spark.createDataFrame([(1, "ａ", "old")], "doc_id int, text string, skeleton string"))
    assert kept.columns == ["doc_id", "text", "skeleton"] and kept.first().skeleton == "a"


SCRIPTS = {
    "greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧρυο", "ABEZHIKMNOPTYXpuo"), "cyrillic": ("АВСЕНІЈКМОРЅТХаеорсухѕіј", "ABCEHIJKMOPSTXaeopcyxsij"), "armenian": ("հոօսՕՍՏ", "hnouOUS"), "coptic": ("ⲞⲟⲤⲥⲢⲣ", "OoCcPp"),
    "cherokee": ("ᎪᏴᏟᎠᎬ", "ABCDE"), "lisu": ("ꓮꓐꓚꓓꓰꓝ", "ABCDEF"),
}


@pytest.mark.parametrize("script", SCRIPTS)
def test_scripts(script):
    drawn, plain = SCRIPTS[script]
    assert L.skeleton(drawn) == plain


def test_prototypes_have_none_of_their_own():
    keys = L._keys()
    assert not {p for p in L.table().values() if p and keys & set(p)}


def test_ascii_in_the_jvm_is_the_same(spark):
    from pyspark.sql import functions as F

    rng = __import__("random").Random(7)
    texts = ["".join(rng.choice("ab  \t\n\r\x00\x0b\x0c\x1c\x1f\x7f.") for _ in range(rng.randrange(30))) for _ in range(800)] + ["a" + " " * 100_000 + "b", "\n" * 50_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", L.ascii_skeleton(F.col("t")).alias("s")).collect()}
    assert [got[i] for i in range(len(texts))] == [L.skeleton(t) for t in texts]
    looks = {r.i: r.k for r in df.select("i", L.looks(F.col("t")).alias("k")).collect()}
    assert all((looks[i] is None) == (not L.skeleton(t).strip()) for i, t in enumerate(texts))


def test_python_runs_once(spark):
    from pyspark.sql import functions as F

    plan = spark.createDataFrame([(1, "a")], "doc_id int, text string").select("doc_id", L.looks(F.col("text")).alias("k"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
