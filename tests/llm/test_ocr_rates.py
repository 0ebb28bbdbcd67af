import pytest

from quirelight.llm import ocr


def rare(spark, words):
    lex = spark.createDataFrame(words, "w string, n bigint")
    return {(r.w, r.v) for r in ocr.candidates(lex, lex.where("false").select("w")).where("rare").collect()}


@pytest.mark.parametrize("times", [1, 10, 100])
def test_a_share_is_judged_alike_at_every_size(spark, times):
    read = {"founcl": "found", "garclen": "garden", "winclow": "window", "shaclow": "shadow", "moclern": "modern", "harclly": "hardly"}
    words = [(w, 7 * times) for w in read] + [(v, 1000 * times) for v in read.values()]
    assert rare(spark, words) == set(read.items())


def test_a_word_is_no_witness_for_itself(spark):
    printed = ["monte", "torre", "fondo", "norte", "puerto", "campo"]
    words = [("las", 266), ("los", 14389), *((v, 5000) for v in printed), *((v[::-1].replace("o", "a", 1)[::-1], 2) for v in printed)]
    got = rare(spark, words)
    assert len(got) == len(printed) and ("las", "los") not in got
    assert ("las", "los") not in rare(spark, [("las", 266), ("los", 14389)])


def test_confusion():
    assert ocr.confusion("founcl", "found") == "d cl" and ocr.confusion("casa", "cosa") == "o a" and ocr.confusion("c1oc1", "clocl") is None
