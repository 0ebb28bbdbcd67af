import os
import random

import pytest
from pyspark.sql import functions as F

from quirelight.llm import mixing as M
from quirelight.llm import tokens as T

PATH = T.ranks_path()
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")
DOCS, TARGETS = "doc_id int, source string, text string, tokens int, block int", "mix_name string, source string, target_share double, max_repeats int, total_ratio double"


def docs(spark):
    rng = random.Random(7)
    rows = [(i, "big" if i % 3 == 0 else "mid" if i % 3 == 1 else "small" if i % 30 == 2 else "other", " ".join(rng.choice(["tree", "river", "old", "garden"]) for _ in range(rng.randint(0, 60))), 1, 2) for i in range(3000)]
    rows += [(5000, None, "no source", 1, 2), (5001, "big", None, 1, 2), (5002, "big", "", 1, 2)]
    return spark.createDataFrame(rows, DOCS)


def test_shares_caps_and_report(spark):
    d = docs(spark)
    t = spark.createDataFrame([("a", "big", 0.5, 2, 0.5), ("a", "mid", 0.3, 1, 0.5), ("a", "small", 0.2, 3, 0.5), ("b", "small", 1.0, 4, 0.02), ("b", "none", 0.5, 9, 0.02), ("b", "big", None, None, 0.02)], TARGETS)
    used, report = M.mix(d, t, PATH, block_tokens=128)
    used, rep = used.cache(), {(r.mix_name, r.source): r for r in report.collect()}
    sizes = {r.doc_id: r.n for r in d.select("doc_id", T.token_count(PATH)("text").alias("n")).collect()}
    uses = used.groupBy("mix_name", "source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("n_tokens").alias("t")).collect()
    assert all(r.n <= {("a", "big"): 2, ("a", "mid"): 1, ("a", "small"): 3, ("b", "small"): 4}[r.mix_name, r.source] for r in uses)
    assert all(r.t == sizes[r.doc_id] > 0 for r in uses)
    total = sum(sizes.values())
    for k, share in ((("a", "big"), 0.5), (("a", "mid"), 0.3)):
        assert abs(rep[k].tokens - share * 0.5 * total) < 3 * 128 + 0.02 * total
    small = sum(sizes[i] for i in range(3000) if i % 30 == 2)
    assert rep["a", "small"].tokens == 3 * small and rep["a", "small"].most_uses == 3  # all of it, as often as allowed
    assert rep["b", "none"].tokens == 0 and rep["b", "big"].tokens == 0 and rep["b", "none"].share_of_mix == 0
    assert abs(sum(r.share_of_mix for k, r in rep.items() if k[0] == "a") - 1) < 1e-9
    assert sum(r.tokens for r in rep.values()) == used.agg(F.sum("n_tokens")).first()[0]


def test_every_stretch_is_balanced(spark):
    t = spark.createDataFrame([("a", "big", 0.6, 9, 0.9), ("a", "mid", 0.4, 9, 0.9)], TARGETS)
    rows = M.slots(M.weights(t, M.source_totals(M.sized(docs(spark), PATH), 64), F.lit(60_000))).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(len(rows)))
    big = [r.source == "big" for r in rows]
    share = sum(big) / len(big)
    for i in range(0, len(big) - 100, 50):
        assert abs(sum(big[i : i + 100]) / 100 - share) < 0.04


def test_golden_points(spark):
    i = [0, 1, 2, 65_535, 65_536, 2**31, 2**40 + 3]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in i], "i bigint").select(M.golden_point(F.col("i"))).collect()]
    assert got == [(x * M.GOLDEN % 2**32) / 2**32 for x in i]


def test_empty(spark):
    t = spark.createDataFrame([("a", "big", 0.5, 2, 0.5)], TARGETS)
    used, report = M.mix(spark.createDataFrame([], DOCS), t, PATH)
    assert used.count() == 0 and [r.tokens for r in report.collect()] == [0]
    odd = spark.createDataFrame([(None, "big", 0.5, 2, 0.5), ("a", None, 0.5, 2, 0.5), ("a", "big", None, None, None), ("b", "big", 0.5, 1, None)], TARGETS)
    used, report = M.mix(docs(spark), odd, PATH)
    assert used.count() == 0 and report.count() == 3
    used, report = M.mix(docs(spark).limit(5), spark.createDataFrame([], TARGETS), PATH)
    assert used.count() == 0 and report.count() == 0
