import os
import random

import pytest
from pyspark.sql import functions as F

from quirelight.llm import tokens as T

PATH = T.ranks_path()
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")
TEXTS = ["", None, "Hello world", "don't  stop\n\n\nnow", "<|endoftext|>", "日本語 текст 🎉", " ", "x" * 3000, "a1b2 " * 400]


def test_ids_and_bytes_round_trip(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    e = T.encoder(PATH)
    got = {r.doc_id: r.ids for r in T.encode_table(df, PATH).collect()}
    assert got == {i: e.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}
    back = T.encode_table(df, PATH).select("doc_id", T.token_bytes(PATH)(F.col("ids")).cast("string").alias("t"))
    assert {r.doc_id: r.t for r in back.collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    part = df.where("doc_id = 5").select(T.token_bytes(PATH)(F.slice(T.token_ids(PATH)(F.col("text")), 1, 1)).alias("b")).first().b
    assert "日本語 текст 🎉".encode().startswith(bytes(part))
    assert {r.doc_id: r.n for r in df.select("doc_id", T.token_count(PATH)("text").alias("n")).collect()} == {i: len(v) for i, v in got.items()}


def test_safe_pieces_change_nothing():
    rng = random.Random(1)
    parts = ["'", "s", "'ll", " ", "  ", "\n", "word", "12", "-", "é", "日", "'t2", " 'x", "\t", "...", "́", "👩‍🏫"]
    e = T.encoder(PATH)
    for _ in range(400):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 60)))
        assert "".join(T.safe_pieces(t, 3)) == t
        assert T.encode_text(t, PATH, 3) == e.encode_ordinary(t), t


def test_same_ids_as_the_other_library():
    tk = pytest.importorskip("tokenizers")
    other = PATH.replace(".tiktoken", ".json")
    if not os.path.exists(other):
        pytest.skip("no vocabulary")
    t = tk.Tokenizer.from_file(other)
    t.encode_special_tokens = True
    for x in TEXTS:
        assert T.encode_text(x, PATH) == t.encode(x or "", add_special_tokens=False).ids


def test_empty_table(spark):
    assert T.encode_table(spark.createDataFrame([], "doc_id int, text string"), PATH).count() == 0
