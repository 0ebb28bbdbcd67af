import random

from quirelight.llm import layout, ocr

KIND = "book_id bigint, text string, known array<string>"
WORDS = "the garden remembered every monastery although several merchants surveyed ancient harbour together with patient children before sunrise".split()


def clean_lines(seed, n):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(8)) for _ in range(n)]


def test_layout_of_pages():
    page = lambda no, head: ["", head, f"[{no}]", "", *clean_lines(no, 22)]
    lines = ["1. The First Part", *clean_lines(0, 20), "1875", *page(11, "A HEDGE IN TILLOWBY"), *page(12, "a hcdge in tillowby"), "2. The Second Part", *page(13, "A HEDGE IN TILLOWBY"), *page(14, "2. THE SECOND PART")]
    kinds = layout.classify("\n".join(lines), ["A Hedge in Tillowby"])
    at = lambda s: [k for x, k in zip(lines, kinds, strict=True) if x == s]
    assert at("[11]") == at("[13]") == ["page_number"] and at("1875") == ["body"]
    assert at("A HEDGE IN TILLOWBY") == ["header"] * 2 and at("a hcdge in tillowby") == ["header"] and at("2. THE SECOND PART") == ["header"]
    assert at("1. The First Part") == at("2. The Second Part") == ["heading"]


def test_page_numbers():
    assert [layout.page_value(x) for x in ("~ 9 ~", "xiv", "Page 12", "word", "12 / 20", "1O5")] == [("arabic", 9, True), ("roman", 14, False), ("arabic", 12, True), None, ("arabic", 12, True), ("arabic", 105, False)]
    assert layout.roman("xc") == 90 and layout.roman("zz") is None


def test_weighted():
    assert ocr.weighted("c1ock", "clock") == 0.3 and ocr.weighted("carne", "came") == 0.3 and ocr.weighted("clerived", "derived") == 0.3
    assert ocr.weighted("castle", "castles") == float("inf") and round(ocr.weighted("5plendld", "splendid"), 6) == 0.6


def corpus():
    lines = clean_lines(1, 400)
    text = [x + "." for x in lines]
    text[10] = "the gardcn rernembered every monasfery."
    text[20] = "several patient child-"
    text[21] = "ren before sunrise."
    text[30] = "a well-kept harbour and a well-kept garden"
    text[31] = "together with the well-"
    text[32] = "kept ancient harbour."
    text[40] = "several merch\xad"
    text[41] = "onts surveyed."
    return text


def issues(spark, texts):
    return sorted(tuple(r) for r in ocr.found(spark.createDataFrame(texts, KIND)).collect())


def test_found(spark):
    got = issues(spark, [(1, "\n".join(corpus()), [])])
    assert got == [(1, 11, "misread"), (1, 21, "hyphen"), (1, 41, "hyphen"), (1, 42, "misread")]


def test_repaired(spark):
    out = ocr.repaired(spark.createDataFrame([(1, "\n".join(corpus()), []), (2, None, None), (3, "", [])], KIND))
    got = {r.book_id: r.text for r in out.collect()}
    assert "the garden remembered every monastery." in got[1] and "children before sunrise" in got[1] and "the well-kept ancient" in got[1] and "merchants surveyed" in got[1]
    assert got[2] is None and got[3] == ""


def test_context_repairs_a_frequent_word(spark):
    rng = random.Random(8)
    some = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    lines = [f"{some(4)} the war was {some(3)}." for _ in range(100)] + [f"{some(4)} a wor of {some(3)}." for _ in range(100)]
    assert issues(spark, [(1, "\n".join(lines), [])]) == []  # both are words
    lines.append(f"{some(4)} the wor was {some(3)}.")
    assert issues(spark, [(1, "\n".join(lines), [])]) == [(1, 201, "misread")]


def test_odd_texts(spark):
    rows = [(1, None, None), (2, "", []), (3, " \n \n", [None]), (4, "x" * 100_000, ["T"]), (5, "-\n-\n¬\n\xad", []), (5, "12\n", []), (6, "a\x00b ퟿", ["T"])]
    assert all(r[2] in ("page_number", "header", "hyphen", "misread") for r in issues(spark, rows))
    assert issues(spark, []) == []
    clash = spark.createDataFrame([(1, "\n".join(corpus()), [], 1, 2)], KIND + ", w int, n int")
    assert ocr.found(clash).count() == 4


def test_page_evidence_does_not_depend_on_the_width(spark):
    def book(words):
        rng = random.Random(5)
        return "\n".join(x for no in range(11, 16) for x in ["\fTHE HEDGE OF TILLOWBY", str(no), *[" ".join(rng.choice(WORDS) for _ in range(words)) for _ in range(24)], ""])

    for words in (8, 24, 60):
        kinds = layout.classify(book(words))
        assert (kinds.count("header"), kinds.count("page_number")) == (5, 5), words
    assert layout.classify("Page 7\ntext goes on\nhere")[0] == "page_number"  # three lines are enough


def test_chains_reach_over_lines_of_numbers():
    rng = random.Random(6)
    page = lambda no: [*clean_lines(no, 20), str(no)]
    figures = [str(rng.randrange(3000, 9000)) for _ in range(30)]
    lines = page(31) + page(32) + clean_lines(1, 5) + figures + clean_lines(2, 5) + page(33) + page(34)
    kinds = layout.classify("\n".join(lines))
    assert [x for x, k in zip(lines, kinds, strict=True) if k == "page_number"] == ["31", "32", "33", "34"]
    assert layout.page_value("- - - - - - - - - - - - - - 12 - - - - - - - - - - - - - - -") == ("arabic", 12, True)
    assert layout.classify("\n".join([*clean_lines(1, 5), "page 6021", *clean_lines(2, 5)]))[5] == "page_number"


def test_many_lines_that_could_be_headers():
    import time

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(3, 9))) for _ in range(4000)]
    text = "\n".join(" ".join(rng.choice(words) for _ in range(7)).upper() for _ in range(10_000))
    began = time.process_time()
    assert set(layout.classify(text)) <= {"body", "header"}
    assert time.process_time() - began < 15  # 2.5 s on a free core; all pairs took minutes


def test_long_words(spark):
    long = "donaudampfschifffahrtsgesellschaftskapitaenswitwe"
    assert len(long) > 45
    text = [f"{x} {long}." for x in clean_lines(4, 40)]
    text[7] = text[7].replace("kapitaens", "kapitacns")
    giant = "x" * 30_000
    assert issues(spark, [(1, "\n".join(text), []), (2, "\n".join([giant, giant + "-", "y"]), [])]) == [(1, 8, "misread"), (2, 2, "hyphen")]
    assert ocr.weighted(giant, giant[:-1] + "y") == float("inf") and ocr.weighted("m" + giant, "rn" + giant) == 0.3


def brute(read, printed, left=2):
    """All ways to read a word, letter by letter."""
    if not printed and not read:
        return 0.0
    best = brute(read[1:], printed[1:], left) if read and printed and read[0] == printed[0] else float("inf")
    if left:
        for a, b, cost in ocr._PAIRS:
            if printed.startswith(a) and read.startswith(b):
                best = min(best, cost + brute(read[len(b) :], printed[len(a) :], left - 1))
    return best


def test_weights_and_index_against_brute_force():
    rng = random.Random(9)
    words = WORDS + "alle corn rim him win time garden lilium".split()
    for _ in range(3000):
        printed = read = rng.choice(words)
        for _ in range(rng.randrange(3)):
            a, b, _c = rng.choice(ocr._PAIRS)
            read = read.replace(a, b, 1)
        if abs(len(read) - len(printed)) > 2:
            continue
        w = ocr.weighted(read, printed)
        assert w == brute(read, printed) or abs(w - brute(read, printed)) < 1e-9
        if read != printed and w < 0.5 and not (ocr.deletes(read) | ocr.reversals(read)) & ocr.deletes(printed):
            raise AssertionError((read, printed))
