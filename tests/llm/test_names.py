import itertools
import random

import pytest

from quirelight.llm import names as N

FIELDS = "field_name string, name string, n bigint"


def linked(spark, names, field="creators"):
    got = N.variant_pairs(spark.createDataFrame([(field, n, 1) for n in names], FIELDS))
    return sorted((r.name_a, r.name_b) for r in got.collect())


def pairs(*groups):
    return sorted(p for g in groups for p in itertools.combinations(sorted(g), 2))


def test_people(spark):
    a = ["Francisco Civagurg", "CIVAGURG, Francisco", "Francisco  Civagurg", "Francisco Ciavgurg", "F. Civagurg", "Civagurg F.", "Dr. Francisco Civagurg", "Francisco Civagurg (ed.)", "Civagurg Francisco"]
    b = ["Jacob Benjamin Gistodosh", "Gistodosh, Jake", "J. B. Gistodosh", "Jcaob Gistodosh"]
    c, d, e = ["Anselm Gistodosh"], ["Jürgen van Tumoreck", "Juergen van Tumoreck", "VAN TUMORECK, Jürgen"], ["Francisco Kutokons", "Kutokons, Francisco"]
    assert linked(spark, a + b + c + d + e) == pairs(a, b, c, d, e)


def test_houses(spark):
    a = ["Romatelm Lithographic Press", "Romatelm Lithogr. Press", "Rommatelm Lithographic Press", "Lithographic Press Romatelm"]
    b, c = ["Romatelm University Press", "University of Romatelm Press", "Univ. Pr. of Romatelm", "Romatelm U.P."], ["Folkult & Menadasift Publishers", "Menadasift & Folkult Publishers", "Folkult + Menadasift", "Folkult, Menadasift & Co."]
    d, e = ["Institute for Textile Studies, Sisti Puno", "Sisti Puno Institute for Textile Studies", "The Sisti Puno Inst. f. Textile Studies"], ["Folkult Verlag", "Verlag Folkult", "Folkult-Verlag"]
    assert linked(spark, a + b + c + d + e, "publisher") == pairs(a, b, c, d, e)


@pytest.mark.parametrize(("a", "b"), [("civagurg", "ciavgurg"), ("gregory", "grehory"), ("marcel", "marrcel"), ("sanavers", "sanaers")])
def test_slips(a, b):
    assert N.slip(a, b) and N.slip(b, a)


@pytest.mark.parametrize(("a", "b"), [("wibrirash", "wibrirash"), ("mosudild", "mosulild"), ("jodavort", "jomovort"), ("ab", "ba"), ("", "a")])
def test_no_slips(a, b):
    assert not N.slip(a, b)


def slips_of(w):
    """All words one slip away."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    found = {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1)} | {w[:i] + w[i] + w[i:] for i in range(len(w))} | {w[:i] + w[i + 1 :] for i in range(len(w))}
    return {v for v in found | {w[:i] + x + w[i + 1 :] for i in range(len(w)) for x in letters} if N.slip(w, v)}


def test_bands_reach_the_recall():
    b = N.bands_for(0.5, 0.99, 3)
    assert 1 - (1 - 0.5**3) ** b >= 0.99 > 1 - (1 - 0.5**3) ** (b - 1)
    hit = total = 0
    for w in ["hustutonkamir", "vamoliderning", "famoniturnesta", "netekistomara", "zemosastilden"]:
        s = N.signature(w, N.bands_for())
        variants = slips_of(w)
        hit += sum(any(x == y for x, y in zip(s, N.signature(v, N.bands_for()), strict=True)) for v in variants)
        total += len(variants)
    assert hit / total >= 0.95


@pytest.mark.parametrize("length", range(3, 13))
def test_candidates_of_words_of_every_length(length):
    rng = random.Random(length)
    for _ in range(60):
        w = "".join(rng.choice("aeioubcdfglmnrstw") for _ in range(length))
        assert all(N.deletion_keys(w) & N.deletion_keys(v) for v in slips_of(w))


def test_short_and_transcribed_names(spark):
    for a, b in (("Wolf", "Wlof"), ("Beck", "Bekc"), ("Lang", "Lagn"), ("Voss", "Vsos"), ("Roth", "Rtoh"), ("Kern", "Kenr"), ("Haas", "Hsaa")):
        assert N.slip(a.lower(), b.lower())
    short = [(f"{g} {a}", f"{g} {b}") for g, a, b in (("Karl", "Wolf", "Wlof"), ("Dora", "Beck", "Bekc"), ("Uwe", "Lang", "Lagn"), ("Ida", "Voss", "Vsos"), ("Otto", "Roth", "Rtoh"), ("Jan", "Kern", "Kenr"), ("Else", "Haas", "Hsaa"))]
    umlauts = [("Karl Müller-Schröder", "Karl Mueller-Schroeder"), ("Jean-Paul Tamorek", "J.-P. Tamorek")]
    assert linked(spark, [n for p in short + umlauts for n in p]) == pairs(*short, *umlauts)


def test_left_out_bands_change_nothing(spark, monkeypatch):
    rows = [("creators", w) for w in ("hustutonk", "husututonk", "hustuutonk", "hustutok", "vamolidern", "vamoliderm", "other")]
    df = spark.createDataFrame(rows, "field_name string, word string")
    some = sorted(tuple(r) for r in N.word_pairs(df).collect())
    monkeypatch.setattr(N, "CROWDED", 0)
    assert some == sorted(tuple(r) for r in N.word_pairs(df).collect()) and some == sorted(("creators", a, b) for (_, a), (_, b) in itertools.permutations(rows, 2) if a < b and N.slip(a, b))


def test_a_family_name_that_many_bear(spark):
    """Forms of one family name meet by their given names; the initial meets all of its letter and goes to one."""
    given = ["".join(p) for p in itertools.product("bdfgh", "aeiou", "lmnr", "a")]
    names = [f"{g} Smithon" for g in given]
    forms = N.forms(spark.createDataFrame([("creators", n, 1) for n in names], FIELDS))
    got = N.links(forms).count()
    first = [N.fold(n).split()[0] for n in names]
    assert got == sum(N.inner(a, b) > 0 for a, b in itertools.combinations(first, 2))


def test_stars_do_not_chain(spark):
    nodes = spark.createDataFrame([(f, 2, w) for f, w in (("a", 9), ("b", 1), ("c", 8), ("d", 1))], "form string, fullness int, weight bigint")
    edges = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8)], "form_a string, form_b string, sim double")
    got = {r.form: r.center for r in N.star_clusters(nodes, edges).collect()}
    assert got == {"a": "b", "b": "b", "c": "b"}


def test_odd_names(spark):
    df = spark.createDataFrame([("creators", n, 1) for n in (None, "", " ", "...", "(ed.)", ",", "X", "Dr.", "x" * 20_000, "Solo", "van", "and")] + [("publisher", n, 1) for n in ("&", "Verlag", "The", "a-b")], FIELDS)
    assert N.variant_pairs(df).count() == 0
    assert N.variant_pairs(spark.createDataFrame([], FIELDS)).count() == 0
    books = spark.createDataFrame([(["A Bcdef", "A Bcdef", None], None, 1), (None, "P", 1), ([], "", 1)], "creators array<string>, publisher string, name int")
    assert {(r.field_name, r.name, r.n) for r in N.distinct_names(books).collect()} == {("creators", "A Bcdef", 2), ("publisher", "P", 1), ("publisher", "", 1)}
