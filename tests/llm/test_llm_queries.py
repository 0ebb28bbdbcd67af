"""Every registered query of the subpackage on the smallest tables: against its SQL, or against brute force."""

import glob
import itertools
import os

import duckdb
import pytest

from quirelight.llm import lookalike, names, queries, splitting, tokens

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows(x):
    return sorted(tuple(map(str, r)) for r in x)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    want = duck.execute(f"select {', '.join(cols)} from ({queries.ORACLES[name]})").fetchall()
    assert rows(got.select(*cols).collect()) == rows(want)


def test_every_query_is_tested():
    here = open(__file__).read()
    assert all(n in queries.ORACLES or f'"{n}"' in here for n in queries.QUERIES)


def run(spark, name):
    return queries.QUERIES[name](spark, DATA).collect()


def test_names(spark, duck):
    """Pairs are exactly those of one entity, and entities hold every spelling with a letter once."""
    pairs, entities = run(spark, "p4_found"), run(spark, "p4_entities")
    spelt = duck.execute("select distinct 'creators' as f, unnest(creators) as n from books union select distinct 'publisher', publisher from books").fetchall()
    parsed = {(f, n) for f, n in spelt if n and (names.house(n)[2] if f == "publisher" else names.person(n)[1])}
    assert sorted((e.field_name, e.name) for e in entities) == sorted(parsed)
    groups = {}
    for e in entities:
        groups.setdefault((e.field_name, e.entity), []).append(e.name)
    assert rows(pairs) == rows((f, a, b) for (f, _), g in groups.items() for a, b in itertools.combinations(sorted(g), 2)) and pairs


def test_scanned_pages(spark, duck):
    texts = dict(duck.execute("select book_id, doc_text from books where doc_text is not null").fetchall())
    found, repaired = run(spark, "p3_found"), {r.book_id: r.text for r in run(spark, "p3_repaired")}
    assert set(repaired) == set(texts) and len({tuple(r) for r in found}) == len(found)
    alone = {(r.book_id, r.line_no) for r in found if r.issue in ("header", "page_number")}
    assert not alone & {(r.book_id, r.line_no) for r in found if r.issue in ("hyphen", "misread")}
    for r in found:
        line = texts[r.book_id].split("\n")[r.line_no - 1]
        assert line.strip() and (r.issue != "page_number" or len(line.strip()) < 40)
    for b, t in texts.items():  # every word of the text lines is still there, but for repairs
        issues = {r.line_no for r in found if r.book_id == b}
        for i, line in enumerate(t.split("\n"), 1):
            if i not in issues and i - 1 not in issues:
                assert "".join(w for w in line.split()[1:-1] if w.isalnum()) in "".join(w for w in repaired[b].split() if w.isalnum()) or not line.strip()


def test_pieces(spark, duck):
    got = {}
    for r in run(spark, "p5_pieces"):
        got.setdefault(r.entry_id, []).append((r.piece_no, r.begin, r.end, r.piece))
    for entry, text, size, overlap in duck.execute("select entry_id, text, chunk_size, chunk_overlap from text_entries join index_states using (state_id) where length(text) > 0").fetchall():
        want = [(i, a, b, text[a:b]) for i, (a, b) in enumerate(zip(*splitting.cuts(text, size, overlap)[:2], strict=True))]
        assert sorted(got.pop(entry)) == want
    assert not got


def test_ids(spark, duck):
    e = tokens.encoder(tokens.ranks_path())
    want = [(i, e.encode_ordinary(t) if t else []) for i, t in duck.execute("select doc_id, text from documents").fetchall()]
    assert rows(run(spark, "p6_ids")) == rows(want)


def test_mixes(spark, duck):
    e = tokens.encoder(tokens.ranks_path())
    n = {i: (s, len(e.encode_ordinary(t)) if t else 0) for i, s, t in duck.execute("select doc_id, source, text from documents").fetchall()}
    caps = {(m, s): k for m, s, k in duck.execute("select mix_name, source, max_repeats from mix_targets").fetchall()}
    uses, total = {}, {}
    for r in run(spark, "p7_mix"):
        assert n[r.doc_id] == (r.source, r.n_tokens)
        uses[r.mix_name, r.source, r.doc_id] = uses.get((r.mix_name, r.source, r.doc_id), 0) + 1
        total[r.mix_name, r.source] = total.get((r.mix_name, r.source), 0) + r.n_tokens
    assert all(k <= caps[m, s] for (m, s, _), k in uses.items())
    shares = {(r.mix_name, r.source): r for r in run(spark, "p7_shares")}
    assert set(shares) == set(caps) and all(shares[k].tokens == total.get(k, 0) for k in caps)
    for m in {m for m, _ in caps}:
        assert abs(sum(r.share_of_mix for (x, _), r in shares.items() if x == m) - 1) < 1e-9


def test_looks(spark, duck):
    docs = [(i, t, lookalike.skeleton(t)) for i, t in duck.execute("select doc_id, text from documents where text is not null").fetchall()]
    seen = [(i, t, s) for i, t, s in docs if s.strip()]
    want = [(min(i, j), max(i, j)) for (i, a, s), (j, b, t) in itertools.combinations(seen, 2) if a != b and s == t]
    assert rows(run(spark, "p8_found")) == rows(want)
