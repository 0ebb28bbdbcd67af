"""Every registered query against its SQL on the smallest tables."""

import datetime as dt
import glob
import os
import re
import zlib

import duckdb
import pandas as pd
import pytest
import yaml

from quirelight.plans import problems, queries, roundtrips  # noqa: F401  (registers its queries)

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
QUERIES, ORACLES = queries.QUERIES | problems.QUERIES, queries.ORACLES | problems.ORACLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows(df):
    def plain(v):
        if hasattr(v, "tolist") and not isinstance(v, str | float):
            v = v.tolist()
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
            return "-"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.toPandas()) == rows(want)


def test_every_query_is_tested():
    here = open(__file__).read()
    assert all(n in ORACLES or f'QUERIES["{n}"]' in here for n in QUERIES)


def test_block_crc(spark, duck):
    want = []
    for i, t in duck.execute("select doc_id, text from documents where text is not null").fetchall():
        raw, crc = t.encode(), 0
        for k in range(0, len(raw), 4096):
            crc ^= zlib.crc32(raw[k : k + 4096])
        want.append((i, crc))
    assert sorted(tuple(r) for r in QUERIES["file_hashes"](spark, DATA).collect()) == sorted(want)


def test_note_metadata(spark, duck):
    want = []
    for key, at, t in duck.execute("select desc_key, strftime(ingested_at, '%Y-%m-%dT%H:%M:%SZ'), text from documents").fetchall():
        m, front = re.match(r"(?s)^---\n(?:(.*?)\n)??---(?:\n|$)", t or ""), None
        if m:
            front = m.group(1) or ""
        elif (t or "").startswith("---\n"):
            front = t[4:]
        try:
            got = yaml.safe_load(front) if front is not None else None
            got = got if isinstance(got, dict) or got is None else {}
        except yaml.YAMLError:
            got = {}
        folder = key.rpartition("/")[0] or "."
        mine = got or {}
        changes = (got is None) + ("uuid" not in mine) + (mine.get("creation") is None) + (mine.get("context") != folder)
        want.append((key, folder, changes))
    rows_ = QUERIES["note_metadata"](spark, DATA).collect()
    mine = {r.path for r in rows_ if not r.context.startswith("Books/")}  # those take it from a tag
    assert sorted((r.path, r.context, r.changes) for r in rows_ if r.path in mine) == sorted(w for w in want if w[0] in mine) and len(rows_) == len(want)
    assert all(r.creation for r in rows_)


def test_clipping_fields(spark, duck):
    """The words of every clipping's block that is read come back as its title and text."""
    texts = dict(duck.execute("select doc_id, text from documents where doc_kind = 'clipping'").fetchall())
    got = QUERIES["clipping_fields"](spark, DATA).collect()
    assert {r.doc_id for r in got} == {i for i, t in texts.items() if t and any(b.strip() for b in t.split("=========="))}
    for r in got:
        raw = texts[r.doc_id].split("==========")[r.block_no]
        block = " ".join(raw.split())
        assert " ".join(r.title.split()) in block and (r.error is not None) == (r.date is None) and (r.text is None or " ".join(r.text.split()) in block)
        assert r.error != "locale" or not re.search(r"- Your .*Added on |- Deine? .*Hinzugefügt am ", raw)


def test_time_texts(spark, duck):
    """Every written-out instant and plain day among the time texts, worked out anew."""
    got = {(r.book_id, r.field_name): r.epoch_us for r in QUERIES["p1_found"](spark, DATA).collect()}
    seen = 0
    for f in problems.DATE_FIELDS:
        for i, raw in duck.execute(f"select book_id, {f} from books where {f} is not null").fetchall():
            if re.fullmatch(r"\d{4}-\d\d-\d\d", raw) and 1400 <= int(raw[:4]) < 9999:
                t = dt.datetime.fromisoformat(raw).replace(tzinfo=dt.UTC)
            elif re.fullmatch(r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:?\d\d)", raw) and not raw.endswith("T00:00:00+00:00") and 1400 <= int(raw[:4]) < 9999:
                t = dt.datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", raw))
            else:
                continue
            if re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\+00:00", raw):
                assert (i, f) not in got
                continue
            seen += 1
            assert got[i, f] == (t - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(microseconds=1), raw
    assert seen > 10


def test_nothing_outside_imports_llm():
    for p in glob.glob(os.path.join(os.path.dirname(queries.__file__), "..", "**", "*.py"), recursive=True):
        if f"{os.sep}llm{os.sep}" not in os.path.normpath(p):
            assert not re.search(r"(?:from|import) .*\bllm\b", open(p).read()), p
