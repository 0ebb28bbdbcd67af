import base64
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quirelight.sinks import render, state
from quirelight.sources import clippings, config, files, library, notes

NOTE = """---
uuid: 11111111-2222-3333-4444-555555555555
creation: 2024-01-05T10:00:00
tags:
  - Series/Old_Maps
---

See [[Rome]] and [[Rome|the city]].

<!-- domain: "history/rome"; source: wiki -->
| Date | Event | Place |
| ---- | ----- | ----- |
| 753 BC | Founding | Rome |
| 509 BC - 27 BC | Republic | Rome |

```
| not | read |
```
| Date | Age |
| bad! | - |
| 1 | a |
"""


def test_notes_folder(spark, tmp_path):
    for p, t in {"Books/Rome map.md": NOTE, "a/plain.md": "text [[X]]", ".obsidian/x.md": "no", "a/.#tmp.md": "no", "a/x.txt": "no", "Templates/t.md": "no"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    got = {r.path: r for r in notes.load_notes(spark, f"file://{tmp_path}").collect()}
    assert set(got) == {"Books/Rome map.md", "a/plain.md"}
    r = got["Books/Rome map.md"]
    assert r.title_key == "rome map" and r.uuid.startswith("1111") and r.links == ["rome", "rome"] and r.metadata["context"] == "Books"
    assert [len(t["rows"]) for t in r.tables] == [2, 1] and r.tables[0]["metadata"] == {"domain": "history/rome", "source": "wiki"} and r.tables[1]["columns"] == []
    assert got["a/plain.md"].changes == 4 and got["a/plain.md"].metadata["context"] == "a"


def test_series_gives_context(spark):
    df = spark.createDataFrame([("Books/x.md", {"context": "Books", "tags": '["a", "Series/Old_Maps"]', "uuid": "u", "creation": "c"})], "path string, metadata map<string,string>").withColumn("modified", F.current_timestamp())
    r = notes.complete_front_matter(df).first()
    assert r.metadata["context"] == "Books/Old_Maps" and r.changes == 1


@pytest.mark.parametrize(
    ("text", "front", "body"),
    [("a\nb", None, "a\nb\n"), ("---\nk: v\n---\n\n\nx", "k: v", "x\n"), ("---\nk: v\nno end", "k: v\nno end", "\n"), ("---\n---\nx", "", "x\n"), (" ---\nx", None, " ---\nx\n"), ("", None, "\n")],
)
def test_front_matter(spark, text, front, body):
    r = spark.createDataFrame([(text,)], "t string").select(notes.front_matter(F.col("t")).alias("f")).first().f
    assert (r.front, r.body) == (front, body)


def test_yaml(spark):
    df = spark.createDataFrame([("a: 1\nb: [x]",), ("a: [",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(notes.yaml_map(F.col("t"))).collect()] == [{"a": "1", "b": '["x"]'}, {}, None, None]


def test_tables():
    assert notes.parse_tables("| a | b |\n| - | - |\n| 1 | 2 |") == [{"columns": ["a", "b"], "rows": [["1", "2"]], "metadata": {}}]
    assert notes.parse_tables("| a | b |\n| - | - |\n| 1 | 2 |\n\n| c | d\n| - | - |\n| 1 | 2 |")[0]["columns"] == ["a", "b"]
    assert notes.parse_tables("| a |\n| - |\n") == [] and notes.parse_tables("$$\n| a |\n| - |\n| 1 |\n$$\n") == [] and notes.parse_tables("| a |\nx\n| 1 |") == []


def test_derived_domain(spark):
    df = spark.createDataFrame([("a b/c.md", "| Date | My Event |\n| - | - |\n| 1 | x |\n")], "path string, body string")
    assert notes.table_rows(df).first().metadata == {"domain": "a_b/c/My_Event"}


CLIPS = """﻿A Book (Doe, Jane)
- Your Highlight at location 100-101 | Added on Tuesday, 28 March 2023 13:48:18

Some text
==========
Ein Buch (Muster, Max)
- Dein Lesezeichen auf Seite 5 | bei Position 70-71 | Hinzugefügt am Dienstag, 28. März 2023 13:48:18

==========
Plain Title
- Your Note on page 7 | Added on Wednesday, 1 November 2023 00:00:00

n
==========
Odd
- Your Note | on page 7 | at location 3 | Added on Wednesday, 1 November 2023 00:00:00
==========
Nothing here
==========
"""


def test_clippings(spark, tmp_path):
    (tmp_path / "c.txt").write_text(CLIPS)
    got = [r.asDict() for r in clippings.parse(clippings.blocks(clippings.read_clippings(spark, f"file://{tmp_path}")), "Europe/Berlin").orderBy("block_no").collect()]
    pick = lambda r: tuple(r[k] for k in ("title", "author", "type", "location", "page", "date", "text", "error"))
    assert pick(got[0]) == ("A Book", "Jane Doe", "Highlight", "100-101", None, "2023-03-28T11:48:18+0000", "Some text", None)
    assert pick(got[1]) == ("Ein Buch", "Max Muster", "Bookmark", "70-71", "5", "2023-03-28T11:48:18+0000", "", None)
    assert pick(got[2]) == ("Plain Title", None, "Note", None, "7", "2023-10-31T23:00:00+0000", "n", None)
    assert got[3]["error"] == "info line" and got[4]["error"] == "locale"


OPF = """<?xml version='1.0'?><package xmlns="http://www.idpf.org/2007/opf" unique-identifier="uuid_id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf">
<dc:identifier opf:scheme="calibre" id="calibre_id">12</dc:identifier><dc:identifier opf:scheme="uuid" id="uuid_id">u-1</dc:identifier><dc:identifier opf:scheme="ISBN">978</dc:identifier>
<dc:title>The Book</dc:title><dc:creator opf:role="aut">Jane Doe</dc:creator><dc:creator opf:role="trl">No One</dc:creator><dc:creator opf:role="aut">Max Muster</dc:creator>
<dc:subject>Maps</dc:subject><dc:language>eng</dc:language><dc:date>2001-02-03T04:05:06+05:00</dc:date>
<meta name="calibre:series" content="Old Maps"/><meta name="calibre:title_sort" content="Book, The"/><meta name="calibre:timestamp" content="2023-11-11T17:03:48.214591+00:00"/></metadata></package>"""


def test_library(spark, tmp_path):
    b = tmp_path / "Jane" / "The Book"
    b.mkdir(parents=True)
    (b / "metadata.opf").write_text(OPF)
    (b / "The Book.txt").write_text("content")
    (b / "The Book.md").write_text("# c")
    (tmp_path / ".caltrash" / "x").mkdir(parents=True)
    (tmp_path / ".caltrash" / "x" / "metadata.opf").write_text(OPF)
    r = library.load_library(spark, f"file://{tmp_path}", load_text=True).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.title, r.title_sort, r.short_title, r.creators, r.series, r.uuid, r.calibre_id, r.identifiers) == ("The Book", "Book", "Book - Jane Doe", ["Jane Doe", "Max Muster"], "Old Maps", "u-1", "12", ["ISBN/978"])
    assert (r.publication_date, r.date_added, r.context, r.publisher) == ("2001-02-03T04:05:06+00:00", "2023-11-11T17:03:48+00:00", "Books/Old Maps", "")
    assert [d["name"] for d in r.docs] == ["The Book.md", "The Book.txt"] and r.formats == ["md", "txt"] and r.doc_text == "content" and r.docs[1]["hash"].isdigit()
    paths = spark.createDataFrame([("a/T.sdr/metadata.epub.lua",), ("a/T.sdr/metadata.pdf.lua",), ("a/x.pdf",)], "path string")
    assert [(s.title, s.formats) for s in library.sidecars(paths).collect()] == [("T", ["epub", "pdf"])]
    assert {x.path for x in library.read_target(spark, f"file://{tmp_path}").collect()} == {"Jane/The Book/metadata.opf", "Jane/The Book/The Book.txt", "Jane/The Book/The Book.md"}


def test_html_tables(spark):
    page = "<p>x<table><tr><th>A<th colspan=2>B</tr><tr><td rowspan=2>1</td><td>2<td>3 &amp; <b>4</b></tr><tr><td>5<td></tr></table><table><tr><td>z</table>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "no table")], "i int, html string")
    got = [tuple(r) for r in files.html_tables(df, "i").orderBy("table_idx", "row_idx").collect()]
    assert got == [(1, 0, 0, ["A", "B", "B"]), (1, 0, 1, ["1", "2", "3 & 4"]), (1, 0, 2, ["1", "5", None]), (1, 1, 0, ["z"])]


def epub():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<c xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="o.opf"/></rootfiles></c>')
        z.writestr("o.opf", OPF)
        z.writestr(files.BOOKMARKS, files.BOOKMARK_PREFIX + base64.b64encode(json.dumps([{"pos": 1}]).encode()).decode())
    return out.getvalue()


def test_epub(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(epub())
    (tmp_path / "b.epub").write_bytes(b"no zip")
    x = files.metadata_scan(spark, f"file://{tmp_path}")
    assert tuple(files.scan_counts(x).first()) == (1, 1)
    assert x.where("valid").first().metadata["title"] == "The Book"
    df = spark.createDataFrame([(epub(),), (b"x",), (None,)], "c binary")
    assert [r[0] for r in df.select(files.bookmarks(F.col("c"))).collect()] == ['[{"pos": 1}]', None, None]


def test_corpus(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x y.md").write_text("hello")
    (tmp_path / "e.txt").write_text("")
    assert [(r.desc, r.text) for r in files.read_corpus(spark, f"file://{tmp_path}", "lib").collect()] == [("{lib}d/x y.md", "hello")]


def test_state(spark, tmp_path):
    root = f"file://{tmp_path}/state"
    assert state.last_state(spark, root) == (0, None) and state.load_state(spark, root) is None
    df = spark.createDataFrame([(1, "a")], "i int, v string")
    assert state.save_state(df, root) == 1 and state.save_state(df.union(df), root, expected=1) == 2
    with pytest.raises(RuntimeError):
        state.save_state(df, root, expected=1)
    assert state.load_state(spark, root).count() == 2


def test_renderers(spark):
    e = spark.createDataFrame([(1, 2451544.5, None, {"Event": "a long text with some-hyphen words", "Place": "x"})], "i int, jd_start double, jd_end double, eventdata map<string,string>")
    assert render.event_lines(e, 8).first().line == "| 2000                     | Event: a... |"
    lines = [r.line for r in render.ascii_lines(e, 40, ["long"]).orderBy("line_no").collect()]
    assert lines[0].startswith("| 2000 | Event: a **long** text") and len(lines) == 2 and lines[1].startswith("|      | ")
    t = [r.line for r in render.table_lines(spark.createDataFrame([(2, "b"), (1, "a")], "i int, v string"), ["i", "v"], ["i"]).orderBy("line_no").collect()]
    assert t == ["| i | v |", "| --- | --- |", "| 1 | a |", "| 2 | b |"]
    assert render.wrap("abc", 5) == ["abc"] and render.wrap("", 5) == [""] and render.wrap("abcdefgh", 4) == ["abcd", "efgh"]
    assert render.wrap("one two three", 9) == ["one two", "three"] and render.wrap("some-hyphen", 7) == ["some-", "hyphen"] and render.wrap("a bcdefghij", 6) == ["a bcde", "fghij"]


def test_notes_out(spark, tmp_path):
    b = spark.createDataFrame([("u", 'T "q"', "T", ["A B"], "S x", ["m n"], ["eng"], ["i/1"], ["pdf"], "7", "2001", "2002", "P", "c.jpg", "<p>d</p>", "Books/S x"), *[(None,) * 16]], "uuid string, title string, title_sort string, creators array<string>, series string, subjects array<string>, languages array<string>, identifiers array<string>, formats array<string>, calibre_id string, publication_date string, date_added string, publisher string, cover string, description string, context string")
    out = render.book_notes(b, "L").collect()
    note = next(r.note for r in out if r.uuid == "u")
    assert note.startswith("---\ncreation: 2002\ntitle: \"T 'q'\"\nuuid: u\nauthors:\n  - A B\ntags:\n  - Library/Calibre\n  - Series/S_x\n  - m_n\n") and "\n# T \"q\"\n\n_by A B_\n\n[Calibre-link]" in note and note.endswith("> d\n> \n> \n\nAuthors: [[A B]]\n")
    plan = spark.createDataFrame([("d/n.md", "text")], "path string, content string")
    assert [r.action for r in render.write_files(plan, str(tmp_path)).collect()] == ["would write"] and not (tmp_path / "d").exists()
    render.write_files(plan, str(tmp_path), dry_run=False)
    assert (tmp_path / "d" / "n.md").read_text() == "text"
    m = spark.createDataFrame([({"a": "1", "tags": '["x"]'}, "body")], "m map<string,string>, b string").select(render.assemble_note(F.col("m"), F.col("b")).alias("n")).first().n
    assert m.endswith("---\nbody") and "tags:\n- x\n" in m
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a").write_text("1")
    (tmp_path / "dst").mkdir()
    (tmp_path / "dst" / "old").write_text("2")
    acts = spark.createDataFrame([("a", "a", "new"), ("old", None, "debris")], "path string, src string, action string")
    render.copy_files(acts, str(tmp_path / "src"), str(tmp_path / "dst"), dry_run=False)
    assert (tmp_path / "dst" / "a").read_text() == "1" and (tmp_path / "dst" / "old").exists()
    render.copy_files(acts, str(tmp_path / "src"), str(tmp_path / "dst"), dry_run=False, delete=True)
    assert not (tmp_path / "dst" / "old").exists()


def test_clip_notes(spark):
    c = spark.createDataFrame([(1, "f.md", "n/Book, x.md", "T", "A", None, "Note", "5", None, "2020", "one"), (2, "f.md", "n/Book, x.md", "T", "A", None, "Highlight", None, "9", "2020", "two")], "pos int, file string, md_file string, title string, author string, warning string, type string, page string, location string, date string, text string")
    full = render.clip_notes(c).first().note
    assert full == "# Notes on T\n\n_by A_\n\nsee [[Book]]\n\n### Note on page 5\n\n_on 2020:_\n\n> one\n\n### Highlight at location 9\n\n_on 2020:_\n\n> two\n\n"
    old = spark.createDataFrame([("f.md", "X ### Note on page 5\n\n")], "file string, content string")
    assert render.clip_notes(c, old).first().note == "X ### Note on page 5\n\n### Highlight at location 9\n\n_on 2020:_\n\n> two\n\n"
    m = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"})], "o map<string,string>, n map<string,string>")
    assert m.select(render.merge_metadata(F.col("o"), F.col("n")).alias("m")).first().m == {"a": "1", "b": "3"}


def test_config_and_device(tmp_path):
    c = config.load_config(tmp_path / "c" / "x.json")
    assert c == config.Config() and (tmp_path / "c" / "x.json").exists()
    c.notes_folder = "/n"
    config.save_config(c, tmp_path / "y.json")
    assert config.load_config(tmp_path / "y.json").notes_folder == "/n"
    assert config.device_clippings("no such device") is None
