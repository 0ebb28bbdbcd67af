"""Other files: HTML tables, EPUB metadata and bookmarks, PDF text, JSON state, and the corpus for search."""

from __future__ import annotations

import base64
import functools
import importlib.util
import io
import json
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from urllib.request import urlopen

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOOKMARKS = "META-INF/calibre_bookmarks.txt"
BOOKMARK_PREFIX = "encoding=json+base64:\n"


class _Tables(HTMLParser):
    """Rows of the tables of a page; a nested table's text belongs to the cell around it, cell spans are repeated."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str | None]]] = []
        self.depth = 0
        self.cell: list[str] | None = None
        self.span = (1, 1)
        self.pending: dict[int, tuple[int, str]] = {}

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
                self.pending = {}
        elif self.depth == 1 and tag == "tr":
            self._close()
            self.tables[-1].append([])
            self._fill()
        elif self.depth == 1 and tag in ("td", "th") and self.tables[-1]:
            self._close()
            a = dict(attrs)
            num = lambda k: max(1, min(1000, int(a[k]))) if (a.get(k) or "").isdigit() else 1
            self.cell, self.span = [], (num("colspan"), num("rowspan"))
        elif tag in ("br", "p", "li") and self.cell:
            self.cell.append(" ")

    def handle_endtag(self, tag):
        if tag == "table":
            if self.depth == 1:
                self._close()
            self.depth = max(0, self.depth - 1)
        elif self.depth == 1 and tag in ("td", "th", "tr"):
            self._close()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def _fill(self):
        row = self.tables[-1][-1]
        while (p := self.pending.get(len(row))) is not None:
            if p[0] <= 1:
                self.pending.pop(len(row))
            else:
                self.pending[len(row)] = (p[0] - 1, p[1])
            row.append(p[1])

    def _close(self):
        if self.cell is None:
            return
        text = " ".join("".join(self.cell).split()) or None
        row = self.tables[-1][-1]
        for _ in range(self.span[0]):
            if self.span[1] > 1:
                self.pending[len(row)] = (self.span[1] - 1, text)
            row.append(text)
        self.cell = None
        self._fill()


def fetch_pages(urls: DataFrame, url: str = "url", timeout: float = 30.0) -> DataFrame:
    """``urls`` with the page of each as ``html``; null where the server or the network gives an error."""

    @F.pandas_udf("string")
    def each(s: pd.Series) -> pd.Series:
        def one(u: str | None) -> str | None:
            if u is None:
                return None
            try:
                with urlopen(u, timeout=timeout) as r:
                    return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
            except (OSError, ValueError):  # HTTP and URL errors are OSErrors
                return None

        return pd.Series([one(u) for u in s], dtype=object)

    return urls.withColumn("html", each(F.col(url)))


def html_rows(html: str | None) -> list[tuple[int, int, list[str | None]]]:
    """(table_idx, row_idx, cells) of a page; null and broken pages give what can be read."""
    if not html:
        return []
    p = _Tables()
    p.feed(html)
    p.close()
    return [(t, i, r) for t, rows in enumerate(x for x in p.tables if any(x)) for i, r in enumerate(x for x in rows if x)]


def html_tables(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, table_idx, row_idx, cells) of all tables of all pages."""

    @F.pandas_udf("array<struct<table_idx:int,row_idx:int,cells:array<string>>>")
    def each(s: pd.Series) -> pd.Series:
        return s.map(lambda v: [{"table_idx": t, "row_idx": i, "cells": c} for t, i, c in html_rows(v)])

    return pages.select(key, F.explode(each(F.col(html))).alias("r")).select(key, "r.*")


def epub_info(content: bytes | None) -> dict[str, str | None] | None:
    """title, language, creator, date and identifier of an EPUB, the first of each; null for what is no EPUB."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            rootfile = next(e for e in ET.fromstring(z.read("META-INF/container.xml")).iter() if e.tag.endswith("}rootfile"))
            opf = ET.fromstring(z.read(rootfile.attrib["full-path"]))
    except (zipfile.BadZipFile, KeyError, ET.ParseError, StopIteration):
        return None
    dc = "{http://purl.org/dc/elements/1.1/}"
    return {k: next((e.text for e in opf.iter(dc + k)), None) for k in ("title", "language", "creator", "date", "identifier")}


def epub_bookmarks(content: bytes | None) -> str | None:
    """The bookmarks of an EPUB as a JSON list."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            raw = z.read(BOOKMARKS).decode()
        return json.dumps(json.loads(base64.b64decode(raw.removeprefix(BOOKMARK_PREFIX)))) if raw.startswith(BOOKMARK_PREFIX) else None
    except (zipfile.BadZipFile, KeyError, ValueError):
        return None


def pdf_text(content: bytes | None) -> str | None:
    """Text of all pages; needs a PDF library."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF needs the pypdf package on the workers") from e
    return "".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(content or b"")).pages) or None


def pdf_info(content: bytes | None) -> dict[str, str] | None:
    """The information dictionary of a PDF; needs a PDF library."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF needs the pypdf package on the workers") from e
    return {str(k).lstrip("/"): str(v) for k, v in (PdfReader(io.BytesIO(content or b"")).metadata or {}).items()}


def _by_content(f: Callable, kind: str) -> Callable[[Column | str], Column]:
    @F.pandas_udf(kind)
    def each(s: pd.Series) -> pd.Series:
        return s.map(lambda v: f(None if v is None else bytes(v)))

    return each


def epub_metadata(content: Column) -> Column:
    return _by_content(epub_info, "map<string,string>")(content)


def bookmarks(content: Column) -> Column:
    return _by_content(epub_bookmarks, "string")(content)


def reads_pdf() -> bool:
    return importlib.util.find_spec("pypdf") is not None


def metadata_scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, metadata, valid) of all EPUB files, and of PDF files where a library can read them."""
    kinds = [("epub", epub_info)] + ([("pdf", pdf_info)] if reads_pdf() else [])
    found = None
    for kind, info in kinds:
        x = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{kind}").load(root)
        x = x.select("path", _by_content(info, "map<string,string>")(F.col("content")).alias("metadata")).withColumn("valid", F.col("metadata").isNotNull())
        found = x if found is None else found.unionByName(x)
    return found


def scan_counts(scanned: DataFrame) -> DataFrame:
    return scanned.agg(F.count_if("valid").alias("ok"), F.count_if(~F.col("valid")).alias("error"))


def read_corpus(spark: SparkSession, root: str, library: str, formats: tuple[str, ...] | None = None) -> DataFrame:
    """(desc, filename, text) of a folder's texts, desc being ``{library}`` and the path below the folder; PDF by default where a library can read it."""
    formats = formats or ("txt", "md", *(["pdf"] if reads_pdf() else []))
    plain = [f for f in formats if f in ("txt", "md", "py")]
    parts = []
    if plain:
        x = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(plain) + "}").text(root, wholetext=True)
        parts.append(x.select(F.col("_metadata.file_path").alias("_p"), F.col("value").alias("text")))
    if "pdf" in formats:
        p = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(root)
        parts.append(p.select(F.col("path").alias("_p"), _by_content(pdf_text, "string")(F.col("content")).alias("text")))
    x = functools.reduce(DataFrame.unionByName, parts)
    base = root.removeprefix("file://").rstrip("/") + "/"
    path = F.url_decode(F.replace("_p", F.lit("+"), F.lit("%2B")))
    below = F.substring(path, F.locate(base, path) + len(base), F.length(path))
    return x.where("text <> ''").select(F.concat(F.lit("{" + library + "}"), below).alias("desc"), F.concat(F.lit(base), below).alias("filename"), "text")


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON document with a given schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)
