"""Cutting items over a size limit at natural boundaries, with a fixed overlap between pieces.

Every item over its limit goes one way.  Workers look at ranges of it with a halo on both sides and list the boundaries in them; the ranges'
tables, in order, are stitched by a fold that sums up the ranges' lengths, keeps one piece's boundaries in memory and says which pieces begin
in which range; each range then cuts out its own pieces by offset.  What a boundary is depends on no more text than the halo, so
the pieces do not depend on where ranges begin.  ``split_texts`` does it over ranges of texts in rows, ``split_files`` over byte ranges of files,
which are never loaded whole.  No step holds more of an item than a range and a piece, and no row more of its pieces than begin in one range.

Places, strongest first: blank line, line end, sentence end, clause end, white space, a separator inside an unspaced
stretch; a stretch without any is cut at the limit, but not inside a combined character.  A piece takes the last of the
strongest places in its second half, else the last place before.  Sizes are code points.

Defined results: null text gives no piece, the empty text none either; a text within the limit is one piece; an
overlap that is not smaller than the size counts as a third of the size, rounded down; null or non-positive sizes give no piece; a
repeated row gives its pieces again.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections import deque
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a range of a text, bytes of a range of a file, and characters of the halo on each side.
RANGE_CHARS, RANGE_BYTES, HALO = 1 << 13, 4 << 20, 256

PARAGRAPH, LINE, SENTENCE, CLAUSE, BLANK, SEPARATOR, UNSAFE = 6, 5, 4, 3, 2, 1, -1
_PLACE = regex.compile(r"\s+|[。！？](?=[^\s。！？」』）])|[、，；：](?=\S)|(?<=[\w\p{P}\p{S}])[-/?&=_.,;:+](?=\w)")
_SPACES = regex.compile(r"\s")
_CLOSERS = "\"'”’»)]}*_"


def _level(text: str, pos: int, first: int) -> int:
    """Strength of the place before ``text[pos]``, from the halo before it."""
    before = text[max(first, pos - HALO) : pos]
    body = before.rstrip()
    if len(body) == len(before):
        return SENTENCE if before[-1] in "。！？" else CLAUSE if before[-1] in "、，；：" else SEPARATOR
    gap = before[len(body) :]
    lines = gap.count("\n") or gap.count("\r") or gap.count("\u2028")
    if lines:
        return PARAGRAPH if lines > 1 else LINE
    body = body.rstrip(_CLOSERS)
    if body[-1:] in ("!", "?", "…"):
        return SENTENCE
    if body[-1:] == ".":
        word = body[:-1].rsplit(None, 1)[-1:] or [""]
        following = text[pos : pos + 1]
        return SENTENCE if len(word[0].strip("(„“«\"'")) > 2 and not following.islower() else BLANK
    return CLAUSE if body[-1:] in (",", ";", ":") else BLANK


@cache
def _joins(ch: str) -> str:
    """Which side of a character no cut may be made on: b(efore), a(fter), f(lag letters: between two of them)."""
    o = ord(ch)
    if 0x1F1E6 <= o <= 0x1F1FF:
        return "f"
    return "ba" if o == 0x200D else "b" if unicodedata.category(ch)[0] == "M" or 0x1F3FB <= o <= 0x1F3FF else ""


def _unsafe(window: str, begin: int, end: int) -> set[int]:
    """Places with begin < p <= end inside a combined character or a line end."""
    found: set[int] = set()
    for ch in set(window):
        if ch == "\r" or ch >= "\u0300" and _joins(ch):
            side, i = _joins(ch), window.find(ch)
            while i >= 0:
                if "b" in side:
                    found.add(i)
                if "a" in side or ch == "\r" and window[i + 1 : i + 2] == "\n" or side == "f" and i + 1 < len(window) and _joins(window[i + 1]) == "f":
                    found.add(i + 1)
                i = window.find(ch, i + 1)
    return {p for p in found if begin < p <= end}


def places(window: str, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Places p with begin < p <= end of a window, and their strengths; places no cut may be made at have -1."""
    at, levels = [], []
    for m in _PLACE.finditer(window, max(0, begin - 1)):
        a, p = m.span()
        if p > end:
            break
        if p > begin:  # a single blank after a letter or digit is the common case
            at.append(p)
            levels.append(BLANK if a and p - a == 1 and window[a] == " " and window[a - 1].isalnum() else _level(window, p, 0))
    places_, strengths = np.array(at, dtype=np.int64), np.array(levels, dtype=np.int8)
    if (not window.isascii() or "\r" in window) and (unsafe := _unsafe(window, begin, end)):
        bad = np.array(sorted(unsafe), dtype=np.int64)
        good = ~np.isin(places_, bad)
        places_, strengths = np.concatenate([places_[good], bad]), np.concatenate([strengths[good], np.full(len(bad), UNSAFE, np.int8)])
        order = np.argsort(places_)
        places_, strengths = places_[order], strengths[order]
    return places_, strengths


def runs(body: str) -> tuple[int, int, int]:
    """Lengths of the unspaced stretch at the start, of the longest one, and of the one at the end."""
    gaps = [m.start() for m in _SPACES.finditer(body)]
    if not gaps:
        return len(body), len(body), len(body)
    edges = np.array([-1, *gaps, len(body)])
    lengths = np.diff(edges) - 1
    return int(lengths[0]), int(lengths.max()), int(lengths[-1])


def effective_overlap(size: int, overlap: int | None) -> int:
    overlap = max(0, int(overlap or 0))
    return overlap if overlap < size else size // 3


class Folder:
    """Turns an item's places, fed in order, into pieces; holds no more places than one piece needs."""

    def __init__(self, size: int, overlap: int | None):
        self.size, self.overlap = int(size), effective_overlap(int(size), overlap)
        self.start, self.done = 0, False
        self.at, self.levels = np.zeros(0, np.int64), np.zeros(0, np.int8)
        self.longest = self.run = 0

    def feed(self, at: np.ndarray, levels: np.ndarray, known: int, edge_runs: tuple[int, int, int] = (0, 0, 0), length: int = 0) -> Iterator[tuple[int, int]]:
        """Add the places up to offset ``known``; yields the pieces that they settle."""
        head, most, tail = edge_runs
        self.longest = max(self.longest, self.run + head, most)
        self.run = self.run + length if head == length else tail
        self.at, self.levels = np.concatenate([self.at, at]), np.concatenate([self.levels, levels])
        while known - self.start > self.size:
            end = self._cut()
            yield self.start, end
            self.start = end - self.overlap
            keep = np.searchsorted(self.at, self.start)
            self.at, self.levels = self.at[keep:], self.levels[keep:]

    def end(self, total: int) -> Iterator[tuple[int, int]]:
        """The last piece."""
        if total > self.start:
            yield self.start, total

    def _cut(self) -> int:
        hi, first = self.start + self.size, self.start + self.overlap + 1
        middle = max(first, self.start + self.size // 2)
        for lo, up in ((middle, hi), (first, middle - 1)):
            a, b = np.searchsorted(self.at, lo), np.searchsorted(self.at, up, "right")
            best, where = 0, -1
            for k in range(b - 1, a - 1, -1):
                strength = int(self.levels[k])
                if strength > best:
                    best, where = strength, int(self.at[k])
                    if best == PARAGRAPH:
                        break
            if best > 0:
                return where
        unsafe = set(self.at[self.levels == UNSAFE].tolist())
        return next((p for p in range(hi, middle - 1, -1) if p not in unsafe), hi)


_TABLE = "key string, range_no bigint, size int, overlap int, last boolean, places binary, levels binary, head int, most int, tail int, length int"
_FOLDED = "key string, copies bigint, range_no bigint, range_begin bigint, first_no bigint, starts array<bigint>, ends array<bigint>, longest_run bigint"
#: Rows of ranges handed over at a time.
BATCH = 512


def _rows(columns: str, rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    names, held = [c.split()[0] for c in columns.split(", ")], []
    for r in rows:
        held.append(r)
        if len(held) >= BATCH:
            yield pd.DataFrame(held, columns=names)
            held = []
    yield pd.DataFrame(held, columns=names)


def _table(key: str, range_no: int, size: int, overlap: int | None, last: bool, pre: str, body: str, post: str) -> tuple:
    """Boundary table of one range between its halos; places are relative to its begin."""
    at, levels = places(pre + body + post, len(pre), len(pre) + len(body))
    return key, range_no, size, overlap, last, (at - len(pre)).astype(np.int32).tobytes(), levels.tobytes(), *runs(body), len(body)


def fold_tables(tables: DataFrame) -> DataFrame:
    """Pieces of every item, grouped by the range they begin in.

    Only boundary tables are shuffled; those of an item come in order to a fold whose whole state is the begin of the open piece.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _rows(_FOLDED, folded(batches))

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        key = None
        for b in batches:
            for r in b.itertuples(index=False):
                if r.key != key:
                    key, known, folder, begins, number = r.key, 0, Folder(r.size, None if pd.isna(r.overlap) else r.overlap), deque(), 0
                begins.append((known, r.range_no))
                at = np.frombuffer(r.places, np.int32).astype(np.int64) + known
                known += r.length
                pieces = list(folder.feed(at, np.frombuffer(r.levels, np.int8), known, (r.head, r.most, r.tail), r.length))
                pieces += folder.end(known) if r.last else ()
                while pieces:
                    while len(begins) > 1 and begins[1][0] <= pieces[0][0]:
                        begins.popleft()
                    n = next((i for i, p in enumerate(pieces) if len(begins) > 1 and p[0] >= begins[1][0]), len(pieces))
                    yield key, r.copies, begins[0][1], begins[0][0], number, [p[0] for p in pieces[:n]], [p[1] for p in pieces[:n]], max(folder.longest, folder.run)
                    number, pieces = number + n, pieces[n:]

    each = [F.first(c).alias(c) for c in ("size", "overlap", "last", "places", "levels", "head", "most", "tail", "length")]
    once = tables.repartition("key").groupBy("key", "range_no").agg(*each, F.count(F.lit(1)).alias("copies"))
    return once.sortWithinPartitions("key", "range_no").mapInPandas(fold, _FOLDED)


_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _items(df: DataFrame, key: str, text: str, size: Column, overlap: Column) -> DataFrame:
    """(id, key, text, size, overlap) of the rows that have pieces; ``key`` tells rows apart that differ."""
    x = df.select(F.col(key).alias("id"), F.col(text).alias("text"), size.cast("int").alias("size"), overlap.cast("int").alias("overlap")).where((F.length("text") > 0) & (F.col("size") > 0))
    return x.withColumn("key", F.to_json(F.struct(F.col("id").alias("k"), F.md5(F.col("text").cast("binary")).alias("t"), "size", "overlap"), _JSON))


def _id_of(items: DataFrame) -> Column:
    return F.from_json("key", f"k {items.schema['id'].dataType.simpleString()}", _JSON)["k"].alias("id")


def range_tables(items: DataFrame, range_chars: int = RANGE_CHARS) -> DataFrame:
    """Boundary tables of all ranges of (key, text, size, overlap); narrow."""

    def tabulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _rows(_TABLE, (
            _table(r.key, s // range_chars, r.size, r.overlap, s + range_chars >= len(r.text), r.text[max(0, s - HALO) : s], r.text[s : s + range_chars], r.text[s + range_chars : s + range_chars + HALO])
            for b in batches for r in b.itertuples(index=False) for s in range(0, len(r.text), range_chars)
        ))

    return items.select("key", "text", "size", "overlap").mapInPandas(tabulate, _TABLE)


def split_summary(df: DataFrame, key: str, text: str, size: Column, overlap: Column, range_chars: int = RANGE_CHARS) -> DataFrame:
    """(id, size, n_pieces, longest_run) of the items over their limit; the longest stretch is one without white space."""
    items = _items(df, key, text, size, overlap).where(F.length("text") > F.col("size"))
    parts = fold_tables(range_tables(items, range_chars)).groupBy("key").agg(F.sum(F.size("starts")).alias("n_pieces"), F.max("longest_run").alias("longest_run"))
    return parts.select(_id_of(items), F.get_json_object("key", "$.size").cast("int").alias("size"), "n_pieces", "longest_run")


def split_texts(df: DataFrame, key: str, text: str, size: Column, overlap: Column, range_chars: int = RANGE_CHARS) -> DataFrame:
    """(key, piece_no, begin, end, piece): the pieces of every item, cut out by offset."""
    items = _items(df, key, text, size, overlap)
    within = items.where(F.length("text") <= F.col("size")).select("id", F.lit(0).cast("bigint").alias("piece_no"), F.lit(0).cast("bigint").alias("begin"), F.length("text").cast("bigint").alias("end"), F.col("text").alias("piece"))
    over = items.where(F.length("text") > F.col("size"))

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each range with as much text after it as a piece that begins in it may need."""
        return _rows("key, range_no, window", ((r.key, s // range_chars, r.text[s : s + range_chars + r.size]) for b in batches for r in b.itertuples(index=False) for s in range(0, len(r.text), range_chars)))

    folded = fold_tables(range_tables(over, range_chars))
    seen = over.select("key", "text", "size").mapInPandas(windows, "key string, range_no bigint, window string").groupBy("key", "range_no").agg(F.first("window").alias("window"))
    x = folded.join(seen, ["key", "range_no"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    x = x.select("key", "range_begin", "first_no", "window", F.posexplode(F.arrays_zip("starts", "ends")).alias("i", "p"))
    begin, end = F.col("p.starts"), F.col("p.ends")
    piece = F.substring("window", (begin - F.col("range_begin") + 1).cast("int"), (end - begin).cast("int"))
    cut = x.select(_id_of(items), (F.col("first_no") + F.col("i")).alias("piece_no"), begin.alias("begin"), end.alias("end"), piece.alias("piece"))
    return within.unionByName(cut).withColumnRenamed("id", key)


def cuts(text: str, size: int, overlap: int | None) -> tuple[list[int], list[int], int]:
    """Starts and ends of the pieces of one text in memory, and its longest unspaced stretch; what the distributed forms must equal."""
    fold = Folder(size, overlap)
    pieces = [*fold.feed(*places(text, 0, len(text)), len(text), runs(text), len(text)), *fold.end(len(text))]
    return [a for a, _ in pieces], [b for _, b in pieces], max(fold.longest, fold.run)


@cache
def _opened(path: str):
    import pyarrow.fs

    system, name = pyarrow.fs.FileSystem.from_uri(re.sub(r"^(\w+):/(?!/)", r"\1:///", path if ":" in path else f"file://{os.path.abspath(path)}"))
    return system.open_input_file(name)


def read_at(path: str, offset: int, length: int) -> bytes:
    """Bytes of a file in a folder that all workers reach."""
    return _opened(path).read_at(length, offset)


def _whole_chars(raw: bytes, begin: int, end: int) -> tuple[str, str, str]:
    """Text before, in and after bytes begin..end, characters counted where they start."""
    lead = lambda i: next((j for j in range(i, min(i + 4, len(raw))) if raw[j] & 0xC0 != 0x80), len(raw))
    a, b, c = lead(0), lead(begin) if begin < len(raw) else len(raw), lead(end) if end < len(raw) else len(raw)
    return raw[a:b].decode("utf-8", "replace"), raw[b:c].decode("utf-8", "replace"), raw[c:].decode("utf-8", "ignore")


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    """(path, n_bytes) of all files under a folder; their contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("n_bytes"))


def split_files(files: DataFrame, range_bytes: int = RANGE_BYTES, read: Callable[[str, int, int], bytes] = read_at) -> DataFrame:
    """(path, piece_no, begin, end, piece) of UTF-8 files that no worker could hold; ``files`` has path, n_bytes, size, overlap.

    Ranges are spread over the cluster; a first pass lists each range's boundaries and its number of characters, the fold turns
    the numbers into offsets by a running sum, and a last pass reads each range once more to emit the pieces that begin in it.
    """
    listed = files.select("path", "n_bytes", F.col("size").cast("int").alias("size"), F.col("overlap").cast("int").alias("overlap")).where("n_bytes > 0 and size > 0")
    last_no = F.floor((F.col("n_bytes") - 1) / F.lit(int(range_bytes))).cast("bigint")
    ranges = listed.withColumn("range_no", F.explode(F.sequence(F.lit(0).cast("bigint"), last_no))).repartition("path", "range_no")
    halo = HALO * 4

    def table(r) -> tuple:
        s, e = r.range_no * range_bytes, min(r.n_bytes, (r.range_no + 1) * range_bytes)
        w0 = max(0, s - halo)
        pre, body, post = _whole_chars(read(r.path, w0, e - w0 + halo), s - w0, e - w0)
        return _table(r.path, r.range_no, r.size, r.overlap, e >= r.n_bytes, pre[-HALO:], body, post[:HALO])

    def tabulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _rows(_TABLE, (table(r) for b in batches for r in b.itertuples(index=False)))

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _rows("path, piece_no, begin, end, piece", emitted(batches))

    def emitted(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        have, text = None, ""
        for b in batches:
            for r in b.itertuples(index=False):
                s = r.range_no * range_bytes
                if have != (r.path, r.range_no):
                    _, body, post = _whole_chars(read(r.path, s, min(r.n_bytes - s, range_bytes + 4 * r.size + 4)), 0, range_bytes)
                    have, text = (r.path, r.range_no), body + post
                for i, (a, z) in enumerate(zip(r.starts, r.ends, strict=True)):
                    yield r.path, r.first_no + i, a, z, text[a - r.range_begin : z - r.range_begin]

    folded = fold_tables(ranges.mapInPandas(tabulate, _TABLE)).withColumnRenamed("key", "path").drop("copies", "longest_run")
    parts = folded.join(listed.select("path", "n_bytes", "size"), "path").repartition("path", "range_no").sortWithinPartitions("path", "range_no", "first_no")
    return parts.mapInPandas(emit, "path string, piece_no bigint, begin bigint, end bigint, piece string")
