"""Markdown notes: files, front-matter, tables, links."""

from __future__ import annotations

import json
import re
import subprocess
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let, strip, table_domain

SKIPPED_DIRS = (".obsidian", "Templates", "Templater")
FRONT_MATTER = r"(?s)^---\n(?:(.*?)\n)??---(?:\n|$)"
LINK = r"\[\[(.*?)(?=\]\]|\|.*\]\])"
TABLES = "array<struct<columns:array<string>,rows:array<array<string>>,metadata:map<string,string>>>"


def read_notes(spark: SparkSession, root: str, skip: tuple[str, ...] = SKIPPED_DIRS) -> DataFrame:
    """(path, text, modified) of all ``*.md`` files below ``root`` outside the skipped folders; path is relative to ``root``."""
    x = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
    x = x.select(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("_p"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("modified"))
    base = root.removeprefix("file://").rstrip("/") + "/"
    x = x.withColumn("path", F.substring("_p", F.locate(base, F.col("_p")) + len(base), F.length("_p")))
    folders = F.split("path", "/")
    return x.where(~F.arrays_overlap(F.slice(folders, F.lit(1), F.size(folders) - 1), F.array(*map(F.lit, skip))) & ~F.element_at(folders, -1).startswith(".#")).select("path", "text", "modified")


def front_matter(text: Column) -> Column:
    """struct(front, body): the YAML between the first line ``---`` and the next one, and the rest with one more line feed.

    Without a first line ``---`` front is null; without the second one all text is front and the body a line feed.
    """

    def of(t: Column) -> Column:
        whole = F.regexp_extract(t, FRONT_MATTER, 0)
        rest = F.regexp_replace(F.substring(t, F.length(whole) + 1, F.length(t)), r"^\n+", "")
        opened = t.startswith("---\n") | (t == "---")
        return (
            F.when(whole != "", F.struct(F.regexp_extract(t, FRONT_MATTER, 1).alias("front"), F.concat(rest, F.lit("\n")).alias("body")))
            .when(opened, F.struct(F.substring(t, F.lit(5), F.length(t)).alias("front"), F.lit("\n").alias("body")))
            .otherwise(F.struct(F.lit(None).cast("string").alias("front"), F.concat(t, F.lit("\n")).alias("body")))
        )

    return let(text, of)


def yaml_map(front: Column) -> Column:
    """YAML as a map of text; lists and maps as JSON; broken YAML as an empty map, empty YAML as null."""

    @F.pandas_udf("map<string,string>")
    def each(s: pd.Series) -> pd.Series:
        import yaml

        def one(v):
            if v is None:
                return None
            try:
                got = yaml.safe_load(v)
            except yaml.YAMLError:
                return {}
            if got is None:
                return None
            if not isinstance(got, dict):
                return {}
            return {str(k): None if x is None else json.dumps(x, ensure_ascii=False, default=str) if isinstance(x, list | dict) else x.isoformat() if hasattr(x, "isoformat") else str(x) for k, x in got.items()}

        return s.map(one)

    return each(front)


def links(body: Column) -> Column:
    """Targets of the links of each line, trimmed and in lower case."""
    lines = F.split(body, "\n")
    return F.flatten(F.transform(lines, lambda x: F.transform(F.regexp_extract_all(x, F.lit(LINK), F.lit(1)), lambda t: F.lower(strip(t)))))


def link_edges(notes: DataFrame, key: str = "path", body: str = "body") -> DataFrame:
    """(key, target) of every link."""
    return notes.select(key, F.explode(links(F.col(body))).alias("target"))


def comment_metadata(line: str) -> dict[str, str]:
    """``k: v; k2: "v2"`` of an HTML comment."""
    out = {}
    for part in line.split("<!--", 1)[1].split("-->", 1)[0].split(";"):
        key, colon, value = part.strip().partition(":")
        if colon:
            value = value.strip()
            out[key.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] == '"' else value
    return out


def parse_tables(body: str) -> list[dict]:
    """Tables of a note: columns, rows and the metadata of the last comment before.

    A header that does not end in a pipe ends the note's parsing; a line after the header that is no separator ends the table, one that begins with a pipe
    but holds other signs only clears the columns; a row's last cell counts only if a pipe ends it; the line that ends a table is not looked at
    again; fences and ``$$`` blocks are skipped, up to a line that begins like them; tables without rows are left out.  Fences, blocks, tables and bad
    separators use up the comments before.  A formula on one line is no block, and a table may end with the text.
    """
    lines = [x.strip() for x in body.split("\n")]
    tables: list[dict] = []
    meta: dict[str, str] = {}
    cells = lambda s: [c.strip() for c in s[1:].split("|")][:-1]
    at = 0

    def take() -> str:
        """The next line; a comment in it replaces the metadata."""
        nonlocal at, meta
        line, at = lines[at], at + 1
        if "<!--" in line:
            meta = comment_metadata(line)
        return line

    while at < len(lines):
        line = take()
        block = next((m for m in ("```", "$$") if line.startswith(m)), None)
        if block and not (block == "$$" and len(line) > 3 and line.endswith("$$")):
            while at < len(lines) and not take().startswith(block):
                pass
            meta = {}
        elif line.startswith("|"):
            if not line.endswith("|"):
                return tables
            if at == len(lines):
                break
            below, columns, rows = take(), cells(line), []
            if not re.fullmatch(r"[| \-:><]*", below):
                columns, meta = [], {}
            if not below.startswith("|"):
                meta = {}
                continue
            while at < len(lines) and (row := take()).startswith("|"):
                rows.append(cells(row))
            if rows:
                tables.append({"columns": columns, "rows": rows, "metadata": meta})
            meta = {}
    return tables


def tables(body: Column) -> Column:
    """The tables of a note as a list."""

    @F.pandas_udf(TABLES)
    def each(s: pd.Series) -> pd.Series:
        return s.map(lambda v: [] if v is None else parse_tables(v))

    return each(body)


def table_rows(notes: DataFrame, root: str = "", key: str = "path", body: str = "body") -> DataFrame:
    """(key, table_no, columns, rows, metadata): every table with its domain, given or derived from the path and the second column."""
    x = notes.select(key, F.posexplode(tables(F.col(body))).alias("table_no", "t")).select(key, "table_no", "t.columns", "t.rows", "t.metadata")
    derived = table_domain(F.col(key), F.col("columns"), root)
    domain = F.create_map(F.lit("domain"), derived)
    return x.withColumn("metadata", F.when(F.map_contains_key("metadata", F.lit("domain")) | derived.isNull(), F.col("metadata")).otherwise(F.map_concat("metadata", domain)))


def complete_front_matter(notes: DataFrame, created: Column | None = None) -> DataFrame:
    """``notes`` (path, metadata) with uuid, creation and context filled in, and the number of changes.

    A note in ``Books`` takes its context from its first ``Series/`` tag; ``created`` overrides the file's time.
    """
    m = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise(".")
    tags = F.from_json(m["tags"], "array<string>")
    series = F.get(F.filter(tags, lambda t: t.startswith("Series/")), F.lit(0))
    context = F.when(m["context"].isNotNull() & (folder == "Books") & series.isNotNull(), F.concat(F.lit("Books/"), F.substring(series, F.lit(8), F.length(series)))).otherwise(folder)
    when = F.coalesce(created, F.col("modified")) if created is not None else F.col("modified")
    x = notes.withColumns({"_m": m, "_c": context, "_when": F.date_format(when, "yyyy-MM-dd'T'HH:mm:ssXXX")})
    lacks = lambda k: (F.col("_m")[k].isNull()).cast("int")
    changes = F.col("metadata").isNull().cast("int") + lacks("uuid") + lacks("creation") + (~F.col("_m")["context"].eqNullSafe(F.col("_c"))).cast("int")
    filled = F.map_concat(
        F.map_filter("_m", lambda k, v: ~k.isin("uuid", "creation", "context")),
        F.create_map(F.lit("uuid"), F.coalesce(F.col("_m")["uuid"], F.uuid()), F.lit("creation"), F.coalesce(F.col("_m")["creation"], F.col("_when")), F.lit("context"), F.col("_c")),
    )
    return x.withColumn("changes", changes).withColumn("metadata", filled).drop("_m", "_c", "_when")


def git_created(spark: SparkSession, root: str) -> DataFrame:
    """(path, created): when each file below a git work tree was first committed, by one walk through its history; empty outside of git."""
    folder = Path(root.removeprefix("file://"))
    walk = ["git", "-C", str(folder), "-c", "core.quotePath=false", "log", "--reverse", "--diff-filter=A", "--format=%x00%aI", "--name-only", "--relative"]
    done = subprocess.run(walk, capture_output=True, text=True, check=False) if (folder / ".git").exists() else None
    first: dict[str, str] = {}
    for commit in (done.stdout if done and not done.returncode else "").split("\0")[1:]:
        when, *names = [x for x in commit.split("\n") if x]
        for n in names:
            first.setdefault(n, when)
    return spark.createDataFrame(list(first.items()), "path string, created string").select("path", F.col("created").cast("timestamp").alias("created"))


def load_notes(spark: SparkSession, root: str, use_git: bool = False) -> DataFrame:
    """(path, title_key, uuid, metadata, body, tables, links, changes) of a folder of notes; creation times come from git where asked for."""
    x = read_notes(spark, root).withColumn("_f", front_matter(F.col("text")))
    x = x.join(git_created(spark, root), "path", "left") if use_git else x.withColumn("created", F.lit(None).cast("timestamp"))
    x = x.select("path", "modified", "created", yaml_map(F.col("_f.front")).alias("metadata"), F.col("_f.body").alias("body"))
    x = complete_front_matter(x, F.col("created"))
    title = F.lower(F.regexp_replace("path", r"^.*/|\.md$", ""))
    return x.select("path", title.alias("title_key"), F.col("metadata")["uuid"].alias("uuid"), "metadata", "body", tables(F.col("body")).alias("tables"), links(F.col("body")).alias("links"), "changes")

