"""Markdown, plain-text and file renderings as one text column per line, note or file."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.julian import event_date_text
from ..functions.text import deep_link, html_to_quote, note_name, strip, tag_name
from ..session import stored


def padded(c: Column, width: Column | int) -> Column:
    """``c`` with blanks up to ``width``; longer text stays whole."""
    w = F.lit(width) if isinstance(width, int) else width
    return F.concat(c, F.repeat(F.lit(" "), F.greatest(w - F.length(c), F.lit(0)).cast("int")))


def table_lines(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """(line_no, line) of a Markdown table; the header takes lines 0 and 1.

    The sorted rows are stored with their place in their part; the parts' lengths, one number each, give where they begin.
    """
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    spark = rows.sparkSession
    head = spark.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + " --- |" * len(columns))], "line_no bigint, line string")
    body = rows.select(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], cells.alias("line"))
    body = stored(body.orderBy(*[f"_o{i}" for i in range(len(order))]).select("line", F.monotonically_increasing_id().alias("_id")), "lines")
    part = F.shiftright("_id", 33)
    sizes = body.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    begins = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))
    body = body.withColumn("_p", part).join(begins, "_p").select((F.col("_b") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 2).alias("line_no"), "line")
    return head.unionByName(body)


def event_text(data: Column) -> Column:
    """``k: v, k: v`` of a map in its order."""
    return F.array_join(F.transform(F.map_entries(data), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), ", ")


def event_lines(events: DataFrame, length: int | None = None) -> DataFrame:
    """``events`` with ``line``: date padded to 24, text cut at ``length`` with three dots."""
    text = event_text(F.col("eventdata"))
    if length is not None:
        text = F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)
    return events.withColumn("line", F.concat(F.lit("| "), padded(event_date_text(F.col("jd_start"), F.col("jd_end")), 24), F.lit(" | "), text, F.lit(" |")))


def wrap(text: str, width: int) -> list[str]:
    """Lines of at most ``width``, broken at the last blank or hyphen of a line's second half, else at the width."""
    out, half = [], width // 2
    while len(text) > width:
        blank, hyphen = text.rfind(" ", half + 1, width + 1), text.rfind("-", half, width) + 1
        end = max(blank, hyphen) if max(blank, hyphen) > 0 else width
        out.append(text[:end])
        text = text[end + (end == blank) :]
    return [*out, text] if text or not out else out


def emphasise(line: str, words: list[str], mark: tuple[str, str] = ("**", "**")) -> str:
    """The first match of each word marked."""
    for w in words:
        at = line.lower().find(w.lower())
        if w and at >= 0:
            line = line[:at] + mark[0] + line[at : at + len(w)] + mark[1] + line[at + len(w) :]
    return line


def ascii_lines(events: DataFrame, width: int, words: list[str] | None = None) -> DataFrame:
    """``events`` with line_no and line: a date column as wide as the widest date, texts wrapped in the rest.

    The widest date is one number; widths below it plus 27 are an error.
    """
    x = stored(events.withColumns({"_date": event_date_text(F.col("jd_start"), F.col("jd_end")), "_text": event_text(F.col("eventdata"))}), "texts")
    widest = x.agg(F.max(F.length("_date")).alias("w")).first().w or 0
    if widest + 27 > width:
        raise ValueError(f"a width of {widest + 27} is needed")
    room, marks = width - widest - 7, [p for w in words or [] for p in w.strip("*").split("*") if p]

    @F.pandas_udf("array<string>")
    def lines(dates: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([[f"| {d if i == 0 else '':{widest}s} | {emphasise(t, marks):{room}s} |" for i, t in enumerate(wrap(s, room))] for d, s in zip(dates, texts, strict=True)], dtype=object)

    return x.withColumn("_l", lines("_date", "_text")).select(*[F.col(c) for c in events.columns], F.posexplode("_l").alias("line_no", "line"))


def _list(label: str, items: Column, each=strip) -> Column:
    rows = F.array_join(F.transform(items, lambda v: F.concat(F.lit("  - "), each(v), F.lit("\n"))), "")
    return F.when(F.size(items) > 0, F.concat(F.lit(f"{label}:\n"), rows)).otherwise("")


def book_notes(books: DataFrame, library: str = "") -> DataFrame:
    """(uuid, name, note): a Markdown note for each book with its front-matter, title, authors, link, cover and description."""
    t = lambda c: F.coalesce(F.col(c), F.lit(""))
    a = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    quote = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit("'")), F.lit('"'))
    same = lambda v: v
    line = lambda label, c: F.when(c != "", F.concat(F.lit(f"{label}: "), c, F.lit("\n"))).otherwise("")
    tags = F.concat(F.array(F.lit("Library/Calibre")), F.when(t("series") != "", F.array(F.concat(F.lit("Series/"), F.replace(t("series"), F.lit(" "), F.lit("_"))))).otherwise(F.array().cast("array<string>")), F.transform(a("subjects"), tag_name))
    head = F.concat(
        F.lit("---\ncreation: "), t("date_added"), F.lit("\ntitle: "), quote(t("title")), F.lit("\nuuid: "), t("uuid"), F.lit("\n"), _list("authors", a("creators"), same), _list("tags", tags, same),
        _list("formats", a("formats")), line("publication_date", t("publication_date")), _list("languages", a("languages")), _list("identifiers", a("identifiers")), line("calibre_id", t("calibre_id")),
        F.lit("title_sort: "), quote(t("title_sort")), F.lit("\n"), F.lit("publisher: "), quote(t("publisher")), F.lit("\ncontext: "), t("context"), F.lit("\n---\n"),
    )
    authors = F.array_join(F.transform(a("creators"), lambda c: F.concat(F.lit("[["), c, F.lit("]]"))), ", ")
    body = F.concat(
        F.lit("\n# "), t("title"), F.lit("\n\n_by "), F.array_join(a("creators"), ", "), F.lit("_\n\n"),
        F.when(t("calibre_id") != "", F.concat(F.lit("[Calibre-link]("), deep_link(F.lit(library), F.col("calibre_id")), F.lit(")\n\n"))).otherwise(""),
        F.when(t("cover") != "", F.concat(F.lit("!["), note_name(t("title")), F.lit("]("), t("cover"), F.lit(")\n\n"))).otherwise(""),
        F.when(t("description") != "", html_to_quote(t("description"))).otherwise(""), F.when(F.length(authors) > 3, F.concat(F.lit("\nAuthors: "), authors, F.lit("\n"))).otherwise(""),
    )
    return books.select("uuid", note_name(t("title")).alias("name"), F.concat(head, body).alias("note"))


def assemble_note(metadata: Column, body: Column) -> Column:
    """A note's text from its front-matter map and body; lists and maps come as JSON, which is YAML too."""

    @F.pandas_udf("string")
    def each(m: pd.Series, b: pd.Series) -> pd.Series:
        import yaml

        def one(x, y):
            if not x:
                return y
            data = {k: yaml.safe_load(v) if v and v[0] in "[{" else v for k, v in dict(x).items()}
            return f"---\n{yaml.safe_dump(data, allow_unicode=True, sort_keys=False)}---\n{y or ''}"

        return pd.Series([one(x, y) for x, y in zip(m, b, strict=True)], dtype=object)

    return each(metadata, body)


def clip_notes(clips: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(file, note): clips of each file in order under its header; clips whose sub-header a file already holds are left out.

    ``clips`` has file, md_file, title, author, warning, type, page, location, date, text and pos; ``existing`` file and content.
    """
    where = F.when(F.col("page").isNotNull(), F.concat(F.lit(" on page "), F.col("page"))).otherwise(F.concat(F.lit(" at location "), F.coalesce("location", F.lit(""))))
    sub = F.concat(F.lit("### "), F.col("type"), where, F.lit("\n\n"))
    ref = F.substring_index(F.regexp_replace(F.regexp_replace("md_file", "^.*/", ""), r"\.md$", ""), ",", 1)
    header = F.concat(F.lit("# Notes on "), F.col("title"), F.lit("\n\n_by "), F.coalesce("author", F.lit("")), F.lit("_\n\nsee [["), ref, F.lit("]]\n\n"), F.when(F.col("warning").isNotNull(), F.concat(F.lit("Warning: "), F.col("warning"), F.lit("\n\n"))).otherwise(""))
    entry = F.concat(sub, F.lit("_on "), F.coalesce(F.col("date").cast("string"), F.lit("")), F.lit(":_\n\n> "), F.coalesce("text", F.lit("")), F.lit("\n\n"))
    x = clips.select("file", "pos", header.alias("_h"), sub.alias("_s"), entry.alias("_e"))
    if existing is not None:
        x = x.join(existing.select("file", F.col("content").alias("_c")), "file", "left").where(F.col("_c").isNull() | ~F.contains("_c", F.col("_s")))
    else:
        x = x.withColumn("_c", F.lit(None).cast("string"))
    g = x.groupBy("file").agg(F.first("_c").alias("_c"), F.min_by("_h", "pos").alias("_h"), F.array_sort(F.collect_list(F.struct("pos", "_e"))).alias("_l"))
    return g.select("file", F.concat(F.coalesce("_c", "_h"), F.array_join(F.transform("_l", lambda s: s["_e"]), "")).alias("note"))


def write_files(plan: DataFrame, root: str, path: str = "path", content: str = "content", dry_run: bool = True) -> DataFrame:
    """Write one text file a row below a folder all workers mount; a dry run only returns (path, action)."""
    out = plan.select(F.col(path).alias("path"), F.lit("would write" if dry_run else "written").alias("action"))
    if not dry_run:

        def put(rows: Iterator) -> None:
            for r in rows:
                p = Path(root) / r[path]
                p.parent.mkdir(parents=True, exist_ok=True)
                p.write_text(r[content] or "")

        plan.select(path, content).foreachPartition(put)
    return out


def copy_files(plan: DataFrame, source_root: str, target_root: str, dry_run: bool = True, delete: bool = False) -> DataFrame:
    """Apply an export plan (path, src, action): new and changed files are copied, debris is removed only where ``delete`` is set."""
    acts = F.when(F.col("action").isin("new", "changed"), "copy").when((F.col("action") == "debris") & F.lit(delete), "delete").otherwise("none")
    out = plan.select("path", "src", acts.alias("step"))
    if not dry_run:
        import shutil

        def go(rows: Iterator) -> None:
            for r in rows:
                target = Path(target_root) / r.path
                if r.step == "copy":
                    target.parent.mkdir(parents=True, exist_ok=True)
                    shutil.copyfile(Path(source_root) / r.src, target)
                elif r.step == "delete":
                    target.unlink(missing_ok=True)

        out.where("step <> 'none'").foreachPartition(go)
    return out


def merge_metadata(old: Column, new: Column) -> Column:
    """A metadata map with new values over old ones."""
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)
