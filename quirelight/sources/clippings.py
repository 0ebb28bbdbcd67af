"""Clippings of an e-reader: text files of blocks with a title line, an info line and a text."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

SEPARATOR = "=========="
# The words of the device's files in each language, the first that fits counts.
LOCALES = {
    "en": {
        "start": "- Your ", "date": "Added on ", "location": "at location ", "page": " on page ", "rewrite": (),
        "types": {"Bookmark": "Bookmark", "Highlight": "Highlight", "Note": "Note"},
        "months": "January February March April May June July August September October November December",
    },
    "de": {
        "start": "- Deine ", "date": "Hinzugefügt am ", "location": "bei Position ", "page": " auf Seite ", "rewrite": (("Dein ", "Deine "),),
        "types": {"Lesezeichen": "Bookmark", "Markierung": "Highlight", "Notiz": "Note"},
        "months": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember",
    },
}


def read_clippings(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of all ``*.txt`` files below ``root``, byte-order marks removed."""
    x = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root, wholetext=True)
    return x.select(F.col("_metadata.file_path").alias("path"), F.replace("value", F.lit("\ufeff"), F.lit("")).alias("text"))


def locale_of(block: Column) -> Column:
    """The first language for which a line begins with its marker and holds its date marker and its location or page marker."""
    out = F.lit(None).cast("string")
    for name, w in reversed(list(LOCALES.items())):
        starts = {w["start"], *(w["start"].replace(b, a) for a, b in w["rewrite"])}

        def fits(line: Column, w: dict = w, starts: set = starts) -> Column:
            begins = F.lit(False)
            for s in starts:
                begins = begins | line.startswith(s)
            return begins & (F.locate(w["date"], line) > 1) & ((F.locate(w["location"], line) > 1) | (F.locate(w["page"], line) > 1))

        out = F.when(F.exists(F.split(block, "\r?\n"), _one_arg(fits)), name).otherwise(out)
    return out


def _one_arg(f):
    return lambda line: f(line)


def blocks(files: DataFrame, text: str = "text") -> DataFrame:
    """One row for each block that holds more than white space: the file's columns but the text, block_no and block."""
    x = files.select(*[c for c in files.columns if c != text], F.posexplode(F.split(F.col(text), SEPARATOR)).alias("block_no", "block"))
    return x.withColumn("block", strip("block")).where("block <> ''")


def first_clippings(files: DataFrame, n: int, text: str = "text") -> DataFrame:
    """The first ``n`` blocks of each file."""
    return blocks(files, text).where(F.col("block_no") < n)


def parse(clips: DataFrame, zone: str = "UTC") -> DataFrame:
    """Blocks with title, author, type, location, page, date (ISO, in UTC), text and error.

    ``zone`` is the device's; a block of an unknown language, or whose info line has another number of parts than two or three, has
    an error and null fields instead of ending the file.
    """
    lines = F.split("block", "\r?\n")
    x = clips.withColumn("_l", lines).withColumn("_k", F.coalesce(F.get(F.filter(F.transform(F.col("_l"), lambda s, i: F.when((F.trim(s) == "") | s.startswith("- "), i)), lambda i: i.isNotNull()), F.lit(0)), F.lit(-1)))
    # blank lines may stand between the header and the info line
    x = x.withColumn("_i", F.get(F.filter(F.transform(F.col("_l"), lambda s, i: F.when(s.startswith("- "), i)), lambda i: i.isNotNull()), F.lit(0)))
    head = F.array_join(F.slice("_l", F.lit(1), F.greatest(F.col("_k"), F.lit(0))), " ")
    info = strip(F.coalesce(F.get("_l", F.col("_i")), F.lit("")))
    x = x.withColumns({"_head": strip(head), "locale": locale_of(F.col("block")), "_text": strip(F.array_join(F.slice("_l", F.coalesce(F.col("_i"), F.lit(0)) + 2, F.size("_l")), "\n"))})
    word = lambda key: F.element_at(F.create_map(*chain.from_iterable((F.lit(n), F.lit(w[key])) for n, w in LOCALES.items())), F.col("locale"))
    for name, w in LOCALES.items():
        for a, b in w["rewrite"]:
            info = F.when(F.col("locale") == name, F.replace(info, F.lit(a), F.lit(b))).otherwise(info)
    x = x.withColumns({"_parts": F.split(info, r" \| "), **{f"_{k}": word(k) for k in ("start", "date", "location", "page")}})
    p = lambda i: strip(F.get("_parts", F.lit(i)))
    two, three = F.size("_parts") == 2, F.size("_parts") == 3
    at = F.contains(p(0), F.col("_location"))
    split_on = lambda c, sep, i: F.get(F.split(c, F.concat(F.lit(r"\Q"), sep, F.lit(r"\E"))), F.lit(i))
    no_start = lambda c: strip(F.replace(c, F.col("_start"), F.lit("")))
    kind = F.when(two & at, no_start(split_on(p(0), F.col("_location"), 0))).when(two | three, no_start(split_on(p(0), F.col("_page"), 0)))
    location = F.when(two & at, strip(split_on(p(0), F.col("_location"), 1))).when(three, strip(F.replace(p(1), F.col("_location"), F.lit(""))))
    page = F.when(two & ~at | three, strip(split_on(p(0), F.col("_page"), 1)))
    date = strip(F.replace(F.when(three, p(2)).otherwise(p(1)), F.col("_date"), F.lit("")))
    x = x.withColumns({"_kind": kind, "location": location, "page": page, "_d": date})
    months = F.element_at(F.create_map(*chain.from_iterable((F.lit(n), F.split(F.lit(w["months"]), " ")) for n, w in LOCALES.items())), F.col("locale"))
    rx = r"(?U)^\p{L}+,?\s+(\d{1,2})\.?\s+(\p{L}+)\s+(\d{4})\s+(\d{2}):(\d{2}):(\d{2})$"
    g = lambda k: F.regexp_extract("_d", rx, k)
    month = F.array_position(months, g(2))
    local = F.try_to_timestamp(F.concat_ws("-", g(3), F.lpad(month.cast("string"), 2, "0"), F.concat_ws(" ", F.lpad(g(1), 2, "0"), F.concat_ws(":", g(4), g(5), g(6)))), F.lit("yyyy-MM-dd HH:mm:ss"))
    # the session's zone reads and the device's zone shifts, so that the result depends on the device alone
    utc = F.to_utc_timestamp(F.from_utc_timestamp(F.to_utc_timestamp(local, F.current_timezone()), F.current_timezone()), zone)
    utc = F.date_format(F.to_utc_timestamp(utc, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+0000'")
    types = F.create_map(*chain.from_iterable((F.lit(a), F.lit(b)) for w in LOCALES.values() for a, b in w["types"].items()))
    open_at = F.length("_head") - F.locate("(", F.reverse("_head"))
    named = (F.contains("_head", F.lit("("))) & (open_at > 0)
    author = F.translate(strip(F.substring("_head", open_at + 1, F.length("_head"))), "()", "")
    comma = F.split(author, ",")
    author = F.when(F.size(comma) == 2, F.concat_ws(" ", strip(F.get(comma, F.lit(1))), strip(F.get(comma, F.lit(0))))).otherwise(author)
    error = F.when(F.col("locale").isNull(), "locale").when(~(two | three), "info line").when(local.isNull(), "date")
    keep = [c for c in clips.columns if c != "block"]
    x = x.withColumns({"title": F.when(named, strip(F.substring("_head", F.lit(1), open_at))).otherwise(F.col("_head")), "author": F.when(named, author), "type": F.coalesce(types[F.col("_kind")], F.col("_kind")), "date": utc, "error": error})
    ok = F.col("error").isNull()
    return x.select(*keep, "title", "author", *[F.when(ok, F.col(c)).alias(c) for c in ("type", "location", "page", "date")], F.when(ok, F.col("_text")).alias("text"), "locale", "error")
