"""Differences between what is and what should be, as plans of actions; nothing is deleted or written here."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEW, CHANGED, SAME, DEBRIS = "new", "changed", "unchanged", "debris"


def full_diff(wanted: DataFrame, present: DataFrame, key: list[str], value: list[str]) -> DataFrame:
    """(key, action): new, changed, unchanged, or debris (present only); nulls in values are equal."""
    w = wanted.select(*key, F.struct(*value).alias("_w"), F.lit(1).alias("_in"))
    p = present.select(*key, F.struct(*value).alias("_p"), F.lit(1).alias("_out"))
    action = F.when(F.col("_out").isNull(), NEW).when(F.col("_in").isNull(), DEBRIS).when(F.col("_w").eqNullSafe(F.col("_p")), SAME).otherwise(CHANGED)
    return w.join(p, key, "full_outer").select(*key, action.alias("action"))


def export_plan(docs: DataFrame, target: DataFrame, target_root: str = "") -> DataFrame:
    """(path, src, action) for documents (path, src, hash, hash_algo) against target files (path, hash, hash_algo).

    Hashes compare only if made by the same algorithm; files of another algorithm count as changed until hashed alike.
    """
    d = docs.select("path", "src", F.col("hash").alias("_h"), F.col("hash_algo").alias("_a"), F.lit(1).alias("_in"))
    t = target.select("path", F.col("hash").alias("_th"), F.col("hash_algo").alias("_ta"), F.lit(1).alias("_out"))
    same = (F.col("_h") == F.col("_th")) & F.col("_a").eqNullSafe(F.col("_ta"))
    action = F.when(F.col("_out").isNull(), NEW).when(F.col("_in").isNull(), DEBRIS).when(F.coalesce(same, F.lit(False)), SAME).otherwise(CHANGED)
    return d.join(t, "path", "full_outer").select(F.concat(F.lit(target_root), F.col("path")).alias("path"), "src", action.alias("action"))


def orphans(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``left`` without a partner."""
    return left.join(right.select(*key).distinct(), key, "left_anti")


def note_plan(entries: DataFrame, notes: DataFrame) -> DataFrame:
    """(uuid, name, old_name, action) for entries (uuid, name) against notes (uuid, name): keep, rename, create or orphan.

    An entry whose name is taken by a note of another uuid is not created again (blocked).
    """
    e, n = entries.select("uuid", F.col("name").alias("_e")), notes.select("uuid", F.col("name").alias("_n"))
    x = e.join(n, "uuid", "full_outer").join(notes.select(F.col("name").alias("_e")).distinct().withColumn("_taken", F.lit(True)), "_e", "left")
    action = F.when(F.col("_n").isNull(), F.when(F.col("_taken"), "blocked").otherwise("create")).when(F.col("_e").isNull(), "orphan").when(F.col("_e") == F.col("_n"), "keep").otherwise("rename")
    return x.select("uuid", F.coalesce("_e", "_n").alias("name"), F.col("_n").alias("old_name"), action.alias("action"))


def quoted(s: Column) -> Column:
    """A text as a literal pattern."""
    return F.regexp_replace(s, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")


def rename_links(notes: DataFrame, links: DataFrame, renames: DataFrame) -> DataFrame:
    """(path, content) of the notes that hold links to renamed titles, links rewritten with their aliases kept.

    ``notes`` has path and content, ``links`` path and target (lower case), ``renames`` old and new.  A note's renames are applied one
    after the other in order of the old title.
    """
    r = renames.withColumn("target", F.lower("old"))
    hit = links.join(r, "target").groupBy("path").agg(F.array_sort(F.collect_set(F.struct("old", "new"))).alias("_r"))
    step = lambda text, x: F.regexp_replace(text, F.concat(F.lit(r"(?i)\[\["), quoted(x["old"]), F.lit(r"(?=\]\]|\|)")), F.concat(F.lit("[["), F.regexp_replace(x["new"], r"([\\$])", r"\\$1")))
    return notes.join(hit, "path").select("path", F.aggregate("_r", F.col("content"), step).alias("content"))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def delete_plan(debris: DataFrame, path: str = "path", allowed: bool = False) -> DataFrame:
    """Rows of debris as actions: ``delete`` only where allowed, else ``report``."""
    return debris.select(F.col(path).alias("path"), F.lit("delete" if allowed else "report").alias("action"))


def vacuum_plan(files: DataFrame, kept_beside: DataFrame, titles: DataFrame, notes: DataFrame, folders: DataFrame, allowed: bool = False) -> DataFrame:
    """(kind, path, action) of what has lost its reason: ``delete`` only where allowed, else ``report``.

    ``files`` (path) are files of the target that no document claims; ``kept_beside`` (title, path) the reader's folders, of which those count whose title is none
    of ``titles`` (title); ``notes`` (path, action) a plan of notes, of which the orphans count; ``folders`` (path, n_entries) all folders, of which
    the empty ones count, unless their name begins with a dot.
    """
    hidden = F.element_at(F.split("path", "/"), -1).startswith(".")
    parts = [
        ("file", files), ("reader", orphans(kept_beside, titles, ["title"])), ("note", notes.where("action = 'orphan'")), ("folder", folders.where((F.col("n_entries") == 0) & ~hidden)),
    ]
    plans = [delete_plan(x, allowed=allowed).select(F.lit(kind).alias("kind"), "path", "action") for kind, x in parts]
    return functools.reduce(DataFrame.unionByName, plans)
