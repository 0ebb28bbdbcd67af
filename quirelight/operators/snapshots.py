"""What changed between consecutive full snapshots of keyed records.

Defined results: rows whose key is null, blank or no uuid do not count; of several rows with one key in one snapshot the
latest delivered counts (ties: the larger row id); a snapshot that the manifest lists but that has no rows removes all keys;
rows of snapshots the manifest does not list are ignored; the first snapshot gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical_uuid(c: Column) -> Column:
    """Lower-case 8-4-4-4-12 form of any notation; null if it holds no uuid."""
    h = F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[\s{}()-]", ""), "^(?:urn:)?(?:uuid:)?", "")
    cut = F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(h.rlike("^[0-9a-f]{32}$"), cut)


def _as_text(fields: list[str]) -> Callable[[Column], Column]:
    return lambda d: F.to_json(F.struct(*[F.coalesce(d[f].cast("string"), F.lit("")).alias(f) for f in fields]))


def content_hash(df: DataFrame, columns: list[str], struct_fields: dict[str, list[str]] | None = None) -> Column:
    """Hash of the columns in which list order, and null against empty, are no difference.

    ``struct_fields`` names the fields that count of a list of structs.
    """
    kinds, parts = dict(df.dtypes), []
    for c in columns:
        if struct_fields and c in struct_fields:
            fields = struct_fields[c]
            parts.append(F.array_sort(F.coalesce(F.transform(F.col(c), _as_text(fields)), F.array().cast("array<string>"))).alias(c))
        elif kinds[c].startswith("array"):
            parts.append(F.array_sort(F.filter(F.coalesce(F.col(c), F.array().cast(kinds[c])), lambda x: F.coalesce(x, F.lit("")) != "")).alias(c))
        else:
            parts.append(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c))
    return F.unhex(F.md5(F.to_json(F.struct(*parts))))


def neighbours(manifest: DataFrame, group: str, seq: str) -> DataFrame:
    """Pairs of neighbouring sequence numbers of each group; repeated manifest rows count once."""
    each = manifest.where(F.col(group).isNotNull() & F.col(seq).isNotNull()).groupBy(group, seq).agg(F.count(F.lit(1)).alias("_n"))
    return each.select(group, F.col(seq).alias("earlier"), F.lead(seq).over(Window.partitionBy(group).orderBy(seq)).alias("later")).where("later is not null")


def snapshot_changes(entries: DataFrame, manifest: DataFrame, *, group: str, seq: str, key: Column, content: Column, recency: list[str]) -> DataFrame:
    """(group, seq, uuid, change_kind) of every pair of neighbouring snapshots.

    Rows shrink to a key and a 16-byte hash in the scan; superseded rows are combined before the shuffle, so a key that is
    repeated in a third of the rows costs one row a task.  The keys spread even the largest group over all tasks.
    """
    slim = entries.select(F.col(group).alias("_g"), F.col(seq).alias("_s"), key.alias("_k"), content.alias("_h"), F.struct(*recency).alias("_at"))
    last = slim.where("_k is not null and _g is not null and _s is not null").groupBy("_g", "_s", "_k").agg(F.max_by("_h", "_at").alias("_h"))
    pairs = neighbours(manifest, group, seq).select(F.col(group).alias("_pg"), "earlier", "later")
    side = lambda mine, name: last.join(pairs, (F.col("_g") == F.col("_pg")) & (F.col("_s") == F.col(mine))).select(F.col("_g").alias(f"{name}g"), F.col("later").alias(f"{name}s"), F.col("_k").alias(f"{name}k"), F.col("_h").alias(f"{name}h"))
    new, old = side("later", "n"), side("earlier", "o")
    both = new.join(old, (F.col("ng") == F.col("og")) & (F.col("ns") == F.col("os")) & (F.col("nk") == F.col("ok")), "full_outer")
    kind = F.when(F.col("og").isNull(), "added").when(F.col("ng").isNull(), "removed").when(F.col("nh") != F.col("oh"), "changed")
    return both.select(F.coalesce("ng", "og").alias(group), F.coalesce("ns", "os").alias(seq), F.coalesce("nk", "ok").alias("uuid"), kind.alias("change_kind")).where("change_kind is not null")
