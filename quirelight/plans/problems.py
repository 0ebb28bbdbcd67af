"""Queries of the general data-pipeline problems over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import instants, snapshots
from ..session import table

DATE_FIELDS = ("publication_date", "date_added")
CONTENT = ["title", "creators", "series", "subjects", "languages", "publisher", "identifiers", "formats", "docs"]


def p1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All date texts of ``books`` with the zone and locale of their repository."""
    repos = table(spark, sf_dir, "repositories").select("repo_name", F.col("home_zone").alias("zone"), "locale")
    books = table(spark, sf_dir, "books").select("book_id", "repo_name", *DATE_FIELDS)
    each = books.select("book_id", "repo_name", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("raw")) for f in DATE_FIELDS])).alias("v")).select("book_id", "repo_name", "v.*")
    return each.where("raw is not null").join(repos, "repo_name", "left").drop("repo_name")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = p1_values(spark, sf_dir)
    out = instants.normalise(rows, instants.kept_at(spark))
    return out.where(F.col("epoch_us").isNotNull() & ~F.col("raw").rlike(instants.CANONICAL)).select("book_id", "field_name", "epoch_us")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lib_entries")
    return snapshots.snapshot_changes(
        e,
        table(spark, sf_dir, "repo_states"),
        group="repo_name",
        seq="sequence_number",
        key=snapshots.canonical_uuid(F.col("uuid")),
        content=snapshots.content_hash(e, CONTENT, {"docs": ["name", "size", "hash"]}),
        recency=["delivered_at", "row_id"],
    )


QUERIES = {"p1_found": p1_found, "p2_found": p2_found}

_LIST = "array_to_string(list_sort([x for x in coalesce({}, []) if coalesce(x, '') <> '']), chr(30))"
_DOC = "array_to_string(list_sort([coalesce(x.name, '') || chr(29) || coalesce(x.size::varchar, '') || chr(29) || coalesce(x.hash, '') for x in coalesce(docs, [])]), chr(30))"
ORACLES = {
    "p2_found": f"""
with k as (select repo_name, sequence_number, delivered_at, row_id, regexp_replace(regexp_replace(lower(uuid), '[\\s{{}}()-]', '', 'g'), '^(urn:)?(uuid:)?', '') as h,
  concat_ws(chr(31), coalesce(title, ''), {_LIST.format("creators")}, coalesce(series, ''), {_LIST.format("subjects")}, {_LIST.format("languages")}, coalesce(publisher, ''), {_LIST.format("identifiers")}, {_LIST.format("formats")}, {_DOC}) as c from lib_entries),
s as (select repo_name, sequence_number, h, arg_max(c, (delivered_at, row_id)) as c from k where regexp_full_match(h, '[0-9a-f]{{32}}') group by all),
p as (select repo_name, sequence_number as a, lead(sequence_number) over (partition by repo_name order by sequence_number) as b from (select distinct repo_name, sequence_number from repo_states) t),
n as (select s.repo_name, p.b as q, h, c from s join p on s.repo_name = p.repo_name and s.sequence_number = p.b), o as (select s.repo_name, p.b as q, h, c from s join p on s.repo_name = p.repo_name and s.sequence_number = p.a where p.b is not null)
select coalesce(n.repo_name, o.repo_name) as repo_name, coalesce(n.q, o.q) as sequence_number, regexp_replace(coalesce(n.h, o.h), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') as uuid,
  case when o.h is null then 'added' when n.h is null then 'removed' else 'changed' end as change_kind
from n full join o on n.repo_name = o.repo_name and n.q = o.q and n.h = o.h where n.c is distinct from o.c""",
}
