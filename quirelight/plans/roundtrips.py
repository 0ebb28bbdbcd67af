"""Queries that write tables in the formats of the engine's sources, or build pages and notes of them, and read them back; each with the SQL of what must come out."""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import diff, search, timeline
from ..session import delete_at_end, shared_dir, table
from ..sinks import render, state
from ..sources import clippings, files, library, notes
from . import curated, pages
from .queries import query

_PLACES = "select *, lower(r_name) as region from nation join region on n_regionkey = r_regionkey"
_ISO = "strftime(o_orderdate, '%Y-%m-%d')"
_JD = "(date_diff('day', date '1970-01-01', o_orderdate::date) + 2440587.5)"


def _fresh(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted at the end."""
    path = f"{shared_dir(spark)}/quirelight/{name}-{uuid.uuid4().hex}"
    delete_at_end(spark, path)
    return path


def _written(spark: SparkSession, x: DataFrame, name: str) -> str:
    """The folder that holds the files (path, content) of ``x``."""
    root = _fresh(spark, name)
    render.write_files(x, root.removeprefix("file://"), dry_run=False)
    return root


def places(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.withColumn("region", F.lower("r_name"))


def dated_orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumn("iso", F.date_format("o_orderdate", "yyyy-MM-dd"))


# ---- folders


def place_notes(spark: SparkSession, d: str) -> DataFrame:
    """(path, content) of a note for each nation."""
    note = F.format_string(
        "---\nuuid: u-%s\ntags: [geo, %s]\n---\n# %s\n\nsee [[%s]] and [[ Atlas|the atlas ]]\n\n<!-- domain: places; rank: \"%s\" -->\n| Date | Event |\n| --- | :-: |\n| %s | founded |\n| %s | grew |\n\n```\n| Date | no |\n|-|-|\n| 1 | 2 |\n```\n| A |\n| - |\n| b |\n",
        "n_nationkey", "region", "n_name", "r_name", "n_nationkey", F.col("n_nationkey") + 1900, F.col("n_nationkey") + 1950,
    )
    return places(spark, d).select(F.concat("region", F.lit("/"), "n_name", F.lit(".md")).alias("path"), note.alias("content"))


@query(f"""
select region || '/' || n_name || '.md' as path, lower(n_name) as title_key, 'u-' || n_nationkey as uuid, region as context, '["geo", "' || region || '"]' as tags, 2 as n_tables, 'places' as domain, n_nationkey::varchar as rank,
  'founded,grew' as events, lower(r_name) || ',atlas' as links, 2 as changes from ({_PLACES})""")
def notes_folder(spark, d):
    """A folder of notes with front-matter, tables and links."""
    x = notes.load_notes(spark, _written(spark, place_notes(spark, d), "notes"))
    first, m = F.get("tables", F.lit(0)), F.col("metadata")
    return x.select("path", "title_key", "uuid", m["context"].alias("context"), m["tags"].alias("tags"), F.size("tables").alias("n_tables"), first["metadata"]["domain"].alias("domain"), first["metadata"]["rank"].alias("rank"), F.array_join(F.transform(first["rows"], lambda r: r[1]), ",").alias("events"), F.array_join("links", ",").alias("links"), "changes")


@query(f"""
select '{{lib}}' || region || '/' || n_name || '.md' as "desc", md5('# ' || n_name) as text_hash from ({_PLACES})""")
def corpus_folder(spark, d):
    """A folder of texts as a corpus for search."""
    x = places(spark, d).select(F.concat("region", F.lit("/"), "n_name", F.lit(".md")).alias("path"), F.concat(F.lit("# "), "n_name").alias("content"))
    return files.read_corpus(spark, _written(spark, x, "corpus"), "lib", ("txt", "md")).select("desc", F.md5("text").alias("text_hash"))


@query(f"select region || '/' || n_name || '.txt' as path, md5(n_name) as hash, 'md5' as hash_algo from ({_PLACES}) where n_nationkey % 5 <> 0")
def target_folder(spark, d):
    """The files of a target; hidden ones do not count."""
    hidden = F.when(F.col("n_nationkey") % 5 == 0, ".").otherwise("")
    x = places(spark, d).select(F.concat("region", F.lit("/"), hidden, "n_name", F.lit(".txt")).alias("path"), F.col("n_name").alias("content"))
    return library.read_target(spark, _written(spark, x, "target"), "md5")


@query(f"""
select n_name as title, region as series, ['Doe ' || n_nationkey] as creators, ['geo', region] as subjects, ['eng'] as languages, 'House ' || n_regionkey as publisher, ['isbn/' || n_nationkey] as identifiers, 'u' || n_nationkey as uuid, n_nationkey::varchar as calibre_id,
  '2001-02-03T04:05:06+00:00' as publication_date, '' as date_added, 'Books/' || region as context, n_name || ' - Doe ' || n_nationkey as short_title, ['txt'] as formats, n_name || '.txt' as doc, length(n_name)::bigint as size, md5(n_name) as hash, n_name as doc_text from ({_PLACES})""")
def library_folder(spark, d):
    """A library of metadata files and the documents beside them."""
    opf = F.format_string(
        "<package xmlns:dc=\"http://purl.org/dc/elements/1.1/\" xmlns:opf=\"http://www.idpf.org/2007/opf\"><metadata><dc:title>%s</dc:title><dc:creator opf:role=\"aut\">Doe %s</dc:creator><dc:creator opf:role=\"edt\">Roe</dc:creator><dc:subject>geo</dc:subject><dc:subject>%s</dc:subject><dc:language>eng</dc:language><dc:publisher>House %s</dc:publisher><dc:date>2001-02-03T04:05:06+02:00</dc:date>"
        "<dc:identifier opf:scheme=\"ISBN\">%s</dc:identifier><dc:identifier opf:scheme=\"uuid\" id=\"uuid_id\">u%s</dc:identifier><dc:identifier opf:scheme=\"calibre\" id=\"calibre_id\">%s</dc:identifier><meta name=\"calibre:series\" content=\"%s\"/><meta name=\"calibre:title_sort\" content=\"%s\"/></metadata></package>",
        "n_name", "n_nationkey", "region", "n_regionkey", "n_nationkey", "n_nationkey", "n_nationkey", "region", "n_name",
    )
    at = F.concat("region", F.lit("/"), "n_name", F.lit("/"))
    p = places(spark, d)
    x = p.select(F.concat(at, F.lit("metadata.opf")).alias("path"), opf.alias("content")).unionByName(p.select(F.concat(at, "n_name", F.lit(".txt")).alias("path"), F.col("n_name").alias("content")))
    b = library.load_library(spark, _written(spark, x, "library"), "md5", load_text=True)
    doc = F.get("docs", F.lit(0))
    lower_ids = F.transform("identifiers", F.lower)
    return b.select("title", "series", "creators", "subjects", "languages", "publisher", lower_ids.alias("identifiers"), "uuid", "calibre_id", "publication_date", "date_added", "context", "short_title", "formats", doc["name"].alias("doc"), doc["size"].alias("size"), doc["hash"].alias("hash"), "doc_text")


@query("select p_name as title, case when bool_or(p_partkey % 2 = 0) then ['epub', 'pdf'] else ['pdf'] end as formats from part where not contains(p_name, '/') group by p_name")
def sidecars(spark, d):
    """Folders that a reader keeps beside documents, by title."""
    p = table(spark, d, "part").where(~F.contains("p_name", F.lit("/")))
    kinds = F.explode(F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("epub"), F.lit("pdf"))).otherwise(F.array(F.lit("pdf"))))
    paths = p.select("p_name", kinds.alias("k")).select(F.concat(F.lit("Books/"), "p_name", F.lit(".sdr/metadata."), "k", F.lit(".lua")).alias("path"))
    return library.sidecars(paths.unionByName(p.select(F.concat(F.lit("Books/"), "p_name", F.lit(".epub")).alias("path"))))


_DE = "['Januar', 'Februar', 'März', 'April', 'Mai', 'Juni', 'Juli', 'August', 'September', 'Oktober', 'November', 'Dezember']"


@query("""
with o as (select *, o_orderkey % 3 as k from orders)
select o_orderkey, 'Order ' || o_orderkey as title, 'Ann Clerk' as author, case k when 0 then 'Highlight' when 1 then 'Bookmark' else 'Note' end as type, case k when 0 then o_custkey || '-' || (o_custkey + 1) when 1 then o_custkey::varchar end as location,
  case k when 0 then null else (o_orderkey % 500)::varchar end as page, strftime(o_orderdate, '%Y-%m-%d') || 'T0' || (o_orderkey % 10) || ':30:15+0000' as date, o_orderpriority as text, case k when 1 then 'de' else 'en' end as locale from o""")
def clippings_files(spark, d):
    """Files of clippings in two languages and three layouts, one for each priority, read back field by field."""
    k, day = F.col("o_orderkey") % 3, F.dayofmonth("o_orderdate")
    clock = F.concat(F.lit("0"), F.col("o_orderkey") % 10, F.lit(":30:15"))
    german = F.element_at(F.array(*[F.lit(m) for m in clippings.LOCALES["de"]["months"].split()]), F.month("o_orderdate"))
    english = F.concat_ws(" ", F.date_format("o_orderdate", "EEEE,"), day, F.date_format("o_orderdate", "MMMM yyyy"), clock)
    info = (
        F.when(k == 0, F.concat(F.lit("- Your Highlight at location "), F.col("o_custkey"), F.lit("-"), F.col("o_custkey") + 1, F.lit(" | Added on "), english))
        .when(k == 1, F.concat(F.lit("- Dein Lesezeichen auf Seite "), F.col("o_orderkey") % 500, F.lit(" | bei Position "), F.col("o_custkey"), F.lit(" | Hinzugefügt am "), F.concat_ws(" ", F.lit("Montag,"), F.concat(day, F.lit(".")), german, F.year("o_orderdate"), clock)))
        .otherwise(F.concat(F.lit("- Your Note on page "), F.col("o_orderkey") % 500, F.lit(" | Added on "), english))
    )
    block = F.concat(F.lit("Order "), "o_orderkey", F.lit(" (Clerk, Ann)\n"), info, F.lit("\n\n"), "o_orderpriority", F.lit("\n"))
    x = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("p")).agg(F.concat(F.lit("﻿"), F.array_join(F.array_sort(F.collect_list(block)), "==========\n")).alias("content"))
    root = _written(spark, x.select(F.concat("p", F.lit(".txt")).alias("path"), "content"), "clippings")
    c = clippings.parse(clippings.blocks(clippings.read_clippings(spark, root)))
    return c.select(F.substring_index("title", " ", -1).cast("bigint").alias("o_orderkey"), "title", "author", "type", "location", "page", "date", "text", "locale")


@query("select o_orderpriority as p, 3::bigint as n from orders group by 1 having count(*) >= 3")
def first_clippings(spark, d):
    """The first three clippings of each file."""
    x = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("p")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("Order "), "o_orderkey"))), "\n==========\n").alias("text"))
    return clippings.first_clippings(x, 3).groupBy("p").agg(F.count(F.lit(1)).alias("n")).where("n = 3")


# ---- states


@query("select n_nationkey, n_name || '!' as n_name, 2::bigint as sequence_number, 2::bigint as listed from nation")
def state_versions(spark, d):
    """Two snapshots of a state and the newest read back; a writer that expects the first is refused."""
    n, root = table(spark, d, "nation").select("n_nationkey", "n_name"), _fresh(spark, "state")
    first = state.save_state(n, root)
    state.save_state(n.withColumn("n_name", F.concat("n_name", F.lit("!"))), root, expected=first)
    try:
        state.save_state(n, root, expected=first)
    except RuntimeError:
        pass
    manifest = files.read_json(spark, f"{root}/manifest", state.MANIFEST)
    return state.load_state(spark, root).withColumns({"sequence_number": F.lit(state.last_state(spark, root)[0]).cast("bigint"), "listed": F.lit(manifest.count()).cast("bigint")})


@query("select vec_id, label, 'index/model=a-b' as folder from embeddings")
def saved_index(spark, d):
    """Vectors kept under their model's folder."""
    root = f"{_fresh(spark, 'vectors')}/index"
    path = state.save_index(table(spark, d, "embeddings").select("vec_id", "label"), root, "a/b")
    return spark.read.parquet(path).select("vec_id", "label", F.lit("/".join(path.split("/")[-2:])).alias("folder"))


@query("""
select desc_key as "desc", case when entry_id % 3 = 0 then 'hit' else 'read' end as action from (select desc_key, max(entry_id) as entry_id from text_entries group by 1)""")
def text_cache(spark, d):
    """Files whose text is cached for their size, and those still to read."""
    f = table(spark, d, "text_entries").groupBy(F.col("desc_key").alias("desc")).agg(F.max("entry_id").alias("file_size"))
    path = _fresh(spark, "cache")
    state.save_text_cache(f.select("desc", F.when(F.col("file_size") % 3 == 0, F.col("file_size")).otherwise(F.col("file_size") + 1).alias("file_size"), F.lit("x").alias("text")), path)
    hits, rest = search.cached_texts(f, spark.read.parquet(path))
    return hits.select("desc", F.lit("hit").alias("action")).unionByName(rest.select("desc", F.lit("read").alias("action")))


# ---- tables of notes and events


def order_notes(spark: SparkSession, d: str) -> DataFrame:
    """(path, body, c) of a note for each customer with a dated table of the orders."""
    k = F.col("o_orderkey")
    day = F.when(k % 11 == 0, "unknown").when(k % 13 == 0, F.concat("iso", F.lit(" - 1900"))).when(k % 17 == 0, ":---").otherwise(F.col("iso"))
    row = F.concat(F.lit("| "), day, F.lit(" | "), "o_orderstatus", F.lit(" | "), k.cast("string"), F.lit(" |"))
    g = dated_orders(spark, d).groupBy(F.col("o_custkey").alias("c")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("r")))).alias("l"))
    body = F.concat(F.lit("# Orders\n<!-- domain: orders/"), "c", F.lit(" -->\n| Date | Status | Key |\n|---|---|---|\n"), F.array_join(F.transform("l", lambda x: x["r"]), "\n"), F.lit("\n\n<!-- domain: lost -->\n$$\nx\n$$\n| Date | Sum |\n|--|--|\n| 1998 | "), F.size("l"), F.lit(" |\n"))
    return g.select(F.concat(F.lit("Sales Notes/"), F.col("c").cast("string"), F.lit(".md")).alias("path"), body.alias("body"), "c")


@query("""
with c as (select o_custkey as c, count(*)::int as n from orders group by 1)
select 'Sales Notes/' || c || '.md' as path, 0 as table_no, 3 as n_columns, n as n_rows, 'orders/' || c as domain from c union all select 'Sales Notes/' || c || '.md', 1, 2, 1, 'Sales_Notes/' || c || '/Sum' from c""")
def table_rows(spark, d):
    """Tables of notes with given domains, and with domains derived from path and columns."""
    t = notes.table_rows(order_notes(spark, d))
    return t.select("path", "table_no", F.size("columns").alias("n_columns"), F.size("rows").alias("n_rows"), F.col("metadata")["domain"].alias("domain"))


_EVENTS = f"""
with o as (select o_custkey * 10 as table_id, row_number() over (partition by o_custkey order by o_orderkey)::int - 1 as pos, o_orderkey as k, o_orderstatus as s, {_JD} as jd,
  case when o_orderkey % 11 = 0 then 'date' when o_orderkey % 13 = 0 then 'reversed' when o_orderkey % 17 = 0 then 'header' end as bad from orders),
v as (select *, max(case when bad is null then jd end) over (partition by table_id order by pos rows between unbounded preceding and 1 preceding) as before from o),
e as (select table_id, pos::int as pos, case when bad is null or bad = 'reversed' then jd end as jd_start, 'Status: ' || s || ', Key: ' || k as event, coalesce(bad, case when jd < before then 'order' end) as skip_reason from v)"""


def order_events(spark: SparkSession, d: str) -> DataFrame:
    n = order_notes(spark, d)
    t = n.select("path", "c").join(notes.table_rows(n), "path").withColumn("table_id", F.col("c") * 10 + F.col("table_no")).where("table_no = 0")
    return timeline.table_events(t)


@query(f"{_EVENTS} select table_id, pos, jd_start, event, 'orders/' || (table_id // 10) as domain, skip_reason from e")
def note_events(spark, d):
    """Dated tables as events, with the reason for each row that is left out."""
    e = order_events(spark, d)
    return e.select("table_id", "pos", "jd_start", render.event_text(F.col("eventdata")).alias("event"), F.col("metadata")["domain"].alias("domain"), "skip_reason")


@query(f"{_EVENTS} select coalesce(skip_reason, 'added') as outcome, count(*) as n from e group by 1")
def event_outcomes(spark, d):
    """Events added, and left out by reason."""
    return timeline.event_counts(order_events(spark, d))


@query(f"{_EVENTS} select table_id, pos, (row_number() over (partition by table_id order by jd_start, pos))::int as place from e where skip_reason is null or skip_reason = 'order'")
def proposed_places(spark, d):
    """Where each dated row belongs in its table's proposed order."""
    from pyspark.sql import Window

    e = timeline.proposed_order(order_events(spark, d).where("skip_reason is null or skip_reason = 'order'"))
    w = Window.partitionBy("table_id").orderBy("jd_start", F.coalesce("jd_end", "jd_start"), "pos")
    return e.select("table_id", "pos", F.row_number().over(w).cast("int").alias("place"))


@query(f"""
select o_orderkey, 'inside' as time_class from orders where o_orderdate >= timestamp '1997-01-01' and o_orderdate::date < date '1998-01-01' and o_orderstatus = 'F' and o_orderpriority not like '%LOW%' and 'x/' || lower(o_orderpriority) like '%urgent%'""")
def timeline_specs(spark, d):
    """The command line's query by time, domain and keywords."""
    from ..functions import julian

    o = dated_orders(spark, d).withColumns({"jd_start": julian.timestamp_to_jd(F.date_trunc("day", "o_orderdate")), "jd_end": F.lit(None).cast("double"), "eventdata": F.create_map(F.lit("state"), F.col("o_orderstatus"), F.lit("kind"), F.col("o_orderpriority")), "metadata": F.create_map(F.lit("domain"), F.concat(F.lit("x/"), F.lower("o_orderpriority")))})
    return timeline.timeline(o, "1997-01-01 - 1997-12-31", "urgent", "F !low").select("o_orderkey", "time_class")


@query("""
with o as (select row_number() over (order by o_orderkey) + 1 as line_no, '| ' || o_orderkey || ' | ' || o_orderstatus || ' |' as line from orders)
select line_no, line from o union all select 0, '| o_orderkey | o_orderstatus |' union all select 1, '| --- | --- |'""")
def table_lines(spark, d):
    """A table as numbered lines of Markdown."""
    return render.table_lines(table(spark, d, "orders").repartition(7), ["o_orderkey", "o_orderstatus"], ["o_orderkey"])


@query(f"""
with o as (select o_orderkey, 'k: ' || rtrim(repeat(repeat(o_orderstatus, 3) || ' ', (o_orderkey % 30 + 1)::int)) as t, case when month(o_orderdate) = 1 and day(o_orderdate) = 1 then strftime(o_orderdate, '%Y') when day(o_orderdate) = 1 then strftime(o_orderdate, '%Y-%m') else {_ISO} end as d from orders),
l as (select *, unnest(range(case when length(t) <= 43 then 1 else 1 + ((length(t) - 43 + 43) // 44) end)) as i from o),
s as (select *, case when length(t) <= 43 then t when i = 0 then substring(t, 1, 42) else substring(t, (44 + (i - 1) * 44)::int, 43) end as p from l)
select o_orderkey, i::int as line_no, '| ' || rpad(case when i = 0 then d else '' end, 10, ' ') || ' | ' || rpad(p, 43, ' ') || ' |' as line from s""")
def wrapped_events(spark, d):
    """Events as plain text wrapped to a width."""
    from ..functions import julian

    words = F.rtrim(F.repeat(F.concat(F.repeat("o_orderstatus", F.lit(3)), F.lit(" ")), (F.col("o_orderkey") % 30 + 1).cast("int")))
    u = table(spark, d, "orders").withColumns({"jd_start": julian.timestamp_to_jd(F.date_trunc("day", "o_orderdate")), "jd_end": F.lit(None).cast("double"), "eventdata": F.create_map(F.lit("k"), words)})
    return render.ascii_lines(u, 60).select("o_orderkey", "line_no", "line")


@query(f"""
select 'c' || o_custkey as file, '# Notes on T' || o_custkey || chr(10) || chr(10) || '_by A_' || chr(10) || chr(10) || 'see [[Book ' || o_custkey || ']]' || chr(10) || chr(10) ||
  string_agg('### Note' || case when o_orderkey % 2 = 0 then ' on page ' || o_orderkey else ' at location ' || o_orderkey end || chr(10) || chr(10) || '_on ' || {_ISO} || ':_' || chr(10) || chr(10) || '> ' || o_orderpriority || chr(10) || chr(10), '' order by o_orderkey) as note from orders group by o_custkey""")
def clip_notes(spark, d):
    """Notes of clippings, one for each customer."""
    k = F.col("o_orderkey").cast("string")
    even = F.col("o_orderkey") % 2 == 0
    c = dated_orders(spark, d).select(
        F.concat(F.lit("c"), "o_custkey").alias("file"), F.concat(F.lit("x/Book "), "o_custkey", F.lit(", more.md")).alias("md_file"), F.concat(F.lit("T"), "o_custkey").alias("title"), F.lit("A").alias("author"), F.lit(None).cast("string").alias("warning"),
        F.lit("Note").alias("type"), F.when(even, k).alias("page"), F.when(~even, k).alias("location"), F.col("iso").alias("date"), F.col("o_orderpriority").alias("text"), F.col("o_orderkey").alias("pos"),
    )
    return render.clip_notes(c)


_Q = "'\"' || replace(coalesce({}, ''), '\"', '''') || '\"'"
_L = "case when len(coalesce({0}, [])) > 0 then '{1}:' || chr(10) || list_aggregate([('  - ' || regexp_replace(x, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') || chr(10)) for x in {0}], 'string_agg', '') else '' end"


@query(f"""
select book_id, md5('---' || chr(10) || 'creation: ' || coalesce(date_added, '') || chr(10) || 'title: ' || {_Q.format("title")} || chr(10) || 'uuid: ' || coalesce(uuid, '') || chr(10)
  || case when len(coalesce(creators, [])) > 0 then 'authors:' || chr(10) || list_aggregate([('  - ' || x || chr(10)) for x in creators], 'string_agg', '') else '' end) as head from books""")
def book_notes(spark, d):
    """The beginnings of the books' notes, up to the authors."""
    b = table(spark, d, "books")
    n = render.book_notes(b.withColumn("uuid", F.concat(F.col("book_id").cast("string"), F.lit(" "), F.coalesce("uuid", F.lit("")))), "Library")
    key = F.substring_index("uuid", " ", 1)
    head = F.substring_index("note", "tags:\n", 1)
    return n.select(key.cast("bigint").alias("book_id"), F.md5(F.replace(head, F.concat(F.lit("uuid: "), key, F.lit(" ")), F.lit("uuid: "))).alias("head"))


@query("select path, case action when 'new' then 'copy' when 'changed' then 'copy' when 'debris' then 'delete' else 'none' end as step from (select c_custkey::varchar as path, case when c_custkey % 4 = 0 then 'new' when c_custkey % 4 = 1 then 'changed' when c_custkey % 4 = 2 then 'debris' else 'unchanged' end as action from customer)")
def copy_steps(spark, d):
    """What applying a plan would do."""
    k = F.col("c_custkey") % 4
    plan = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.lit("s").alias("src"), F.when(k == 0, diff.NEW).when(k == 1, diff.CHANGED).when(k == 2, diff.DEBRIS).otherwise(diff.SAME).alias("action"))
    return render.copy_files(plan, "", "", dry_run=True, delete=True).select("path", "step")


@query("select c_custkey::varchar as path, 'report' as action from customer")
def delete_reports(spark, d):
    """Debris is only reported where deleting is not allowed."""
    return diff.delete_plan(table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path")))


# ---- search


def letters(texts: list[str]) -> list[list[float]]:
    """An encoder whose vectors SQL can work out too: how often e and a occur."""
    return [[float(t.count("e")), float(t.count("a"))] for t in texts]


_CHUNKS = """
with t as (select desc_key as d, max_by(text, entry_id) as x from text_entries where text is not null group by 1),
c as (select d, x, unnest(range((length(x) - 1) // 448 + 1)) as i from t where length(x) > 0),
s as (select d, x, i, length(substring(x, (i * 448 + 1)::int, 512)) - length(replace(substring(x, (i * 448 + 1)::int, 512), 'e', '')) as e from c)"""


def _latest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "text_entries").where("text is not null").groupBy(F.col("desc_key").alias("desc")).agg(F.max_by("text", "entry_id").alias("text"))


@query(f"""{_CHUNKS}, b as (select * from s order by e desc, d, i limit 5), g as (select *, i - row_number() over (partition by d order by i) as island from b)
select d as "desc", min(i)::int as first_chunk, count(*) as n_chunks, max(e)::double as cosine, substring(x, (min(i) * 448 + 1)::int, (512 + (count(*) - 1) * 448)::int) as text from g group by d, x, island""")
def semantic_search(spark, d):
    """Entries chunked, embedded, searched, merged and cut to text spans."""
    t = _latest(spark, d)
    index = search.embed(search.chunk(t, "text", 512, 64), letters).select("desc", "chunk_no", "embedding")
    return search.search(index, t, [1.0, 0.0], 512, 64, 5)


@query("""
with t as (select doc_id, text, unnest(range(0, length(text), 4)) as a from documents where length(text) > 0),
w as (select doc_id, a, substring(text, (greatest(0, least(a - 8, length(text) - 16)) + 1)::int, 16) as w from t)
select doc_id, list((length(w) - length(replace(w, 'e', '')))::int order by a) as yellow_liner from w group by doc_id""")
def highlights(spark, d):
    """How well each place of a text fits a query."""
    h = search.highlight(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"], "text", [1.0, 0.0], letters)
    return h.select("doc_id", F.transform("yellow_liner", lambda x: x.cast("int")).alias("yellow_liner"))


@query("""
with t as (select desc_key as d, max_by(text, struct_pack(a := indexed_at, b := entry_id)) as x from text_entries group by 1)
select d as "desc", ((length(x) - 1) // 448 + 1)::bigint as n, 0::bigint as not_whole from t where length(x) > 0""")
def index_update(spark, d):
    """An index of the first versions brought up to the latest: chunks a document, and documents that are not whole."""
    t, at = table(spark, d, "text_entries"), F.struct("indexed_at", "entry_id")
    side = lambda pick: t.groupBy(F.col("desc_key").alias("desc")).agg(pick(F.struct("text"), at)["text"].alias("text"))
    hashed = lambda x: x.select("desc", F.md5(F.coalesce("text", F.lit(""))).alias("text_hash"))
    old, new = side(F.min_by), side(F.max_by)
    index = search.embed(search.chunk(old, "text", 512, 64), letters).select("desc", "chunk_no", "embedding")
    now = search.update_index(index, search.index_changes(hashed(old), hashed(new)), new, letters, 512, 64)
    wrong = search.index_is_whole(now, new, 512, 64).agg(F.count(F.lit(1)).alias("not_whole"))
    return now.groupBy("desc").agg(F.count(F.lit(1)).alias("n")).join(wrong, F.lit(True))


# ---- pages

_ROWS = f"(o_orderkey % 3) * {pages.TABLE_ROWS} + o_orderkey // 3"


def page_rows(spark: SparkSession, d: str, *cells) -> DataFrame:
    """Orders as the rows of three tables of a page."""
    return dated_orders(spark, d).select((F.col("o_orderkey") % 3).cast("int").alias("table_idx"), F.floor(F.col("o_orderkey") / 3).cast("int").alias("row_idx"), F.array(*[c.cast("string") for c in cells]).alias("cells"))


@query(f"select {_ROWS} as pos, {_ISO} as date, 'order ' || o_orderkey || ', ' || o_orderstatus as event, {_JD} as jd_start, o_orderpriority as kind from orders where o_orderkey % 3 < 2")
def page_timeline(spark, d):
    """Tables of year, day and text as a timeline, with a further column."""
    rows = page_rows(spark, d, F.year("o_orderdate"), F.date_format("o_orderdate", "MMMM d"), F.concat(F.lit("order "), F.col("o_orderkey"), F.lit("[3]")), F.col("o_orderstatus"), F.col("o_orderpriority"))
    p = pages.Page(tables=((0, 1),), rest=1, text=(2, 3), kept={"kind": 4}, order="time")
    return pages.build(rows, p).select("pos", "date", "event", "jd_start", "kind")


@query(f"""
with o as (select *, {_ISO} as iso, o_orderkey % 5 = 0 as lacks from orders where o_orderkey % 3 = 1),
f as (select o_orderkey, lacks, last_value(case when not lacks then iso end ignore nulls) over w as d, last_value(case when not lacks then o_orderkey end ignore nulls) over w as k from o window w as (order by o_orderkey))
select {_ROWS} as pos, d as date, case when lacks then '<NA>, date from previous table entry t' || k || ' used!' else '' end as remark from f""")
def page_filled(spark, d):
    """Missing dates taken from the row before."""
    rows = page_rows(spark, d, F.when(F.col("o_orderkey") % 5 != 0, F.col("iso")), F.concat(F.lit("t"), F.col("o_orderkey")))
    return pages.build(rows, pages.Page(tables=((1, 1),), fill=True)).select("pos", "date", "remark")


@query(f"""
with o as (select {_ROWS} as pos, (o_custkey + 20) * case when o_orderkey % 3 = 2 then 1000 else 1 end as v from orders)
select pos, case when v >= 1000000 then regexp_replace(printf('%.3f', v / 1000000.0), '\\.?0+$', '') || ' Ga BP' when v >= 1000 then regexp_replace(printf('%.3f', v / 1000.0), '\\.?0+$', '') || ' Ma BP' else v || ' ka BP' end as date from o""")
def page_ages(spark, d):
    """Bare numbers as ages, in another unit from the third table on."""
    rows = page_rows(spark, d, F.col("o_custkey") + 20, F.lit("x"))
    return pages.build(rows, pages.Page(tables=((0, 2),), scale="kya BP", factor=1000.0, factor_from=2, order="reverse")).select("pos", "date")


@query(f"""
with x(raw, d, r) as (values ('1-URGENT', '1100', 'by hand'), ('2-HIGH', '1200', 'guessed'), ('3-MEDIUM', '1300', 'guessed'), ('4-NOT SPECIFIED', '1400', 'guessed'), ('5-LOW', '1500', 'by hand'))
select {_ROWS} as pos, d as date, r as remark, 'Date: ' || r || ', k' || o_orderkey as event from orders join x on o_orderpriority = raw""")
def curated_dates(spark, d):
    """Dates that a page's table of exceptions settles before the rules do."""
    known = {"1-URGENT": ("1100", "by hand"), "2-HIGH": ("1200", "guessed"), "3-MEDIUM": ("1300", "guessed"), "4-NOT SPECIFIED": ("1400", "guessed"), "5-LOW": ("1500", "by hand")}
    rows = page_rows(spark, d, F.col("o_orderpriority"), F.concat(F.lit("k"), F.col("o_orderkey")))
    return pages.build(rows, pages.Page(tables=((0, 2),), curated=known)).select("pos", "date", "remark", "event")


@query(f"""
with o as (select {_ROWS} as pos, strftime(o_orderdate, '%Y') as date, o_orderstatus as event from orders), p as (select *, lag(event) over (partition by date order by pos) as b from o)
select pos, date, event from p where b is distinct from event""")
def page_distinct(spark, d):
    """Rows of a page that repeat the one before them in the order of time are left out."""
    rows = page_rows(spark, d, F.year("o_orderdate"), F.col("o_orderstatus"))
    return pages.build(rows, pages.Page(tables=((0, 2),), order="time", distinct=True)).select("pos", "date", "event")


@query(f"select {_ROWS} as pos, 'Part ' || (o_orderkey % 3) as title, '| ' || {_ISO} || ' | s ' || o_orderstatus || ' | ' || o_orderpriority || ' |' as line from orders")
def page_lines(spark, d):
    """A timeline as Markdown lines with the titles of its tables."""
    rows = page_rows(spark, d, F.col("iso"), F.concat(F.lit("s "), F.col("o_orderstatus")), F.col("o_orderpriority"))
    titles = spark.range(3).select(F.col("id").cast("int").alias("table_idx"), F.concat(F.lit("Part "), F.col("id")).alias("title"))
    t = pages.titled(pages.markdown(pages.build(rows, pages.Page(tables=((0, 2),), kept={"kind": 2})), ("kind",)), titles)
    return t.select("pos", "title", "line")


@query(f"""
select 'C' || o_orderkey as name, {_ISO} || ' - 2001-02-03' as date, 'term' as kind from orders union all
select 'C' || o_orderkey, case when o_orderkey % 2 = 0 then {_ISO} else '1900 - 1970' end, 'life' from orders""")
def terms_and_births(spark, d):
    """Terms of office, and births and deaths, from one table."""
    day = F.date_format("o_orderdate", "MMMM d, yyyy")
    life = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("b. "), day)).otherwise("1900–1970")
    rows = page_rows(spark, d, F.lit("x"), F.lit("y"), F.concat(F.lit("C"), F.col("o_orderkey"), F.lit(" ("), life, F.lit(")")), F.concat(day, F.lit(" – February 3, 2001")))
    term, lived = pages.terms_and_births(rows)
    return term.withColumn("kind", F.lit("term")).unionByName(lived.withColumn("kind", F.lit("life")))


@query(f"select {_ISO} as date, 'Mission: m, ' || o_orderkey || ', spacecraft: s on v by USA, mission type: ' || o_orderstatus || ' resulted in ok. more' as event from orders")
def missions(spark, d):
    """Launches as sentences."""
    rows = page_rows(spark, d, F.lit("m"), F.col("o_orderkey"), F.lit("s[1]"), F.date_format("o_orderdate", "d MMMM yyyy"), F.lit("USA"), F.col("o_orderstatus"), F.lit("ok"), F.lit("more"), F.lit("v"))
    return pages.missions(rows)


@query("""
select o_orderkey, (o_custkey + 5) || ' Ma BP - ' || (o_custkey - 0.5)::decimal(18, 1) || ' Ma BP' as tolerant, o_custkey || ' kya BP - ' || o_orderkey || ' kya BP' as spread, (o_custkey * 1000)::varchar as scaled,
  o_custkey || '.5 Ma BP - ' || o_custkey || ' Ma BP' as fossil from (select o_orderkey, o_custkey + 1 as o_custkey from orders)""")
def age_texts(spark, d):
    """Ages written with tolerances, shared units, other units and decimal commas."""
    o = table(spark, d, "orders").withColumn("c", F.col("o_custkey") + 1)
    tolerant = F.concat_ws(" ", F.col("c") + F.lit(2.25).cast("decimal(18,2)"), F.lit("±"), F.lit("2.75"))
    return o.select(
        "o_orderkey", dates.tolerance_to_range(tolerant, "Ma BP").alias("tolerant"), dates.spread_unit(F.concat_ws(" ", "c", F.lit("-"), "o_orderkey", F.lit("ka"))).alias("spread"), dates.scale_age(F.col("c"), 1000.0).alias("scaled"),
        dates.fossil_date(F.concat(F.lit("ca. "), "c", F.lit(",5–"), "c", F.lit(" mya (x)"))).alias("fossil"),
    )


@query("""
select event_type, sum((day(ts) <= 10)::int)::varchar as early, sum((day(ts) between 11 and 20)::int)::varchar as middle, sum((day(ts) > 20)::int)::varchar as late from events group by 1""")
def transpose_counts(spark, d):
    """Counts by part of the month and kind, as a page's table turned over."""
    e = table(spark, d, "events")
    part = F.when(F.dayofmonth("ts") <= 10, "early").when(F.dayofmonth("ts") <= 20, "middle").otherwise("late")
    n = e.groupBy(part.alias("part"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    g = n.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("event_type", "n"))).alias("l"))
    kinds = g.select(F.concat(F.array(F.lit("kind")), F.transform("l", lambda s: s["event_type"])).alias("cells")).limit(1)
    rows = kinds.unionByName(g.select(F.concat(F.array("part"), F.transform("l", lambda s: s["n"].cast("string"))).alias("cells")))
    return pages.transposed(rows).select(F.col("kind").alias("event_type"), "early", "middle", "late")


@query("select o_orderkey, repeat('█', least(40, o_orderkey * 40 // 60000)::int) || repeat('░', (40 - least(40, o_orderkey * 40 // 60000))::int) as bar, regexp_full_match(o_orderpriority[3:], '[IVXLCDM]*|[0-9]*') as numeral from orders")
def bars_and_numerals(spark, d):
    """Progress bars, and words that are numbers."""
    o = table(spark, d, "orders")
    return o.select("o_orderkey", text.progress_bar(F.col("o_orderkey"), F.lit(60000)).alias("bar"), text.is_number(F.substring("o_orderpriority", F.lit(3), F.length("o_orderpriority"))).alias("numeral"))


@query("""
with o as (select o_orderkey, year(o_orderdate) as y, o_orderkey % 90 + 1 as t, o_orderkey % 5 as k from orders)
select o_orderkey, case k when 0 then y::varchar when 1 then y || ' BC' when 2 then (y + t)::varchar when 3 then '1280 - 1299' else y::varchar end as date, case when k < 3 then '±' || t else '' end as remark,
  case k when 0 then (y - t) || ' - ' || (y + t) when 1 then y || ' BC' when 2 then (y + t) || ' Ma BP - ' || y || ' Ma BP' when 3 then ((y + t) * 1000) || ' kya BP - ' || ((y - t) * 1000) || ' kya BP' else (y * 1000) || ' kya BP' end as impact from o""")
def tolerances(spark, d):
    """Dates with tolerances, spans and phrases, and ages of impacts."""
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").cast("string").alias("y"), (F.col("o_orderkey") % 90 + 1).alias("t"), (F.col("o_orderkey") % 5).alias("k"))
    y, t, k = F.col("y"), F.col("t").cast("string"), F.col("k")
    later = (F.col("y").cast("bigint") + F.col("t")).cast("string")
    written = F.when(k == 0, F.concat(F.lit("c. "), y, F.lit(" ± "), t)).when(k == 1, F.concat(y, F.lit(" ± "), t, F.lit(" BCE"))).when(k == 2, F.concat(y, F.lit(" to "), later)).when(k == 3, F.lit("the end of the 13th century")).otherwise(F.concat(F.lit("Around "), y, F.lit("s")))
    impact = F.when(k == 0, F.concat(F.lit("0.01 ("), y, F.lit(" ± "), t, F.lit(" AD)"))).when(k == 1, F.concat(y, F.lit(" bc"))).when(k == 2, F.concat(y, F.lit("–"), later, F.lit("[1]"))).when(k == 3, F.concat(F.lit("<"), y, F.lit(" ± "), t)).otherwise(y)
    return o.select("o_orderkey", dates.tolerant_span(dates.phrase(written)).alias("c"), dates.impact_age(impact).alias("impact")).select("o_orderkey", "c.date", "c.remark", "impact")


@query(f"""
with o as (select {_ROWS} as pos, o_orderkey % 26 as k, o_orderstatus as s from orders), c(i, raw, d, r) as (values {", ".join(f"({i}, '{raw}', '{date}', '{remark}')" for i, (raw, (date, remark)) in enumerate(curated.table(curated.RENAISSANCE_COMPOSERS).items()))})
select pos, d as date, r as remark, s as event from o join c on k = i""")
def composers(spark, d):
    """A page's own table of exceptions, every one of its dates many times."""
    raw = F.element_at(F.array(*[F.lit(x) for x in curated.table(curated.RENAISSANCE_COMPOSERS)]), (F.col("o_orderkey") % 26 + 1).cast("int"))
    page = dataclasses.replace(pages.PAGES["renaissance_composers"], tables=((0, 2),))
    return pages.build(page_rows(spark, d, F.col("o_orderstatus"), raw), page).select("pos", "date", "remark", F.element_at(F.split("event", ", "), -1).alias("event"))


@query("""
select 'page ' || n_nationkey as page, 0 as table_idx, i as row_idx, [a, b] as cells from (select n_nationkey, unnest([0, 1])::int as i, unnest(['Date', '19' || (n_nationkey + 10)]) as a, unnest(['Event', n_name]) as b from nation)""")
def fetched_pages(spark, d):
    """Pages fetched by their addresses, tables read out; an address that gives an error has none."""
    n = table(spark, d, "nation")
    html = F.concat(F.lit("<html><table><tr><th>Date<th>Event<tr><td>19"), F.col("n_nationkey") + 10, F.lit("<td>"), "n_name", F.lit("</table></html>"))
    root = _written(spark, n.select(F.concat(F.lit("p"), "n_nationkey", F.lit(".html")).alias("path"), html.alias("content")), "pages")
    url = F.concat(F.lit("file://" + root.removeprefix("file:").removeprefix("//") + "/p"), F.col("n_nationkey").cast("string"), F.lit(".html"))
    urls = n.select(F.concat(F.lit("page "), "n_nationkey").alias("page"), url.alias("url")).unionByName(n.select(F.lit("lost").alias("page"), F.concat(url, F.lit("x")).alias("url")))
    return files.html_tables(files.fetch_pages(urls), "page")


@query("""
select 'file' as kind, 'f' || c_custkey as path, 'delete' as action from customer where c_custkey not in (select o_custkey from orders) union all
select 'reader', c_name || '.sdr', 'delete' from customer where c_custkey % 3 <> 0 union all select 'note', c_name || '.md', 'delete' from customer where c_custkey % 7 = 0 union all
select 'folder', 'x/' || r_name, 'delete' from region where r_regionkey not in (select n_regionkey from nation where n_nationkey > 20)""")
def vacuum(spark, d):
    """What a target and the notes hold without reason: files, readers' folders, notes and empty folders."""
    c, r = table(spark, d, "customer"), table(spark, d, "region")
    unclaimed = diff.orphans(c.select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k")), ["k"]).select(F.concat(F.lit("f"), "k").alias("path"))
    beside = c.select(F.col("c_name").alias("title"), F.concat("c_name", F.lit(".sdr")).alias("path"))
    plan = c.select(F.concat("c_name", F.lit(".md")).alias("path"), F.when(F.col("c_custkey") % 7 == 0, "orphan").otherwise("keep").alias("action"))
    held = table(spark, d, "nation").where("n_nationkey > 20").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count(F.lit(1)).alias("n_entries"))
    shown = r.join(held, "r_regionkey", "left").select(F.concat(F.lit("x/"), "r_name").alias("path"), F.coalesce("n_entries", F.lit(0)).alias("n_entries"))
    folders = shown.unionByName(r.select(F.concat(F.lit("x/."), "r_name").alias("path"), F.lit(0).alias("n_entries")))
    return diff.vacuum_plan(unclaimed, beside, c.where("c_custkey % 3 = 0").select(F.col("c_name").alias("title")), plan, folders, allowed=True)
