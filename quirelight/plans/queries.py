"""Queries of the engine's own operators over the test tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, hashes, julian, text
from ..operators import diff, intervals, ordered, search, snapshots, timeline
from ..operators.keywords import domain_filter, keyword_filter
from ..session import is_folder, table
from ..sinks import render
from ..sources import clippings, files, library, notes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FROM, TO = "1997-01-01", "1999-01-01"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- time

_SPANS = """
select l_orderkey, l_linenumber, epoch(least(o_orderdate, l_shipdate)) / 86400.0 + 2440587.5 as jd_start, epoch(greatest(o_orderdate, l_shipdate)) / 86400.0 + 2440587.5 as jd_end
from lineitem join orders on l_orderkey = o_orderkey"""
_CLASS = """case when jd_start >= qs and jd_end <= qe then 'inside' when jd_start < qs and jd_end > qe then 'surrounding'
when (jd_start >= qs and jd_start < qe and jd_end > qe) or (jd_end <= qe and jd_end > qs and jd_start < qs) then 'partial' else 'none' end"""
_PERIOD = "(select 2450449.5 as qs, 2451179.5 as qe)"


def spans(spark: SparkSession, d: str) -> DataFrame:
    """Line items as events from order to shipping, whichever is first."""
    x = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    a, b = F.least("o_orderdate", "l_shipdate"), F.greatest("o_orderdate", "l_shipdate")
    return x.withColumns({"jd_start": julian.timestamp_to_jd(a), "jd_end": julian.timestamp_to_jd(b)})


@query(f"select l_orderkey, l_linenumber, {_CLASS} as time_class from ({_SPANS}) s, {_PERIOD}")
def event_time_class(spark, d):
    a, b = map(F.lit, julian.range_of(spark, f"{FROM} - {TO}"))
    return spans(spark, d).select("l_orderkey", "l_linenumber", F.coalesce(timeline.time_class(F.col("jd_start"), F.col("jd_end"), a, b), F.lit("none")).alias("time_class"))


def _time(kind: str) -> None:
    def f(spark, d):
        x = spans(spark, d).withColumns({"eventdata": F.create_map(F.lit("mode"), F.col("l_returnflag")), "metadata": F.create_map(F.lit("domain"), F.lit("orders"))})
        return timeline.search_events(x, f"{FROM} - {TO}", classes=[kind]).select("l_orderkey", "l_linenumber")

    f.__name__ = f"time_{kind}"
    query(f"select l_orderkey, l_linenumber from ({_SPANS}) s, {_PERIOD} where {_CLASS} = '{kind}'")(f)


for _kind in (timeline.INSIDE, timeline.SURROUNDING, timeline.PARTIAL):
    _time(_kind)


@query("""
with u as (select user_id, epoch_us(min(ts)) / 86400000000.0 + 2440587.5 as jd_start, epoch_us(max(ts)) / 86400000000.0 + 2440587.5 as jd_end,
  string_agg(distinct event_type, ' ' order by event_type) as kinds from events group by user_id)
select user_id, round(jd_start, 6) as jd_start, round(jd_end, 6) as jd_end, case when jd_start < 2460319.5 and jd_end > 2460329.5 then 'surrounding'
  when jd_start >= 2460319.5 and jd_end <= 2460329.5 then 'inside' else 'partial' end as time_class
from u where jd_end > 2460319.5 and jd_start < 2460329.5 and (regexp_matches(kinds, '\\bclick') or regexp_matches(kinds, '\\bview\\b'))""")
def timeline_query(spark, d):
    """One span a user, a time and a keyword filter, in order of time."""
    e = table(spark, d, "events")
    u = e.groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.array_join(F.array_sort(F.collect_set("event_type")), " ").alias("kinds"))
    u = u.withColumns({"jd_start": julian.timestamp_to_jd(F.col("a")), "jd_end": julian.timestamp_to_jd(F.col("b")), "eventdata": F.create_map(F.lit("kinds"), F.col("kinds")), "metadata": F.create_map(F.lit("domain"), F.lit("events"))})
    x = timeline.search_events(u, "2024-01-10 - 2024-01-20", keywords=["click*|view"])
    return timeline.order_by_time(x).select("user_id", F.round("jd_start", 6).alias("jd_start"), F.round("jd_end", 6).alias("jd_end"), "time_class")


@query("""
with p as (select m, date_trunc('month', date '1995-01-01') + to_months(m) as s, date '1995-01-01' + to_months(m + 1) - interval 1 day as e from range(12) t(m)),
o as (select o_orderkey, o_orderdate::date as s, max(l_shipdate)::date as e from orders join lineitem on l_orderkey = o_orderkey group by all)
select m::int as month_no, count(*) as n from o join p on o.s <= p.e and p.s <= o.e where o.s <= o.e group by all""")
def interval_overlap_join(spark, d):
    """Orders from order to last shipping against the months of a year."""
    o = table(spark, d, "orders").join(table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last")), F.col("o_orderkey") == F.col("l_orderkey"))
    o = o.select("o_orderkey", F.unix_date(F.to_date("o_orderdate")).alias("os"), F.unix_date(F.to_date("last")).alias("oe"))
    first = F.add_months(F.lit("1995-01-01").cast("date"), F.col("id").cast("int"))
    p = spark.range(12).select(F.col("id").cast("int").alias("month_no"), F.unix_date(first).alias("ps"), F.unix_date(F.last_day(first)).alias("pe"))
    return intervals.overlap_join(o, p, ("os", "oe"), ("ps", "pe"), 31.0).groupBy("month_no").agg(F.count(F.lit(1)).alias("n"))


@query("""
with t as (select entry_id, emb_ten_idx as lo, emb_ten_idx + emb_ten_size as hi from text_entries where emb_ten_size > 0)
select event_id, entry_id from events join t on event_id >= lo and event_id < hi""")
def chunk_to_document(spark, d):
    """Places in the matrix of vectors to the entries that hold them."""
    t = table(spark, d, "text_entries").select("entry_id", F.col("emb_ten_idx").alias("lo"), (F.col("emb_ten_idx") + F.col("emb_ten_size")).alias("hi"))
    return intervals.point_in_range(table(spark, d, "events").select("event_id"), t, "event_id", "lo", "hi", 64).select("event_id", "entry_id")


@query("select o_orderkey, date_diff('day', date '1970-01-01', o_orderdate::date) + 2440587.5 as jd, strftime(o_orderdate, '%Y-%m-%d') as iso from orders")
def julian_day(spark, d):
    """Civil dates to Julian days and back."""
    o = table(spark, d, "orders")
    jd = julian.point_to_jd(F.date_format("o_orderdate", "yyyy-MM-dd"))
    back = julian.civil_from_days((jd - F.lit(julian.EPOCH_JD)).cast("bigint"))
    return o.select("o_orderkey", jd.alias("jd"), F.format_string("%04d-%02d-%02d", back["y"], back["m"], back["d"]).alias("iso"))


@query("""
select o_orderkey, case when month(o_orderdate) = 1 and day(o_orderdate) = 1 then strftime(o_orderdate, '%Y') when day(o_orderdate) = 1 then strftime(o_orderdate, '%Y-%m') else strftime(o_orderdate, '%Y-%m-%d') end as date_text from orders""")
def time_text(spark, d):
    """Julian days as the shortest time text."""
    return table(spark, d, "orders").select("o_orderkey", julian.jd_to_text(F.floor(julian.timestamp_to_jd(F.col("o_orderdate")) - 0.5) + 0.5).alias("date_text"))


@query("""
with s as (select event_id, user_id, floor(epoch(ts))::bigint % 1000 as a, case when event_id % 3 = 0 then null else floor(epoch(ts))::bigint % 1000 + event_id % 7 end as b from events),
m as (select *, max(a) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as la,
  max(b) over (partition by user_id, a order by event_id rows between unbounded preceding and 1 preceding) as lb from s)
select event_id, (coalesce(a < la, false) or (lb is not null and (b is null or b < lb))) as rejected from m""")
def order_check(spark, d):
    """Rows that break the time order of their table; a user's events are a table."""
    a = (F.unix_date(F.to_date("ts")).cast("bigint") * 86_400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")) % 1000
    e = table(spark, d, "events").select("event_id", "user_id", a.alias("jd_start"), F.when(F.col("event_id") % 3 != 0, a + F.col("event_id") % 7).alias("jd_end"))
    return e.select("event_id", timeline.order_rejected(["user_id"], "event_id").alias("rejected"))


@query("""
with y as (select doc_id, regexp_extract_all(text, '\\b((?:18|19|20)[0-9]{2})\\b', 1) as ys from documents)
select doc_id, unnest(range(len(ys)))::int as pos, unnest(ys) as year from y""")
def year_mentions(spark, d):
    """Years from 1800 to 2099 in texts."""
    x = timeline.year_events(table(spark, d, "documents").withColumn("title", F.col("desc_key")), "text")
    w = Window.partitionBy("doc_id").orderBy("position_offset")
    return x.select("doc_id", (F.row_number().over(w) - 1).alias("pos"), "year")


@query("""
select doc_id, translate(substring(text, greatest(n - 51, 0) + 1, n + 19 - greatest(n - 51, 0)), chr(10) || chr(13) || chr(9), '   ') as snippet
from (select doc_id, text, strpos(text, 'e')::int as n from documents) t where n > 0""")
def snippet(spark, d):
    """Text around the first match."""
    x = table(spark, d, "documents").withColumn("n", F.locate("e", F.col("text"))).where("n > 0")
    return x.select("doc_id", text.snippet(F.col("text"), F.col("n") - 1).alias("snippet"))


@query("select user_id, event_id, ts, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) t where r = 1")
def interval_sort_topn(spark, d):
    """The latest event of each user, combined before the shuffle."""
    e = table(spark, d, "events")
    top = e.groupBy("user_id").agg(F.max_by(F.struct("event_id", "ts", "value"), F.struct("ts", "event_id")).alias("e"))
    return top.select("user_id", "e.event_id", "e.ts", "e.value")


# ---- keywords and domains


@query("select doc_id from documents where regexp_matches(lower(text), '\\bgarden') and (regexp_matches(lower(text), '\\bold\\b') or regexp_matches(lower(text), 'er\\b')) and not regexp_matches(lower(text), '\\briver\\b')")
def keyword_and_or_not(spark, d):
    return table(spark, d, "documents").where(keyword_filter(F.col("text"), ["garden*", "old|*er", "!river"])).select("doc_id")


@query("select 0 as n")
def keyword_only_negative(spark, d):
    """Only negative keywords accept nothing."""
    return table(spark, d, "documents").where(keyword_filter(F.col("text"), ["!river"])).agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("select doc_id from documents where (contains(lower(source), 'notes') or contains(lower(source), 'archive') or regexp_matches(lower(desc_key), '^\\{attic_scans\\}')) and not contains(lower(source), 'field')")
def domain_include_exclude(spark, d):
    x = table(spark, d, "documents")
    inside = domain_filter(F.col("source"), ["notes", "archive", "!field"]) | domain_filter(F.col("desc_key"), ["{attic_scans}"]) & domain_filter(F.col("source"), ["!field"])
    return x.where(inside).select("doc_id")


# ---- chunks and search


@query("""
select doc_id, i::int as chunk_no, md5(substring(text, (i * 150 + 1)::int, 200)) as h
from (select doc_id, text, unnest(range((length(text) - 1) // 150 + 1)) as i from documents where length(text) > 0) t""")
def chunk_documents(spark, d):
    return search.chunk(table(spark, d, "documents").select("doc_id", "text"), "text", 200, 50).select("doc_id", "chunk_no", F.md5("chunk").alias("h"))


@query("""
with n as (select doc_id, case when length(text) > 0 then (length(text) - 1) // 150 + 1 else 0 end as n from documents)
select doc_id, n::int as n, (sum(n) over (order by doc_id) - n)::bigint as first_row from n""")
def chunk_totals(spark, d):
    """Number of chunks, and each document's first row in the matrix of vectors, by a running sum in two levels."""
    x = table(spark, d, "documents").select("doc_id", search.chunk_count(F.col("text"), 150).alias("n"))
    return ordered.running_total(x, "doc_id", "n", "first_row")


@query("select doc_id, substring(text, 301, 350) as span from documents where length(text) > 300")
def span_text(spark, d):
    """The text of two chunks from the third."""
    return table(spark, d, "documents").where(F.length("text") > 300).select("doc_id", search.span(F.col("text"), F.lit(2), F.lit(2), 200, 50).alias("span"))


@query("""
with q as (select embedding::double[] as e from embeddings where vec_id = (select min(vec_id) from embeddings))
select vec_id, round(list_dot_product(embedding::double[], e), 6) as cosine from embeddings, q order by list_dot_product(embedding::double[], e) desc, vec_id limit 10""")
def vector_topk(spark, d):
    """The ten vectors nearest to the first one."""
    e = table(spark, d, "embeddings")
    q = e.orderBy("vec_id").select("embedding").first().embedding
    return search.top_k(search.scores(e, q), 10, ["vec_id"]).select("vec_id", F.round("cosine", 6).alias("cosine"))


@query("""
with s as (select q.vec_id as query_id, v.vec_id, round(list_dot_product(q.embedding::double[], v.embedding::double[]), 9) as c from embeddings q join embeddings v on q.vec_id <> v.vec_id where q.vec_id % 20 = 0)
select query_id, vec_id, round(c, 6) as cosine, rank::int as rank from (select *, row_number() over (partition by query_id order by c desc, vec_id) as rank from s) t where rank <= 5""")
def vector_search(spark, d):
    """The five nearest of every row whose id is divisible by 20, against all rows."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return search.top_k_per_query(e, e.where("vec_id % 20 = 0"), 5).select("query_id", "vec_id", F.round("cosine", 6).alias("cosine"), "rank")


@query("""
with q as (select embedding::double[] as e from embeddings where vec_id = (select min(vec_id) from embeddings)),
h as (select label, vec_id, list_dot_product(embedding::double[], e) as c from embeddings, q where list_dot_product(embedding::double[], e) > 0),
i as (select *, vec_id - row_number() over (partition by label order by vec_id) as g from h)
select label, min(vec_id) as first_chunk, count(*) as n_chunks, round(max(c), 6) as cosine from i group by label, g""")
def vector_hits_merged(spark, d):
    """Hits in neighbouring places of a document as one span with the best score; a label stands for a document."""
    e = table(spark, d, "embeddings")
    q = e.orderBy("vec_id").select("embedding").first().embedding
    m = search.merge_hits(search.scores(e, q).where("cosine > 0"), ["label"], "vec_id")
    return m.select("label", "first_chunk", "n_chunks", F.round("cosine", 6).alias("cosine"))


@query("""
with r as (select desc_key as k, md5(coalesce(text, '')) as h, row_number() over (partition by desc_key order by indexed_at, entry_id) as a, row_number() over (partition by desc_key order by indexed_at desc, entry_id desc) as b from text_entries)
select k as "desc", case when max(case when a = 1 then h end) = max(case when b = 1 then h end) then 'keep' else 'replace' end as action from r group by k""")
def index_changes(spark, d):
    """What an index of the first version of every entry must do to hold the latest."""
    t, at = table(spark, d, "text_entries"), F.struct("indexed_at", "entry_id")
    side = lambda pick: t.groupBy(F.col("desc_key").alias("desc")).agg(F.md5(F.coalesce(pick(F.struct("text"), at)["text"], F.lit(""))).alias("text_hash"))
    return search.index_changes(side(F.min_by), side(F.max_by))


@query("""
with t as (select doc_id, text, unnest(range(0, length(text), 4)) as a from documents where length(text) > 0)
select doc_id, a::int as at, md5(substring(text, (greatest(0, least(a - 8, length(text) - 16)) + 1)::int, 16)) as h from t""")
def context_windows(spark, d):
    """Windows of 16 characters every 4 characters, moved inward at the ends."""
    return search.windows(table(spark, d, "documents").select("doc_id", "text"), "text", 16, 4).select("doc_id", "at", F.md5("window").alias("h"))


# ---- order


@query("""
with m as (select event_id, case when value > 50 then value end as v, case when value > 50 then event_id end as f from events)
select event_id, last_value(v ignore nulls) over (order by event_id) as filled, coalesce(last_value(f ignore nulls) over (order by event_id), -1) as filled_from from m""")
def forward_fill(spark, d):
    """Missing values from the last row that has one, over all rows, in two levels."""
    return ordered.forward_fill(table(spark, d, "events"), "event_id", {"filled": "value", "filled_from": "event_id"}, F.col("value") > 50).select("event_id", "filled", F.coalesce("filled_from", F.lit(-1)).alias("filled_from"))


@query("select event_id, event_type from (select event_id, event_type, lag(event_type) over (order by event_id) as p from events) t where p is distinct from event_type")
def consecutive_dedupe(spark, d):
    return ordered.drop_repeats(table(spark, d, "events").select("event_id", "event_type"), "event_id", ["event_type"])


@query("select doc_id, source from (select *, row_number() over (partition by lower(text) order by doc_id) as r from documents) t where r = 1")
def first_wins(spark, d):
    return ordered.first_wins(table(spark, d, "documents").select("doc_id", "source", "text"), F.lower("text"), ["doc_id"]).select("doc_id", "source")


@query("select lower(text) as key, count(*) as n from documents group by 1 having count(*) > 1")
def duplicate_keys(spark, d):
    return ordered.duplicate_keys(table(spark, d, "documents"), F.lower("text"))


@query("select user_id, string_agg(event_type, ',' order by ts, event_id) as kinds from events group by user_id")
def ordered_list(spark, d):
    x = ordered.ordered_list(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", "kinds")
    return x.select("user_id", F.array_join("kinds", ",").alias("kinds"))


@query("""
with recursive b as (select row_number() over (order by book_id) as i, book_id as pos, lower(title) as title_key, nullif(lower(uuid), '') as uuid from books),
r as (select 0::bigint as i, 0::bigint as pos, false as accepted, []::varchar[] as titles, []::varchar[] as uuids union all
select b.i, b.pos, t.ok, case when t.ok then list_append(titles, coalesce(b.title_key, chr(1))) else titles end, case when t.ok and b.uuid is not null then list_append(uuids, b.uuid) else uuids end
from r join b on b.i = r.i + 1, lateral (select not list_contains(titles, coalesce(b.title_key, chr(1))) and not coalesce(list_contains(uuids, b.uuid), false) as ok) t)
select b.pos, title_key, uuid, accepted from r join b using (i)""")
def accepted_notes(spark, d):
    """Books that keep their place when an earlier one holds their title or uuid."""
    b = table(spark, d, "books").select(F.col("book_id").alias("pos"), F.lower("title").alias("title_key"), F.nullif(F.lower("uuid"), F.lit("")).alias("uuid"))
    return ordered.accepted_notes(b)


# ---- differences


@query("""
with w as (select book_id as k, title, publisher from books), p as (select book_id + 7 as k, title, case when book_id % 5 = 0 then publisher else null end as publisher from books where book_id % 3 <> 0),
p2 as (select k - 7 as k, title, publisher from p union all select book_id + 1000000, title, publisher from books where book_id % 50 = 0)
select coalesce(w.k, p2.k) as k, case when p2.k is null then 'new' when w.k is null then 'debris' when w.title is not distinct from p2.title and w.publisher is not distinct from p2.publisher then 'unchanged' else 'changed' end as action
from w full join p2 on w.k = p2.k""")
def diff_full_outer(spark, d):
    b = table(spark, d, "books")
    w = b.select(F.col("book_id").alias("k"), "title", "publisher")
    p = b.where("book_id % 3 <> 0").select(F.col("book_id").alias("k"), "title", F.when(F.col("book_id") % 5 == 0, F.col("publisher")).alias("publisher"))
    return diff.full_diff(w, p.unionByName(b.where("book_id % 50 = 0").select((F.col("book_id") + 1_000_000).alias("k"), "title", "publisher")), ["k"], ["title", "publisher"])


_DOCS = """docs as (select distinct on (path) d.path as path, d.hash as h, d.hash_algo as a from (select book_id, unnest(docs) as d from books) t order by path, book_id)"""


@query(f"""
with {_DOCS}, target as (select path, case when length(path) % 4 = 0 then 'x' else h end as h, a from docs where length(path) % 3 <> 0 union all select 'lost/' || path, h, a from docs where length(path) % 10 = 0)
select coalesce(d.path, t.path) as path, case when t.path is null then 'new' when d.path is null then 'debris' when d.h = t.h and d.a is not distinct from t.a then 'unchanged' else 'changed' end as action from docs d full join target t on d.path = t.path""")
def export_plan(spark, d):
    """Documents against the files of a target folder."""
    x = table(spark, d, "books").select("book_id", F.explode("docs").alias("d")).select("book_id", "d.path", "d.hash", "d.hash_algo")
    docs = ordered.first_wins(x.withColumn("src", F.col("path")), F.col("path"), ["book_id"]).select("path", "src", "hash", "hash_algo")
    n = F.length("path")
    there = docs.where(n % 3 != 0).select("path", F.when(n % 4 == 0, F.lit("x")).otherwise(F.col("hash")).alias("hash"), "hash_algo")
    target = there.unionByName(docs.where(n % 10 == 0).select(F.concat(F.lit("lost/"), F.col("path")).alias("path"), "hash", "hash_algo"))
    return diff.export_plan(docs, target).select("path", "action")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def anti_sidecar(spark, d):
    return diff.orphans(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k")), ["k"]).select(F.col("k").alias("c_custkey"))


@query("""
with k as (select sequence_number % 2 as odd, title, regexp_replace(regexp_replace(lower(uuid), '[\\s{}()-]', '', 'g'), '^(urn:)?(uuid:)?', '') as h from lib_entries),
u as (select odd, title, regexp_replace(h, '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') as uuid from k where regexp_full_match(h, '[0-9a-f]{32}')),
e as (select uuid, coalesce(min(title), '') as name from u where odd = 0 group by uuid), n as (select uuid, coalesce(max(title), '') as name from u where odd = 1 group by uuid)
select coalesce(e.uuid, n.uuid) as uuid, coalesce(e.name, n.name) as name, n.name as old_name,
case when n.uuid is null then case when e.name in (select name from n) then 'blocked' else 'create' end when e.uuid is null then 'orphan' when e.name = n.name then 'keep' else 'rename' end as action from e full join n on e.uuid = n.uuid""")
def note_plan(spark, d):
    """The plan over all entries that have a uuid, in whatever notation; an entry without title has the empty name."""
    x = table(spark, d, "lib_entries").select(snapshots.canonical_uuid(F.col("uuid")).alias("uuid"), "sequence_number", "title").where("uuid is not null")
    side = lambda odd, name: x.where(f"sequence_number % 2 = {odd}").groupBy("uuid").agg(F.coalesce(name, F.lit("")).alias("name"))
    return diff.note_plan(side(0, F.min("title")), side(1, F.max("title")))


@query("select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) t where r = 1")
def upsert_incremental(spark, d):
    """The latest event of each user before a date, brought up to date by all events from then on."""
    e = table(spark, d, "events")
    at = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    last = lambda x: x.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    return diff.upsert(last(e.where(F.col("ts") < at)), last(e.where(F.col("ts") >= at)), ["user_id"])


@query("""
select desc_key as path, regexp_replace(regexp_replace(text, '\\[\\[ostrand(\\]\\]|\\|)', '[[Ostrand (city)\\1', 'gi'), '\\[\\[pellask(\\]\\]|\\|)', '[[New Pellask\\1', 'gi') as content
from documents where regexp_matches(lower(text), '\\[\\[(ostrand|pellask)(\\]\\]|\\|[^\\n]*\\]\\])')""")
def rename_links(spark, d):
    x = table(spark, d, "documents").select(F.col("desc_key").alias("path"), F.col("text").alias("content"))
    renames = spark.createDataFrame([("Pellask", "New Pellask"), ("Ostrand", "Ostrand (city)")], "old string, new string")
    return diff.rename_links(x, notes.link_edges(x, "path", "content").distinct(), renames)


# ---- notes, tables, pages


@query("select doc_id, trim(lower(u)) as target from (select doc_id, unnest(regexp_extract_all(text, '\\[\\[([^\\]|\\n]*)(?:\\]\\]|\\|[^\\n]*?\\]\\])', 1)) as u from documents) t")
def link_edges(spark, d):
    return notes.link_edges(table(spark, d, "documents"), "doc_id", "text")


@query("""
select doc_id, case when regexp_matches(text, '^---\\n(?s)(?:(.*?)\\n)??---(?:\\n|$)') then regexp_extract(text, '^---\\n(?s)(?:(.*?)\\n)??---(?:\\n|$)', 1) when starts_with(text, '---' || chr(10)) or text = '---' then substring(text, 5) end as front from documents where text is not null""")
def front_matter(spark, d):
    x = table(spark, d, "documents").where("text is not null")
    return x.select("doc_id", notes.front_matter(F.col("text"))["front"].alias("front"))


@query()
def note_metadata(spark, d):
    """Front-matter of the documents, completed."""
    x = table(spark, d, "documents").select(F.col("desc_key").alias("path"), F.col("ingested_at").alias("modified"), notes.yaml_map(notes.front_matter(F.col("text"))["front"]).alias("metadata"))
    m = notes.complete_front_matter(x)
    return m.select("path", F.col("metadata")["context"].alias("context"), F.col("metadata")["creation"].alias("creation"), "changes")


@query()
def clipping_fields(spark, d):
    """Title, author, kind, place, time and text of the clippings among the documents."""
    x = table(spark, d, "documents").where("doc_kind = 'clipping'").select("doc_id", "text")
    return clippings.parse(clippings.blocks(x), "Europe/Berlin")


@query("""
select doc_id, case when len([x for x in string_split(replace(text, chr(13), ''), chr(10)) if starts_with(x, '- Your ') and strpos(x, 'Added on ') > 1 and (strpos(x, 'at location ') > 1 or strpos(x, ' on page ') > 1)]) > 0 then 'en'
when len([x for x in string_split(replace(text, chr(13), ''), chr(10)) if (starts_with(x, '- Deine ') or starts_with(x, '- Dein ')) and strpos(x, 'Hinzugefügt am ') > 1 and (strpos(x, 'bei Position ') > 1 or strpos(x, ' auf Seite ') > 1)]) > 0 then 'de' end as locale from documents""")
def locale_detect(spark, d):
    return table(spark, d, "documents").select("doc_id", clippings.locale_of(F.replace("text", F.lit("\r"), F.lit(""))).alias("locale"))


@query("""
select book_id, regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(description,
'<h1>', '&num; '), '<h2>', '&num;&num; '), '<h3>', '&num;&num;&num; '), '<h4>', '&num;&num;&num;&num; '), '</h1>', chr(10) || chr(10)), '</h2>', chr(10) || chr(10)), '</h3>', chr(10) || chr(10)), '</h4>', chr(10) || chr(10)),
'<em>', ' *'), '</em>', '* '), '<strong>', '**'), '</strong>', '** '), '<p>', ''), '</p>', chr(10) || chr(10)), '<br>', chr(10) || chr(10)), '<br/>', chr(10) || chr(10)), '<br />', chr(10) || chr(10)), '<li>', '- '), '</li>', chr(10)), '  ', ' '), '  ', ' '), '<[^>]+>', '', 'g') as md from books""")
def html_strip(spark, d):
    return table(spark, d, "books").select("book_id", text.tags_to_text(F.col("description")).alias("md"))


@query("""
with n as (select r_name, n_name, n_nationkey, row_number() over (partition by r_name order by n_name || '<td>')::int as row_idx from nation join region on n_regionkey = r_regionkey)
select r_name, 0 as table_idx, row_idx, [n_name, n_nationkey::varchar] as cells from n union all select distinct r_name, 0, 0, ['Nation', 'Key'] from n""")
def html_table_cells(spark, d):
    """Tables rendered to HTML and read back: nations by region."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    row = F.concat(F.lit("<tr><td>"), F.col("n_name"), F.lit("<td>"), F.col("n_nationkey"), F.lit("</tr>"))
    page = n.groupBy("r_name").agg(F.concat(F.lit("<p>x<table><tr><th>Nation<th>Key"), F.array_join(F.array_sort(F.collect_list(row)), ""), F.lit("</table>")).alias("html"))
    return files.html_tables(page, "r_name")


# ---- text functions

_NOTE_NAME = "replace(replace(replace(replace(regexp_replace(title, '[\\\\/:*?\"<>|.`''\\n\\r\\t\\[\\]{}()&^%$#@!~]', '_', 'g'), '__', '_'), ' _ ', ', '), '_ ', ', '), ' _', ' ')"
_FILE_NAME = "trim(replace(replace(replace(replace(replace(replace(replace(replace(replace(translate({}, '<>:\"/\\|?*', ',,,,,,,,,'), '__', '_'), ' _ ', ', '), '_ ', ', '), '  ', ' '), '  ', ' '), ',,', ','), ' ,', ' '), '  ', ' '), '  ', ' '))"


@query(f"select book_id, {_NOTE_NAME} as note_name, {_FILE_NAME.format('title')} as file_name from books")
def sanitize_name(spark, d):
    return table(spark, d, "books").select("book_id", text.note_name(F.col("title")).alias("note_name"), text.file_name(F.col("title")).alias("file_name"))


_STRIP = "regexp_replace({}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
_FIND = "case when contains(s, '{0}') then case when strpos(substring(s, 31), '{0}') > 0 then 29 + strpos(substring(s, 31), '{0}') else -1 end end"
_COUNTS = "regexp_full_match({}, '[0-9]+|[IVXLCDM]+')"


@query(f"""
with b as (select book_id, coalesce(title, '') as t, regexp_replace(regexp_replace(coalesce(title_sort, ''), ', (Der|Die|Das|Ein|Eine)$', ''), ', (The|A|An)$', '') as ts, coalesce(creators[1], 'Unknown') as a from books),
f as (select *, nfc_normalize({_STRIP.format(_FILE_NAME.format("ts").removeprefix("trim(").removesuffix(")"))}) as s, string_split(t, ' ') as w, list_extract(string_split(ts, ' '), -1) as l from b),
v as (select *, coalesce(case when {_COUNTS.format("w[1]")} then w[1] end, case when {_COUNTS.format("l")} then l end, list_extract([x for x in w if {_COUNTS.format("x")}], 1), '') as volume,
  coalesce(least({", ".join(_FIND.format(ch) for ch in ",.-:;")}), -1) as p, case when strpos(substring(s, 31), ' ') > 0 then 29 + strpos(substring(s, 31), ' ') else -1 end as q from f),
c as (select *, {_STRIP.format("case when length(s) > 70 then substring(s, 1, case when p > 30 and p < 70 then p when q >= 30 and q < 70 then q else 70 end) else s end")} as h from v)
select book_id, {_STRIP.format("case when volume <> '' and not contains(h, volume) then h || ' ' || volume else h end")} || ' - ' || nfc_normalize({_STRIP.format(_FILE_NAME.format("a").removeprefix("trim(").removesuffix(")"))}) as short_title from c""")
def short_title(spark, d):
    """Short titles of every book, by the rule; the stored ones keep signs and drop other articles."""
    return table(spark, d, "books").select("book_id", text.short_title(F.col("title"), text.strip_articles(F.col("title_sort")), F.col("creators"), text.nfc).alias("short_title"))


@query("select doc_id, md5(regexp_replace(regexp_replace(text, ' {2,}', ' ', 'g'), '\\n{2,}', chr(10), 'g')) as light, md5(regexp_replace(regexp_replace(text, '(\\n\\n)+', ' ', 'g'), ' {2,}', ' ', 'g')) as full_ from documents")
def compress_ws(spark, d):
    x = table(spark, d, "documents")
    return x.select("doc_id", F.md5(text.compress_blanks(F.col("text"), "light")).alias("light"), F.md5(text.compress_blanks(F.col("text"), "full")).alias("full_"))


@query("select o_orderkey, o_orderpriority || ' of ' || o_orderstatus as plain from orders")
def remove_footnotes(spark, d):
    o = table(spark, d, "orders")
    noisy = F.concat(F.col("o_orderpriority"), F.lit("["), F.col("o_custkey"), F.lit("] of "), F.col("o_orderstatus"), F.lit("[a]"))
    return o.select("o_orderkey", text.remove_footnotes(noisy).alias("plain"))


@query("""
with y as (select o_orderkey, year(o_orderdate) // 100 + o_orderkey % 3 - 18 as c, o_orderkey % 2 = 0 as bc from orders)
select o_orderkey, case when bc then case when c = 1 then '100 BC - 1 BC' else c || '00 BC - ' || (c - 1) || '00 BC' end else case when c = 1 then '1 - 100' else (c - 1) || '00 - ' || c || '00' end end as date from y where c > 0""")
def decenturize(spark, d):
    o = table(spark, d, "orders").withColumn("c", F.floor(F.year("o_orderdate") / 100) + F.col("o_orderkey") % 3 - 18).where("c > 0")
    suffix = F.when(F.col("c") == 1, "st").when(F.col("c") == 2, "nd").when(F.col("c") == 3, "rd").otherwise("th")
    words = F.concat(F.col("c").cast("string"), suffix, F.lit(" century"), F.when(F.col("o_orderkey") % 2 == 0, " BC").otherwise(""))
    return o.select("o_orderkey", dates.century(words)["date"].alias("date"))


@query("select o_orderkey, case when o_orderkey % 4 = 0 then year(o_orderdate) || '-' || lpad(month(o_orderdate)::varchar, 2, '0') when o_orderkey % 4 = 1 then year(o_orderdate)::varchar else strftime(o_orderdate, '%Y-%m-%d') end as date from orders")
def date_merge(spark, d):
    o = table(spark, d, "orders")
    month, day = F.date_format("o_orderdate", "MMMM"), F.dayofmonth("o_orderdate")
    k = F.col("o_orderkey") % 4
    rest = F.when(k == 0, month).when(k == 1, "spring").when(k == 2, F.concat_ws(" ", day, month)).otherwise(F.concat_ws(" ", month, day))
    return o.select("o_orderkey", dates.merge_date(F.year("o_orderdate").cast("string"), rest).alias("date"))


@query("""
select o_orderkey, case o_orderkey % 5 when 0 then year(o_orderdate) || ' - ' || (year(o_orderdate) + 3) when 1 then year(o_orderdate)::varchar when 2 then year(o_orderdate)::varchar when 3 then year(o_orderdate) || ' BC' else year(o_orderdate)::varchar end as date,
case o_orderkey % 5 when 0 then '' when 1 then 'ca.' when 2 then 'Alt.: ' || (year(o_orderdate) // 10 * 10 + 9) when 3 then 'before' else year(o_orderdate) || 's' end as remark from orders""")
def date_clean(spark, d):
    y, k = F.year("o_orderdate"), F.col("o_orderkey") % 5
    raw = F.when(k == 0, F.concat(y, F.lit(" – "), y + 3)).when(k == 1, F.concat(F.lit("ca. "), y, F.lit("[12]"))).when(k == 2, F.concat(y, F.lit("/9"))).when(k == 3, F.concat(F.lit("before "), y, F.lit(" BCE"))).otherwise(F.concat(y, F.lit("s")))
    x = dates.clean_column(table(spark, d, "orders").select("o_orderkey", raw.alias("raw")), "raw")
    return x.select("o_orderkey", "cleaned.date", "cleaned.remark")


@query("select doc_id, md5(coalesce(text, '')) as md5, sha256(coalesce(text, '')) as sha256 from documents")
def content_hash(spark, d):
    c = F.coalesce("text", F.lit("")).cast("binary")
    return table(spark, d, "documents").select("doc_id", hashes.digest(c, "md5").alias("md5"), hashes.digest(c, "sha256").alias("sha256"))


_SAMPLES = " || ".join(f"array_slice(encode(text), {o + 1}, {o + 1024})" for o in (0, *(1024 << (2 * i) for i in range(11))))


@query(f"select doc_id, md5({_SAMPLES}) as sparse_md5 from documents where text is not null")
def sparse_hashes(spark, d):
    """MD5 of samples of the documents' bytes."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", hashes.sparse_md5(F.col("text").cast("binary")).alias("sparse_md5"))


@query()
def file_hashes(spark, d):
    """Exclusive-or of the CRC-32 of the blocks of the documents' bytes; there is no CRC-32 in SQL."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", hashes.block_crc32(F.col("text").cast("binary")).alias("crc32"))


@query("select book_id, 'calibre://show-book/_hex_-' || lower(hex(encode(repo_name))) || '/' || calibre_id as link from books")
def deep_link(spark, d):
    return table(spark, d, "books").select("book_id", text.deep_link(F.col("repo_name"), F.col("calibre_id")).alias("link"))


@query("select book_id, [replace(trim(x), ' ', '_') for x in coalesce(subjects, [])] as tags from books")
def tag_names(spark, d):
    return table(spark, d, "books").select("book_id", F.transform(F.coalesce("subjects", F.array().cast("array<string>")), text.tag_name).alias("tags"))


@query("select p_partkey, replace(p_brand || '/' || p_type, '/', '-') as folder from part")
def model_folders(spark, d):
    return table(spark, d, "part").select("p_partkey", text.model_folder(F.concat_ws("/", "p_brand", "p_type")).alias("folder"))


@query("select entry_id, case when filename like '~/%' then '/home/u' || substring(filename, 2) else filename end as f, filename as short from text_entries")
def home_relative(spark, d):
    t = table(spark, d, "text_entries")
    full = F.when(F.col("filename").startswith("~/"), F.concat(F.lit("/home/u"), F.substring("filename", F.lit(2), F.length("filename")))).otherwise(F.col("filename"))
    return t.select("entry_id", full.alias("f"), text.home_relative(full, "/home/u").alias("short"))


@query("select event_id, (props::json ->> 'k')::bigint as k from events")
def json_map(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "map<string,bigint>")["k"].alias("k"))


# ---- tables and counts


@query("select source, count(*) as n, sum(case when text is null or text = '' then 1 else 0 end)::bigint as blank, max(n_chars) as longest, epoch_us(max(ingested_at)) as latest from documents group by source")
def stats_counts(spark, d):
    blank = F.col("text").isNull() | (F.col("text") == "")
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(blank).alias("blank"), F.max("n_chars").alias("longest"), F.unix_micros(F.max("ingested_at")).alias("latest"))


@query("""
select 'title' as field, count(*) filter (coalesce(title, '') = '') as missing from books union all select 'publisher', count(*) filter (coalesce(publisher, '') = '') from books union all
select 'creators', count(*) filter (len(coalesce(creators, [])) = 0) from books union all select 'doc_text', count(*) filter (coalesce(doc_text, '') = '') from books""")
def missing_fields(spark, d):
    """Books that lack a field or hold it empty."""
    return library.missing_fields(table(spark, d, "books"), ["title", "publisher", "creators", "doc_text"])


@query("select r_name as name, 'region' as kind from region union all select n_name, 'nation' from nation")
def union_tables(spark, d):
    r = table(spark, d, "region").select(F.col("r_name").alias("name"), F.lit("region").alias("kind"))
    return r.unionByName(table(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("kind")))


@query("select book_id, id from (select book_id, unnest(identifiers) as id from books) t where split_part(id, '/', 1) not in ('calibre', 'uuid')")
def identifiers(spark, d):
    return table(spark, d, "books").select("book_id", F.explode(library.own_identifiers(F.col("identifiers"))).alias("id"))


@query("select b.book_id, r.home_zone from books b join repositories r on b.repo_name = r.repo_name")
def small_side_join(spark, d):
    """A join whose small side is broadcast by its measured size."""
    return table(spark, d, "books").join(table(spark, d, "repositories"), "repo_name").select("book_id", "home_zone")


@query("""
select n_nationkey, '| ' || n_name || repeat(' ', greatest(24 - length(n_name), 0)) || ' |' as line from nation""")
def padded_cells(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("| "), render.padded(F.col("n_name"), 24), F.lit(" |")).alias("line"))


@query("""
select o_orderkey, '| ' || d || repeat(' ', greatest(24 - length(d), 0)) || ' | status: ' || o_orderstatus || ', priority...' || ' |' as line
from (select *, case when month(o_orderdate) = 1 and day(o_orderdate) = 1 then strftime(o_orderdate, '%Y') when day(o_orderdate) = 1 then strftime(o_orderdate, '%Y-%m') else strftime(o_orderdate, '%Y-%m-%d') end as d from orders) t""")
def event_lines(spark, d):
    """Events as lines of a Markdown table."""
    o = table(spark, d, "orders").withColumns({"jd_start": julian.timestamp_to_jd(F.date_trunc("day", "o_orderdate")), "jd_end": F.lit(None).cast("double"), "eventdata": F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))})
    return render.event_lines(o, 19).select("o_orderkey", "line")


# ---- pages and streams


@query("select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as n from events group by all")
def stream_event_windows(spark, d):
    """Daily counts by kind, as a stream over the table's files."""
    from ..streaming import events

    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet" if not is_folder(spark, f"{d}/events.parquet") else "*.parquet").parquet(d if not is_folder(spark, f"{d}/events.parquet") else f"{d}/events.parquet")
    stream = stream.withColumn("at", F.col("ts").cast("timestamp"))
    out = events.run_once(events.windowed_counts(stream, "at", ["event_type"]), ["start", "event_type"])
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")
