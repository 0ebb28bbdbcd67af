"""Queries of the language-model problems over their whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_at_end, shared_dir, table
from . import lookalike, mixing, names, ocr, splitting, tokens


def sized_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``text_entries`` with the chunk size and overlap of their state; the six states join by their measured size."""
    states = table(spark, sf_dir, "index_states").select("state_id", "chunk_size", "chunk_overlap")
    return table(spark, sf_dir, "text_entries").select("entry_id", "state_id", "text").join(states, "state_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.found(ocr.book_texts(table(spark, sf_dir, "books")))


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.repaired(ocr.book_texts(table(spark, sf_dir, "books")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.variant_pairs(names.distinct_names(table(spark, sf_dir, "books")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = splitting.split_summary(sized_entries(spark, sf_dir), "entry_id", "text", F.col("chunk_size"), F.col("chunk_overlap"))
    kinds = F.array(F.when(F.col("n_pieces") > 1, F.lit("oversized")), F.when(F.col("longest_run") > F.col("size"), F.lit("unspaced")))
    return x.select(F.col("id").alias("entry_id"), F.explode(kinds).alias("case_kind")).where("case_kind is not null")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_texts(sized_entries(spark, sf_dir), "entry_id", "text", F.col("chunk_size"), F.col("chunk_overlap"))


def p5_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text put together again from its pieces without their overlaps, and whether every piece is within the size."""
    size, overlap = F.col("chunk_size"), F.col("chunk_overlap")
    states = sized_entries(spark, sf_dir).select("entry_id", size, F.when(overlap < size, overlap).otherwise(F.floor(size / 3)).cast("int").alias("_o"))
    x = p5_pieces(spark, sf_dir).join(states, "entry_id")
    own = F.when(F.col("piece_no") == 0, F.col("piece")).otherwise(F.substring("piece", F.col("_o") + 1, F.length("piece")))
    each = F.array_sort(F.collect_list(F.struct("piece_no", own.alias("s"))))
    x = x.groupBy("entry_id").agg(each.alias("l"), F.min(F.length("piece") <= F.col("chunk_size")).alias("fits"))
    return x.select("entry_id", F.md5(F.array_join(F.transform("l", lambda s: s["s"]), "").cast("binary")).alias("md5"), "fits")


def p5_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of each state written to files, which are split by byte ranges: whether the pieces cover every character once, but for overlaps."""
    path = f"{shared_dir(spark)}/quirelight/packed-{uuid.uuid4().hex}"
    sized_entries(spark, sf_dir).where("text is not null").select("state_id", "text").write.partitionBy("state_id").text(path)
    delete_at_end(spark, path)
    states = table(spark, sf_dir, "index_states").select("state_id", F.col("chunk_size").alias("size"), F.col("chunk_overlap").alias("overlap"))
    files = splitting.files_of(spark, path).withColumn("state_id", F.regexp_extract("path", r"state_id=(\d+)", 1).cast("int")).join(states, "state_id")
    x = splitting.split_files(files, 1 << 18).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("piece")).alias("total"), F.max("end").alias("chars"), F.max(F.length("piece")).alias("longest"))
    o = F.when(F.col("overlap") < F.col("size"), F.col("overlap")).otherwise(F.floor(F.col("size") / 3))
    x = x.join(files, "path").groupBy("state_id").agg(F.sum("chars").alias("chars"), F.min(F.col("longest") <= F.col("size")).alias("fits"), F.min(F.col("total") - o * (F.col("n") - 1) == F.col("chars")).alias("covers"))
    return x


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_table(table(spark, sf_dir, "documents"), tokens.ranks_path())


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), tokens.ranks_path())[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), tokens.ranks_path())[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.same_look_pairs(table(spark, sf_dir, "documents"))


def p4_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity of every spelling; unlike pairs it grows only with the spellings."""
    return names.entities(names.distinct_names(table(spark, sf_dir, "books")))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document turned back into bytes."""
    ids = p6_ids(spark, sf_dir)
    return ids.select("doc_id", F.md5(tokens.token_bytes(tokens.ranks_path())(F.col("ids"))).alias("md5"))


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each target's documents are used no more often than allowed, and its tokens are those wanted or, where the source is too small, all it may give."""
    docs, targets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")
    used, shares = mixing.mix(docs, targets, tokens.ranks_path())
    uses = used.groupBy("mix_name", "source", "doc_id").agg(F.count(F.lit(1)).alias("n")).groupBy("mix_name", "source").agg(F.max("n").alias("uses"))
    have = docs.groupBy("source").agg(F.sum(tokens.token_count(tokens.ranks_path())("text")).alias("have")).where("have > 0")
    x = shares.join(targets.select("mix_name", "source", "max_repeats"), ["mix_name", "source"]).join(have, "source").join(uses, ["mix_name", "source"], "left")
    expected = F.least(F.col("wanted_tokens"), F.col("max_repeats") * F.col("have"))
    near = F.abs(F.col("tokens") - expected) <= F.greatest(F.lit(4.0 * mixing.BLOCK_TOKENS), expected * 0.02)
    return x.select("mix_name", "source", (F.coalesce("uses", F.lit(0)) <= F.col("max_repeats")).alias("capped"), near.alias("reached"))


def p8_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every visible text keeps its look with other blanks, look-alike letters, invisible characters and line ends."""
    swapped = F.replace(F.translate("text", "aeo ", "\u0430\u0435\u043e\u00a0"), F.lit("n"), F.lit("n\u200b"))
    swapped = F.replace(F.replace(swapped, F.lit("\r\n"), F.lit("\n")), F.lit("\n"), F.lit("\r\n"))
    x = table(spark, sf_dir, "documents").select("doc_id", lookalike.looks(F.col("text")).alias("a"), lookalike.looks(swapped).alias("b"))
    return x.where("a is not null").select("doc_id", F.col("a").eqNullSafe(F.col("b")).alias("same"))


QUERIES = {f.__name__: f for f in (p3_found, p3_repaired, p4_found, p4_entities, p5_found, p5_pieces, p5_rebuilt, p5_files, p6_ids, p6_decoded, p7_mix, p7_shares, p7_checks, p8_found, p8_variants)}

_SPACE = "[\\s\\x{85}\\p{Z}\\x{0b}\\x{1c}-\\x{1f}]"
ORACLES = {
    "p5_found": f"""
with t as (select entry_id, text, chunk_size from text_entries join index_states using (state_id) where text is not null)
select entry_id, 'oversized' as case_kind from t where length(text) > chunk_size union all
select entry_id, 'unspaced' from t where list_max([length(x) for x in regexp_split_to_array(text, '{_SPACE}')]) > chunk_size""",
    "p5_rebuilt": "select entry_id, md5(text) as md5, true as fits from text_entries join index_states using (state_id) where length(text) > 0",
    "p5_files": "select state_id, sum(length(text) + 1)::bigint as chars, true as fits, true as covers from text_entries join index_states using (state_id) where text is not null group by state_id",
    "p6_decoded": "select doc_id, md5(coalesce(text, '')) as md5 from documents",
    "p7_checks": "select mix_name, source, true as capped, true as reached from mix_targets where source in (select source from documents where length(text) > 0)",
    "p8_variants": "select doc_id, true as same from documents where regexp_matches(text, '[^\\s\\p{Z}\\p{C}\\x{ad}\\x{115f}\\x{1160}\\x{3164}\\x{ffa0}\\x{2800}\\x{fe00}-\\x{fe0f}\\x{34f}]')",
}
