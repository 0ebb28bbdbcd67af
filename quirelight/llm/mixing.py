"""Mixing sources to target shares, in tokens of a public tokenizer.

Every source is shuffled by a hash of its ids and cut into blocks of equal numbers of tokens.  A mix is a row of slots; slot i
takes the golden-ratio point frac(i / phi) through the cumulative weights of the sources, so that every stretch of the mix
has nearly the target shares.  The slots of a source are ranked, rank r takes block r modulo the number of blocks, and ranks
beyond ``max_repeats`` rounds stay empty: that share is reported as unmet and goes to nobody else.

Running sums and ranks are made in two levels, within bounded buckets and over the buckets' totals, so that a source that
holds a third of all rows meets no single task.

Defined results: documents without tokens (null, empty) or without a source are not used, though null-source documents count
towards the size of the corpus; a target without documents gets no slot and the share 0; null or negative shares and repeats count as 0;
targets without a mix name are no targets; a repeated document is another document, a repeated
target adds to its share, with the larger repeats and ratio.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .tokens import token_count

#: Target size of a block in tokens, rows of a bucket of the running sums, and slots of a chunk.
BLOCK_TOKENS, BUCKET_ROWS, CHUNK_SLOTS = 2048, 65_536, 65_536
#: 2**32 divided by the golden ratio.
GOLDEN = 2_654_435_769


def golden_point(i: Column) -> Column:
    """frac(i / phi) in steps of 2**-32, by products below 2**63."""
    low, high = i % 65_536, F.floor(i / 65_536) % 65_536
    return ((low * GOLDEN + ((high * GOLDEN) % 65_536) * 65_536) % (1 << 32)) / float(1 << 32)


def sized(documents: DataFrame, ranks: str, seed: int = 0) -> DataFrame:
    """(doc_id, source, n_tokens, spot): sizes and places in the shuffle, stored once."""
    return stored(documents.select("doc_id", "source", token_count(ranks)("text").alias("n_tokens"), F.xxhash64(F.lit(seed), "doc_id").alias("spot")), "sized")


def source_totals(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Per source: tokens, documents, number and exact size of its blocks."""
    t = docs.where("n_tokens > 0 and source is not null").groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    n = F.greatest(F.lit(1), F.round(F.col("tokens") / block_tokens)).cast("bigint")
    return stored(t.withColumn("n_blocks", n).withColumn("block_size", F.col("tokens") / F.col("n_blocks")), "sources")


def blocks(docs: DataFrame, totals: DataFrame) -> DataFrame:
    """(source, block, doc_id, n_tokens): each document in the block its first token falls into."""
    unit = F.col("spot") / float(1 << 64) + 0.5
    x = docs.where("n_tokens > 0").join(totals, "source").withColumn("bucket", F.floor(unit * F.ceil(F.col("docs") / BUCKET_ROWS)))
    before = x.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("s"))
    before = before.select("source", "bucket", (F.sum("s").over(Window.partitionBy("source").orderBy("bucket")) - F.col("s")).alias("before"))
    inside = Window.partitionBy("source", "bucket").orderBy("spot", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("start", F.sum("n_tokens").over(inside) - F.col("n_tokens")).join(before, ["source", "bucket"])
    block = F.least(F.col("n_blocks") - 1, F.floor((F.col("before") + F.col("start")) / F.col("block_size")))
    return x.select("source", block.alias("block"), "doc_id", "n_tokens")


def weights(targets: DataFrame, totals: DataFrame, corpus_tokens: Column) -> DataFrame:
    """Targets with the tokens wanted, blocks, and the number of slots they ask for."""
    size = F.coalesce("total_ratio", F.lit(0.0)) * corpus_tokens
    t = targets.where("mix_name is not null").groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"), F.max("total_ratio").alias("total_ratio"))
    x = t.join(totals, "source", "left").withColumn("wanted", F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)) * size)
    return x.withColumn("asked", F.when(F.col("n_blocks").isNotNull(), F.col("wanted") / F.col("block_size")).otherwise(0.0))


def slots(w: DataFrame) -> DataFrame:
    """(mix_name, slot, source, repeat_no, block): which block fills which slot."""
    by_mix = Window.partitionBy("mix_name")
    cum = F.sum("asked").over(by_mix.orderBy("source").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("asked").over(by_mix)
    kept = w.where("asked > 0").withColumn("_cum", cum)
    plan = kept.groupBy("mix_name").agg(
        F.array_sort(F.collect_list(F.struct("_cum", "source", "n_blocks", F.coalesce("max_repeats", F.lit(0)).alias("max_repeats")))).alias("plan"),
        F.round(F.sum("asked")).cast("bigint").alias("n"),
    )
    chunks = plan.where("n > 0").withColumn("chunk", F.explode(F.expr(f"sequence(0l, (n - 1) div {CHUNK_SLOTS})"))).repartition("mix_name", "chunk")
    each = chunks.withColumn("slot", F.explode(F.expr(f"sequence(chunk * {CHUNK_SLOTS}, least(n, (chunk + 1) * {CHUNK_SLOTS}) - 1)")))
    point = golden_point(F.col("slot"))
    each = each.withColumn("_u", point).withColumn("_p", F.expr("coalesce(element_at(filter(plan, p -> p._cum > _u), 1), element_at(plan, -1))"))
    each = each.select("mix_name", "chunk", "slot", F.col("_p.source").alias("source"), F.col("_p.n_blocks").alias("n_blocks"), F.col("_p.max_repeats").alias("max_repeats"))
    each = each.withColumn("_r", F.row_number().over(Window.partitionBy("mix_name", "source", "chunk").orderBy("slot")) - 1)
    count = each.groupBy("mix_name", "source", "chunk").agg(F.count(F.lit(1)).alias("c"))
    count = count.select("mix_name", "source", "chunk", (F.sum("c").over(Window.partitionBy("mix_name", "source").orderBy("chunk")) - F.col("c")).alias("_before"))
    rank = F.col("_before") + F.col("_r")
    each = each.join(count, ["mix_name", "source", "chunk"]).withColumn("repeat_no", F.floor(rank / F.col("n_blocks"))).withColumn("block", rank % F.col("n_blocks"))
    return each.where("repeat_no < max_repeats").select("mix_name", "slot", "source", "repeat_no", "block")


def mix(documents: DataFrame, targets: DataFrame, ranks: str, block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The mixes and their report.

    Mix rows: (mix_name, slot, source, repeat_no, doc_id, n_tokens), one for each use of a document, in the order of ``slot``.
    Report rows: (mix_name, source, target_share, wanted_tokens, tokens, share_of_mix, share_of_wanted_mix, most_uses), one a target.
    """
    docs = sized(documents, ranks, seed)
    totals = source_totals(docs, block_tokens)
    w = stored(weights(targets, totals, docs.agg(F.sum("n_tokens")).scalar()), "weights")
    used = slots(w).join(blocks(docs, totals), ["source", "block"]).select("mix_name", "slot", "source", "repeat_no", "doc_id", "n_tokens")
    got = used.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("tokens"), (F.max("repeat_no") + 1).alias("most_uses"))
    t = w.select("mix_name", "source", "target_share", "wanted").join(got, ["mix_name", "source"], "left")
    tokens, by_mix = F.coalesce("tokens", F.lit(0)), Window.partitionBy("mix_name")
    report = t.select(
        "mix_name", "source", "target_share", F.round("wanted").cast("bigint").alias("wanted_tokens"), tokens.alias("tokens"),
        (tokens / F.nullif(F.sum(tokens).over(by_mix), F.lit(0))).alias("share_of_mix"), (tokens / F.nullif(F.sum("wanted").over(by_mix), F.lit(0.0))).alias("share_of_wanted_mix"),
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
    )
    return used, report
