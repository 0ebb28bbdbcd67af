"""Overlap chunks, vector search, merging of hits, highlighting, and the incremental index."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Texts of one call of the embedder.
EMBED_BATCH = 2048


def effective_overlap(size: int, overlap: int) -> int:
    """An overlap that is not smaller than the size counts as a third of the size, rounded down."""
    return overlap if overlap < size else size // 3


def chunk_count(text: Column, step: int) -> Column:
    n = F.length(text)
    return F.when(n > 0, F.floor((n - 1) / step).cast("int") + 1).otherwise(0)


def chunk(df: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """``df`` with chunk_no and chunk in place of the text; empty and null texts give no chunk.

    Chunk i begins at i times (size - overlap); the last ones may lie within the one before.
    """
    step = size - effective_overlap(size, overlap)
    n = chunk_count(F.col(text), step)
    x = df.where(F.length(text) > 0).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), n - 1)))
    return x.withColumn("chunk", F.substring(F.col(text), F.col("chunk_no") * step + 1, F.lit(size))).drop(text)


def span(text: Column, first: Column, count: Column, size: int, overlap: int) -> Column:
    """The text that ``count`` chunks from chunk ``first`` cover."""
    step = size - effective_overlap(size, overlap)
    return F.substring(text, (first * step + 1).cast("int"), (F.lit(size) + (count - 1) * step).cast("int"))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def scores(vectors: DataFrame, query: list[float], embedding: str = "embedding", out: str = "cosine") -> DataFrame:
    """``vectors`` with the dot product of each and the query, by matrix products over Arrow batches."""
    q = np.asarray(query, dtype=np.float64)

    @F.pandas_udf("double")
    def product(e: pd.Series) -> pd.Series:
        if not len(e):
            return pd.Series([], dtype="float64")
        same = e.map(lambda v: v is not None and len(v) == len(q))
        got = np.full(len(e), np.nan)
        if same.any():
            got[same.to_numpy()] = np.stack(e[same].to_numpy()).astype(np.float64) @ q
        return pd.Series(got).where(same.reset_index(drop=True), None)

    return vectors.withColumn(out, product(F.col(embedding)))


def top_k(scored: DataFrame, k: int, key: list[str], score: str = "cosine") -> DataFrame:
    """The k best, ties by key; planned as take-ordered, without a full sort."""
    return scored.where(F.col(score).isNotNull()).orderBy(F.col(score).desc(), *key).limit(k)


def merge_hits(hits: DataFrame, document: list[str], chunk_no: str = "chunk_no", score: str = "cosine") -> DataFrame:
    """Hits of neighbouring chunks as one span with its first chunk, count and best score."""
    w = Window.partitionBy(*document).orderBy(chunk_no)
    x = hits.withColumn("_island", F.col(chunk_no) - F.row_number().over(w))
    return x.groupBy(*document, "_island").agg(F.min(chunk_no).alias("first_chunk"), F.count(F.lit(1)).alias("n_chunks"), F.max(score).alias(score)).drop("_island")


def hashing_embedder(dimensions: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in for a model: signed counts of hashed words, unit length."""

    def encode(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dimensions))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % dimensions] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).tolist()

    return encode


def embed(chunks: DataFrame, encode: Callable[[list[str]], list[list[float]]], text: str = "chunk", out: str = "embedding", batch: int = EMBED_BATCH) -> DataFrame:
    """``chunks`` with a vector for each text; the encoder gets at most ``batch`` texts a call."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = s.fillna("").tolist()
            yield pd.Series([[float(x) for x in v] for i in range(0, len(texts), batch) for v in encode(texts[i : i + batch])], dtype=object)

    return chunks.withColumn(out, vectors(F.col(text)))


def windows(df: DataFrame, text: str, context: int = 16, step: int = 4) -> DataFrame:
    """Sliding windows of ``context`` characters every ``step`` characters, moved inward at both ends: (…, at, window)."""
    n = F.length(text)
    x = df.where(n > 0).withColumn("at", F.explode(F.sequence(F.lit(0), n - 1, F.lit(step))))
    start = F.greatest(F.lit(0), F.least(F.col("at") - context // 2, F.length(text) - context))
    return x.withColumn("window", F.substring(F.col(text), (start + 1).cast("int"), F.lit(context)))


def highlight(df: DataFrame, key: list[str], text: str, query: list[float], encode: Callable[[list[str]], list[list[float]]], context: int = 16, step: int = 4) -> DataFrame:
    """(key, yellow_liner): how well each place of a text fits the query, in the order of the places."""
    w = scores(embed(windows(df.select(*key, text), text, context, step), encode, "window"), query)
    return w.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "cosine"))), lambda s: s["cosine"].cast("float")).alias("yellow_liner"))


def search(index: DataFrame, texts: DataFrame, query: list[float], size: int, overlap: int, max_results: int = 2) -> DataFrame:
    """(desc, first_chunk, n_chunks, cosine, text) of the best chunks, neighbours merged, ordered by document and place.

    ``index`` has desc, chunk_no and embedding; ``texts`` has desc and text.  Only the k best rows meet the texts.
    """
    best = top_k(scores(index, query), max_results, ["desc", "chunk_no"])
    merged = merge_hits(best, ["desc"])
    x = merged.join(texts, "desc")
    return x.select("desc", "first_chunk", "n_chunks", "cosine", span(F.col("text"), F.col("first_chunk"), F.col("n_chunks"), size, overlap).alias("text")).orderBy("desc", "first_chunk")


def index_changes(known: DataFrame, current: DataFrame) -> DataFrame:
    """(desc, action) between an index's documents and the corpus, both (desc, text_hash): keep, add, replace or remove."""
    k, c = known.select("desc", F.col("text_hash").alias("_k")), current.select("desc", F.col("text_hash").alias("_c"))
    x = k.withColumn("_in", F.lit(1)).join(c.withColumn("_now", F.lit(1)), "desc", "full_outer")
    action = F.when(F.col("_in").isNull(), "add").when(F.col("_now").isNull(), "remove").when(F.col("_k").eqNullSafe(F.col("_c")), "keep").otherwise("replace")
    return x.select("desc", action.alias("action"))


def update_index(index: DataFrame, changes: DataFrame, texts: DataFrame, encode: Callable[[list[str]], list[list[float]]], size: int, overlap: int) -> DataFrame:
    """The index after the changes: removed and replaced documents leave, added and replaced ones are chunked and embedded anew."""
    kept = index.join(changes.where("action in ('remove', 'replace')").select("desc"), "desc", "left_anti")
    fresh = texts.join(changes.where("action in ('add', 'replace')").select("desc"), "desc", "left_semi")
    new = embed(chunk(fresh.select("desc", "text"), "text", size, overlap), encode).select("desc", "chunk_no", "embedding")
    return kept.select("desc", "chunk_no", "embedding").unionByName(new)


def index_is_whole(index: DataFrame, texts: DataFrame, size: int, overlap: int) -> DataFrame:
    """Documents whose number of chunks differs from what their text asks for; no rows for a whole index."""
    step = size - effective_overlap(size, overlap)
    have = index.groupBy("desc").agg(F.count(F.lit(1)).alias("have"))
    want = texts.select("desc", chunk_count(F.col("text"), step).alias("want")).where("want > 0")
    return have.join(want, "desc", "full_outer").where(~F.col("have").eqNullSafe(F.col("want")))


def cached_texts(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with text, files still to read) of (desc, file_size) against a cache (desc, file_size, text)."""
    hits = files.join(cache.select("desc", "file_size", "text"), ["desc", "file_size"])
    return hits, files.join(cache.select("desc", "file_size"), ["desc", "file_size"], "left_anti")


def top_k_per_query(vectors: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(query_id, vec_id, cosine, rank): the k best vectors for each query vector, the query itself left out; ties by vec_id.

    Queries and vectors (vec_id, embedding) come in blocks of about ``block`` rows; every block of the one meets every block of the other as one
    matrix product that keeps k rows a query, so what moves on is k rows per query and block, never all pairs.  Null vectors, and those of another length than
    the queries' longest, meet nothing.
    """
    n_q, width = queries.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    queries, vectors = (x.where((F.size("embedding") == (width or 0)) & F.col("vec_id").isNotNull()) for x in (queries, vectors))
    n_v = vectors.count()
    bq, bv = max(1, -(-n_q // block)), max(1, -(-n_v // block))
    q = queries.select(F.pmod(F.xxhash64("vec_id"), F.lit(bq)).alias("qb"), F.lit(True).alias("q"), "vec_id", "embedding").withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(bv - 1))))
    v = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(bv)).cast("int").alias("vb"), F.lit(False).alias("q"), "vec_id", "embedding").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(bq - 1))))
    both = q.select("qb", "vb", "q", "vec_id", "embedding").unionByName(v.select(F.col("qb").cast("bigint"), "vb", "q", "vec_id", "embedding"))

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        qs, vs = pdf[pdf.q].reset_index(drop=True), pdf[~pdf.q].reset_index(drop=True)
        if not len(qs) or not len(vs):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "cosine": pd.Series(dtype="float64")})
        ids = vs.vec_id.to_numpy()
        s = np.stack(qs.embedding.to_numpy()).astype(np.float64) @ np.stack(vs.embedding.to_numpy()).astype(np.float64).T
        out = []
        for i, query in enumerate(qs.vec_id):
            best = np.lexsort((ids, -np.round(s[i], 9)))[: k + 1]
            out += [(query, ids[j], s[i, j]) for j in best if ids[j] != query]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "cosine"])

    near = both.groupBy("qb", "vb").applyInPandas(product, "query_id bigint, vec_id bigint, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.round("cosine", 9).desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
