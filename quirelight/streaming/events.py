"""Event streams: windowed counts with late data, and the incremental update of a keyed table.

The engine's batches need no stream; these serve sources that never end.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.diff import upsert
from ..session import delete_at_end, folders, remove, shared_dir


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, keys, n): counts by window; rows later than ``late`` behind the newest one are dropped."""
    x = stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))
    return x.select(F.col("window.start").alias("start"), *keys, "n")


#: Parts of a kept table; a micro-batch rewrites only those that its keys fall into.
BUCKETS = 64


def keep_latest(stream: DataFrame, root: str, key: list[str], order: list[str]) -> object:
    """Keep the latest row of each key in a versioned table below ``root``; returns the writer to start.

    Every micro-batch is reduced to one row a key, and the buckets it touches are merged with their last version and written under the batch's number, so
    a repeated batch writes the same version again and a lost executor costs a retry.
    """

    def latest(x: DataFrame) -> DataFrame:
        return x.groupBy(*key).agg(F.max_by(F.struct(*[F.col(c) for c in x.columns]), F.struct(*order)).alias("_w")).select("_w.*")

    merge = lambda batch, number: _merge(batch, number, root, key, lambda old, new: latest(new if old is None else old.unionByName(new)))
    return stream.writeStream.outputMode("append").foreachBatch(merge).option("checkpointLocation", f"{root}/_progress")


def _merge(batch: DataFrame, number: int, root: str, key: list[str], combine: Callable[[DataFrame | None, DataFrame], DataFrame]) -> None:
    """Write the buckets of a batch, combined with their newest versions below its number; versions that no retry needs any more are removed."""
    spark, bucket = batch.sparkSession, F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")
    batch.persist()
    touched = {r[0] for r in batch.select(bucket).distinct().collect()}  # at most BUCKETS numbers
    held = {b: [n for n in sorted(v) if n < number] for b, v in _held(spark, root).items() if b in touched}
    paths = [_folder(root, v[-1], b) for b, v in held.items() if v]
    merged = combine(spark.read.schema(batch.schema).parquet(*paths) if paths else None, batch)
    merged.withColumn("_bucket", bucket).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{root}/version={number:012d}")
    batch.unpersist()
    for b, v in held.items():
        for n in v[:-1]:  # a retry of this batch reads the last one
            remove(spark, _folder(root, n, b))


def _folder(root: str, version: int, bucket: int) -> str:
    return f"{root}/version={version:012d}/_bucket={bucket}"


def _held(spark: SparkSession, root: str) -> dict[int, list[int]]:
    """The versions of each bucket."""
    found: dict[int, list[int]] = {}
    for v in folders(spark, root, "version="):
        for b in folders(spark, f"{root}/{v}", "_bucket="):
            found.setdefault(int(b.partition("=")[2]), []).append(int(v.partition("=")[2]))
    return found


def versions(spark: SparkSession, root: str) -> DataFrame | None:
    """The kept table: the newest version of each of its buckets."""
    paths = [_folder(root, max(v), b) for b, v in _held(spark, root).items()]
    return spark.read.parquet(*paths) if paths else None


def run_once(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Run a stream over what is there now and return its result: updates of a key replace each other."""
    spark = counts.sparkSession
    root = f"{shared_dir(spark)}/quirelight/stream-{uuid.uuid4().hex}"
    delete_at_end(spark, root)
    merge = lambda batch, number: _merge(batch, number, root, keys, lambda old, new: new if old is None else upsert(old, new, keys))
    counts.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", f"{root}/_progress").trigger(availableNow=True).start().awaitTermination()
    got = versions(spark, root)
    return spark.createDataFrame([], counts.schema) if got is None else got
