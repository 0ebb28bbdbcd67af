"""Versioned states: snapshots of entries with a sequence number, and the index of a search corpus."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import model_folder
from ..session import create, exists

MANIFEST = "sequence_number bigint, timestamp string, path string"


def last_state(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """(sequence number, path) of the newest snapshot below ``root``; (0, None) without one."""
    if not exists(spark, f"{root}/manifest"):
        return 0, None
    top = spark.read.schema(MANIFEST).json(f"{root}/manifest").where("path is not null").orderBy(F.col("sequence_number").desc()).limit(1).collect()
    return (top[0].sequence_number, top[0].path) if top else (0, None)


def save_state(entries: DataFrame, root: str, expected: int | None = None) -> int:
    """Write a snapshot under the next sequence number and return it.

    The entries go under a name of their own and count only from the moment the manifest's file of that number is created, which fails if there is one: of two
    writers one gets the number.  With ``expected`` the other is refused, else it takes the number after.
    """
    spark = entries.sparkSession
    now, _ = last_state(spark, root)
    if expected is not None and now != expected:
        raise RuntimeError(f"the state is at {now}, not at {expected}")
    path = f"{root}/entries/{uuid.uuid4().hex}"
    entries.write.parquet(path)
    while True:
        now += 1
        when = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S+00:00")
        if create(spark, f"{root}/manifest/{now:012d}.json", json.dumps({"sequence_number": now, "timestamp": when, "path": path})):
            return now
        if expected is not None:
            raise RuntimeError(f"state {now} was written meanwhile")


def load_state(spark: SparkSession, root: str) -> DataFrame | None:
    _, path = last_state(spark, root)
    return spark.read.parquet(path) if path else None


def save_index(index: DataFrame, root: str, model: str) -> str:
    """Write vectors of one model under the model's folder."""
    path = f"{root}/model={model.replace('/', '-')}"
    index.write.mode("overwrite").parquet(path)
    return path


def save_text_cache(texts: DataFrame, root: str) -> None:
    """Append (desc, file_size, text) to the cache of extracted texts."""
    texts.select("desc", "file_size", "text").write.mode("append").parquet(root)


def model_paths(models: DataFrame, column: str) -> DataFrame:
    return models.withColumn("folder", model_folder(F.col(column)))
