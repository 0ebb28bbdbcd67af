"""Session helpers: table access, the shared folder, and lineage cuts."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once a session, so that clusters need no installed copy.

    The archive lies on the driver only; Spark hands it to the workers.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        here = Path(__file__).resolve().parent
        made = shutil.make_archive(tempfile.mkdtemp(prefix="quirelight-") + "/" + here.name, "zip", here.parent, here.name)
        spark.sparkContext.addPyFile(made)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only on a single machine (a local master, as in tests) a folder is made and set where the session leaves it unset.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.quirelight.localCheckpointDir", None)
    if not known:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="quirelight-")
        spark.conf.set("spark.quirelight.localCheckpointDir", known)
    return re.sub(r"^file:/(?!/)", "file:///", known.rstrip("/"))


def _path(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def create(spark: SparkSession, path: str, content: str) -> bool:
    """Create a small file; false if there is one of that name."""
    p, fs = _path(spark, path)
    try:
        out = fs.create(p, False)
    except Exception:
        if fs.exists(p):
            return False
        raise
    out.write(bytearray(content.encode()))
    out.close()
    return True


def is_folder(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Names of the folders directly below one that begin with a prefix."""
    p, fs = _path(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory() and x.getPath().getName().startswith(prefix)] if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the application ends."""
    try:
        p, fs = _path(spark, path)
        fs.deleteOnExit(p)
    except AttributeError:
        pass  # a remote session has no JVM handle


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back.

    It cuts the lineage like ``checkpoint()``, survives lost executors, and unlike it keeps columnar files, so
    that later readers prune columns, and partitions of ``partition_by``, and see true sizes when choosing a join.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quirelight/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*(partition_by or [])).parquet(path)
    delete_at_end(spark, path)  # the table lasts as long as the application
    return spark.read.schema(df.schema).parquet(path)


def parts(df: DataFrame, each: int) -> int:
    """Into how many partitions to spread ``df`` so that each holds about ``each`` bytes, and every core has some."""
    spark = df.sparkSession
    try:
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
        cores = spark.sparkContext.defaultParallelism
    except AttributeError:  # a remote session has no JVM handle
        size, cores = 0, 1
    return max(3 * cores, int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // each, 1_000_000))
