"""Book libraries: metadata files, documents beside them, sidecars and targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashes import digest, sparse_md5
from ..functions.text import nfc, short_title, strip_articles

FORMATS = ("pdf", "epub", "md", "txt")
SKIPPED = (".caltrash", ".calnotes")


def _paths(x: DataFrame, root: str, column: str) -> DataFrame:
    base = root.removeprefix("file://").rstrip("/") + "/"
    p = F.url_decode(F.replace(F.col(column), F.lit("+"), F.lit("%2B")))
    return x.withColumn("path", F.substring(p, F.locate(base, p) + len(base), F.length(p)))


def folder(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def read_metadata(spark: SparkSession, root: str) -> DataFrame:
    """(path, opf): the metadata files below ``root`` outside trash and notes folders."""
    x = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "metadata.opf").text(root, wholetext=True)
    x = _paths(x.select(F.col("value").alias("opf"), F.col("_metadata.file_path").alias("_p")), root, "_p")
    for s in SKIPPED:
        x = x.where(~F.contains("path", F.lit(s)))
    return x.select("path", "opf")


def _first(opf: Column, tag: str) -> Column:
    return F.coalesce(F.xpath_string(opf, F.lit(f"//*[name()='dc:{tag}'][1]/text()")), F.lit(""))


def _all(opf: Column, path: str) -> Column:
    return F.coalesce(F.xpath(opf, F.lit(path)), F.array().cast("array<string>"))


def utc_text(ts: Column) -> Column:
    """The first 19 characters of a time as UTC, whatever zone is written behind; null if they are no time."""
    t = F.substring(ts, 1, 19)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"), F.concat(t, F.lit("+00:00")))


def parse_metadata(files: DataFrame) -> DataFrame:
    """Book entries of metadata files: fields are empty where the file has none; creators are those with the role ``aut``."""
    o = F.col("opf")
    meta = lambda n: F.coalesce(F.xpath_string(o, F.lit(f"//*[local-name()='meta' and @name='{n}']/@content")), F.lit(""))
    scheme = "//*[name()='dc:identifier' and @*[local-name()='scheme']]"
    ids = own_identifiers(F.zip_with(_all(o, f"{scheme}/@*[local-name()='scheme']"), _all(o, f"{scheme}/text()"), lambda s, v: F.concat_ws("/", s, v)))
    by_id = lambda n: F.coalesce(F.xpath_string(o, F.lit(f"//*[name()='dc:identifier' and @id='{n}']/text()")), F.lit(""))
    series = meta("calibre:series")
    creators = _all(o, "//*[name()='dc:creator' and @*[local-name()='role']='aut']/text()")
    sort = strip_articles(meta("calibre:title_sort"))
    return files.select(
        "path", folder(F.col("path")).alias("folder"), _first(o, "title").alias("title"), sort.alias("title_sort"), short_title(_first(o, "title"), sort, creators, nfc).alias("short_title"), series.alias("short_folder"),
        _first(o, "description").alias("description"), creators.alias("creators"), series.alias("series"), _all(o, "//*[name()='dc:subject']/text()").alias("subjects"),
        _all(o, "//*[name()='dc:language']/text()").alias("languages"), _first(o, "publisher").alias("publisher"), ids.alias("identifiers"), by_id("uuid_id").alias("uuid"), by_id("calibre_id").alias("calibre_id"),
        F.coalesce(utc_text(_first(o, "date")), F.lit("")).alias("publication_date"), F.coalesce(utc_text(meta("calibre:timestamp")), F.lit("")).alias("date_added"), F.concat(F.lit("Books/"), series).alias("context"),
    )


def read_documents(spark: SparkSession, root: str, formats: tuple[str, ...] = FORMATS, hash_algo: str = "crc32") -> DataFrame:
    """(path, folder, name, format, size, hash, hash_algo, kosync_md5, mod_time) of the documents below ``root``."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(formats) + "}").load(root)
    x = _paths(x.withColumnRenamed("path", "_p"), root, "_p")
    for s in SKIPPED:
        x = x.where(~F.contains("path", F.lit(s)))
    name = F.element_at(F.split(nfc("path"), "/"), -1)
    return x.select(
        "path", folder(F.col("path")).alias("folder"), name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("format"), F.col("length").alias("size"),
        digest(F.col("content"), hash_algo).alias("hash"), F.lit(hash_algo).alias("hash_algo"), sparse_md5(F.col("content")).alias("kosync_md5"), F.unix_micros("modificationTime").cast("double").__truediv__(1e6).alias("mod_time"),
    )


def read_text_siblings(spark: SparkSession, root: str) -> DataFrame:
    """(folder, doc_text): the text beside a book; of several the last name counts."""
    x = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root, wholetext=True)
    x = _paths(x.select("value", F.col("_metadata.file_path").alias("_p")), root, "_p")
    return x.groupBy(folder(F.col("path")).alias("folder")).agg(F.max_by("value", "path").alias("doc_text"))


def load_library(spark: SparkSession, root: str, hash_algo: str = "crc32", load_text: bool = False) -> DataFrame:
    """Book entries with their documents, formats and latest change; text only where asked for."""
    books = parse_metadata(read_metadata(spark, root))
    d = read_documents(spark, root, hash_algo=hash_algo)
    item = F.struct("path", "name", "size", "hash", "hash_algo", "kosync_md5", "mod_time", F.lit("").alias("ref_name"))
    docs = d.groupBy("folder").agg(F.array_sort(F.collect_list(item)).alias("docs"), F.array_sort(F.collect_set("format")).alias("formats"), F.max("mod_time").alias("latest"))
    x = books.join(docs, "folder", "left")
    return x.join(read_text_siblings(spark, root), "folder", "left") if load_text else x


def own_identifiers(ids: Column) -> Column:
    """The identifiers (``scheme/value``) that other houses gave; the library's own numbers are left out."""
    return F.filter(ids, lambda x: ~F.substring_index(x, "/", 1).isin("calibre", "uuid"))


def missing_fields(entries: DataFrame, mandatory: list[str]) -> DataFrame:
    """One row (field, missing): how many entries lack a mandatory field, or hold it empty as the loader does."""
    empty = {"string": lambda c: c == "", "array": lambda c: F.size(c) == 0}
    lacks = lambda f: F.col(f).isNull() | empty.get(entries.schema[f].dataType.typeName(), lambda c: F.lit(False))(F.col(f))
    counts = entries.agg(*[F.count_if(lacks(f)).alias(f) for f in mandatory])
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, mandatory)), F.array(*mandatory))).alias("field", "missing"))


def read_target(spark: SparkSession, root: str, hash_algo: str = "crc32") -> DataFrame:
    """(path, hash, hash_algo) of a target folder without hidden files and folders, state and annotations."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    x = _paths(x.withColumnRenamed("path", "_p"), root, "_p")
    parts = F.split("path", "/")
    x = x.where(~F.exists(parts, lambda p: p.startswith(".")) & ~F.element_at(parts, -1).isin("repo_state.json", "annotations.json"))
    return x.select(nfc("path").alias("path"), digest(F.col("content"), hash_algo).alias("hash"), F.lit(hash_algo).alias("hash_algo"))


def sidecars(files: DataFrame) -> DataFrame:
    """(title, formats) of the ``.sdr`` folders in a list of paths."""
    rx = r"(?:^|/)([^/]+)\.sdr/metadata\.(epub|pdf)\.lua$"
    x = files.select(F.regexp_extract("path", rx, 1).alias("title"), F.regexp_extract("path", rx, 2).alias("f")).where("title <> ''")
    return x.groupBy("title").agg(F.array_sort(F.collect_set("f")).alias("formats"))
