"""Files as tables."""

from __future__ import annotations

import fnmatch
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_map(spark: SparkSession, root: str) -> DataFrame:
    """(abs_path, rel_path, length) of all files below ``root``; contents are not read. A missing root gives no rows, a single file its own name."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return spark.createDataFrame([], "abs_path string, rel_path string, length bigint")
    status = fs.getFileStatus(path)
    base = status.getPath().toString()
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # scans leave out empty files, so names come from the listing that the scan itself keeps on the driver
    names = spark.createDataFrame([(unquote(f),) for f in found.inputFiles()], "_f string").withColumn("_k", _key("_f"))
    sizes = found.select(_key("path").alias("_p"), "length")
    rows = names.join(sizes, F.col("_k") == F.col("_p"), "left")
    start = len(urlparse(base).path) + 2
    rel = F.substring_index(F.col("_k"), "/", -1) if status.isFile() else F.substring(F.col("_k"), F.lit(start), F.length("_k"))
    return rows.select(F.col("_f").alias("abs_path"), rel.alias("rel_path"), F.coalesce("length", F.lit(0)).cast("long").alias("length"))


def _key(c: str) -> Column:
    """A file's path without scheme and host, which listings write in several ways."""
    return F.regexp_replace(F.col(c), "^[a-zA-Z0-9+.-]+:(//[^/]*)?", "")


def read_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(path relative to ``root``, content, length)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    names = file_map(spark, root).select(_key("abs_path").alias("_abs"), F.col("rel_path").alias("path"))
    if pattern:
        names = names.filter(F.regexp_replace("path", "^.*/", "").rlike(fnmatch.translate(pattern).replace("(?s:", "(?:").replace("\\Z", "$").replace("\\z", "$")))
    raw = reader.load(root).select(_key("path").alias("_p"), "content", "length")
    out = names.join(raw, F.col("_p") == F.col("_abs"), "left")
    return out.select("path", F.coalesce("content", F.unhex(F.lit(""))).alias("content"), F.coalesce("length", F.lit(0)).cast("long").alias("length"))


def synthetic(spark: SparkSession, n_json: int = 3000, n_blobs: int = 30, blob_bytes: int = 4 << 20, seed: int = 42) -> DataFrame:
    """(path, content): small JSON objects and large wave-like blobs with noise, the same every time."""
    node = F.format_string("%04d", F.col("id"))
    json = spark.range(n_json).select(F.concat(F.lit("metadata/node_"), node, F.lit(".json")).alias("path"), F.to_json(F.struct("id", F.md5((F.col("id") + seed).cast("string")).alias("salt"), F.lit("payload").alias("payload"))).cast("binary").alias("content"))
    unit = 4096
    bytes_of = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(unit - 1).cast("long")), lambda i: F.lpad(F.hex(F.pmod((128 + 60 * F.sin((F.col("part") * unit + i) * 0.05) + 40 * F.cos((F.col("part") * unit + i) * 0.001) + F.pmod(F.xxhash64(F.col("part") * unit + i, F.lit(seed)), F.lit(48))).cast("long"), F.lit(256))), 2, "0"))
    parts = spark.range(max(1, blob_bytes // unit)).withColumnRenamed("id", "part").select("part", F.array_join(bytes_of, "").alias("h"))
    one = parts.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), "").alias("h"))
    names = spark.range(n_blobs).select(F.concat(F.lit("textures/tex_4k_aligned_"), F.format_string("%02d", F.col("id")), F.lit(".dds")).alias("path"))
    return json.unionByName(names.select("path", F.unhex(one.scalar()).alias("content")))
