"""Chunks of assets: split, sizes, offsets, lookup by position, reassembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import codecs
from . import ordered


def count(size: Column, chunk: int = S.CHUNK_BYTES) -> Column:
    """Chunks of an asset; an empty one still has a chunk of no bytes."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(size / F.lit(chunk)).cast("long"))


def sizes(df: DataFrame, key: str = "path", size: str = "size", chunk: int = S.CHUNK_BYTES) -> DataFrame:
    """(key, chunk_idx, chunk_size)."""
    idx = F.explode(F.sequence(F.lit(0).cast("long"), count(F.col(size), chunk) - 1)).alias("i")
    return df.select(key, F.col(size).alias("_n"), idx).select(key, F.col("i").cast("int").alias("chunk_idx"), F.least(F.lit(chunk).cast("long"), F.col("_n") - F.col("i") * chunk).alias("chunk_size"))


def split(df: DataFrame, key: str = "path", content: str = "content", chunk: int = S.CHUNK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """(key, kept columns, chunk_idx, raw): the chunks' bytes."""
    keep = keep or []
    n = F.octet_length(F.col(content))
    idx = F.explode(F.sequence(F.lit(0).cast("long"), count(n, chunk) - 1)).alias("i")
    at = (F.col("i") * chunk + 1).cast("int")
    return df.select(key, *keep, content, idx).select(key, *keep, F.col("i").cast("int").alias("chunk_idx"), F.substring(F.col(content), at, F.lit(chunk)).alias("raw"))


def encode(chunks: DataFrame, method: Column, level: int = 9) -> DataFrame:
    """Chunks (with raw) to data, compressed_size, original_size."""
    out = codecs.by_row(chunks.withColumn("_m", method), lambda raw, m: codecs.encoded(raw, m, level), ["raw", "_m"], {"data": "binary", "compressed_size": "long", "original_size": "long"})
    return out.select(*[c for c in chunks.columns if c != "raw"], "data", "compressed_size", "original_size")


def decode(chunks: DataFrame, method: Column) -> DataFrame:
    """Chunks (with data and sizes) to raw; the stored data are not kept."""
    rows = chunks.withColumns({"_m": method, "_n": F.col("original_size")})
    out = codecs.by_row(rows, lambda data, n, m: (None if data is None else codecs.decompress_bytes(data, n, m),), ["data", "_n", "_m"], {"raw": "binary"})
    return out.select(*[c for c in chunks.columns if c != "data"], "raw")


def decodes(chunks: DataFrame, method: Column, keep: list[str]) -> DataFrame:
    """(kept columns, ok): whether each chunk decodes to its original size."""
    rows = chunks.select(*keep, "data", F.col("original_size").alias("_n"), method.alias("_m"))
    return codecs.by_row(rows, lambda data, n, m: (codecs.decodes(data, n, m),), ["data", "_n", "_m"], {"ok": "boolean"})


def offsets(chunks: DataFrame, key: str = "path", size: str = "chunk_size", name: str = "chunk_offset") -> DataFrame:
    """``chunks`` with each chunk's place in its asset: the sum of the sizes before it (F2)."""
    w = W.partitionBy(key).orderBy("chunk_idx").rowsBetween(W.unboundedPreceding, -1)
    return chunks.withColumn(name, F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))


def at_position(chunks: DataFrame, wanted: DataFrame, key: str = "path", size: str = "chunk_size", position: str = "pos") -> DataFrame:
    """For rows (key, position), the first chunk that ends after the position (F4); a position past the end finds none."""
    placed = offsets(chunks, key, size, "_from").select(F.col(key).alias("_key"), "chunk_idx", "_from", size)
    near = wanted.join(placed, F.col(key) == F.col("_key"))
    return near.filter((F.col(position) >= F.col("_from")) & (F.col(position) < F.col("_from") + F.col(size))).select(*wanted.columns, "chunk_idx", (F.col(position) - F.col("_from")).alias("in_chunk"))


def assemble(chunks: DataFrame, key: str = "path", data: str = "raw", name: str = "content") -> DataFrame:
    """Assets from their chunks, in order (J8). A group is one asset, which fits one value."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_idx", F.col(data).alias("d"))))
    rows = chunks.groupBy(key).agg(parts.alias("_p")).select(key, F.transform("_p", lambda x: x["d"]).alias("_p"))
    return codecs.by_row(rows, lambda p: (codecs.join_chunks(p),), ["_p"], {name: "binary"})


def restore(stored: DataFrame, method: Column, key: str = "path", name: str = "content", more: DataFrame | None = None) -> DataFrame:
    """Assets from their stored chunks, which meet before they are decoded: less to shuffle, and one pass through Python.

    ``more`` has further columns by the key; it joins the assets as they lie, before they grow.
    """
    parts = F.array_sort(F.collect_list(F.struct("chunk_idx", "original_size", "data")))
    rows = stored.withColumn("_m", method).groupBy(key).agg(parts.alias("_p"), F.first("_m").alias("_m"))
    if more is not None:
        rows = rows.join(more.hint("shuffle_hash"), key)
    return codecs.by_row(rows, lambda p, m: (codecs.joined(p, m),), ["_p", "_m"], {name: "binary"})


def load(chunks: DataFrame, key_value: object, idx: int, method: Column, key: str = "asset_id") -> DataFrame:
    """One decoded chunk (J9); the filter reaches the scan."""
    return decode(chunks.filter((F.col(key) == F.lit(key_value)) & (F.col("chunk_idx") == idx)), method)


def totals(df: DataFrame, chunks: str = "chunks") -> DataFrame:
    """``df`` with the sums over each row's chunk array."""
    total = lambda f: F.aggregate(chunks, F.lit(0).cast("long"), lambda acc, x: acc + x[f])
    return df.withColumn("sum_compressed", total("compressed_size")).withColumn("sum_original", total("original_size"))


def rebase(chunks: DataFrame, key: str = "path", size: str = "chunk_size") -> DataFrame:
    """``chunks`` with batch_offset: assets concatenated in path order, chunks in theirs."""
    order = [*ordered.by_path(key), F.col("chunk_idx")]
    return ordered.running(chunks, order, {"batch_offset": F.col(size)})
