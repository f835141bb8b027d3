"""Queries on packages: metadata, search, totals, lookups, overlays and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import meta
from . import ordered


def package_entries(toc: DataFrame, names: DataFrame) -> DataFrame:
    """The listing of a package: TOC with names, method, alignment and texture text (A12, D2). Ids without a name show as themselves."""
    first = names.groupBy("asset_id").agg(F.min("path").alias("_path")).withColumnRenamed("asset_id", "_id")
    rows = toc.join(first, toc["asset_id"] == first["_id"], "left")
    info = F.when(meta.is_texture(F.col("flags")), meta.texture_info(F.col("meta1"), F.col("meta2")))
    return rows.select(F.coalesce("_path", "asset_id").alias("path"), "asset_id", F.col("data_offset").alias("offset"), "original_size", "compressed_size", meta.decode_alignment(F.col("flags")).alias("alignment"), meta.method_name(F.col("flags")).alias("method"), info.alias("metadata_info"))


def package_summary(toc: DataFrame, names: DataFrame, chunk_bytes: Column | None = None) -> DataFrame:
    """One row: entries, bytes of the table of contents and of the data section, kept apart."""
    n = toc.agg(F.count("*").alias("file_count"), F.coalesce(F.max(F.col("data_offset") + F.col("compressed_size")), F.lit(0)).cast("long").alias("data_bytes"), F.coalesce(F.sum("chunk_count"), F.lit(0)).cast("long").alias("_chunks"))
    b = names.agg(F.coalesce(F.sum(18 + F.octet_length("path")), F.lit(0)).cast("long").alias("name_bytes"))
    return n.withColumn("name_bytes", b.scalar()).select("file_count", "data_bytes", "name_bytes", (S.HEADER_BYTES + F.col("file_count") * S.ROW_BYTES + F.col("name_bytes") + 8 * F.col("_chunks")).alias("toc_bytes"))


def name_bytes(paths: DataFrame, path: str = "path") -> DataFrame:
    """Bytes of the name section: 18 and the UTF-8 path per row."""
    return paths.agg(F.coalesce(F.sum(18 + F.octet_length(path)), F.lit(0)).cast("long").alias("name_bytes"))


def search(entries: DataFrame, text: str, path: str = "path") -> DataFrame:
    return entries.filter(meta.matches(F.col(path), text))


def method_totals(entries: DataFrame, method: str = "method") -> DataFrame:
    """Per method: entries and both sizes."""
    return entries.groupBy(method).agg(F.count("*").alias("n"), F.sum("compressed_size").cast("long").alias("compressed"), F.sum("original_size").cast("long").alias("original"))


def distinct_first(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in the order (E5)."""
    rank = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    return df.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*df.columns), rank).alias("_r")).select("_r.*")


def to_map(df: DataFrame, key: str) -> DataFrame:
    """``df``, after a check that ``key`` is unique."""
    twice = df.groupBy(key).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"key {twice[0][0]!r} occurs {twice[0][1]} times")
    return df


def lookup(toc: DataFrame, ids: DataFrame, id_col: str = "asset_id") -> DataFrame:
    """TOC rows of the wanted ids."""
    return toc.join(ids.select(F.col(id_col).alias("_id")).distinct(), toc[id_col] == F.col("_id"), "left_semi")


def exists(wanted: DataFrame, entries: DataFrame, key: Column, entry_key: Column) -> DataFrame:
    """The wanted rows that have an entry."""
    return wanted.join(entries.select(entry_key.alias("_e")), key == F.col("_e"), "left_semi")


def matched(wanted: DataFrame, entries: DataFrame, key: str = "path") -> DataFrame:
    """Wanted paths with their entries; unmatched ones are left out."""
    return wanted.join(entries, key)


def folded(path: str = "path") -> Column:
    """Key under which paths are the same asset: slashes and case do not count."""
    return F.lower(F.replace(F.col(path), F.lit("\\"), F.lit("/")))


def overlay(layers: DataFrame, layer: str = "layer", path: str = "path") -> DataFrame:
    """Mounted archives as one view: of entries with one key the highest layer wins (D3, F8, H1)."""
    return layers.groupBy(folded(path).alias("_key")).agg(F.max_by(F.struct(*layers.columns), F.struct(F.col(layer).alias("l"), F.col(path).alias("p"))).alias("_r")).select("_r.*")


def mounted(layers: list[DataFrame]) -> DataFrame:
    """Layers in mount order as one table with their number."""
    out = layers[0].withColumn("layer", F.lit(0))
    for i, df in enumerate(layers[1:], 1):
        out = out.unionByName(df.withColumn("layer", F.lit(i)), allowMissingColumns=True)
    return out


def loose_override(loose: DataFrame, archived: DataFrame, path: str = "path") -> DataFrame:
    """Loose files, newest layer first, before any archive; then archives for what no folder has."""
    top = overlay(loose)
    keys = top.select(folded(path).alias("_loose"))
    rest = overlay(archived).join(keys, folded(path) == F.col("_loose"), "left_anti")
    return top.unionByName(rest, allowMissingColumns=True)


def source_of(wanted: DataFrame, view: DataFrame, source: str = "source", path: str = "path") -> DataFrame:
    """Wanted paths with the file name of the archive that serves them, or None as text."""
    known = view.select(folded(path).alias("_key"), meta.file_name(F.col(source)).alias("_source"))
    return wanted.join(known, folded(path) == F.col("_key"), "left").select(*wanted.columns, F.coalesce("_source", F.lit("None")).alias("source_archive"))


def difference(base: DataFrame, new: DataFrame, content: str = "content_hash", path: str = "path") -> DataFrame:
    """(path, change): added, modified or removed entries of ``new`` against ``base`` (D7), by content hash."""
    b = base.select(folded(path).alias("_b"), F.col(path).alias("_bp"), F.col(content).alias("_bh"))
    n = new.select(folded(path).alias("_n"), F.col(path).alias("_np"), F.col(content).alias("_nh"))
    both = b.join(n, F.col("_b") == F.col("_n"), "full")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col("_bh").eqNullSafe(F.col("_nh")), "modified")
    return both.select(F.coalesce("_np", "_bp").alias("path"), change.alias("change")).filter("change is not null")


def listing(opened: DataFrame, pending: DataFrame) -> DataFrame:
    """Entries of open archives and files to be added, in one list, nothing merged."""
    return opened.withColumn("pending", F.lit(False)).unionByName(pending.withColumn("pending", F.lit(True)), allowMissingColumns=True)


def pending(entries: DataFrame) -> DataFrame:
    return entries.filter("pending")


def preview(df: DataFrame, content: str = "content", n: int = 1024) -> DataFrame:
    """The first characters of each content."""
    return df.withColumn("preview", F.substring(F.col(content).cast("string"), 1, n))


def path_order(df: DataFrame, path: str = "path") -> DataFrame:
    return df.orderBy(*ordered.by_path(path))


def bytes_read(df: DataFrame, content: str = "content") -> DataFrame:
    """Sum of content lengths."""
    return df.agg(F.coalesce(F.sum(F.octet_length(content)), F.lit(0)).cast("long").alias("bytes"))
