"""Whole jobs on packages: pack, info, unpack, verify, patch (A9-A12, D7, E8), with tables as the stored form.

A package is a folder of Parquet tables: ``toc`` and ``names`` (small, sorted by
asset id, so lookups prune by min and max), ``chunk`` (sizes per chunk) and
``blob`` (one copy of each distinct stored content, cut into chunks). Metadata
queries never touch ``blob``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import crypto, dds, ids, meta
from ..operators import catalog, chunks, layout, ordered
from ..session import shared_table


def assets(files: DataFrame, method: str = "Auto", split_mips: bool = False) -> DataFrame:
    """Files (path, content) with id, method, alignment, flags and texture metadata."""
    base = files.withColumn("method", meta.choose_method(F.col("path"), method)).withColumn("align", meta.alignment(F.col("method")))
    texture = meta.has_suffix(F.col("path"), ".dds")
    head = F.when(texture, dds.header(F.col("content")))
    base = base.withColumn("_head", head)
    if split_mips:
        plan = F.when(texture, dds.split_plan(F.col("content")))
        base = base.withColumn("_new", dds.split_rewrite(F.col("content"), plan)).withColumn("content", F.col("_new.content")).withColumn("_tail", F.col("_new.tail_size")).drop("_new")
    else:
        base = base.withColumn("_tail", F.lit(0).cast("long"))
    known = F.col("_head").isNotNull()
    zero = F.lit(0).cast("long")
    m1, m2 = meta.encode_texture(F.col("_head.width").cast("long"), F.col("_head.height").cast("long"), F.col("_head.mip_count").cast("long"), F.col("_tail"))
    flags = meta.encode_flags(F.col("method"), F.col("align"), texture=known)
    out = base.withColumn("flags", flags).withColumn("meta1", F.when(known, m1).otherwise(zero)).withColumn("meta2", F.when(known, m2).otherwise(zero))
    return out.withColumn("asset_id", ids.asset_id(F.col("path"))).drop("_head", "_tail")


def pack(files: DataFrame, path: str, method: str = "Auto", level: int = 9, dedup: bool = True, passphrase: str | None = None, split_mips: bool = False, chunk: int = S.CHUNK_BYTES) -> None:
    """Write files (path, content) as a package at ``path``. Two paths that differ only by case or slashes are refused.

    Equal contents with equal method and alignment are compressed once and stored once; only hashes and sizes are shuffled
    to find them. With a passphrase the chunk tables are encrypted, payloads are not.
    """
    meta.check_level(method, level)
    rows = assets(files, method, split_mips).withColumn("content_hash", F.sha2(F.concat(F.sha2("content", 256).cast("binary"), F.col("method").cast("string").cast("binary"), F.col("align").cast("string").cast("binary")), 256))
    slim = shared_table(rows.withColumn("original_size", F.octet_length("content").cast("long")).drop("content"))
    catalog.to_map(slim, "asset_id")
    key = "content_hash" if dedup else "asset_id"
    lead = slim.select(F.col(key).alias("blob_id"), "path", "align")
    lead = shared_table(layout.first_of_hash(lead, "blob_id") if dedup else lead)
    # contents meet the chosen paths once, and are not sorted for that
    chosen = files.join(lead.hint("shuffle_hash"), "path").withColumn("method", meta.choose_method(F.col("path"), method))
    if split_mips:
        texture = meta.has_suffix(F.col("path"), ".dds")
        chosen = chosen.withColumn("content", dds.split_rewrite(F.col("content"), F.when(texture, dds.split_plan(F.col("content"))))["content"])
    parts = chunks.encode(chunks.split(chosen, "blob_id", "content", chunk, keep=["path", "align", "method"]), F.col("method"), level)
    parts.select("blob_id", "chunk_idx", "compressed_size", "original_size", "data").write.parquet(f"{path}/blob")
    stored = files.sparkSession.read.parquet(f"{path}/blob").drop("data")
    sizes = stored.groupBy("blob_id").agg(F.sum("compressed_size").alias("compressed_size"), F.count("*").cast("int").alias("chunk_count"), F.array_sort(F.collect_list(F.struct("chunk_idx", "compressed_size", "original_size"))).alias("chunks"))
    # only sizes go through the layout; chunk tables and metadata meet the places afterwards
    placed = layout.aligned_offsets(lead.join(sizes.select("blob_id", "compressed_size"), "blob_id"), "compressed_size").select("blob_id", "data_offset")
    entries = slim.join(sizes.join(placed, "blob_id").withColumnRenamed("blob_id", key), key)
    table_bytes = 8 * F.col("chunk_count").cast("long") + (28 if passphrase is not None else 0)
    head = slim.agg((F.lit(S.HEADER_BYTES) + F.count("*") * S.ROW_BYTES + F.sum(18 + F.octet_length("path"))).cast("long").alias("_base"))
    entries = layout.table_pointers(entries.withColumn("_first", head.scalar()), F.col("_first"), table_bytes).drop("_first")
    if passphrase is not None:
        raw = F.unhex(F.array_join(F.transform("chunks", lambda c: F.concat(F.hex(dds.to_le_u32(c["compressed_size"])), F.hex(dds.to_le_u32(c["original_size"])))), ""))
        entries = entries.withColumn("flags", F.col("flags").bitwiseOR(F.lit(S.FLAG_ENCRYPTED).cast("long"))).withColumn("sealed", crypto.encrypt_table(raw, crypto.derive_key(F.lit(passphrase))))
    entries = shared_table(entries)
    toc = entries.select("asset_id", "data_offset", "chunk_table_offset", "compressed_size", "original_size", "flags", "meta1", "meta2", "chunk_count", F.col(key).alias("blob_id"), *(["sealed"] if passphrase is not None else []))
    toc.repartitionByRange("asset_id").sortWithinPartitions("asset_id").write.parquet(f"{path}/toc")
    entries.select("asset_id", "path", "content_hash").repartitionByRange("asset_id").sortWithinPartitions("asset_id").write.parquet(f"{path}/names")
    if passphrase is None:
        entries.select("asset_id", F.explode("chunks").alias("c")).select("asset_id", "c.*").write.parquet(f"{path}/chunk")


class Package:
    """A stored package."""

    def __init__(self, spark: SparkSession, path: str, passphrase: str | None = None):
        self.spark, self.path, self.passphrase = spark, path, passphrase
        self.toc = spark.read.parquet(f"{path}/toc")
        self.names = spark.read.parquet(f"{path}/names")
        self.sealed = "sealed" in self.toc.columns

    def chunk_table(self) -> DataFrame:
        """(asset_id, chunk_idx, compressed_size, original_size) (A5, J11). An encrypted table without a passphrase is an error."""
        if not self.sealed:
            return self.spark.read.parquet(f"{self.path}/chunk")
        if self.passphrase is None:
            raise ValueError("the package's chunk tables are encrypted; a passphrase is needed")
        table = crypto.decrypt_table(F.col("sealed"), crypto.derive_key(F.lit(self.passphrase)))
        rows = self.toc.withColumn("_t", table).select("asset_id", "_t", F.explode(F.sequence(F.lit(0), F.col("chunk_count") - 1)).alias("chunk_idx"))
        number = lambda at: F.conv(F.hex(F.concat(*[F.substring(F.col("_t"), at + i, F.lit(1)) for i in (3, 2, 1, 0)])), 16, 10).cast("long")
        return rows.select("asset_id", "chunk_idx", number(F.col("chunk_idx") * 8 + 1).alias("compressed_size"), number(F.col("chunk_idx") * 8 + 5).alias("original_size"))

    def entries(self) -> DataFrame:
        return catalog.package_entries(self.toc, self.names)

    def summary(self) -> DataFrame:
        return catalog.package_summary(self.toc, self.names)

    def chunks(self, wanted: DataFrame | None = None) -> DataFrame:
        """Stored chunks of all, or the wanted (asset_id), entries with their method; sizes come from the chunk table."""
        toc = self.toc if wanted is None else catalog.lookup(self.toc, wanted)
        blob = self.spark.read.parquet(f"{self.path}/blob").select("blob_id", "chunk_idx", "data")
        sizes = self.chunk_table()
        return toc.select("asset_id", "blob_id", meta.method_number(F.col("flags")).alias("method")).join(sizes, "asset_id").join(blob, ["blob_id", "chunk_idx"])

    def read(self, wanted: DataFrame | None = None) -> DataFrame:
        """(asset_id, content) of all or the wanted entries."""
        return chunks.restore(self.chunks(wanted), F.col("method"), "asset_id")

    def load_chunk(self, asset_id: str, idx: int) -> DataFrame:
        """One decoded chunk."""
        one = self.toc.filter(F.col("asset_id") == asset_id)
        return chunks.decode(self.chunks(one).filter(F.col("chunk_idx") == idx), F.col("method"))

    def verify(self) -> DataFrame:
        """(asset_id, ok): whether all chunks are there and decode to their sizes (E8); ``all_ok`` sums it up."""
        ok = chunks.decodes(self.chunks(), F.col("method"), ["asset_id"])
        per = ok.groupBy("asset_id").agg(F.bool_and("ok").alias("ok"), F.count("*").alias("n"))
        return self.toc.select("asset_id", "chunk_count").join(per, "asset_id", "left").select("asset_id", (F.coalesce("ok", F.lit(False)) & (F.coalesce("n", F.lit(0)) == F.col("chunk_count"))).alias("ok"))

    def all_ok(self) -> bool:
        return not self.verify().filter(~F.col("ok")).limit(1).collect()

    def contents(self, wanted: DataFrame | None = None) -> DataFrame:
        """(path, content)."""
        return chunks.restore(self.chunks(wanted), F.col("method"), "asset_id", more=self.names.select("asset_id", "path")).select("path", "content")


def safe_path(path: Column) -> Column:
    """The path, or an error where it would leave the target folder."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    bad = F.startswith(p, F.lit("/")) | F.array_contains(F.split(p, "/"), "..") | p.rlike("^[A-Za-z]:")
    return F.when(bad, F.raise_error(F.concat(F.lit("unsafe path: "), path))).otherwise(p)


def unpack(package: Package, target: str, wanted: DataFrame | None = None) -> int:
    """Write entries as files below ``target``, a folder that all executors have mounted; returns how many."""
    rows = package.contents(wanted).withColumn("path", safe_path(F.col("path")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                full = os.path.join(target, path)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                part = f"{full}.{os.getpid()}.part"
                with open(part, "wb") as f:
                    f.write(content.as_py() or b"")
                os.replace(part, full)  # a repeated task writes the same file again
                done.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["path"])

    return rows.select("path", "content").mapInArrow(write, "path string").count()


def patch(base: Package, new: Package) -> DataFrame:
    """(path, change) between two packages."""
    return catalog.difference(base.names, new.names)


def ordered_paths(names: DataFrame) -> DataFrame:
    return names.orderBy(*ordered.by_path())
