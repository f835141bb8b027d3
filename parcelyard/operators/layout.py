"""Content dedup and aligned physical layout.

Offsets follow path order with alignments of 16 and 4096 bytes. As 16 divides
4096, padding every size to 16 leaves two sums: bytes since the last 4096-aligned
row, and the padded lengths of earlier segments. A range of rows is summed up by
three numbers (bytes before its first 4096-aligned row, whether it has one, and
its length from there on), and those are combined over the ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema as S
from . import ordered


def up(x: Column, unit: int) -> Column:
    return F.floor((x + (unit - 1)) / F.lit(unit)).cast("long") * unit


def first_of_hash(df: DataFrame, hash_col: str = "content_hash", path: str = "path") -> DataFrame:
    """The first row of each hash in path order (F7). Aggregates before the shuffle, so frequent contents do not gather."""
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(ordered.by_path(path))])
    cols = [c for c in df.columns if c != hash_col]
    best = df.groupBy(hash_col).agg(F.min_by(F.struct(*cols), key).alias("_r"))
    return best.select(hash_col, "_r.*").select(*df.columns)


def dedup_groups(df: DataFrame, hash_col: str = "content_hash", size: str = "size") -> DataFrame:
    """Hashes that occur twice or more, how often, and the bytes saved by one copy."""
    return df.groupBy(hash_col).agg(F.count("*").alias("n"), (F.sum(size) - F.max(size)).cast("long").alias("saved")).filter("n > 1")


def aligned_offsets(df: DataFrame, size: str = "size", align: str = "align", path: str = "path") -> DataFrame:
    """``df`` with data_offset: each row at the next multiple of its alignment (16 or 4096) after the row before (F1). Paths are unique."""
    order = ordered.by_path(path)
    rows = ordered.ranged(df.withColumn("_p", up(F.col(size).cast("long"), S.ALIGN_DEFAULT)), order)
    seg = F.sum(F.when(F.col(align) == S.ALIGN_GPU, 1).otherwise(0)).over(ordered.within(order).rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_seg", seg)
    inside = W.partitionBy(ordered.PART, "_seg").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_p").over(inside), F.lit(0)))
    segs = rows.groupBy(ordered.PART, "_seg").agg(F.sum("_p").alias("_t"))
    # start of each segment from the first 4096-aligned row of its range; the last segment's end is not padded
    w = W.partitionBy(ordered.PART).orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)
    padded = F.when(F.col("_seg") > 0, up(F.col("_t"), S.ALIGN_GPU)).otherwise(0)
    segs = segs.withColumn("_start", F.coalesce(F.sum(padded).over(w), F.lit(0)))
    parts = segs.groupBy(ordered.PART).agg(
        F.sum(F.when(F.col("_seg") == 0, F.col("_t")).otherwise(0)).alias("pre"),
        F.max(F.when(F.col("_seg") > 0, F.col("_start") + F.col("_t"))).alias("rest"),
    )
    # a few numbers per range: where each range begins
    states = parts.groupBy().agg(F.array_sort(F.collect_list(F.struct(ordered.PART, "pre", "rest"))).alias("all"))
    zero = F.struct(F.lit(0).cast("long").alias("ptr"), F.array().cast("array<struct<part:int,ptr:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["ptr"] + x["pre"]
        return F.struct(F.when(x["rest"].isNotNull(), up(end, S.ALIGN_GPU) + x["rest"]).otherwise(end).alias("ptr"), F.concat(acc["out"], F.array(F.struct(x[ordered.PART].alias("part"), acc["ptr"].alias("ptr")))).alias("out"))

    begin = states.select(F.explode(F.aggregate("all", zero, step, lambda acc: acc["out"])).alias("s")).select(F.col("s.part").alias(ordered.PART), F.col("s.ptr").alias("_ptr"))
    pre = parts.select(ordered.PART, F.col("pre").alias("_pre"))
    out = rows.join(segs.select(ordered.PART, "_seg", "_start"), [ordered.PART, "_seg"]).join(begin, ordered.PART).join(pre, ordered.PART)
    base = F.when(F.col("_seg") == 0, F.col("_ptr")).otherwise(up(F.col("_ptr") + F.col("_pre"), S.ALIGN_GPU) + F.col("_start"))
    return out.select(*df.columns, (base + F.col("_in")).cast("long").alias("data_offset"))


def deduplicated_offsets(df: DataFrame, hash_col: str = "content_hash", size: str = "size", align: str = "align", path: str = "path") -> DataFrame:
    """Offsets where equal contents share the place of the first in path order. With a hash that covers the alignment, no row inherits a coarser place."""
    lead = aligned_offsets(first_of_hash(df, hash_col, path), size, align, path).select(F.col(hash_col).alias("_h"), "data_offset")
    return df.join(lead, F.col(hash_col) == F.col("_h")).drop("_h")


def table_pointers(df: DataFrame, base: Column, length: Column, path: str = "path") -> DataFrame:
    """``df`` with chunk_table_offset: tables follow each other in path order from ``base``."""
    out = ordered.running(df.withColumn("_base", base), ordered.by_path(path), {"_before": length})
    return out.withColumn("chunk_table_offset", (F.col("_base") + F.col("_before")).cast("long")).select(*df.columns, "chunk_table_offset")


def gaps(df: DataFrame, offset: str = "data_offset", size: str = "size", tie: str = "path") -> DataFrame:
    """``df`` with gap: bytes between the end of the row before, by offset, and this row (F5); null for the first."""
    order = [F.col(offset), F.col(tie)]
    out = ordered.previous(df, order, F.col(offset) + F.col(size), "_end")
    return out.withColumn("gap", (F.col(offset) - F.col("_end")).cast("long")).drop("_end")


def slack(gapped: DataFrame, size: str = "size", limit: int = S.CHUNK_BYTES) -> DataFrame:
    """Bytes lost to alignment: gaps between 0 and ``limit``, and their per cent of the data."""
    return gapped.agg(F.coalesce(F.sum(F.when((F.col("gap") > 0) & (F.col("gap") < limit), F.col("gap"))), F.lit(0)).cast("long").alias("slack_bytes"), F.sum(size).cast("long").alias("data_bytes")).withColumn(
        "slack_percent", F.when(F.col("data_bytes") > 0, F.col("slack_bytes") * 100.0 / F.col("data_bytes")).otherwise(0.0)
    )


def misaligned(toc: DataFrame, flags: str = "flags", offset: str = "data_offset") -> DataFrame:
    """GDeflate entries off a 4096-byte boundary (C6); count them for E7."""
    return toc.filter((F.col(flags).bitwiseAND(S.METHOD_MASK) == S.GDEFLATE << S.METHOD_SHIFT) & (F.col(offset) % S.ALIGN_GPU != 0))
