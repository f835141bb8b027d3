"""Texture headers and the split into a resident tail and streamed levels (A8, B13, B14), JVM-side over binary columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the texture container format.
MAGIC = 0x20534444  # "DDS "
HEADER_SIZE = 124
FOURCC_DX10 = 0x30315844
FOURCC_DXT1 = 0x31545844
AT_SIZE, AT_HEIGHT, AT_WIDTH, AT_PITCH, AT_MIPS, AT_FOURCC = 4, 12, 16, 20, 28, 84


def le_u32(data: Column, at: int) -> Column:
    """The little-endian unsigned 32-bit number at byte ``at``."""
    parts = [F.substring(data, at + 1 + i, 1) for i in (3, 2, 1, 0)]
    return F.conv(F.hex(F.concat(*parts)), 16, 10).cast("long")


def to_le_u32(value: Column) -> Column:
    h = F.lpad(F.hex(value), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]))


def header(data: Column) -> Column:
    """struct(width, height, mip_count, four_cc), or null where the data is no texture."""
    ok = (F.octet_length(data) >= 128) & (le_u32(data, 0) == MAGIC)
    return F.when(ok, F.struct(le_u32(data, AT_WIDTH).cast("int").alias("width"), le_u32(data, AT_HEIGHT).cast("int").alias("height"), F.greatest(F.lit(1), le_u32(data, AT_MIPS).cast("int")).alias("mip_count"), le_u32(data, AT_FOURCC).alias("four_cc")))


def split_plan(data: Column, max_tail: int = 128) -> Column:
    """struct(header_size, split_offset, cut, width, height, mips): where the levels of at most ``max_tail`` begin; null where no cut is possible."""
    return F.transform(F.array(data), lambda d: _plan(d, max_tail))[0]


def _plan(d: Column, max_tail: int) -> Column:
    w, h = le_u32(d, AT_WIDTH), le_u32(d, AT_HEIGHT)
    mips = F.greatest(F.lit(1).cast("long"), le_u32(d, AT_MIPS))
    four = le_u32(d, AT_FOURCC)
    head = F.when(four == FOURCC_DX10, 148).otherwise(128).cast("long")
    block = F.when(four == FOURCC_DXT1, 8).otherwise(16).cast("long")
    at = lambda x, i: F.greatest(F.lit(1).cast("long"), F.floor(x / F.pow(F.lit(2.0), i)).cast("long"))
    levels = F.sequence(F.lit(0).cast("long"), F.least(mips, F.lit(33).cast("long")) - 1)
    cut = F.filter(levels, lambda i: (at(w, i) <= max_tail) & (at(h, i) <= max_tail))
    blocks = lambda x: F.floor((x + 3) / 4).cast("long")
    before = F.filter(levels, lambda i: i < F.get(cut, F.lit(0)))
    offset = F.aggregate(before, head, lambda acc, i: acc + blocks(at(w, i)) * blocks(at(h, i)) * block)
    valid = (F.octet_length(d) >= 128) & (le_u32(d, 0) == MAGIC) & (le_u32(d, AT_SIZE) == HEADER_SIZE) & ((w > max_tail) | (h > max_tail)) & (F.size(cut) > 0) & (offset < F.octet_length(d))
    first = F.get(cut, F.lit(0))
    return F.when(valid, F.struct(head.alias("header_size"), offset.alias("split_offset"), first.cast("int").alias("cut"), at(w, first).cast("int").alias("width"), at(h, first).cast("int").alias("height"), (mips - first).cast("int").alias("mips")))


def split_rewrite(data: Column, plan: Column) -> Column:
    """struct(content, tail_size): header of the small levels, the small levels, then the large ones; data without a plan stays."""
    n = F.octet_length(data).cast("long")
    head, cut = plan["header_size"], plan["split_offset"]
    sub = lambda a, b: F.substring(data, (a + 1).cast("int"), (b - a).cast("int"))
    lit = lambda x: F.lit(x).cast("long")
    new = F.concat(sub(lit(0), lit(AT_HEIGHT)), to_le_u32(plan["height"].cast("long")), to_le_u32(plan["width"].cast("long")), to_le_u32(lit(0)), sub(lit(AT_PITCH + 4), lit(AT_MIPS)), to_le_u32(plan["mips"].cast("long")), sub(lit(AT_MIPS + 4), head))
    out = F.concat(new, sub(cut, n), sub(head, cut))
    return F.when(plan.isNotNull(), F.struct(out.alias("content"), (head + n - cut).alias("tail_size"))).otherwise(F.struct(data.alias("content"), n.alias("tail_size")))
