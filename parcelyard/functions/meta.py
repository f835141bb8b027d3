"""Flags, texture metadata, labels and path helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S


def choose_method(path: Column, forced: str | None = None) -> Column:
    """Auto: GDeflate for .dds in any case, else Zstd; or the forced method's number."""
    if forced is not None and forced != "Auto":
        return F.lit(S.METHOD_NAMES.index(forced))
    return F.when(F.lower(path).endswith(".dds"), S.GDEFLATE).otherwise(S.ZSTD)


def alignment(method: Column) -> Column:
    return F.when(method == S.GDEFLATE, S.ALIGN_GPU).otherwise(S.ALIGN_DEFAULT)


def encode_flags(method: Column, align: Column, encrypted: Column | None = None, texture: Column | None = None) -> Column:
    bit = lambda c, v: F.when(c, v).otherwise(0) if c is not None else F.lit(0)
    parts = [bit(method != S.STORE, S.FLAG_COMPRESSED), bit(encrypted, S.FLAG_ENCRYPTED), F.shiftleft(method.cast("long"), S.METHOD_SHIFT), bit(texture, S.TYPE_TEXTURE), F.shiftleft(F.log2(align).cast("long"), S.ALIGN_SHIFT)]
    out = F.lit(S.FLAG_CHUNKED).cast("long")
    for p in parts:
        out = out.bitwiseOR(p.cast("long"))
    return out


def method_number(flags: Column) -> Column:
    return F.shiftright(flags.bitwiseAND(S.METHOD_MASK), S.METHOD_SHIFT)


def method_name(flags: Column) -> Column:
    out = F.lit("Unknown")
    for i, name in enumerate(S.METHOD_NAMES):
        out = F.when(method_number(flags) == i, name).otherwise(out)
    return out


def decode_alignment(flags: Column) -> Column:
    return F.pow(F.lit(2.0), F.shiftright(flags, S.ALIGN_SHIFT).bitwiseAND(255)).cast("long")


def is_encrypted(flags: Column) -> Column:
    return flags.bitwiseAND(S.FLAG_ENCRYPTED) != 0


def is_texture(flags: Column) -> Column:
    return flags.bitwiseAND(S.TYPE_MASK) == S.TYPE_TEXTURE


def encode_texture(width: Column, height: Column, mips: Column, tail: Column) -> tuple[Column, Column]:
    """(meta1, meta2); a dimension over 65,535 or a tail of 16 MiB or more loses its upper bits."""
    m1 = F.shiftleft(width.bitwiseAND(0xFFFF).cast("long"), 16).bitwiseOR(height.bitwiseAND(0xFFFF).cast("long"))
    m2 = F.shiftleft(mips.bitwiseAND(0xFF).cast("long"), 24).bitwiseOR(tail.bitwiseAND(0xFFFFFF).cast("long"))
    return m1, m2


def texture_info(meta1: Column, meta2: Column) -> Column:
    """"{w}x{h} M:{mips}", and " T:{kb}KB" where there is a tail."""
    tail = meta2.bitwiseAND(0xFFFFFF)
    base = F.concat(F.shiftright(meta1, 16).cast("string"), F.lit("x"), meta1.bitwiseAND(0xFFFF).cast("string"), F.lit(" M:"), F.shiftright(meta2, 24).cast("string"))
    return F.when(tail > 0, F.concat(base, F.lit(" T:"), F.floor(tail / 1024).cast("string"), F.lit("KB"))).otherwise(base)


def ratio(compressed: Column, original: Column) -> Column:
    """Per cent of the original size; 0 for empty originals."""
    return F.when(original > 0, compressed / original * 100).otherwise(0.0)


def show_path(path: Column, limit: int = 50) -> Column:
    """Long paths keep their last characters behind three dots."""
    return F.when(F.length(path) > limit, F.concat(F.lit("..."), F.right(path, F.lit(limit - 3)))).otherwise(path)


def size_label(size: Column) -> Column:
    """Bytes below 1024, else mebibytes with two decimals."""
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).otherwise(F.concat(F.format_string("%.2f", size / 1048576.0), F.lit(" MB")))


def method_label(pending: Column, method: Column, encrypted: Column, percent: Column) -> Column:
    """What a listing shows of an entry's compression."""
    mark = F.when(encrypted, F.lit(" [Enc]")).otherwise(F.lit(""))
    return F.when(pending, F.lit("Pending")).otherwise(F.concat(method, mark, F.lit(" ("), F.round(percent).cast("long").cast("string"), F.lit("%)")))


def block_width(compressed: Column, total: Column) -> Column:
    """Width of an entry in the block map: its share of 2000, at least 2 and at most 100."""
    share = compressed.cast("double") * 2000 / F.greatest(total, F.lit(1))
    return F.least(F.lit(100.0), F.greatest(F.lit(2.0), share))


# Block map colours by method.
BLOCK_COLOURS = {"GDeflate": "LimeGreen", "Zstd": "DodgerBlue", "LZ4": "Orange", "Store": "Gray"}


def block_colour(method: Column) -> Column:
    out = F.lit("Gray")
    for name, colour in BLOCK_COLOURS.items():
        out = F.when(method == name, colour).otherwise(out)
    return out


def list_label(path: Column, asset_id: Column) -> tuple[Column, Column]:
    """(icon, text) of a listing row."""
    icon = F.when(F.lower(path).endswith(".dds"), "image").otherwise("file")
    return icon, F.concat(path, F.lit("\n["), asset_id, F.lit("]"))


def matches(path: Column, text: str) -> Column:
    """Contains ``text`` in any case; an empty text matches all. Not a pattern: % and _ are plain."""
    return F.contains(F.lower(path), F.lower(F.lit(text)))


def has_suffix(path: Column, suffix: str, any_case: bool = True) -> Column:
    return F.lower(path).endswith(suffix.lower()) if any_case else path.endswith(suffix)


def file_name(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def extension(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"(\.[^.]*)$", 1)


def change_extension(path: Column, ext: str) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./\\]*$", ""), F.lit(ext))


MAX_LEVEL = {"Zstd": 22, "LZ4": 12, "GDeflate": 12, "Auto": 12, "Store": 1}


def check_level(method: str, level: int) -> int:
    """The level, if the method takes it."""
    if method not in MAX_LEVEL:
        raise ValueError(f"unknown method {method}")
    if not 1 <= level <= MAX_LEVEL[method]:
        raise ValueError(f"{method} takes levels 1 to {MAX_LEVEL[method]}")
    return level
