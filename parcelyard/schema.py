"""Schemas and format constants. Unsigned 32-bit fields are LongType."""

from __future__ import annotations


# Fixed values of the archive format.
MAGIC = 0x4B435047
VERSION = 1
HEADER_BYTES = 64
ROW_BYTES = 56
CHUNK_BYTES = 131072
ALIGN_DEFAULT = 16
ALIGN_GPU = 4096
FLAG_COMPRESSED = 1
FLAG_ENCRYPTED = 2
METHOD_MASK = 0x1C
METHOD_SHIFT = 2
TYPE_MASK = 0xE0
TYPE_TEXTURE = 1 << 5
FLAG_CHUNKED = 1 << 8
ALIGN_SHIFT = 24
STORE, GDEFLATE, ZSTD, LZ4 = 0, 1, 2, 3
METHOD_NAMES = ("Store", "GDeflate", "Zstd", "LZ4")




CHUNK_ARRAY = "array<struct<compressed_size:bigint,original_size:bigint>>"
FILE_MAP = "abs_path string, rel_path string"
ASSET = f"asset_id string, path string, original_size bigint, compressed_size bigint, flags bigint, alignment int, meta1 bigint, meta2 bigint, chunk_count int, content binary, chunks {CHUNK_ARRAY}"
HEADER = "magic int, version int, file_count int, file_table_offset bigint, name_table_offset bigint"
TOC = "asset_id string, data_offset bigint, chunk_table_offset bigint, compressed_size bigint, original_size bigint, flags bigint, meta1 bigint, meta2 bigint, chunk_count int"
NAMES = "asset_id string, path string"
CHUNK = "asset_id string, chunk_idx int, compressed_size bigint, original_size bigint, data binary"
PACKAGE_ENTRY = "path string, asset_id string, offset bigint, original_size bigint, compressed_size bigint, alignment bigint, method string, metadata_info string"
