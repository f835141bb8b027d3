"""Chunk codecs in Arrow batches.

A chunk that does not shrink is kept raw; readers tell by equal sizes. There is
no GDeflate codec for Python: its chunks are written raw, which the format
allows, and compressed ones are refused rather than passed off as another codec.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .. import schema as S

#: Bytes that a worker makes before it hands them on.
SLICE_BYTES = 1 << 20


def available(method: str) -> bool:
    """Whether this installation can compress and decompress with the method."""
    if method == "Store":
        return True
    if method == "Zstd":
        try:
            import zstandard  # noqa: F401
        except ImportError:
            return False
        return True
    return method == "LZ4" and pa.Codec.is_available("lz4_raw")


def compress_bytes(raw: bytes, method: int, level: int) -> bytes:
    """Compressed bytes, or the raw ones where those are no longer."""
    if method == S.ZSTD:
        import zstandard

        out = zstandard.ZstdCompressor(level=level).compress(raw)
    elif method == S.LZ4:
        # as in the archive's packer, levels over 3 are high compression
        codec = pa.Codec("lz4_raw", compression_level=level) if level > 3 else pa.Codec("lz4_raw")
        out = codec.compress(raw, asbytes=True) if raw else raw
    elif method in (S.STORE, S.GDEFLATE):
        return raw
    else:
        raise ValueError(f"unknown method {method}")
    return out if len(out) < len(raw) else raw


def decompress_bytes(data: bytes, original: int, method: int) -> bytes:
    """Inverse of compress_bytes; a wrong length is an error."""
    if len(data) == original:
        return data
    if method == S.ZSTD:
        import zstandard

        out = zstandard.ZstdDecompressor().decompress(data, max_output_size=original)
    elif method == S.LZ4:
        out = pa.Codec("lz4_raw").decompress(data, decompressed_size=original, asbytes=True)
    elif method == S.GDEFLATE:
        raise NotImplementedError("compressed GDeflate chunks need a codec that is not available here")
    else:
        raise ValueError("a stored chunk has another size than its original")
    if len(out) != original:
        raise ValueError(f"chunk decoded to {len(out)} bytes, expected {original}")
    return out


def by_row(df: DataFrame, f: Callable[..., tuple], inputs: list[str], adds: dict[str, str]) -> DataFrame:
    """``df`` with the columns ``inputs`` replaced by ``adds`` (name to type), which ``f`` makes from a row's inputs.

    Values are made one at a time and leave the worker about SLICE_BYTES at a time. Besides these it holds one batch of
    Spark's, which is at most maxRecordsPerBatch rows and about maxBytesPerBatch bytes: no more for a larger table.
    """
    kept = [c for c in df.columns if c not in inputs and c not in adds]
    types = {"binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(c, T._parse_datatype_string(t)) for c, t in adds.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            given, start, made, size = [column[c] for c in inputs], 0, [], 0
            for i in range(batch.num_rows):
                made.append(f(*[g[i].as_py() for g in given]))
                size += sum(len(v) for v in made[-1] if isinstance(v, bytes))
                if size >= SLICE_BYTES or i == batch.num_rows - 1:
                    new = [pa.array(v, types[t]) for v, t in zip(zip(*made, strict=True), adds.values(), strict=True)]
                    yield pa.RecordBatch.from_arrays([column[c].slice(start, i + 1 - start) for c in kept] + new, [*kept, *adds])
                    start, made, size, new = i + 1, [], 0, None
            del batch, column, given
        release()

    return df.select(*kept, *inputs).mapInArrow(run, schema)


def release() -> None:
    """Freed memory goes back to the system: an executor keeps idle workers beside busy ones."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library; nothing depends on it
        pass


def encoded(raw: bytes | None, method: int, level: int) -> tuple[bytes | None, int | None, int | None]:
    """(data, compressed_size, original_size) of a chunk."""
    if raw is None:
        return None, None, None
    data = compress_bytes(raw, method, level)
    return data, len(data), len(raw)


def decodes(data: bytes | None, original: int, method: int) -> bool:
    """Whether a chunk decodes to its original size."""
    try:
        decompress_bytes(data, original, method)
        return True
    except Exception:
        return False


def joined(parts: list[dict], method: int) -> bytes:
    """The content of an asset's stored chunks, given in order."""
    return b"".join(decompress_bytes(p["data"], p["original_size"], method) for p in parts)


def join_chunks(parts: list[bytes]) -> bytes:
    """The bytes of an array of binary values, in order."""
    return b"".join(parts)
