"""The single-file archive format: a row source for tables of contents and a writer.

Layout, little-endian. Table file: header of 64 bytes (magic, version, count,
padding as 32-bit, then the places of the file and name tables as 64-bit), rows
of 56 bytes in order of asset id, names (id, 16-bit length, UTF-8), chunk tables.
Data file: payloads at aligned places.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schema as S
from ..functions import codecs, crypto
from ..operators import chunks, ordered
from ..session import shared_table

_HEAD = struct.Struct("<iiiiqq")
_ROW = struct.Struct("<16sqqIIIIIi")
#: Bytes of the name section that are held at once while its runs are found.
_BLOCK = 1 << 20
#: Bytes of names after which a run ends.
_RUN = 8 << 20


def read_header(f) -> dict:
    """The header's fields; wrong magic or version is an error."""
    f.seek(0)
    raw = f.read(_HEAD.size)
    if len(raw) < _HEAD.size:
        raise EOFError("the header is cut off")
    magic, version, count, _, files, names = _HEAD.unpack(raw)
    if magic != S.MAGIC:
        raise ValueError(f"not an archive: magic {magic:#x}")
    if version != S.VERSION:
        raise ValueError(f"unsupported version {version}")
    return {"magic": magic, "version": version, "file_count": count, "file_table_offset": files, "name_table_offset": names}


def read_range(path: str, at: int, size: int) -> bytes:
    """Exactly ``size`` bytes, or an error at the end of the file."""
    with open(path, "rb") as f:
        f.seek(at)
        raw = f.read(size)
    if len(raw) != size:
        raise EOFError(f"{path} ends before byte {at + size}")
    return raw


def parse_rows(raw: bytes) -> Iterator[tuple]:
    for g, data, table, comp, orig, flags, m1, m2, n in _ROW.iter_unpack(raw):
        yield str(uuid.UUID(bytes_le=g)), data, table, comp, orig, flags, m1, m2, n


class RowRange(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class TocReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("rowsPerPartition", 100_000))

    def partitions(self) -> list[RowRange]:
        with open(self.path, "rb") as f:
            self.head = read_header(f)
        n = self.head["file_count"]
        return [RowRange(a, min(n, a + self.step)) for a in range(0, n, self.step)] or [RowRange(0, 0)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            head = read_header(f)
        size = (partition.end - partition.start) * S.ROW_BYTES
        yield from parse_rows(read_range(self.path, head["file_table_offset"] + partition.start * S.ROW_BYTES, size))


class TocSource(DataSource):
    """spark.read.format("parcel_toc").load(path): a row per entry, split by rows; ``path`` is a file that all executors have mounted."""

    @classmethod
    def name(cls) -> str:
        return "parcel_toc"

    def schema(self) -> str:
        return S.TOC

    def reader(self, schema) -> DataSourceReader:
        return TocReader(self.options)


def name_ranges(path: str, step: int) -> list[tuple[int, int, int]]:
    """(first byte, end, names) of runs of at most ``step`` names. Their rows vary in length, so lengths are read in turn, a block at a time; only the runs are kept."""
    with open(path, "rb") as f:
        head = read_header(f)
        f.seek(head["name_table_offset"])
        block, base, at = b"", head["name_table_offset"], 0  # ``at`` counts from the block's start
        out, first, n = [], base, 0
        for _ in range(head["file_count"]):
            if at + 18 > len(block):
                base, at = base + at, 0
                f.seek(base)
                block = f.read(_BLOCK)
                if len(block) < 18:
                    raise EOFError("the name section is cut off")
            at += 18 + int.from_bytes(block[at + 16 : at + 18], "little")
            n += 1
            if n == step or base + at - first >= _RUN:
                out.append((first, base + at, n))
                first, n = base + at, 0
        return [*out, (first, base + at, n)] if n else out


class NameRange(InputPartition):
    def __init__(self, start: int, end: int, count: int):
        self.start, self.end, self.count = start, end, count


class NamesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("rowsPerPartition", 100_000))

    def partitions(self) -> list[NameRange]:
        return [NameRange(*r) for r in name_ranges(self.path, self.step)] or [NameRange(0, 0, 0)]

    def read(self, partition: NameRange) -> Iterator[tuple]:
        raw, at = read_range(self.path, partition.start, partition.end - partition.start), 0
        for _ in range(partition.count):
            g, n = struct.unpack_from("<16sH", raw, at)
            yield str(uuid.UUID(bytes_le=g)), raw[at + 18 : at + 18 + n].decode()
            at += 18 + n


class NamesSource(DataSource):
    """spark.read.format("parcel_names").load(path): the names of a table file, split by rows."""

    @classmethod
    def name(cls) -> str:
        return "parcel_names"

    def schema(self) -> str:
        return S.NAMES

    def reader(self, schema) -> DataSourceReader:
        return NamesReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TocSource)
    spark.dataSource.register(NamesSource)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(asset_id, path) from the name section (A4), read by tasks that each parse a run of names."""
    with open(path, "rb") as f:
        read_header(f)
    register(spark)
    return spark.read.format("parcel_names").load(path)


def read_contents(toc: DataFrame, table_path: str, data_path: str, passphrase: str | None = None) -> DataFrame:
    """(asset_id, content), and ``path`` where ``toc`` has it: each entry's chunks read by range and decoded. Encrypted chunk tables need the passphrase."""
    more = ["path"] if "path" in toc.columns else []

    def tables(batches):
        import pyarrow as pa

        for batch in batches:
            rows = batch.to_pylist()
            extra = [28 if r["flags"] & S.FLAG_ENCRYPTED else 0 for r in rows]
            if any(extra) and passphrase is None:
                raise ValueError("the chunk table is encrypted; a key is needed")
            got = [read_range(table_path, r["chunk_table_offset"], 8 * r["chunk_count"] + n) for r, n in zip(rows, extra, strict=True)]
            kept = ["asset_id", "data_offset", "flags", *more]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + [pa.array(got, pa.binary())], [*kept, "chunk_table"])

    def content(data_offset: int, flags: int, chunk_table: bytes) -> tuple[bytes]:
        table = struct.unpack(f"<{len(chunk_table) // 4}I", chunk_table)
        raw, at, parts = memoryview(read_range(data_path, data_offset, sum(table[::2]))), 0, []
        for comp, orig in zip(table[::2], table[1::2], strict=True):
            parts.append(codecs.decompress_bytes(bytes(raw[at : at + comp]), orig, (flags & S.METHOD_MASK) >> S.METHOD_SHIFT))
            at += comp
        return (b"".join(parts),)

    kinds = "asset_id string, data_offset long, flags long" + ", path string" * bool(more)
    found = toc.select("asset_id", "data_offset", "chunk_table_offset", "flags", "chunk_count", *more).mapInArrow(tables, f"{kinds}, chunk_table binary")
    if passphrase is not None:
        plain = crypto.decrypt_table(F.col("chunk_table"), crypto.derive_key(F.lit(passphrase)))
        found = found.withColumn("chunk_table", F.when(F.col("flags").bitwiseAND(S.FLAG_ENCRYPTED) != 0, plain).otherwise(F.col("chunk_table")))
    return codecs.by_row(found, content, ["data_offset", "flags", "chunk_table"], {"content": "binary"}).select("asset_id", *more, "content")


#: Bytes that a writing task holds back for one write, and gaps up to which neighbours go into one write.
_WRITE_BYTES, _GAP = 1 << 20, S.ALIGN_GPU


def _write_at(fd: int, at: int, raw: bytes) -> None:
    view = memoryview(raw)
    while view:
        n = os.pwrite(fd, view, at)
        at, view = at + n, view[n:]


def _put(rows: DataFrame, path: str, record: Callable[[dict], bytes] = lambda r: r["data"]) -> int:
    """Write each row's bytes at its place ``at`` of a file that is there already; returns the number of rows.

    Tasks hold ranges of places, so each writes its own stretch of the file from start to end, and only counts reach the
    driver. A repeated task writes the same bytes again.
    """

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fd = os.open(path, os.O_WRONLY)
        try:
            start, held = 0, bytearray()
            for batch in batches:
                names, done = batch.schema.names, batch.num_rows
                for i in range(done):
                    row = {c: batch.column(k)[i].as_py() for k, c in enumerate(names)}
                    at, raw = row["at"], record(row)
                    if not raw:
                        continue
                    gap = at - start - len(held)
                    if held and (len(held) >= _WRITE_BYTES or not 0 <= gap <= _GAP):
                        _write_at(fd, start, held)
                        held = bytearray()
                    if held:
                        held += bytes(gap)
                    else:
                        start = at
                    held += raw
                del batch
                yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["n"])
            _write_at(fd, start, held)
        finally:
            os.close(fd)

    return rows.repartitionByRange("at").sortWithinPartitions("at").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _toc_record(r: dict) -> bytes:
    return _ROW.pack(uuid.UUID(r["asset_id"]).bytes_le, r["data_offset"], r["chunk_table_offset"], r["compressed_size"], r["original_size"], r["flags"], r["meta1"], r["meta2"], r["chunk_count"])


def _name_record(r: dict) -> bytes:
    raw = r["path"].encode()
    return uuid.UUID(r["asset_id"]).bytes_le + struct.pack("<H", len(raw)) + raw


def _table_record(r: dict) -> bytes:
    return b"".join(struct.pack("<II", c["compressed_size"], c["original_size"]) for c in r["c"])


def write_archive(package, table_path: str, data_path: str) -> None:
    """Write a package as one table file and one data file on a disk that the driver and all executors have mounted.

    All places are known before anything is written, so the tasks write to the files themselves, each its own range. The
    driver writes the header.
    """
    toc = package.toc.join(package.names, "asset_id")
    n, longest = toc.agg(F.count("*"), F.coalesce(F.max(F.octet_length("path")), F.lit(0))).first()
    if longest > 0xFFFF:
        raise ValueError("a path is longer than its length field")
    names_at = S.HEADER_BYTES + n * S.ROW_BYTES
    with open(table_path, "wb") as f:
        f.write(_HEAD.pack(S.MAGIC, S.VERSION, n, 0, S.HEADER_BYTES, names_at).ljust(S.HEADER_BYTES, b"\0"))
    fields = ["asset_id", "data_offset", "chunk_table_offset", "compressed_size", "original_size", "flags", "meta1", "meta2", "chunk_count"]
    # each entry's rank and the bytes of the names before its own
    ranked = ordered.running(toc.select(*fields, "path"), [F.col("asset_id")], {"_rank": F.lit(1), "_names": 18 + F.octet_length("path")})
    ranked = shared_table(ranked)
    written = [_put(ranked.select((S.HEADER_BYTES + F.col("_rank") * S.ROW_BYTES).cast("long").alias("at"), *fields), table_path, _toc_record)]
    written.append(_put(ranked.select((names_at + F.col("_names")).cast("long").alias("at"), "asset_id", "path"), table_path, _name_record))
    at = F.col("chunk_table_offset").alias("at")
    if package.sealed:
        written.append(_put(package.toc.select(at, F.col("sealed").alias("data")), table_path))
    else:
        sizes = package.spark.read.parquet(f"{package.path}/chunk").groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "compressed_size", "original_size"))).alias("c"))
        written.append(_put(package.toc.join(sizes, "asset_id").select(at, "c"), table_path, _table_record))
    if written != [n] * 3:
        raise ValueError(f"of {n} entries, {written} rows, names and chunk tables were written")
    open(data_path, "wb").close()
    blob = package.spark.read.parquet(f"{package.path}/blob")
    place = package.toc.groupBy("blob_id").agg(F.min("data_offset").alias("data_offset"))
    # places come from the sizes alone; the data meet them once and need no order for that
    places = chunks.offsets(blob.select("blob_id", "chunk_idx", F.col("compressed_size").alias("_n")), "blob_id", "_n", "_before").join(place, "blob_id")
    places = places.select("blob_id", "chunk_idx", (F.col("data_offset") + F.col("_before")).cast("long").alias("at")).hint("shuffle_hash")
    _put(blob.select("blob_id", "chunk_idx", "data").join(places, ["blob_id", "chunk_idx"]).select("at", "data"), data_path)
