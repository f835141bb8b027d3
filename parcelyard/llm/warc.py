"""WARC archives: gzip members written through Spark's own files, and a splittable reader.

Writing: a partition's records, one gzip member each, form a byte stream. Spark's
text writer ends every row with a newline, so the stream is cut into rows at the
newline bytes that it holds anyway; the file is the stream and one newline after
the last member. It goes through Spark's commit protocol to any store.

Reading: Spark's text source deals byte ranges of the files to tasks, on any store
that Spark reads, as the lines that start in a range. A task scans its range for
the gzip magic, validates each candidate by decoding the start of its header, and
owns the records that start inside. What precedes the first record of a range
belongs to a record of an earlier range: that range's unfinished end and the next
ranges' beginnings, a record's length each, are the only bytes that are shuffled.
Files whose names end in z, which Spark would unpack as a whole, are read whole,
2 GB at most each.

Null html counts as an empty payload and a null url is left out. Of equal payloads
of at least ``least`` bytes, rows with the smallest page id are responses (all of
them, if repeated) and others revisit it; rows without an id take part as revisits.
Other columns are not archived. An empty table gives no records.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as Over
from pyspark.sql import functions as F

from . import common

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLOCK = 1 << 18
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def member(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One record as a gzip member. ``first``: the page whose equal payload it revisits."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    head = [f"WARC-Type: {'revisit' if first is not None else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=-._~%"))
    if first is not None:
        head += [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {PROFILE}"]
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def write_archives(pages: DataFrame, path: str, least: int = 100) -> None:
    """Archive every row of ``pages`` (page_id, url, html) under ``path``, a record each."""
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256)).withColumn("n", F.octet_length("html"))
    # only payloads that occur twice need a partner; their digests alone are shuffled to find them
    again = base.filter(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).filter("c > 1 and first is not null").select("digest", "first")
    rows = base.join(again, "digest", "left").select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = b""
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256).to_pydict()
                stream = rest + b"".join(member(i, u, h.encode("utf-8", "replace"), d, f) for i, u, h, d, f in zip(*(part[c] for c in ("page_id", "url", "html", "digest", "first")), strict=True))
                *lines, rest = stream.split(b"\n")
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], ["line"])
        if rest:
            yield pa.RecordBatch.from_arrays([pa.array([rest], pa.binary())], ["line"])

    rows.mapInArrow(common.tidy(run), "line binary").select(F.col("line").cast("string").alias("value")).write.text(path)


class Window:
    """Forward reads of a file or buffer by absolute position."""

    def __init__(self, f: BinaryIO, start: int):
        self.f, self.base, self.buf = f, start, b""
        f.seek(start)

    def more(self) -> bool:
        got = self.f.read(BLOCK)
        self.buf += got
        return bool(got)

    def forget(self, pos: int) -> None:
        self.buf = self.buf[pos - self.base :]
        self.base = pos


def records(f: BinaryIO, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded record) of the members that start in [start, end)."""
    w, pos = Window(f, start), start
    while pos < end:
        at = w.buf.find(MAGIC, pos - w.base)
        if at < 0:
            keep = max(pos, w.base + len(w.buf) - len(MAGIC) + 1)
            w.forget(keep)
            pos = keep
            if not w.more():
                return
            continue
        pos = w.base + at
        if pos >= end:
            return
        w.forget(pos)
        z, used, out, ok = zlib.decompressobj(31), 0, [], False
        try:
            while not z.eof:
                if used == len(w.buf) and not w.more():
                    break
                out.append(z.decompress(w.buf[used : used + BLOCK]))
                used = min(len(w.buf), used + BLOCK)
                if not ok:
                    head = b"".join(out)
                    if len(head) >= 5:
                        if not head.startswith(b"WARC/"):
                            break
                        ok = True
        except zlib.error:
            if ok:
                raise ValueError(f"damaged record at byte {pos}") from None
        if ok and not z.eof:
            raise ValueError(f"record at byte {pos} is cut off")
        if ok:
            nxt = pos + used - len(z.unused_data)
            yield pos, b"".join(out)
            w.forget(nxt)
            pos = nxt
        else:
            pos += 1


def parse(raw: bytes) -> tuple:
    """A record's fields in the order of RECORD."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    number = lambda k: int(x) if (x := fields.get(k, "").removeprefix("<urn:page:").removesuffix(">")) else None
    url = fields.get("warc-target-uri")
    return number("warc-record-id"), None if url is None else unquote(url), payload if kind == "response" else None, size, digest, kind, number("warc-refers-to")


def pieces(read: Callable[[], bytes]) -> Iterator[tuple[str, bytes]]:
    """What a range holds, from ``read`` (its next bytes, none at the end): ("head", the bytes before its first record), ("record",
    decoded) for each complete one, and ("tail", the bytes of the last) if that goes on. A range without a start is all head."""
    buf, pos, started = b"", 0, False
    while True:
        at = buf.find(MAGIC, pos)
        if at < 0:
            pos = max(pos, len(buf) - len(MAGIC) + 1)
            if started and pos > BLOCK:
                buf, pos = buf[pos:], 0
            if not (got := read()):
                break
            buf += got
            continue
        z, used, out, ok, ended = zlib.decompressobj(31), at, [], False, False
        try:
            while not z.eof:
                if used == len(buf):
                    if not (got := read()):
                        ended = True
                        break
                    if started:
                        buf, used, at = buf[at:], used - at, 0
                    buf += got
                out.append(z.decompress(buf[used : used + BLOCK]))
                used = min(len(buf), used + BLOCK)
                if not ok and len(start := b"".join(out)) >= 5:
                    if not start.startswith(b"WARC/"):
                        break
                    ok = True
        except zlib.error:
            if ok:
                raise ValueError("damaged record") from None
        if ended and (ok or started):
            if not started:
                yield "head", buf[:at]
            yield "tail", buf[at:]
            return
        if ended:  # too little to tell whether a record starts: with the range before, it will show
            break
        if ok:
            if not started:
                yield "head", buf[:at]
                started = True
            yield "record", b"".join(out)
            pos = used - len(z.unused_data)
            if pos > 4 * BLOCK:
                buf, pos = buf[pos:], 0
        else:
            pos = at + 1
    if not started:
        yield "head", buf


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records under ``path``. Ranges are as large as spark.sql.files.maxPartitionBytes says."""
    schema = RECORD if payloads else RECORD.replace("payload binary, ", "")
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    names = [x.split()[0] for x in schema.split(", ")]
    types = [kinds[x.split()[1]] for x in schema.split(", ")]
    fragment = "file long, block long, starts boolean, head binary, tail binary"
    more = [x.split()[0] for x in fragment.split(", ")]
    more_types = [kinds[x.split()[1]] for x in fragment.split(", ")]

    def emit(rows: list[tuple], fragments: list[tuple] | None) -> pa.RecordBatch:
        if not payloads:
            rows = [(*r[:2], *r[3:]) for r in rows]
        cols = list(zip(*[*rows, *[(None,) * len(names) for _ in fragments or ()]], strict=True)) or [()] * len(names)
        if fragments is None:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)
        ends = list(zip(*[*[(None,) * len(more) for _ in rows], *fragments], strict=True)) or [()] * len(more)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*cols, *ends], [*types, *more_types], strict=True)], [*names, *more])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], bytes]]:
        for batch in batches:
            lines = batch.column(0).to_pylist()
            keys = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            for key, own in groupby(zip(keys, lines, strict=True), key=lambda x: x[0]):
                yield key, b"\n".join([line for _, line in own]) + b"\n"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), own in groupby(segments(batches), key=lambda x: x[0]):
            rows, held, head, tail, starts = [], 0, b"", b"", False
            for kind, data in pieces(lambda: next(own, (None, b""))[1]):  # noqa: B023
                if kind == "head":
                    head = data
                elif kind == "tail":
                    tail, starts = data, True
                else:
                    starts = True
                    rows.append(parse(data))
                    held += len(data)
                    if held > 4 << 20 or len(rows) >= 2000:
                        yield emit(rows, [])
                        rows, held = [], 0
            yield emit(rows, [(file, block, starts, head, tail)])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data = batch.column(0)[k].as_py()
                rows, held = [], 0
                for _, raw in records(io.BytesIO(data), 0, len(data)):
                    rows.append(parse(raw))
                    held += len(raw)
                    if held > 4 << 20 or len(rows) >= 2000:
                        yield emit(rows, None)
                        rows, held = [], 0
                if rows:
                    yield emit(rows, None)

    files = spark.read.option("recursiveFileLookup", "true")
    lines = files.option("lineSep", "\n").option("pathGlobFilter", "*[!z]").text(path)
    lines = lines.select(F.col("value").cast("binary").alias("line"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    found = common.table(lines.mapInArrow(common.tidy(scan), f"{schema}, {fragment}"))
    # a record that goes on: the tail of the range that it starts in, and the heads up to the next start
    ends = found.filter("file is not null").select(*more)
    order = ends.select("file", "block", "starts").withColumn("own", F.sum(F.col("starts").cast("long")).over(Over.partitionBy("file").orderBy("block")))
    at = F.explode(F.array(F.struct((F.col("own") - F.col("starts").cast("long")).alias("own"), F.col("head").alias("data")), F.struct(F.col("own").alias("own"), F.col("tail").alias("data"))))
    parts = ends.join(order.drop("starts"), ["file", "block"]).select("file", "block", at.alias("p")).filter(F.octet_length("p.data") > 0)
    joined = parts.groupBy("file", "p.own").agg(F.array_sort(F.collect_list(F.struct("block", "p.data"))).alias("all"))
    joined = joined.select(F.aggregate("all", F.lit(b""), lambda acc, x: F.concat(acc, x["data"])).alias("content"))
    zipped = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*z").load(path).select("content")
    return found.filter("file is null").select(*names).unionByName(joined.mapInArrow(common.tidy(whole), schema)).unionByName(zipped.mapInArrow(common.tidy(whole), schema))
