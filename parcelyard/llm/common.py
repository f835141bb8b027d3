"""Shared pieces of the training-data operators: shared folders, batch slicing, vectorised hashing.

Texts are handled as whole UTF-8 byte buffers. A batch of rows is cut into
slices of a few megabytes so that the working memory of a Python worker does
not depend on the number of rows or partitions.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import passing, shared_dir, write  # noqa: F401
from ..session import shared_table as table  # noqa: F401

#: Bytes of text handled at once by the vectorised operators.
SLICE_BYTES = 1 << 20
_P1 = np.uint64(0x9E3779B97F4A7C15)
_P2 = np.uint64(0xBF58476D1CE4E5B9)
_P3 = np.uint64(0x94D049BB133111EB)
_BASE = 0x5851F42D4C957F2D
_INV = pow(_BASE, -1, 1 << 64)


def fold(docs: DataFrame, text_col: str) -> DataFrame:
    """(doc, text): all other columns as one, so that their names cannot clash with an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("doc"), F.col(f"`{text_col}`").alias("text"))


def unfold(folded: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """The columns of ``docs`` from (doc, text)."""
    return folded.select(*[F.col("text").alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, after which the worker gives freed memory back: an executor keeps idle workers beside busy ones."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return tidied


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library; nothing depends on it
        pass


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, back to back, and its n + 1 offsets. Null counts as empty."""
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    n = len(col)
    off = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``limit`` bytes of text each; a longer text stands alone, whole."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    _, off = text_bytes(col)
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(off, off[start] + limit, "right")) - 1
        end = min(batch.num_rows, max(end, start + 1))
        yield batch.slice(start, end - start)
        start = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _P2
    x = x ^ (x >> np.uint64(27))
    x = x * _P3
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        m = max(n, SLICE_BYTES + (SLICE_BYTES >> 2))
        for k, base in (("p", _BASE), ("q", _INV)):
            a = np.full(m, base, np.uint64)
            a[0] = 1
            with np.errstate(over="ignore"):
                _powers[k] = np.multiply.accumulate(a)
    p, q = _powers["p"][:n], _powers["q"][:n]
    if len(_powers["p"]) > 4 * SLICE_BYTES:  # one very long text; do not keep its tables
        _powers.clear()
    return p, q


class Prefix:
    """Hashes of any byte ranges of a buffer, from one pass over it."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        p, self.q = _pow(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:n], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.q[start]
        return mix(h + (end - start).astype(np.uint64) * _P1)


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, off: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges [start, end) of the maximal runs of non-separators, never across rows; and the first word of each row (n + 1)."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~sep[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    before[off] = False
    start = np.flatnonzero(inside & ~before)
    follows = inside[1:].copy()
    cut = off[(off > 0) & (off <= len(data))] - 1
    follows[cut] = False
    end = np.flatnonzero(inside[:-1] & ~follows) + 1
    return start, end, np.searchsorted(start, off, "left")


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive items; the caller leaves out runs that cross rows."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    m = 1
    for i in range(size):
        m = m * _BASE % (1 << 64)
        out += h[i : i + n] * np.uint64(m)
    return mix(out)


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from each a and from each b on are equal."""
    stop = np.cumsum(size)
    inside = np.arange(int(stop[-1]) if len(stop) else 0) - np.repeat(stop - size, size)
    differ = data[np.repeat(a, size) + inside] != data[np.repeat(b, size) + inside]
    bad = np.zeros(len(size), bool)
    bad[np.repeat(np.arange(len(size)), size)[differ]] = True
    return ~bad


class HashClash(ValueError):
    """Two different things have one hash; nothing wrong is returned, the job ends."""


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each item, from the first item of each row."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def whole_windows(first: np.ndarray, size: int) -> np.ndarray:
    """Start items of the windows that stay within a row."""
    n = int(first[-1])
    ok = np.zeros(n + 1, np.int32)
    stop = np.maximum(first[1:] - size + 1, first[:-1])
    np.add.at(ok, first[:-1], 1)
    np.add.at(ok, stop, -1)
    return np.flatnonzero(np.cumsum(ok[:n]) > 0) if n else np.zeros(0, np.int64)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in some [start, end)."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:n]) > 0


def ranges_sum(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of flags over each row's items."""
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[first[1:]] - c[first[:-1]]
