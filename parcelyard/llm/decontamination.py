"""Benchmark decontamination with training suffix arrays.

Every task builds suffix arrays over slices of the documents it reads (a shard
each): word codes are ranked by prefix doubling to a depth of ``window`` words.
Every suffix of every test item is searched in each shard by binary search over
the ranks of depth 1, 2, 4, ..., which yields all places that share a whole
window; neighbouring places on one diagonal join into the longest verbatim
matches. Affected documents can then be removed. Documents are never shuffled.

The test items are read in blocks of a bounded size, each broadcast by itself. A
worker holds one block at a time, with the shards of a bounded number of bytes, so
memory does not depend on the number of items; executors keep the blocks on disk.

Words are maximal runs of letters a-z (A-Z are lowered first), digits and
non-ASCII characters. An item with fewer words than a window is one window as a
whole. Null and empty texts have no words and no matches. Items with equal ids
count once, those without an id are searched as one item. Rows of documents are
kept one to one, repeated ones too, with all their columns, whatever their names.
Empty documents give no rows; without items nothing is found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import common

#: Bytes of item texts in a broadcast block.
BLOCK_BYTES = 16 << 20
#: Bytes of text whose shards are held while the blocks take turns.
HELD_BYTES = 8 << 20
SEPARATOR = np.ones(256, bool)
SEPARATOR[48:58] = SEPARATOR[65:91] = SEPARATOR[97:123] = False
SEPARATOR[128:] = False


def codes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word codes of all rows, back to back, and each row's first word."""
    data, off = common.text_bytes(col)
    data = common.LOWER[data]
    start, end, first = common.words(data, off, SEPARATOR)
    return common.Prefix(data).hash(start, end), first


class SuffixArray:
    """Suffixes of a shard ordered by their first ``depth`` words, a power of two. Documents end with a sentinel that matches nothing."""

    def __init__(self, code: np.ndarray, first: np.ndarray, depth: int):
        n_rows = len(first) - 1
        n = len(code) + n_rows
        place = np.arange(len(code)) + common.row_of(first)
        self.words, rank1 = np.unique(code, return_inverse=True)
        rank = np.zeros(n, np.int64)
        rank[place] = rank1 + 1
        self.first = first[:-1] + np.arange(n_rows)
        self.levels: list[np.ndarray] = []
        self.ranks = [rank]
        h = 1
        while h < depth:
            key = rank * (n + 1)
            key[:-h] += rank[h:]
            key[rank == 0] = 0
            unique, rank = np.unique(key, return_inverse=True)
            # rank 0 stays the sentinel's; where there is none, 0 is left unused
            if not len(unique) or unique[0] != 0:
                unique, rank = np.concatenate(([0], unique)), rank + 1
            self.levels.append(unique)
            self.ranks.append(rank.astype(np.int64))
            h *= 2
        self.n, self.depth = n, depth
        self.order = np.argsort(self.ranks[-1], kind="stable")
        self.sorted = [r[self.order] for r in self.ranks]

    @staticmethod
    def _find(table: np.ndarray, value: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.full(len(value), -1)
        at = np.minimum(np.searchsorted(table, value), len(table) - 1)
        return np.where(table[at] == value, at, -1)

    def search(self, code: np.ndarray) -> list[np.ndarray]:
        """For each level, the rank here of the test suffixes' first 2**level words, or -1. ``code`` is one sequence; windows past its end are the caller's to leave out."""
        got = self._find(self.words, code)
        got = np.where(got >= 0, got + 1, -1)
        out, h = [got], 1
        for table in self.levels:
            nxt = np.full(len(code), -1)
            if len(code) > h:
                a, b = got[:-h], got[h:]
                key = np.where((a > 0) & (b > 0), a * (self.n + 1) + b, -1)
                nxt[: len(code) - h] = self._find(table, key)
            got = nxt
            out.append(got)
            h *= 2
        return out

    def places(self, rank: int, level: int) -> np.ndarray:
        """Positions whose first 2**level words have this rank: an interval of the suffix array."""
        s = self.sorted[level]
        return self.order[np.searchsorted(s, rank, "left") : np.searchsorted(s, rank, "right")]


class Items:
    """A block of test items as word codes."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids = ids
        self.code, self.first = codes(pa.array(texts, pa.string()))

    def hits(self, sa: SuffixArray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """(item, place in the item, place in the shard, words) of all occurrences of windows, by window length."""
        found = sa.search(self.code)
        level = window.bit_length() - 1
        sizes = np.diff(self.first)
        last = np.repeat(self.first[1:], sizes)
        at = np.flatnonzero((found[level] > 0) & (np.arange(len(self.code)) + window <= last))
        row = common.row_of(self.first)
        if len(at):
            rank = found[level][at]
            s = sa.sorted[level]
            lo, hi = np.searchsorted(s, rank, "left"), np.searchsorted(s, rank, "right")
            count = hi - lo
            idx = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            which = np.repeat(at, count)
            yield row[which], which - self.first[row[which]], sa.order[idx], window
        for i in np.flatnonzero((sizes > 0) & (sizes < window)):  # short items: by the powers of two in their length
            size, at0 = int(sizes[i]), int(self.first[i])
            place, done = None, 0
            for lev in range(level, -1, -1):
                if size & (1 << lev):
                    r = found[lev][at0 + done]
                    if r <= 0:
                        place = np.zeros(0, np.int64)
                        break
                    if place is None:
                        place = sa.places(int(r), lev)
                    else:
                        ok = place + done < sa.n
                        place = place[ok][sa.ranks[lev][place[ok] + done] == r]
                    done += 1 << lev
            if len(place):
                yield np.full(len(place), i), np.zeros(len(place), np.int64), place, size


def longest(item: np.ndarray, at: np.ndarray, place: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Joins occurrences that follow each other on a diagonal into the longest matches: (item, place in item, place in shard, words)."""
    order = np.lexsort((at, place - at, item))
    item, at, place = item[order], at[order], place[order]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (place[1:] - at[1:] != place[:-1] - at[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    run = np.diff(np.append(head, len(item)))
    return item[head], at[head], place[head], run + size - 1


def blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[tuple[list, list]]:
    """The test items, ``limit`` bytes of text at a time."""
    ids, texts, held = [], [], 0
    for r in benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        ids.append(r["i"])
        texts.append(r["t"])
        held += len(r["t"] or "")
        if held >= limit:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


class Shard:
    """A slice's suffix array and what was found in it."""

    def __init__(self, part: pa.RecordBatch, window: int):
        self.part = part
        code, first = codes(part.column(1))
        self.sa = SuffixArray(code, first, window)
        self.n_words = np.diff(first)
        self.owner = np.repeat(np.arange(part.num_rows), self.n_words + 1)
        self.flags = np.zeros(self.sa.n, bool)
        self.items: list[set] = [set() for _ in range(part.num_rows)]
        self.matches: list[list] = [[] for _ in range(part.num_rows)]

    def search(self, block: Items, window: int) -> None:
        for found in block.hits(self.sa, window):
            for i, at, place, size in zip(*(x.tolist() for x in longest(*found)), strict=True):
                d = int(self.owner[place])
                self.flags[place : place + size] = True
                self.items[d].add(block.ids[i])
                self.matches[d].append({"item": block.ids[i], "doc_word": place - int(self.sa.first[d]), "item_word": at, "words": size})

    def result(self, kind: pa.DataType) -> pa.RecordBatch:
        n_hit = common.ranges_sum(self.flags, np.append(self.sa.first, self.sa.n))
        match = pa.struct([("item", kind), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("words", pa.int64())])
        cols = [pa.array(self.n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([list(x) for x in self.items], pa.list_(kind)), pa.array(self.matches, pa.list_(match))]
        return pa.RecordBatch.from_arrays([*self.part.columns, *cols], ["doc", "text", "n_words", "n_hit", "items", "matches"])


def find(docs: DataFrame, benchmark: DataFrame, window: int = 8, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc (its other columns), text, n_words, n_hit, items (ids whose windows occur), matches (item, first word in the
    document, first word in the item, words: the longest verbatim matches). ``window`` is a power of two."""
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    spark = docs.sparkSession
    item_type = benchmark.schema[item_col].dataType
    kind = to_arrow_type(item_type)
    sent = [spark.sparkContext.broadcast(b) for b in blocks(benchmark, item_col, item_text_col, block_bytes)]
    folded = common.fold(docs, text_col)
    match = T.StructType([T.StructField("item", item_type), *[T.StructField(c, T.LongType()) for c in ("doc_word", "item_word", "words")]])
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(item_type)), T.StructField("matches", T.ArrayType(match))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = Items(*sent[0].value) if len(sent) == 1 else None

        def search(held: list[Shard]) -> Iterator[pa.RecordBatch]:
            for b in sent:
                block = only or Items(*b.load_from_path(b._path))  # not b.value, which would stay in memory
                for shard in held:
                    shard.search(block, window)
            for shard in held:
                yield shard.result(kind)

        held, size = [], 0
        for batch in batches:
            for part in common.slices(batch):
                held.append(Shard(part, window))
                size += part.nbytes
                if only or size >= HELD_BYTES:
                    yield from search(held)
                    held, size = [], 0
        yield from search(held)

    return folded.mapInArrow(common.tidy(run), T.StructType([*folded.schema.fields, *added]))


def digest(found: DataFrame, least_items: int = 2, id_col: str = "doc_id") -> DataFrame:
    named = F.array_sort(F.transform(F.array_distinct("items"), lambda x: x.cast("string")))
    n = F.size(F.array_distinct("items")).cast("long")
    return found.select(F.col("doc").getField(id_col).alias(id_col), "n_words", "n_hit", n.alias("n_items"), F.sha2(F.array_join(F.filter(named, lambda x: x.isNotNull()), ","), 256).alias("items_sha256"), (n >= least_items).alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame, least_items: int = 1, window: int = 8, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without those that hold windows of at least ``least_items`` items."""
    found = find(docs, benchmark, window, text_col, item_col, item_text_col)
    return common.unfold(found.filter(F.size("items") < least_items), docs, text_col)


def items_digest(ids: list) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
