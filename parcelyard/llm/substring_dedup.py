"""Substring dedup by recompression of word sequences.

Rounds give global names to symbols, starting from words: first to short runs of
one word, then to pairs. A round splits the alphabet in two by a bit of each
name; a left symbol followed by a right one becomes one symbol. Names are 64-bit
fingerprints of what they stand for, so every task of every round gives equal
pairs equal names without a shared dictionary. Whether two neighbours join
depends on a bounded number of words around them, so inside equal passages the
parses agree except near the ends. Each window of ``size`` words takes the
smallest-named of the high-level symbols that lie in its agreed middle, named
together with the agreed words around it; documents that share such a name are
brought together. There all words, then pairs, pairs of pairs and so on up to a
window get exact names, words compared byte by byte, so windows of one name are
equal. Whole runs of windows that occur again as they are, as in copies, are
settled once by hash, verified by a digest of their words.

A removed word is covered by a window that also starts in a document with a
smaller id, judged on the input. Null and empty texts have no words. Ids must be
integers; rows with a null id are never changed nor sources. Repeated rows lose the
same words and are not each other's sources; of documents with one id, neither takes
from the other. Other columns are not returned, whatever their names. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, repeats

#: Longest run of one word that gets a name; longer ones keep their single words.
RUN = 3
#: Pair rounds after the run round.
ROUNDS = 2


def reach() -> tuple[int, int]:
    """(words around a symbol boundary that decide it, longest symbol in words)."""
    around, longest = RUN + 1, RUN
    for _ in range(ROUNDS):
        around, longest = around + longest, 2 * longest
    return around, longest


def recompress(code: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and first words of the highest symbols; symbols never cross rows."""
    name, at = code, np.arange(len(code))
    if not len(name):
        return name, at
    # runs of a word
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(name)))
    short = (size > 1) & (size <= RUN)
    run = np.cumsum(new) - 1
    keep = new | ~short[run]
    name = np.where(short[run], common.mix(name + size[run].astype(np.uint64) * common._P2), name)[keep]
    at = at[keep]
    for t in range(ROUNDS):
        side = common.mix(name ^ np.uint64(0x9E37 + 2 * t)) & np.uint64(1)
        join = np.zeros(len(name), bool)
        join[:-1] = (side[:-1] == 0) & (side[1:] == 1) & (row[at[1:]] == row[at[:-1]])
        pair = np.zeros(len(name), np.uint64)
        pair[:-1] = common.mix(name[:-1] * common._P1 + common.mix(name[1:]) + np.uint64(t + 1))
        name = np.where(join, pair, name)
        keep = np.ones(len(name), bool)
        keep[1:] = ~join[:-1]
        name, at = name[keep], at[keep]
    return name, at


def least_in_window(value: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Position of the smallest value (the first, on ties) in each [lo, hi), all non-empty; by a sparse table of doubling widths."""
    width = hi - lo
    out = np.empty(len(lo), np.int64)
    level, best = 0, np.arange(len(value))
    top = int(width.max()).bit_length() if len(width) else 0
    bits = np.frexp(width.astype(float))[1] - 1  # floor(log2(width))
    while level < top:
        use = bits == level
        a, b = best[lo[use]], best[hi[use] - (1 << level)]
        out[use] = np.where(value[b] < value[a], b, a)
        step = 1 << level
        if len(best) > step:
            a, b = best[:-step], best[step:]
            best = np.where(value[b] < value[a], b, a)
        level += 1
    return out


class WordWindows(repeats.Method):
    def __init__(self, size: int = 50):
        around, longest = reach()
        if size < 2 * around + 2 * longest:
            raise ValueError(f"windows need at least {2 * around + 2 * longest} words")
        self.size = size

    def runs(self, col: pa.Array) -> repeats.Runs:
        data, off = common.text_bytes(col)
        start, end, first = common.words(data, off)
        code = common.Prefix(data).hash(start, end)
        row = common.row_of(first)
        w = common.whole_windows(first, self.size)
        if not len(w):
            none = np.zeros(0, np.int64)
            return repeats.Runs(none.astype(np.uint64), none, none, none, none.astype(np.uint64), lambda idx: b"", lambda i: b"", lambda idx: (none.astype(np.uint64), lambda k: b""))
        around, _ = reach()
        name, at = recompress(code, row)
        stop = np.append(at[1:], len(code))
        stop = np.minimum(stop, first[row[at] + 1])
        # a symbol's key: its name and the words around it that every window holding it in its middle has
        sums = np.zeros(len(code) + 1, np.uint64)
        p, q = common._pow(len(code) + 1)
        np.cumsum(code * p[: len(code)], out=sums[1:])
        a, b = np.maximum(at - around, 0), np.minimum(stop + around, len(code))
        key = common.mix((sums[b] - sums[a]) * q[a] + common.mix(name))
        lo = np.searchsorted(at, w + around)
        hi = np.searchsorted(stop, w + self.size - around, "right")
        pick = least_in_window(key, lo, hi)
        new = np.ones(len(w), bool)
        new[1:] = (pick[1:] != pick[:-1]) | (w[1:] != w[:-1] + 1)
        h = np.flatnonzero(new)
        count = np.diff(np.append(h, len(w)))
        sym = pick[h]
        full = common.windows(code, self.size)
        content = common.mix((sums[w[h] + count + self.size - 1] - sums[w[h]]) * q[w[h]] + count.astype(np.uint64))

        raw = data.tobytes()

        def words_of(a: int, b: int) -> bytes:
            """Words a to b, each followed by one space."""
            return b" ".join([*raw[start[a] : end[b - 1]].split(), b""])

        def plain(i: int) -> bytes:
            return words_of(w[h[i]], w[h[i]] + count[i] + self.size - 1)

        def pack(idx: np.ndarray) -> bytes:
            return b"".join([plain(i) for i in idx.tolist()])

        def single(idx: np.ndarray):
            s, n = w[h[idx]], count[idx]
            at = np.repeat(s - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            return full[at], lambda k: b"".join([words_of(a, a + self.size) for a in at[k].tolist()])

        r = row[w[h]]
        return repeats.Runs(key[sym], r, w[h] - first[r], count, content, pack, plain, single)

    def compare(self, body: bytes, owner: np.ndarray, count: np.ndarray, key: np.ndarray) -> np.ndarray:
        data = np.frombuffer(body, np.uint8)
        end = np.flatnonzero(data == 32)
        start = np.concatenate(([0], end[:-1] + 1))
        first = np.concatenate(([0], np.cumsum(count + self.size - 1)))
        name = windows_named(exact_names(data, start, end), self.size)
        at = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        name, doc = name[at], np.repeat(owner, count)
        least = np.full(int(name.max()) + 1 if len(name) else 0, np.iinfo(np.int64).max)
        np.minimum.at(least, name, doc)
        return doc > least[name]


def exact_names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words only: words of one hash are compared byte by byte."""
    _, at, name = np.unique(common.Prefix(data).hash(start, end), return_index=True, return_inverse=True)
    size = end - start
    other = np.flatnonzero(at[name] != np.arange(len(name)))
    lead = at[name[other]]
    if np.any(size[other] != size[lead]) or not common.same_bytes(data, start[other], start[lead], size[other]).all():
        raise common.HashClash("two different words have one 64-bit hash")
    return name


def windows_named(name: np.ndarray, size: int) -> np.ndarray:
    """A number for the window from each place on, equal for equal windows only: pairs of names of a length get names of the double
    length, as far as the window reaches; two of those overlap in a window. Windows past the end have none."""
    length = 1
    while 2 * length <= size:
        name = paired(name[: len(name) - length], name[length:])
        length *= 2
    rest = size - length
    return paired(name[: len(name) - rest], name[rest:]) if rest else name


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(a * (int(b.max()) + 1 if len(b) else 1) + b, return_inverse=True)[1]


def dedup(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """(id, text, n_words, n_removed, kept_sha256, spans): the kept words joined by one space, and the removed word ranges."""
    found = repeats.with_marks(docs, WordWindows(size), id_col, text_col)
    schema = "id long, text string, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                rows = []
                for text, marks in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    found = text.encode("utf-8", "replace").split()
                    spans = repeats.ranges(marks)
                    kept, at = [], 0
                    for a, b in spans.tolist():
                        kept += found[at:a]
                        at = b
                    left = b" ".join(kept + found[at:])
                    rows.append((left if keep_text else None, len(found), int((spans[:, 1] - spans[:, 0]).sum()), hashlib.sha256(left).hexdigest(), [{"start": a, "end": b} for a, b in spans.tolist()]))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(cols[0], pa.binary()).cast(pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    ["id", "text", "n_words", "n_removed", "kept_sha256", "spans"],
                )

    return found.mapInArrow(common.tidy(run), schema).withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, "n_words", "n_removed", "kept_sha256")
