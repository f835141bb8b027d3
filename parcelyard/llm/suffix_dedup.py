"""Suffix-array dedup of bytes with deep-shallow sorting.

Equal strings of ``size`` bytes are brought together by content-chosen anchors
(the smallest hash of a ``GRAM``-byte string in a window), and the suffixes that
start there are sorted: multikey quicksort partitions them by eight bytes at a
time down to a shallow depth, and the groups that still agree there are ordered
by blind tries, which look at branching bytes only and compare a suffix once.
Suffixes that stay together to ``size`` bytes are equal strings. Whole runs of
neighbouring strings that occur again as they are, as in copies, are settled once
by hash, verified by a digest or byte by byte; the sort orders the rest.

A byte goes if it is covered by a string of ``size`` bytes that also starts in a
document with a smaller id; strings are judged on the input. Null texts count as
empty. Ids must be integers; rows with a null id are never changed nor sources.
Repeated rows lose the same bytes and are not each other's sources; of documents
with one id, neither takes from the other. Other columns are not returned, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, repeats

#: Bytes of an anchor.
GRAM = 20
#: Bytes to which multikey quicksort goes before blind tries take over.
SHALLOW = 40
#: Windows whose anchors are found at once.
BLOCK = 1 << 16


class BlindTrie:
    """Strings of one length by their branching positions. A node is (position, {byte: child}); a leaf is a list of members, all equal."""

    __slots__ = ("at", "depth", "raw", "root", "size")

    def __init__(self, raw: bytes, at: np.ndarray, depth: int, size: int):
        self.raw, self.at, self.depth, self.size, self.root = raw, at, depth, size, None

    def get(self, member: int) -> bytes:
        a = int(self.at[member])
        return self.raw[a + self.depth : a + self.size]

    def add(self, member: int) -> None:
        if self.root is None:
            self.root = [member]
            return
        s = self.get(member)
        node = self.root
        while isinstance(node, tuple):  # blindly: bytes between branches are not looked at
            pos, kids = node
            node = kids.get(s[pos]) or next(iter(kids.values()))
        t = self.get(node[0])
        if s == t:
            node.append(member)
            return
        lo, hi = 0, len(s)  # the first byte in which they differ
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if s[:mid] == t[:mid] else (lo, mid)
        parent, node = None, self.root
        while isinstance(node, tuple) and node[0] < lo:
            parent, node = node, node[1][s[node[0]]]
        if isinstance(node, tuple) and node[0] == lo:
            node[1][s[lo]] = [member]
            return
        fork = (lo, {t[lo]: node, s[lo]: [member]})
        if parent is None:
            self.root = fork
        else:
            parent[1][s[parent[0]]] = fork

    def leaves(self) -> Iterator[list[int]]:
        """Equal members, in the order of their strings."""
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                yield node


def _words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number, without copying."""
    return np.ndarray((len(data) - 7,), ">u8", data, 0, (1,))


def sort_groups(data: np.ndarray, at: np.ndarray, size: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(members, starts): places in ``at`` of suffixes that agree in ``size`` bytes with another, group after group, and where each group starts.

    ``data`` holds ``size`` bytes from each place on. Multikey quicksort takes eight bytes as a key; all segments of a depth are
    partitioned together, and segments of one suffix are done. Groups come in suffix order at the shallow depth; blind tries keep
    that order within.
    """
    view = _words_at(data)
    idx, seg, depth = np.arange(len(at)), np.zeros(len(at), np.int64), 0
    while depth < shallow and len(idx):
        w = view[at[idx] + depth].astype(np.uint64)
        order = np.argsort(w, kind="stable") if depth == 0 else np.lexsort((w, seg))
        idx, seg, w = idx[order], seg[order], w[order]
        new = np.ones(len(idx), bool)
        new[1:] = (seg[1:] != seg[:-1]) | (w[1:] != w[:-1])
        seg = np.cumsum(new) - 1
        many = np.bincount(seg)[seg] > 1
        idx, seg = idx[many], seg[many]
        depth += 8
    if not len(idx):
        return idx, idx
    starts = np.flatnonzero(repeats._first_of(seg))
    # most groups are copies to the end, which their first suffix tells
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(idx))))
    head = at[idx[starts]]
    same = np.ones(len(idx), bool)
    for d in sorted({*range(depth, size - 7, 8), size - 8}):
        same &= view[at[idx] + d] == view[head[group] + d]
    mixed = np.zeros(len(starts), bool)
    mixed[group[~same]] = True
    if not mixed.any():
        return idx, starts
    out, sizes = [idx[~mixed[group]]], [np.diff(np.append(starts, len(idx)))[~mixed]]
    raw = data.tobytes()
    ends = np.append(starts[1:], len(idx))
    for g in np.flatnonzero(mixed).tolist():
        trie = BlindTrie(raw, at, depth, size)
        for i in idx[starts[g] : ends[g]].tolist():
            trie.add(i)
        leaves = [x for x in trie.leaves() if len(x) > 1]
        out += [np.array(x) for x in leaves]
        sizes.append(np.array([len(x) for x in leaves], np.int64))
    n = np.concatenate(sizes)
    return np.concatenate(out), np.concatenate(([0], np.cumsum(n)[:-1])).astype(np.int64)


def least(value: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest (the first, on ties) of each ``width`` neighbours, by doubling the width."""
    best, place, have = value, np.arange(len(value), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        a, b = best[:-step], best[step:]
        place = np.where(b < a, place[step:], place[:-step])
        best = np.minimum(a, b)
        have += step
    return place


class ByteWindows(repeats.Method):
    def __init__(self, size: int = 50):
        if size < GRAM or size < SHALLOW + 8:
            raise ValueError(f"windows need at least {max(GRAM, SHALLOW + 8)} bytes")
        self.size = size

    def runs(self, col: pa.Array) -> repeats.Runs:
        data, off = common.text_bytes(col)
        size = self.size
        found = [self._block(data, off, lo, min(lo + BLOCK, len(data) - size + 1)) for lo in range(0, len(data) - size + 1, BLOCK)]
        key, row, h, count, content, place = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.uint64 if i in (0, 4) else np.int64) for i in range(6))
        # a run that a block's edge cuts is put together again: what a run is must not depend on its neighbours in the batch
        cut = 1 + np.flatnonzero((h[1:] % BLOCK == 0) & (place[1:] == place[:-1]) & (row[1:] == row[:-1]) & (h[1:] == h[:-1] + count[:-1]))
        for i in cut.tolist():
            count[i - 1] += count[i]
            whole = data[h[i - 1] : h[i - 1] + count[i - 1] + size - 1]
            content[i - 1] = common.Prefix(whole).hash(np.array([0]), np.array([len(whole)]))[0]
        if len(cut):
            keep = np.ones(len(h), bool)
            keep[cut] = False
            key, row, h, count, content = key[keep], row[keep], h[keep], count[keep], content[keep]

        def pack(idx: np.ndarray) -> bytes:
            return b"".join([data[a:b].tobytes() for a, b in zip(h[idx].tolist(), (h[idx] + count[idx] + size - 1).tolist(), strict=True)])

        def single(idx: np.ndarray):
            n = count[idx]
            at = np.repeat(h[idx] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            return common.Prefix(data).hash(at, at + size), lambda k: b"".join([data[a : a + size].tobytes() for a in at[k].tolist()])

        def plain(i: int) -> bytes:
            return data[h[i] : h[i] + count[i] + size - 1].tobytes()

        return repeats.Runs(key, row, h - off[row], count, content, pack, plain, single)

    def _block(self, data: np.ndarray, off: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, ...]:
        """Runs of the windows that start in [lo, hi), with the places of their anchors; a block's arrays stay in the processor's cache."""
        size, n = self.size, hi - lo
        seg = data[lo : hi + size - 1]
        pre = common.Prefix(seg)
        m = len(seg) - GRAM + 1
        gram = common.mix((pre.sums[GRAM:] - pre.sums[:m]) * pre.q[:m])
        pick = least(gram, size - GRAM + 1)
        new = np.ones(n, bool)
        np.not_equal(pick[1:], pick[:-1], out=new[1:])
        edges = off - lo
        first, last = np.searchsorted(edges, (0, n), "left")
        new[edges[first:last]] = True
        # windows that reach past the end of their row
        past = np.zeros(n, bool)
        for e in edges[(edges > 0) & (edges < n + size)].tolist():
            past[max(0, e - size + 1) : min(e, n)] = True
            if 0 < e - size + 1 < n:
                new[e - size + 1] = True
        if off[-1] - lo < n + size - 1:
            raise AssertionError("blocks end with the buffer")
        heads = np.flatnonzero(new)
        count = np.diff(np.append(heads, n))
        ok = ~past[heads]
        h, count = heads[ok], count[ok]
        content = pre.hash(h, h + count + size - 1)
        row = np.searchsorted(off, h + lo, "right") - 1
        return gram[pick[h]], row, h + lo, count, content, pick[h].astype(np.int64) + lo

    def compare(self, body: bytes, owner: np.ndarray, count: np.ndarray, key: np.ndarray) -> np.ndarray:
        size = self.size
        length = count + size - 1
        first = np.concatenate(([0], np.cumsum(length)))
        data = np.frombuffer(body + bytes(size + 8), np.uint8)
        window0 = np.concatenate(([0], np.cumsum(count)))
        out = np.zeros(window0[-1], bool)
        # equal runs first: all but those of the smallest owner are settled, one of the rest stands for them
        h = common.Prefix(data).hash(first[:-1], first[1:])
        order = np.lexsort((owner, h))
        new = repeats._first_of(h[order])
        group = np.empty(len(h), np.int64)
        group[order] = np.cumsum(new) - 1
        lead = order[new]
        least_owner = owner[lead]
        other = np.flatnonzero(lead[group] != np.arange(len(h)))
        if np.any(length[other] != length[lead[group[other]]]) or not common.same_bytes(data, first[:-1][other], first[:-1][lead[group[other]]], length[other]).all():
            raise common.HashClash("two different runs have one 64-bit hash")
        # suffixes of the distinct runs whose anchor another distinct run has
        _, same_key = np.unique(key[lead], return_inverse=True)
        rival = np.bincount(same_key)[same_key] > 1
        n = count[lead]
        base = np.concatenate(([0], np.cumsum(n)))
        beaten = np.zeros(base[-1], bool)
        m = np.where(rival, n, 0)
        stop = np.cumsum(m)
        inside = np.arange(stop[-1]) - np.repeat(stop - m, m)
        at = np.repeat(first[lead], m) + inside
        place = np.repeat(base[:-1], m) + inside
        doc = np.repeat(least_owner, m)
        members, starts = sort_groups(data, at, size)
        if len(members):
            low = np.minimum.reduceat(doc[members], starts)
            span = np.diff(np.append(starts, len(members)))
            beaten[place[members]] = doc[members] > np.repeat(low, span)
        src = np.repeat(base[group] - window0[:-1], count) + np.arange(len(out))
        out[:] = beaten[src] | np.repeat(owner > least_owner[group], count)
        return out


def dedup(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = True) -> DataFrame:
    """(id, kept, n_bytes, n_removed, kept_sha256, spans): the remaining bytes concatenated, and the removed byte ranges."""
    found = repeats.with_marks(docs, ByteWindows(size), id_col, text_col)
    schema = "id long, kept binary, n_bytes long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                rows = []
                for text, marks in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    raw = text.encode("utf-8", "replace")
                    spans = repeats.ranges(marks)
                    kept, at = [], 0
                    for a, b in spans.tolist():
                        kept.append(raw[at:a])
                        at = b
                    left = b"".join([*kept, raw[at:]])
                    rows.append((left if keep_bytes else None, len(raw), int((spans[:, 1] - spans[:, 0]).sum()), hashlib.sha256(left).hexdigest(), [{"start": a, "end": b} for a, b in spans.tolist()]))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    ["id", "kept", "n_bytes", "n_removed", "kept_sha256", "spans"],
                )

    return found.mapInArrow(common.tidy(run), schema).withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")

