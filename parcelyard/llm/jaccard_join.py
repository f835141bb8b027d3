"""N-gram Jaccard join with count-vector R-trees.

A document is the set of its distinct shingles (hashes of word n-grams). Hashing
the shingles into groups and counting them gives a point; the overlap of two
sets is at most the sum of the coordinate minima of their points. An R-tree over
points keeps the upper corner of each node, so a search drops whole nodes whose
corner leaves too small a bound; surviving pairs are verified on the sets.

The tree is sharded so that no pair with enough overlap is missed: in a fixed
order of all shingles, two sets with Jaccard t or more share one of their first
n - ceil(t n) + 1 shingles. The order puts frequent shingles last, then goes by
hash. A shard holds the documents that share such a shingle. With k - 1 shingles
more at the front they share k of them; unrelated texts share one by chance, the
more often the larger the table is, but hardly ever k.

1. Equal sets collapse to one representative each.
2. Representatives learn which of their leading shingles others have as well;
   those that share fewer than k are done.
3. Two linking rounds: points visit one shard each, the trees name each point's
   likeliest partners, their texts are compared, and components form. Hot shards
   are salted; the second round has one representative per component and less salt.
4. Exact rest: of the shingles that still meet several components, those of few
   components count only for pairs of components that share k of them; points go
   to the shards of what is left and the trees list all pairs between components,
   which are verified. Hot shards are dealt in pairs of blocks. So no link is lost.

Texts move only where a pair has to be verified, once per shard.

Null and empty texts have no shingles, link with nothing and are their own
component. Shorter texts than an n-gram count as one shingle. Repeated rows have
equal sets. Ids must be integers. An empty table gives no rows. Other columns may have
any names; they take no part. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, repeats
from .components import components

#: Groups of the points of sets of up to FEW shingles; every doubling of the size doubles them, DOUBLINGS times at most.
GROUPS = 128
FEW = 512
DOUBLINGS = 3
#: Bytes of points that are handed on at once.
HANDED = 4 << 20
LEAF = 32
#: Of a member's open shards, in an order that is the same for all, so many travel with its point.
SEEN = 16
#: Members of a shard that are looked at together in the linking rounds.
BLOCK = 4096
#: A shingle is frequent if this part of all rows has it (and at least HOT_LEAST rows); so there are at most HOT_PART times the mean set size of them.
HOT_PART = 1024
HOT_LEAST = 64
#: Leading shingles that linked sets are sure to share, where the similarity allows it.
MEET = 4
#: A shingle of at most so many components counts for each pair of them; one of more opens a shard for all.
PAIRED = 64
#: Pairs of components that a task holds before it hands them on.
PAIRS = 1 << 18


def need(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of sets of sizes n and m with 100 * intersection >= percent * union."""
    total = (np.asarray(n, np.int64) + np.asarray(m, np.int64)) * percent
    return -(-total // (100 + percent))


def meet(percent: int) -> int:
    """How many leading shingles linked sets share: MEET, or the least overlap that two different linked sets can have if that is less."""
    return min(MEET, -(-percent // (100 - percent))) if percent < 100 else MEET


def leading(n: np.ndarray, percent: int) -> np.ndarray:
    """How many first shingles of a set of n must be looked at, so that linked sets share ``meet`` of them."""
    k = meet(percent)
    return n - np.maximum(-(-n * percent // 100), k) + k


def shingles(col: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows in order of hash, back to back, and each row's first."""
    data, off = common.text_bytes(col)
    data = common.LOWER[data]
    start, end, first = common.words(data, off)
    code = common.Prefix(data).hash(start, end)
    at = common.whole_windows(first, size)
    h, row = common.windows(code, size)[at] if len(at) else np.zeros(0, np.uint64), common.row_of(first)[at]
    n = np.diff(first)
    for k in range(1, size):  # short texts
        rows = np.flatnonzero(n == k)
        if len(rows):
            own = common.windows(code, k)[first[rows]] ^ common.mix(np.full(len(rows), k, np.uint64))
            h, row = np.concatenate([h, own]), np.concatenate([row, rows])
    count = np.bincount(row, minlength=len(col))
    edges = np.concatenate(([0], np.cumsum(count)))
    if np.any(row[1:] < row[:-1]):
        h = h[np.argsort(row, kind="stable")]
    else:
        h = h.copy()
    for i in np.flatnonzero(count > 1).tolist():  # a sort per row is faster than one by row and hash
        h[edges[i] : edges[i + 1]].sort()
    row = np.repeat(np.arange(len(col)), count)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.concatenate(([0], np.cumsum(np.bincount(row[new], minlength=len(col)))))


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One number per set, equal for equal sets."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(common.mix(h ^ common._P3), out=sums[1:])
    n = np.diff(first).astype(np.uint64)
    return common.mix(sums[first[1:]] - sums[first[:-1]] + n * common._P1).view(np.int64)


def scale(n: np.ndarray) -> np.ndarray:
    """How often the groups are doubled for sets of n."""
    return np.frexp(np.maximum(np.asarray(n) - 1, 1) / FEW)[1].clip(0, DOUBLINGS)


def point(h: np.ndarray) -> bytes:
    """A set's counts per group, up to 255 each; what is beyond is the set's size less the sum."""
    k = int(scale(len(h))) + 7
    return np.minimum(np.bincount((h >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k), 255).astype(np.uint8).tobytes()


class CountTree:
    """An R-tree over count points, bulk-loaded by median cuts along the widest coordinate; a node's box is its upper corner and its range of sizes."""

    def __init__(self, pts: np.ndarray, sizes: np.ndarray):
        self.pts, self.sizes = pts, sizes
        self.slack = sizes - pts.sum(1, dtype=np.int64)
        leaves, stack = [], [np.arange(len(pts))]
        while stack:
            idx = stack.pop()
            if len(idx) <= LEAF:
                leaves.append(idx)
                continue
            spread = sizes[idx].max() - sizes[idx].min()
            sub = pts[idx]
            wide = sub.max(0).astype(np.int64) - sub.min(0)
            key = sizes[idx] if spread >= wide.sum() / 2 else sub[:, int(wide.argmax())]
            idx = idx[np.argsort(key, kind="stable")]
            stack += [idx[len(idx) // 2 :], idx[: len(idx) // 2]]
        self.leaves = leaves
        self.levels = []
        corner = np.stack([pts[i].max(0) for i in leaves])
        slack = np.array([self.slack[i].max() for i in leaves])
        low = np.array([sizes[i].min() for i in leaves])
        high = np.array([sizes[i].max() for i in leaves])
        self.levels.append((corner, slack, low, high))
        while len(corner) > 8:
            cut = np.arange(0, len(corner), 8)
            corner = np.maximum.reduceat(corner, cut, axis=0)
            slack, low, high = np.maximum.reduceat(slack, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((corner, slack, low, high))

    def search(self, q: np.ndarray, size: int, slack: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Members whose bound with the query reaches what their sizes need, and the bounds."""
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, sl, low, high = (x[nodes] for x in self.levels[depth])
            bound = np.minimum(corner, q).sum(1, dtype=np.int64) + np.minimum(sl, slack)
            ok = (high * 100 >= size * percent) & (low * percent <= size * 100) & (bound >= need(np.maximum(low, -(-size * percent // 100)), size, percent))
            nodes = nodes[ok]
            if depth and len(nodes):
                nodes = (nodes[:, None] * 8 + np.arange(8)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1][0])]
        if not len(nodes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        idx = np.concatenate([self.leaves[k] for k in nodes])
        n = self.sizes[idx]
        bound = np.minimum(self.pts[idx], q).sum(1, dtype=np.int64) + np.minimum(self.slack[idx], slack)
        ok = (bound >= need(n, size, percent)) & (n * 100 >= size * percent) & (n * percent <= size * 100)
        return idx[ok], bound[ok]


class Forest:
    """The members of a shard in a tree per scale. Linked sets differ by a quarter in size at most, so by one scale at most;
    between scales the finer point is folded."""

    def __init__(self, sizes: np.ndarray, pts: list[bytes], percent: int):
        self.percent, self.sizes, self.scales = percent, sizes, scale(sizes)
        self.trees: dict[int, tuple[np.ndarray, CountTree]] = {}
        for c in np.unique(self.scales).tolist():
            idx = np.flatnonzero(self.scales == c)
            self.trees[c] = idx, CountTree(np.frombuffer(b"".join([pts[i] for i in idx]), np.uint8).reshape(-1, GROUPS << c), sizes[idx])
        self.place = np.zeros(len(sizes), np.int64)
        for idx, _ in self.trees.values():
            self.place[idx] = np.arange(len(idx))

    def before(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Members that could be linked to i and come before it: of its scale those with smaller numbers, of the scale below all."""
        c = int(self.scales[i])
        idx, tree = self.trees[c]
        q, slack, size = tree.pts[self.place[i]], int(tree.slack[self.place[i]]), int(self.sizes[i])
        found, bound = tree.search(q, size, slack, self.percent)
        found = idx[found]
        ok = found < i
        found, bound = found[ok], bound[ok]
        if c - 1 in self.trees and size * self.percent <= 100 * (FEW << (c - 1)):
            idx, tree = self.trees[c - 1]
            more, high = tree.search(q.reshape(-1, 2).sum(1, dtype=np.uint16), size, slack, self.percent)
            found, bound = np.concatenate([found, idx[more]]), np.concatenate([bound, high])
        return found, bound


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets, as sorted hashes, reach the similarity."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


class Hot:
    """Frequent shingles with their counts, as sorted arrays; bounded in number whatever the size of the table."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]

    def count(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.counts[at], 0)


def frequent(found: DataFrame, n_rows: int) -> Hot:
    """Shingles that many distinct texts have, from the slices' lists in the table of sets."""
    least = max(HOT_LEAST, n_rows // HOT_PART)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(x.as_py(), np.int64).reshape(2, -1) for x in batch.column(0)]
            if lists:
                both = np.concatenate(lists, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["key", "n"])

    got = found.filter("often is not null").select("often").mapInArrow(common.tidy(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toArrow()
    return Hot(got["key"].to_numpy().view(np.uint64), got["n"].to_numpy())


def prefix(h: np.ndarray, first: np.ndarray, hot: Hot, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading shingles of every row in the common order (frequent ones last, then by hash): (shingle, row)."""
    row = common.row_of(first)
    late = hot.count(h) > 0
    if late.any():
        order = np.lexsort((h, late, row))
        h = h[order]
    n = np.diff(first)
    place = np.arange(len(h)) - first[row]
    take = place < leading(n, percent)[row]
    return h[take], row[take]


def tables(rows: DataFrame, size: int) -> DataFrame:
    """(row, id, sig, n, often) of every row. ``often``, on a slice's first row: shingles that eight or more of its distinct texts
    have, with how many; rarer ones never leave the slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                h, first = shingles(part.column(2), size)
                sig = signatures(h, first)
                _, once = np.unique(sig, return_index=True)
                keep = np.zeros(part.num_rows, bool)
                keep[once] = True
                key = np.sort(h[keep[common.row_of(first)]])
                heads = np.flatnonzero(repeats._first_of(key))
                n = np.diff(np.append(heads, len(key)))
                many = n >= max(8, len(once) // 256)
                often = [np.stack([key[heads[many]].view(np.int64), n[many]]).astype(np.int64).tobytes() if many.any() else None, *[None] * (part.num_rows - 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sig), pa.array(np.diff(first).astype(np.int64)), pa.array(often, pa.binary())], ["row", "id", "sig", "n", "often"])

    return rows.mapInArrow(common.tidy(run), "row long, id long, sig long, n long, often binary")


def _announce_pairs(key: np.ndarray, who: np.ndarray, addr: np.ndarray, ids: int) -> list[tuple]:
    """Rows of repeats.ANNOUNCED for (key, who) pairs: a key is shared if two different ``who`` have it."""
    order = np.lexsort((who, key))
    key, who, addr = key[order], who[order], addr[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (who[1:] != who[:-1])
    key, who, addr = key[new], who[new], addr[new]
    start = repeats._first_of(key)
    heads = np.flatnonzero(start)
    many = np.diff(np.append(heads, len(key))) > 1
    told = many[np.cumsum(start) - 1]
    out = [(int(a % ids), int(a), ks.tobytes(), None) for a, ks in repeats._by(addr[told], key[told])]
    one = np.where(many, repeats.NOBODY, addr[heads])
    for b, ks, w in repeats._by((key[heads] % np.uint64(ids)).astype(np.int64), key[heads], one):
        out.append((int(b), None, ks.tobytes(), w.tobytes()))
    return out


def shared_prefixes(rows: DataFrame, size: int, percent: int, hot, ids: int, parts: int) -> DataFrame:
    """(row: a set's signature, keys: leading shingles that other sets lead with too); a set may come in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                h, first = shingles(part.column(2), size)
                if not len(h):
                    continue
                sig = signatures(h, first)
                key, row = prefix(h, first, hot.value, percent)
                yield repeats._batch(repeats.ANNOUNCED, _announce_pairs(key, sig[row], sig[row], ids))

    return rows.mapInArrow(common.tidy(run), repeats.ANNOUNCED).repartition(parts, "bucket").mapInArrow(common.tidy(repeats.settle_keys), repeats.SHARED)


def near_pairs(sizes: list[int], pts: list[bytes], percent: int) -> Iterator[tuple[int, int]]:
    """Pairs whose bound is high enough: by the forest, or one by one in a small shard."""
    if len(sizes) > 12:
        forest = Forest(np.array(sizes, np.int64), pts, percent)
        for i in range(len(sizes)):
            for j in forest.before(i)[0].tolist():
                yield i, j
        return
    arrays = [np.frombuffer(p, np.uint8) for p in pts]
    slack = [n - int(a.sum(dtype=np.int64)) for n, a in zip(sizes, arrays, strict=True)]
    for i in range(len(sizes)):
        for j in range(i):
            n, m = sizes[i], sizes[j]
            if m * 100 < n * percent or n * 100 < m * percent:
                continue
            x, y = arrays[i], arrays[j]
            if len(x) != len(y):
                x, y = (x, y) if len(x) > len(y) else (y, x)
                x = x.reshape(len(y), -1).sum(1, dtype=np.uint16)
            bound = int(np.minimum(x, y).sum(dtype=np.int64)) + min(slack[i], slack[j])
            if bound * (100 + percent) >= (n + m) * percent:
                yield i, j


#: A set to be verified against others of its shard. ``comp``: what it is known to be linked to.
CALLED = "shard long, cell long, sig long, comp long"


def likely_members(members: DataFrame, hot, percent: int, parts: int, order: int) -> DataFrame:
    """Members (CALLED) to verify first: each visits the shard of its smallest shared shingle under an order, and is called if the
    bound with another one is high enough. Shards of frequent shingles are salted, less so in later orders, and so bounded. Misses
    links; the exact rest follows."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = []
            for sig, keys in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
                k = np.frombuffer(keys.as_py(), np.uint64)
                s = int(k[np.argmin(common.mix(k ^ np.uint64(order * 7919)))])
                n = int(hot.value.count(np.array([s], np.uint64))[0])
                salt = sig % (n // (1024 << 4 * order) + 1)
                shard.append(int(common.mix(np.array([(s + salt * 0x9E3779B97F4A7C15) % (1 << 64)], np.uint64)).view(np.int64)[0]))
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), batch.column(0), batch.column(2), batch.column(4)], ["shard", "sig", "n", "point"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, group, block = None, [], 0

        def close() -> list[tuple]:
            if len(group) < 2:
                return []
            called: set[int] = set()
            for pair in near_pairs([g[1] for g in group], [g[2] for g in group], percent):
                called.update(pair)
            return [(current, block, group[i][0], group[i][0]) for i in sorted(called)]

        for batch in batches:
            out = []
            for shard, *rest in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if shard != current or len(group) >= BLOCK:
                    out += close()
                    # a full block leaves its first members behind, so that the next one can join them
                    block = block + 1 if shard == current else 0
                    current, group = shard, group[:8] if shard == current else []
                group.append(rest)
            yield repeats._batch(CALLED, out)
        yield repeats._batch(CALLED, close())

    moved = members.mapInArrow(common.tidy(send), "shard long, sig long, n long, point binary").repartition(parts, "shard").sortWithinPartitions("shard", "sig")
    return moved.mapInArrow(common.tidy(search), CALLED)


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])


GROUPED = "bucket int, keys binary, comps binary, low binary, high binary"
SETTLED = "bucket int, row long, keys binary, shards binary, a binary, b binary"
OPEN = "row long, keys binary, shards binary"


def open_keys(members: DataFrame, hot, percent: int, parts: int) -> DataFrame:
    """(row: component, keys, shards): shingles that it shares with other components, from (sig, comp, keys, n).

    Shingles shared by the same components form one shard, however many they are: near copies share most of their leading
    shingles. Where at most PAIRED components have a shingle, it counts for those pairs of them whose sizes allow a link, and opens
    a shard for the pairs that share ``meet`` such shingles; linked sets that share fewer of those share one that more have.
    Frequent shingles are told by their smallest and largest component alone, which is enough to know whether several
    components have them; those that several have come in rows without component and are shards of their own for all their holders.
    """
    ids = repeats.even_ids(parts)
    least = meet(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(k.as_py(), np.uint64) for k in batch.column(2)]
            n = np.array([len(x) for x in lists], np.int64)
            if not n.sum():
                continue
            size = np.repeat(batch.column(3).to_numpy(), n)
            key, comp, low, high = _ranges(np.concatenate(lists), np.repeat(batch.column(1).to_numpy(), n), size, size)
            start = repeats._first_of(key)
            told = (hot.value.count(key) == 0) | start | np.append(start[1:], True)
            key, comp, low, high = key[told], comp[told], low[told], high[told]
            yield repeats._batch(GROUPED, [(int(ids[p]), *[x.tobytes() for x in own]) for p, *own in repeats._by((key % np.uint64(parts)).astype(np.int64), key, comp, low, high)])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list] = [[], [], [], []]
        for batch in batches:
            for column, kind, to in zip(batch.columns[1:], (np.uint64, np.int64, np.int64, np.int64), got, strict=True):
                to += [np.frombuffer(x.as_py(), kind) for x in column]
        if not got[0]:
            return
        key, comp, low, high = _ranges(*[np.concatenate(x) for x in got])
        heads = np.flatnonzero(repeats._first_of(key))
        n = np.diff(np.append(heads, len(key)))
        shard = common.mix(np.add.reduceat(common.mix(comp.view(np.uint64)), heads) + n.astype(np.uint64))
        often = hot.value.count(key[heads]) > 0
        many = np.repeat((n > PAIRED) & ~often, n)
        held = key[heads[often & (n > 1)]].tobytes()
        out: list[tuple] = [(0, None, held, held, None, None)] if held else []
        for c, k, s in repeats._by(comp[many], key[many], np.repeat(shard, n)[many]):
            out.append((int(ids[c % parts]), int(c), k.tobytes(), s.tobytes(), None, None))
            if len(out) == 5000:
                yield repeats._batch(SETTLED, out)
                out = []
        yield repeats._batch(SETTLED, out)
        met: list[tuple] = []
        for size in range(2, PAIRED + 1):
            groups = np.flatnonzero((n == size) & ~often)
            i, j = np.triu_indices(size, 1)
            step = max(1, PAIRS // len(i))
            for lo in range(0, len(groups), step):
                g = groups[lo : lo + step]
                x, y = (heads[g][:, None] + i).ravel(), (heads[g][:, None] + j).ravel()
                fit = (high[x] * 100 >= low[y] * percent) & (high[y] * 100 >= low[x] * percent)
                x, y = x[fit], y[fit]
                met.append((key[x], np.repeat(shard[g], len(i))[fit], comp[x], comp[y]))
                if sum(len(m[0]) for m in met) >= PAIRS:
                    yield dealt(met)
                    met = []
        if met:
            yield dealt(met)

    def dealt(met: list[tuple]) -> pa.RecordBatch:
        key, shard, a, b = (np.concatenate(x) for x in zip(*met, strict=True))
        to = (common.mix(a.view(np.uint64) ^ common.mix(b.view(np.uint64))) % np.uint64(parts)).astype(np.int64)
        return repeats._batch(SETTLED, [(int(ids[p]), None, *[v.tobytes() for v in own]) for p, *own in repeats._by(to, key, shard, a, b)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list] = [[], [], [], []]
        for batch in batches:
            ready = np.asarray(batch.column(4).is_null())
            passed = batch.filter(pa.array(ready))
            yield pa.RecordBatch.from_arrays(passed.columns[1:4], ["row", "keys", "shards"])
            pairs = batch.filter(pa.array(~ready))
            for column, kind, to in zip(pairs.columns[2:], (np.uint64, np.uint64, np.int64, np.int64), got, strict=True):
                to += [np.frombuffer(x.as_py(), kind) for x in column]
        if not got[0]:
            return
        key, shard, a, b = (np.concatenate(x) for x in got)
        order = np.lexsort((b, a))
        key, shard, a, b = key[order], shard[order], a[order], b[order]
        new = repeats._first_of(a) | repeats._first_of(b)
        times = np.diff(np.append(np.flatnonzero(new), len(a)))
        enough = np.repeat(times >= least, times)
        key, shard = np.tile(key[enough], 2), np.tile(shard[enough], 2)
        comp = np.concatenate([a[enough], b[enough]])
        out: list[tuple] = []
        for c, k, s in repeats._by(comp, key, shard):
            k, once = np.unique(k, return_index=True)
            out.append((int(c), k.tobytes(), s[once].tobytes()))
            if len(out) == 5000:
                yield repeats._batch(OPEN, out)
                out = []
        yield repeats._batch(OPEN, out)

    settled = members.mapInArrow(common.tidy(run), GROUPED).repartition(parts, "bucket").mapInArrow(common.tidy(settle), SETTLED)
    return settled.repartition(parts, "bucket").mapInArrow(common.tidy(count), OPEN)


def _ranges(key: np.ndarray, comp: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each (key, component) once, in order, with the smallest and the largest size."""
    order = np.lexsort((comp, key))
    key, comp, low, high = key[order], comp[order], low[order], high[order]
    at = np.flatnonzero(repeats._first_of(key) | repeats._first_of(comp))
    return key[at], comp[at], np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)


def rest_members(open_points: DataFrame, percent: int, parts: int) -> DataFrame:
    """Members (CALLED) of the open shards, from (sig, comp, n, point, shards): all that have a partner in another component with a
    high enough bound. A pair that meets in several shards counts in one of them if the first few of both lists of shards tell which."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[np.ndarray] = []
            own: list[np.ndarray] = []
            seen, held = [], 0

            def flush() -> pa.RecordBatch:
                idx = pa.array(np.concatenate(at), pa.int64())  # noqa: B023
                first = pa.array(seen, pa.binary()).take(pa.array(np.repeat(np.arange(len(seen)), [len(x) for x in at]), pa.int64()))  # noqa: B023
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(own), pa.int64()), *[batch.column(i).take(idx) for i in range(4)], first], ["shard", "sig", "comp", "n", "point", "seen"])  # noqa: B023

            for i in range(batch.num_rows):
                shards = np.frombuffer(batch.column(4)[i].as_py(), np.int64)
                few = shards[np.argsort(common.mix(shards.view(np.uint64)), kind="stable")[:SEEN]].tobytes()
                each = len(batch.column(3)[i].as_py()) + 200
                step = max(1, HANDED // each)
                for lo in range(0, len(shards), step):
                    part = shards[lo : lo + step]
                    at.append(np.full(len(part), i))
                    own.append(part)
                    seen.append(few)
                    held += each * len(part)
                    if held >= HANDED:
                        yield flush()
                        at, own, seen, held = [], [], [], 0
            if at:
                yield flush()

    entries = open_points.mapInArrow(common.tidy(unpack), "shard long, sig long, comp long, n long, point binary, seen binary")
    # a shard of many members is dealt in blocks, each of which meets every other
    sizes = open_points.select("shards").mapInArrow(common.tidy(_shards_of), "shard long").groupBy("shard").count().filter(F.col("count") > 2 * BLOCK)
    sizes = sizes.select(F.col("shard").alias("_s"), F.ceil(F.col("count") / BLOCK).cast("long").alias("b"))
    dealt = entries.join(sizes, entries["shard"] == sizes["_s"], "left").withColumn("b", F.coalesce("b", F.lit(1).cast("long")))
    mine = F.pmod(F.col("sig"), F.col("b"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1)))
    dealt = dealt.withColumn("cell", F.least(mine, F.col("o")) * F.col("b") + F.greatest(mine, F.col("o")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, group = None, []

        def close() -> list[tuple]:
            if len(group) < 2 or all(g[1] == group[0][1] for g in group):
                return []
            shard = current[0]
            comp = [g[1] for g in group]
            lists = [frozenset(np.frombuffer(g[4], np.int64).tolist()) for g in group]
            called: set[int] = set()
            for i, j in near_pairs([g[2] for g in group], [g[3] for g in group], percent):
                if comp[i] == comp[j] or (i in called and j in called):
                    continue
                both = lists[i] & lists[j]
                if both and min(both) != shard:  # they meet there as well
                    continue
                called |= {i, j}
            return [(*current, group[i][0], group[i][1]) for i in sorted(called)]

        for batch in batches:
            out = []
            for shard, cell, *rest in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if (shard, cell) != current:
                    out += close()
                    current, group = (shard, cell), []
                group.append(rest)
            yield repeats._batch(CALLED, out)
        yield repeats._batch(CALLED, close())

    moved = dealt.select("shard", "cell", "sig", "comp", "n", "point", "seen").repartition(parts, "shard", "cell").sortWithinPartitions("shard", "cell")
    return moved.mapInArrow(common.tidy(search), CALLED)


def _shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column(0):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_py(), np.int64))], ["shard"])


def link_members(sigs: list[int], comps: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect the components among a shard's members; pairs already connected are not looked at again."""
    forest = Forest(np.array([len(s) for s in sets], np.int64), [point(s) for s in sets], percent)
    _, label = np.unique(np.array(comps, np.int64), return_inverse=True)
    left, out = len(np.unique(label)), []
    for i in range(len(sets)):
        if left == 1:
            break
        found, bound = forest.before(i)
        other = label[found] != label[i]
        found = found[other][np.argsort(-bound[other], kind="stable")]
        for j in found.tolist():
            if label[i] != label[j] and linked(sets[i], sets[j], percent):
                out.append((sigs[i], sigs[j]))
                label[label == label[j]] = label[i]
                left -= 1
    return out


def stars(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links that connect the same nodes, each of which leads to the smallest node it reaches."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in up if root(x) != x]


def verify(called: DataFrame, members: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that connect the members called in each cell of a shard as the verified pairs do, as stars, so that few rounds are
    left for the components. A text goes once to each cell; cells are bounded by BLOCK."""
    wanted = called.distinct().join(members.select("sig", "row"), "sig")
    moved = rows.select("row", "text").join(wanted, "row").select("shard", "cell", "sig", "comp", "text")

    def run(group: pa.Table) -> pa.Table:
        sigs, comps, sets, seen = [], [], [], set()
        for batch in group.combine_chunks().to_batches():
            for part in common.slices(batch, "text"):
                h, first = shingles(part.column(4), size)
                for s, c, a, b in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                    if s not in seen:
                        seen.add(s)
                        sigs.append(s)
                        comps.append(c)
                        sets.append(h[a:b].copy())
        return pa.Table.from_batches([_links(stars(link_members(sigs, comps, sets, percent)) if len(sigs) > 1 else [])])

    return moved.groupBy("shard", "cell").applyInArrow(run, "a long, b long")


def _with_more(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Links of known components, as stars, and further ones."""
    return comps.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)


def join_sets(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_shingles, component_id) of every row; ``row`` is a hash of id and text.

    component_id is the smallest id reachable by links (Jaccard of at least ``percent`` hundredths), the row's own included.
    """
    named = joined(docs, size, percent, id_col, text_col)
    # as a table, so that Spark may split the join where a component holds very many rows
    least = common.table(named.filter("n > 0").groupBy("comp").agg(F.min("id").alias("least")).withColumnRenamed("comp", "_comp"))
    out = named.join(least, (named["comp"] == least["_comp"]) & (named["n"] > 0), "left")
    return out.select("row", "id", F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def joined(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(row, id, n, comp) of every row: its number of shingles, and its component by a signature. Rows without shingles are not joined."""
    with common.passing() as keep:
        return _joined(docs, size, percent, id_col, text_col, keep)


def _joined(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str, keep) -> DataFrame:
    spark = docs.sparkSession
    parts = common.partitions(spark)
    ids = 4 * parts
    rows = repeats.addressed(docs, id_col, text_col)
    all_rows = common.table(tables(rows, size))
    hot = spark.sparkContext.broadcast(frequent(all_rows, all_rows.count()))
    keys = common.table(shared_prefixes(rows, size, percent, hot, ids, parts).groupBy("row").agg(F.collect_list("keys").alias("parts"), F.sum(F.octet_length("keys")).alias("held")).filter(F.col("held") >= 8 * meet(percent)).select(F.col("row").alias("sig"), "parts"))
    # one row per set that shares enough leading shingles brings its text
    chosen = all_rows.join(keys, "sig").groupBy("sig").agg(F.min("row").alias("row"), F.first("parts").alias("parts"))
    text = rows.select("row", "text")

    def to_member(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                h, first = shingles(part.column(2), size)
                found = [np.unique(np.frombuffer(b"".join(p), np.uint64)).tobytes() for p in part.column(3).to_pylist()]
                pts = [point(h[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(first).astype(np.int64)), pa.array(found, pa.binary()), pa.array(pts, pa.binary())], ["sig", "row", "n", "keys", "point"])

    made = text.join(chosen, "row").select("sig", "row", "text", "parts").mapInArrow(common.tidy(to_member), "sig long, row long, n long, keys binary, point binary")
    members = common.table(made.dropDuplicates(["sig"]))  # repeated rows bring a set twice
    links = common.table(verify(common.table(likely_members(members, hot, percent, parts, 0)), members, rows, size, percent))
    comps = common.table(components(links))
    # what the salt or the order split: a point per component visits another shard, of less salt
    heads = members.join(comps.filter("node <> component"), members["sig"] == comps["node"], "left_anti")
    more = common.table(verify(common.table(likely_members(heads, hot, percent, parts, 1)), members, rows, size, percent))
    comps = common.table(components(_with_more(comps, more)))
    labelled = members.join(comps, members["sig"] == comps["node"], "left").select("sig", F.coalesce("component", "sig").alias("comp"), "keys", "n", "point")
    opened = common.table(open_keys(labelled.select("sig", "comp", "keys", "n"), hot, percent, parts))
    # as bounded in number as the frequent shingles themselves
    often = opened.filter("row is null").select("keys").toArrow()["keys"].to_pylist()
    often = spark.sparkContext.broadcast(np.frombuffer(b"".join(often), np.uint64))
    wanted = opened.filter("row is not null").groupBy("row").agg(F.collect_list("keys").alias("open"), F.collect_list("shards").alias("shards")).withColumnRenamed("row", "_comp")

    def keep_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for keys, lists, shards in zip(batch.column(4), batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True):
                own = np.frombuffer(keys.as_py(), np.uint64)
                k, s = np.frombuffer(b"".join(lists or []), np.uint64), np.frombuffer(b"".join(shards or []), np.uint64)
                out.append(np.unique(np.concatenate([s[np.isin(k, own)], own[np.isin(own, often.value)]])).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.binary())], ["sig", "comp", "n", "point", "shards"])

    still = labelled.join(wanted, labelled["comp"] == wanted["_comp"], "left").select("sig", "comp", "n", "point", "keys", "open", "shards")
    still = still.mapInArrow(common.tidy(keep_open), "sig long, comp long, n long, point binary, shards binary").filter(F.octet_length("shards") > 0)
    called = common.table(rest_members(common.table(still), percent, parts))
    last = common.table(verify(called, members, rows, size, percent))
    final = comps if last.isEmpty() else common.table(components(_with_more(comps, last)))
    keep(final)
    return keep(all_rows).join(final, all_rows["sig"] == final["node"], "left").select("row", "id", "n", F.coalesce("component", "sig").alias("comp"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id (of equal rows, one); texts without words stay."""
    found = joined(docs, size, percent, id_col, text_col).filter("n > 0")
    found = common.table(found.groupBy("comp", "row").agg(F.min("id").alias("id"), F.count("*").alias("rows")))
    first = found.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("least")).select(F.col("least.row").alias("_first"))
    # addresses to drop, and those to stay that several equal rows have
    some = found.join(first, found["row"] == first["_first"], "left").filter("_first is null or rows > 1")
    some = common.table(some.select(F.col("row").alias("_row"), F.col("_first").isNotNull().alias("_stays")))
    folded = common.fold(docs, text_col)
    address = F.xxhash64(F.col("doc").getField(id_col).cast("long"), F.coalesce(F.col("text"), F.lit("")))
    folded = folded.withColumn("_address", address)
    kept = folded.join(some, F.col("_address") == F.col("_row"), "left_anti").select("doc", "text")
    again = some.filter("_stays")
    if not again.isEmpty():
        same = folded.join(again, F.col("_address") == F.col("_row"), "left_semi")
        one = same.groupBy("_address").agg(F.min_by(F.struct("doc", "text"), F.xxhash64("doc")).alias("one"))
        kept = kept.unionByName(one.select("one.doc", "one.text"))
    return common.unfold(kept, docs, text_col)
