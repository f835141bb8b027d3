"""Best-fit packing of token sequences with swap-based local search.

Documents become pieces of at most ``limit`` tokens. Pieces are dealt into shards
of a bounded number of rows; every shard starts from best fit in order of arrival
and then improves by local search: pieces are moved, exchanged one-for-one or
two-for-one between underfull bins, so that the sum of squared fills rises with
every step and bins run out of pieces. Where no step is left, free room changes
places with full bins of more pieces at an equal sum, and the search goes on. It
ends when no fewer bins are possible, or when no step and no such change is left;
then a second search starts from best fit decreasing, and the better end counts.
Only ids and lengths are shuffled, never tokens or texts.

Null texts count as empty: they hold the end marker alone. Repeated rows are
packed one by one, dealt to different shards. Extra columns are not returned,
whatever their names. An empty table packs into nothing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common
from .token_counts import split_words

#: Words of unaccented or Latin-1 letters between runs of ASCII marks other than the apostrophe: a run is one pre-token, so is each side of it.
MARKED = re.compile(rb"([!-&(-/:-@[-`{-~]*)((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@[-`{-~]*)")

#: Words kept in a worker's cache; a full cache is emptied, results do not depend on it.
CACHE_WORDS = 1_000_000
#: Words that an idle worker keeps: the first ones met, which are the frequent ones.
IDLE_WORDS = 100_000
#: Pieces in a shard, about. A shard is one task's work and wastes part of one bin at most.
SHARD_ROWS = 60_000


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


_cache: dict[str, dict[bytes, bytes]] = {}


@lru_cache(maxsize=4)
def word_ends(path: str) -> np.ndarray:
    """Whether each id ends a word of the vocabulary."""
    vocab = tokenizer(path).get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocab.values()) + 1, bool)
    out[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
    return out


def encode_words(path: str, found: list[bytes]) -> dict[bytes, bytes]:
    """Ids of each word by the library. Words of letters alone are one pre-token each, so many are encoded as one text and
    told apart by the ids that end words; others go one by one."""
    tok, ends, out = tokenizer(path), word_ends(path), {}
    plain = [w for w in found if w.decode().isalpha()]
    lists = [plain[i : i + 500] for i in range(0, len(plain), 500)]
    for lo in range(0, len(lists), 40):
        part = lists[lo : lo + 40]
        for own, e in zip(part, tok.encode_batch_fast([b" ".join(x).decode() for x in part], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            at = np.flatnonzero(ends[ids]) + 1
            if len(at) == len(own) and at[-1] == len(ids):
                raw, stops = ids.tobytes(), (4 * at).tolist()
                out.update(zip(own, (raw[i:j] for i, j in zip([0, *stops], stops)), strict=True))  # noqa: B905
    rest = [w for w in found if w not in out]
    for lo in range(0, len(rest), 20_000):
        part = rest[lo : lo + 20_000]
        got = tok.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
        out.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(part, got, strict=True))
    return out


def encode_batch(path: str, texts: list[str | None]) -> list[bytes]:
    """Ids of whole texts as little-endian unsigned 32-bit numbers. White space ends pre-tokens, so each word is encoded once."""
    cache = _cache.setdefault(path, {})
    lists = [split_words(t) for t in texts]
    new = set(chain.from_iterable(lists)).difference(cache)
    if new:
        if len(cache) + len(new) > CACHE_WORDS:
            cache.clear()
            new = set(chain.from_iterable(lists))
        # marks around letters are pre-tokens of their own: each mark and each row of letters is encoded once
        parted = {w: m.groups() for w in new if (m := MARKED.fullmatch(w)) and len(m[2]) < len(w) and b"<|" not in w}
        cache.update(encode_words(path, list(new.difference(parted).union(*parted.values()).difference(cache, (b"",)))))
        cache[b""] = b""
        cache.update([(w, cache[x] + cache[y] + cache[z]) for w, (x, y, z) in parted.items()])
    get = cache.__getitem__
    return [b"".join(map(get, x)) for x in lists]


def trim(path: str) -> None:
    """Let go of most of the cache at the end of a task: other operators' tasks may be next in this worker."""
    cache = _cache.get(path, {})
    if len(cache) > IDLE_WORDS:
        _cache[path] = dict(islice(cache.items(), IDLE_WORDS))


def pieces(docs: DataFrame, path: str, limit: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32): every document's ids and the end marker, cut into pieces of ``limit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in common.slices(batch):
                who, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(encode_batch(path, part.column(1).to_pylist())):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * limit)):
                        own = ids[at : at + 4 * limit]
                        who.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(who, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["id", "piece", "start", "length", "ids_crc32"],
                )
        trim(path)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(common.tidy(run), f"id {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", id_col)


class BestFit:
    """Bins filled in order of arrival: a piece goes to the fullest bin with room for it. ``by_room`` lists the bins by free tokens."""

    def __init__(self, limit: int):
        self.limit = limit
        self.items: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: list[list[int]] = [[] for _ in range(limit + 1)]
        self.mask = 0

    def put(self, i: int, size: int) -> None:
        m = self.mask >> size
        if m:
            r = size + (m & -m).bit_length() - 1
            b = self.by_room[r].pop()
            if not self.by_room[r]:
                self.mask &= ~(1 << r)
        else:
            b, r = len(self.items), self.limit
            self.items.append([])
            self.room.append(r)
        self.items[b].append(i)
        self.room[b] = r - size
        if r > size:
            self.by_room[r - size].append(b)
            self.mask |= 1 << (r - size)


class Stock:
    """Pieces by size that bins still to be treated can give; those of the emptiest bins come first. Stale entries go when met."""

    def __init__(self, limit: int, sizes: list[int]):
        self.sizes, self.lists, self.mask = sizes, [[] for _ in range(limit + 1)], 0
        self.bin_of: dict[int, int] = {}
        self.closed: set[int] = set()

    def add(self, i: int, b: int) -> None:
        s = self.sizes[i]
        self.bin_of[i] = b
        self.lists[s].append(i)
        self.mask |= 1 << s

    def most(self, top: int) -> int:
        """The largest size up to ``top`` that there is, or 0."""
        m = self.mask & ((2 << top) - 1)
        while m:
            s = m.bit_length() - 1
            own = self.lists[s]
            while own and self.bin_of[own[-1]] in self.closed:
                own.pop()
            if own:
                return s
            self.mask &= ~(1 << s)
            m &= ~(1 << s)
        return 0

    def take(self, size: int) -> int:
        own = self.lists[size]
        i = own.pop()
        if not own:
            self.mask &= ~(1 << size)
        return i


def improve(items: list[list[int]], room: list[int], sizes: list[int], limit: int, rigid_first: bool = False) -> int:
    """One round of local search over the underfull bins, from the fullest on, or from those of fewest pieces on; returns its steps.

    A bin takes a piece of another bin not yet treated and gives nothing, one or two smaller pieces in return: the choice that leaves
    it with least room, over all pieces of all those bins. A step of d tokens from a bin with room ra to one with room rb raises the
    sum of squared fills if d + ra > rb, and only such steps are made. A bin is treated until it is full or no step is left. Emptied
    bins are gone; the round ends when no fewer bins are possible.
    """
    under = sorted((b for b in range(len(items)) if items[b] and room[b]), key=lambda b: (room[b], b))
    stock = Stock(limit, sizes)
    for b in under:
        for i in items[b]:
            stock.add(i, b)
    free, steps = sum(room[b] for b in under), 0
    if rigid_first:  # bins of few large pieces fit few others; those of many small ones can wait
        under.sort(key=lambda b: len(items[b]))
    for b in under:
        if free < limit:
            break
        if not items[b]:
            continue
        stock.closed.add(b)
        while room[b]:
            r = room[b]
            best = size = stock.most(r)
            back: tuple = ()
            own: dict[int, int] = {sizes[j]: j for j in items[b]}
            if best < r:
                for g in sorted(own, reverse=True):
                    s = stock.most(g + r)
                    if s - g > best:
                        best, size, back = s - g, s, (own[g],)
                        if best == r:
                            break
            if best < r:
                best, size, back = _two_for_one(items[b], sizes, own, r, limit, stock, best, size, back)
            if best < r and (s := stock.most(r)):  # nothing fills the bin: the largest piece that fits, and on from there
                best, size, back = s, s, ()
            if not best or best + room[stock.bin_of[stock.lists[size][-1]]] <= r:
                break
            i = stock.take(size)
            a = stock.bin_of[i]
            items[a].remove(i)
            items[b].append(i)
            stock.bin_of[i] = b
            for j in back:
                items[b].remove(j)
                items[a].append(j)
                stock.add(j, a)
            room[a] += best
            room[b] -= best
            steps += 1
            if not items[a]:
                stock.closed.add(a)
                room[a] = 0
                free -= limit
                if free < limit:
                    break
    return steps


def _two_for_one(own: list[int], sizes: list[int], by_size: dict[int, int], r: int, limit: int, stock: Stock, best: int, size: int, back: tuple) -> tuple:
    """The best exchange of two pieces of a bin for one of another, if better than ``best``; pairs of equal total are tried once."""
    tried: set[int] = set()
    n = {}
    for j in own:
        n[sizes[j]] = n.get(sizes[j], 0) + 1
    values = sorted(by_size)
    for x, p in enumerate(values):
        for q in values[x if n[p] > 1 else x + 1 :]:
            g = p + q
            if g >= limit or g in tried:
                continue
            tried.add(g)
            s = stock.most(min(limit, g + r))
            if s - g > best:
                j = by_size[p]
                k = by_size[q] if q != p else next(i for i in own if sizes[i] == p and i != j)
                best, size, back = s - g, s, (j, k)
                if best == r:
                    return best, size, back
    return best, size, back


def shift(items: list[list[int]], room: list[int], sizes: list[int], limit: int) -> int:
    """Free room changes places at an equal sum of squared fills; returns how often.

    A bin is filled from a full one of more pieces, by a move or a one-for-one exchange, and that one has the room then: with more
    pieces it finds steps where the other had none. As room only goes to bins of more pieces, this ends.
    """
    full = sorted((b for b in range(len(items)) if items[b] and not room[b]), key=lambda b: len(items[b]))
    stock = Stock(limit, sizes)
    for b in full:
        for i in items[b]:
            stock.add(i, b)
    steps = 0
    for b in sorted((b for b in range(len(items)) if items[b] and room[b]), key=lambda b: (len(items[b]), b)):
        r = room[b]
        for g, j in [(0, -1), *sorted({sizes[j]: j for j in items[b]}.items())]:
            if g + r > limit or stock.most(g + r) != g + r:
                continue
            i = stock.lists[g + r][-1]
            c = stock.bin_of[i]
            if len(items[c]) - (g == 0) <= len(items[b]):
                continue
            items[c].remove(i)
            items[b].append(i)
            if g:
                items[b].remove(j)
                items[c].append(j)
            room[b], room[c] = 0, r
            stock.closed.add(c)
            steps += 1
            break
    return steps


def local_search(items: list[list[int]], room: list[int], sizes: list[int], limit: int, least: int) -> int:
    """Rounds until no fewer than ``least`` bins are left to empty, or neither a step nor a shift is; returns the steps."""
    steps = 0
    while sum(1 for x in items if x) > least:
        made = improve(items, room, sizes, limit, True) + improve(items, room, sizes, limit)
        steps += made
        if not made and not shift(items, room, sizes, limit):
            break
    return steps


def pack(sizes: list[int], limit: int, search: bool = True) -> list[list[int]]:
    """Positions of ``sizes`` in bins of ``limit``: best fit in the given order, then local search. Where that ends with more bins
    than the least possible, it starts again from best fit in decreasing order, and the better end counts. No bin is left empty."""
    least = -(-sum(sizes) // limit)
    best: list[list[int]] | None = None
    for order in (range(len(sizes)), sorted(range(len(sizes)), key=lambda i: -sizes[i])):
        bins = BestFit(limit)
        for i in order:
            bins.put(i, sizes[i])
        if search:
            local_search(bins.items, bins.room, sizes, limit, least)
        found = [x for x in bins.items if x]
        if best is None or len(found) < len(best):
            best = found
        if not search or len(best) == least:
            break
    return best


def pack_pieces(rows: DataFrame, limit: int = 2048, shard_rows: int = SHARD_ROWS, length_col: str = "length") -> DataFrame:
    """Adds sequence_id and offset to rows with a length of 1 to ``limit``. Pieces of full length stand alone.

    ``rows`` are written once: no text is tokenized twice, and a row's place in the files, by which it is dealt, stays the same when
    a lost task is run again.
    """
    rows = common.table(rows)
    shards = max(1, -(-rows.count() // shard_rows))
    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    schema = rows.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema

    def run(key: tuple[int], pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.drop(columns="_shard")
        own = own.sort_values([c for c in own.columns if own[c].dtype.kind in "iu"], kind="stable")
        sizes = own[length_col].to_numpy()
        seq, off = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        full = np.flatnonzero(sizes == limit)
        seq[full] = np.arange(len(full))
        rest = np.flatnonzero(sizes != limit)
        for b, members in enumerate(pack(sizes[rest].tolist(), limit)):
            at = 0
            for i in members:
                k = rest[i]
                seq[k], off[k] = len(full) + b, at
                at += int(sizes[k])
        return own.assign(sequence_id=seq + (int(key[0]) << 34), offset=off)

    return rows.withColumn("_shard", shard).groupBy("_shard").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents to placed pieces."""
    return pack_pieces(pieces(docs, path, limit, 0, id_col, text_col), limit)
