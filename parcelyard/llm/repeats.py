"""Repeated windows across documents, found without shuffling every position.

A window is ``size`` consecutive items (bytes or words) of one document. Each
window belongs to one anchor, which its own content determines, so equal windows
have equal anchors. Windows of one anchor form a run of neighbouring starts.

1. Tasks announce anchor and content fingerprints of their runs, once per slice:
   what a slice can tell by itself (a run that a smaller document of it has) is
   settled there, so a passage in a third of all rows sends a row per slice.
2. Where announcements meet, a run that a smaller document has is settled; the
   first holder of a run whose anchor has other runs must compare them. Runs are
   told apart by 64-bit hashes here; those that are taken for equal are compared
   byte by byte within a slice, and between slices in step 3 by another 32 bits of
   a cryptographic digest of their content; a difference ends the job.
3. Those holders send their runs; the windows are compared by the operator's own
   method, and one that also starts in a smaller document is marked. Anchors
   with very many different runs send single windows instead, dealt by content.
4. Marks return to their document by its row address.

Announcements, runs and marks travel as packed arrays. Rows with a null id are
neither sources nor changed. Rows are addressed by a hash of id and text, and
marks by the id as well; repeated rows share marks, as they should.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Different runs of one anchor that are compared as runs; beyond, each of their windows finds its equals by itself.
HOT = 4096
#: Parts of a bucket, compared one after the other.
SUB = 24
#: Proofs that a task holds, to tell equal ones once.
PROOFS = 500_000
NOBODY = np.int64(-(1 << 63))


@dataclass
class Runs:
    """Anchors of a slice: key, row, first window start (in items from the row's start), number of windows, and the run's content hash."""

    key: np.ndarray
    row: np.ndarray
    start: np.ndarray
    count: np.ndarray
    content: np.ndarray
    #: Packs the runs at some positions into one string of bytes.
    pack: Callable[[np.ndarray], bytes]
    #: A run's content as bytes that other runs have only if they are equal.
    plain: Callable[[int], bytes]
    #: For the runs at some positions: a hash of each of their windows, and what packs some of those windows.
    single: Callable[[np.ndarray], tuple[np.ndarray, Callable[[np.ndarray], bytes]]]


class Method:
    """What an operator supplies: cutting a slice into runs, and comparing runs."""

    size: int

    def runs(self, col: pa.Array) -> Runs:
        raise NotImplementedError

    def compare(self, body: bytes, owner: np.ndarray, count: np.ndarray, key: np.ndarray) -> np.ndarray:
        """For all windows of all runs, back to back: whether an equal one has a smaller owner."""
        raise NotImplementedError


def _first_of(sorted_ids: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_ids), bool)
    new[1:] = sorted_ids[1:] != sorted_ids[:-1]
    return new


def _by(values: np.ndarray, *others: np.ndarray) -> Iterator[tuple]:
    """Groups of equal values with the matching parts of the other arrays."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    edges = np.append(np.flatnonzero(_first_of(v)), len(v))
    rest = [o[order] for o in others]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield (v[a], *[o[a:b] for o in rest])


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names = [c.split() for c in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, names, strict=True)], [n for n, _ in names])


def _ids(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    col = part.column(1)
    return col.fill_null(0).to_numpy(zero_copy_only=False), ~np.asarray(col.is_null())


def addressed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text) with the row's address."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.select(F.xxhash64("id", "text").alias("row"), "id", "text")


ANNOUNCED = "bucket int, row long, keys binary, rows binary"
SHARED = "row long, keys binary"
TOLD = "bucket int, row long, settled binary, tags binary, anchors binary, who binary"
ANSWERED = "bucket int, kind int, who binary, tags binary"
JUDGED = "row long, settled binary, equal binary, open binary, hot binary, lead binary"
KINDS = 5
SENT = "bucket int, row long, id long, parts binary, head binary, body binary"
MARKED = "row long, id long, marks binary"


def settle_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which announced keys two different announcers have; ready answers pass."""
    keys, who = [], []
    for batch in batches:
        at, ks, ws = batch.column(1), batch.column(2), batch.column(3)
        mine = np.asarray(at.is_null())
        if not mine.all():
            passed = batch.filter(pa.array(~mine))
            yield pa.RecordBatch.from_arrays([passed.column(1), passed.column(2)], ["row", "keys"])
        for i in np.flatnonzero(mine):
            keys.append(np.frombuffer(ks[int(i)].as_py(), np.uint64))
            who.append(np.frombuffer(ws[int(i)].as_py(), np.int64))
    if keys:
        k, w = np.concatenate(keys), np.concatenate(who)
        order = np.lexsort((w, k))
        k, w = k[order], w[order]
        heads = np.flatnonzero(_first_of(k))
        last = np.append(heads[1:], len(k)) - 1
        several = ((w[last] != w[heads]) | (w[heads] == NOBODY))[np.cumsum(_first_of(k)) - 1] & (w != NOBODY)
        k, w = k[several], w[several]
        out = []
        for a, ks in _by(w, k):
            out.append((int(a), np.unique(ks).tobytes()))
            if len(out) == 5000:
                yield _batch(SHARED, out)
                out = []
        yield _batch(SHARED, out)


def _partition_of(x: np.ndarray, parts: int) -> np.ndarray:
    """The partition that Spark's hash partitioning gives a 32-bit integer (Murmur3 with seed 42)."""

    def turn(v: np.ndarray, n: int) -> np.ndarray:
        return (v << np.uint32(n)) | (v >> np.uint32(32 - n))

    k = turn(x.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = turn(np.uint32(42) ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(4)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64) % parts


def even_ids(parts: int) -> np.ndarray:
    """For each of ``parts`` partitions, a bucket number that lands there, so that buckets are dealt evenly."""
    x = np.arange(40 * parts + 1000, dtype=np.int64)
    where = _partition_of(x, parts)
    first = np.unique(where, return_index=True)
    out = np.arange(parts)
    out[first[0]] = x[first[1]]
    return out.astype(np.int64)


#: The key's lower bits choose the bucket, its upper half tells anchors apart there; anchors that are taken for one only have more runs compared.
_LOW = np.uint64(0xFFFFFF)


def _anchors(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(32)).astype(np.uint32)


def _packed_marks(starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Ranges as pairs of 64-bit numbers, touching ones joined."""
    return ranges([np.stack([starts, ends], 1).astype(np.int64).tobytes()]).tobytes()


def judged(rows: DataFrame, method: Method, parts: int) -> DataFrame:
    """(row, settled, equal, open, hot, lead): tags of each row's runs that a smaller document has as well (verified in the slice, or
    still to be), that must be compared with other runs of their anchor, or compared window by window, and those that others are
    settled by; one row per address. A run's tag is its whole 64-bit content hash."""
    ids = even_ids(parts)

    def announce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                addr = part.column(0).to_numpy()
                docs, known = _ids(part)
                r = method.runs(part.column(2))
                ok = known[r.row]
                tag, key, row = r.content[ok], r.key[ok], r.row[ok]
                if not len(tag):
                    continue
                doc = docs[row]
                order = np.lexsort((row, doc, tag))
                tag, key, row, doc, place = tag[order], key[order], row[order], doc[order], np.flatnonzero(ok)[order]
                start = _first_of(tag)
                lead = np.flatnonzero(start)[np.cumsum(start) - 1]
                out = []
                late = doc > doc[lead]  # settled within the slice, and verified there
                if any(r.plain(i) != r.plain(j) for i, j in zip(place[late].tolist(), place[lead[late]].tolist(), strict=True)):
                    raise common.HashClash("two different runs have one 64-bit hash")
                for i, t in _by(row[late], tag[late]):
                    a = int(addr[i])
                    out.append((int(ids[a % parts]), a, np.unique(t).tobytes(), None, None, None))
                new = start | _first_of(row)
                say = ~late & new
                tag, key, row = tag[say], key[say], row[say]
                for p, t, k, i in _by(((key & _LOW) % np.uint64(parts)).astype(np.int64), tag, _anchors(key), row):
                    order = np.argsort(i, kind="stable")
                    t, k, i = t[order], k[order], i[order]
                    heads = np.flatnonzero(_first_of(i))
                    n = np.diff(np.append(heads, len(i)))
                    who = np.stack([addr[i[heads]], docs[i[heads]], n]).astype(np.int64)
                    out.append((int(ids[p]), None, None, t.tobytes(), k.tobytes(), who.tobytes()))
                yield _batch(TOLD, out)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list] = [[], [], [], []]
        for batch in batches:
            mine = np.asarray(batch.column(1).is_null())
            if not mine.all():
                passed = batch.filter(pa.array(~mine))
                own = [np.frombuffer(x.as_py(), np.uint64) for x in passed.column(2)]
                n = np.array([len(x) for x in own])
                yield _batch(ANSWERED, answers(0, np.repeat(passed.column(1).to_numpy(), n), np.concatenate(own)))
            for i in np.flatnonzero(mine).tolist():
                who = np.frombuffer(batch.column(5)[i].as_py(), np.int64).reshape(3, -1)
                got[0].append(np.frombuffer(batch.column(3)[i].as_py(), np.uint64))
                got[1].append(np.frombuffer(batch.column(4)[i].as_py(), np.uint32))
                got[2].append(np.repeat(who[0], who[2]))
                got[3].append(np.repeat(who[1], who[2]))
        if not got[0]:
            return
        tag, anchor, row, doc = (np.concatenate(x) for x in got)
        got.clear()
        order = np.lexsort((doc, tag, anchor))
        tag, anchor, row, doc = tag[order], anchor[order], row[order], doc[order]
        start = _first_of(tag) | _first_of(anchor)
        heads = np.flatnonzero(start)
        least = doc[heads][np.cumsum(start) - 1]
        own = anchor[heads]
        first = np.flatnonzero(_first_of(own))
        kinds = np.repeat(np.diff(np.append(first, len(own))), np.diff(np.append(heads[first], len(tag))))
        status = np.where(doc > least, 1, np.where(kinds == 1, 0, np.where(kinds <= HOT, 2, 3)))
        lead = start & (np.diff(np.append(heads, len(tag))) > 1)[np.cumsum(start) - 1]
        for kind, on in ((1, status == 1), (2, status == 2), (3, status == 3), (4, lead)):
            yield _batch(ANSWERED, answers(kind, row[on], tag[on]))

    def answers(kind: int, row: np.ndarray, tag: np.ndarray) -> list[tuple]:
        """A row for each bucket of rows: the addresses, and their tags of this kind."""
        order = np.argsort(row, kind="stable")
        return [(int(ids[b]), kind, r.tobytes(), t.tobytes()) for b, r, t in _by(row[order] % parts, row[order], tag[order])]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list] = [[], [], []]
        for batch in batches:
            for k, w, t in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                got[0].append(np.frombuffer(w.as_py(), np.int64))
                got[1].append(np.full(len(got[0][-1]), k))
                got[2].append(np.frombuffer(t.as_py(), np.uint64))
        if not got[0]:
            return
        row, kind, tag = (np.concatenate(x) for x in got)
        got.clear()
        order = np.lexsort((kind, row))
        row, kind, tag = row[order], kind[order], tag[order]
        heads = np.flatnonzero(_first_of(row))
        edges = np.append(heads, len(row))
        cuts = np.searchsorted(np.stack([np.repeat(np.arange(len(heads)), np.diff(edges)), kind]).T @ np.array([KINDS, 1]), np.arange(KINDS * len(heads) + 1))
        out = []
        for i, a in enumerate(row[heads].tolist()):
            c = cuts[KINDS * i : KINDS * i + KINDS + 1]
            out.append((a, *(tag[x:y].tobytes() if y > x else None for x, y in zip(c[:-1], c[1:], strict=True))))
            if len(out) == 5000:
                yield _batch(JUDGED, out)
                out = []
        yield _batch(JUDGED, out)

    met = rows.mapInArrow(common.tidy(announce), TOLD).repartition(parts, "bucket").mapInArrow(common.tidy(judge), ANSWERED)
    return met.repartition(parts, "bucket").mapInArrow(common.tidy(gather), JUDGED)


def marked(rows: DataFrame, method: Method, parts: int) -> DataFrame:
    """(row, id, marks): starts and ends, as pairs of 64-bit numbers, of items covered by repeated windows; a row may come in parts."""
    size, ids = method.size, even_ids(parts)
    fine = SUB * parts
    told = judged(rows, method, parts).withColumnRenamed("row", "_row")
    mine = rows.join(told, rows["row"] == told["_row"]).select("row", "id", "text", "settled", "equal", "open", "hot", "lead")

    def dealt(key: np.ndarray, head: np.ndarray, body: Callable[[np.ndarray], bytes]) -> list[tuple]:
        """A row per bucket, with its parts (number, runs, bytes) one after the other."""
        fine_no = (key % np.uint64(fine)).astype(np.int64)
        out = []
        for b, idx, no in _by(fine_no // SUB, np.arange(len(key)), fine_no):
            order = np.argsort(no, kind="stable")
            idx, no = idx[order], no[order]
            cuts = np.append(np.flatnonzero(_first_of(no)), len(no)).tolist()
            bodies = [body(idx[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            parts = np.array([(no[x], y - x, len(c)) for x, y, c in zip(cuts[:-1], cuts[1:], bodies, strict=True)], np.int64)
            out.append((int(ids[b]), None, None, parts.tobytes(), head[:, idx].tobytes(), b"".join(bodies)))
        return out

    def told_once(proofs: list[np.ndarray]) -> list[tuple]:
        """A row per bucket of tags: different (tag, digest) pairs."""
        both = np.concatenate(proofs) if proofs else np.zeros((0, 2), np.uint64)
        both = both[np.lexsort((both[:, 1], both[:, 0]))]
        both = both[_first_of(both[:, 0]) | _first_of(both[:, 1])]
        return [(int(ids[b]), None, None, None, t[:, 0].tobytes(), t[:, 1].astype(np.uint32).tobytes()) for b, t in _by((both[:, 0] % np.uint64(parts)).astype(np.int64), both)]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proofs: list[np.ndarray] = []
        for batch in batches:
            for part in common.slices(batch):
                addr = part.column(0).to_numpy()
                docs, _ = _ids(part)
                r = method.runs(part.column(2))
                tag = r.content
                status, proof = np.zeros(len(tag), np.int8), np.zeros(len(tag), bool)
                edges = np.searchsorted(r.row, np.arange(part.num_rows + 1))
                for column, k in ((3, 1), (4, 1), (5, 2), (6, 3), (7, 0)):
                    for i, named in enumerate(part.column(column).to_pylist()):
                        if named:
                            a, b = edges[i], edges[i + 1]
                            on = np.isin(tag[a:b], np.frombuffer(named, np.uint64))
                            if k:
                                status[a:b][on] = k
                            if column in (4, 7):
                                proof[a:b] |= on
                out = []
                # what is taken for equal is verified where equal tags meet
                s = np.flatnonzero(proof)
                proofs.append(np.stack([tag[s], np.frombuffer(b"".join([hashlib.blake2b(r.plain(i), digest_size=4).digest() for i in s.tolist()]), np.uint32).astype(np.uint64)], 1))
                if sum(map(len, proofs)) > PROOFS:
                    out += told_once(proofs)
                    proofs = []
                s = np.flatnonzero(status == 1)
                gone = [(r.row[s], r.start[s], r.start[s] + r.count[s] - 1 + size)]
                s = np.flatnonzero(status == 2)
                head = np.stack([addr[r.row[s]], docs[r.row[s]], r.start[s], r.count[s], r.key[s].view(np.int64)]).astype(np.int64)
                out += dealt(r.key[s], head, lambda idx: r.pack(s[idx]))  # noqa: B023
                s = np.flatnonzero(status == 3)
                if len(s):  # anchors with very many runs: each window goes where equal windows go, once per slice
                    name, body = r.single(s)
                    run = np.repeat(s, r.count[s])
                    at = np.arange(len(run)) - np.repeat(np.cumsum(r.count[s]) - r.count[s], r.count[s]) + r.start[run]
                    doc = docs[r.row[run]]
                    order = np.lexsort((doc, name))
                    start = _first_of(name[order])
                    least = np.empty(len(name), np.int64)
                    least[order] = doc[order][np.flatnonzero(start)][np.cumsum(start) - 1]
                    late = doc > least
                    gone.append((r.row[run[late]], at[late], at[late] + size))
                    k = np.flatnonzero(~late)
                    head = np.stack([addr[r.row[run[k]]], doc[k], at[k], np.ones(len(k), np.int64), name[k].view(np.int64)]).astype(np.int64)
                    out += dealt(name[k], head, lambda idx: body(k[idx]))  # noqa: B023
                row, first, last = (np.concatenate(x) for x in zip(*gone, strict=True))
                for i, x, y in _by(row, first, last):
                    a = int(addr[i])
                    out.append((int(ids[a % parts]), a, int(docs[i]), None, _packed_marks(x, y), None))
                yield _batch(SENT, out)
        yield _batch(SENT, told_once(proofs))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        proofs: list[np.ndarray] = []
        for batch in batches:
            own = np.asarray(batch.column(1).is_null())
            if not own.all():
                passed = batch.filter(pa.array(~own))
                yield pa.RecordBatch.from_arrays([passed.column(1), passed.column(2), passed.column(4)], ["row", "id", "marks"])
            for i in np.flatnonzero(own).tolist():
                if batch.column(3)[i].as_py() is None:
                    tags, digests = np.frombuffer(batch.column(4)[i].as_py(), np.uint64), np.frombuffer(batch.column(5)[i].as_py(), np.uint32)
                    proofs.append(np.stack([tags, digests.astype(np.uint64)], 1))
                    continue
                head = np.frombuffer(batch.column(4)[i].as_py(), np.int64).reshape(5, -1)
                body, x, y = batch.column(5)[i].as_py(), 0, 0
                for no, n, size_ in np.frombuffer(batch.column(3)[i].as_py(), np.int64).reshape(-1, 3).tolist():
                    heads, bodies = held.setdefault(no, ([], []))
                    heads.append(head[:, x : x + n])
                    bodies.append(body[y : y + size_])
                    x, y = x + n, y + size_
        verify(proofs)
        while held:  # a part of the bucket at a time: equal windows share it
            _, (heads, bodies) = held.popitem()
            out = _settle_bucket(np.concatenate(heads, axis=1).T, b"".join(bodies), method)
            if out:
                yield _batch(MARKED, out)

    return mine.mapInArrow(common.tidy(send), SENT).repartition(parts, "bucket").mapInArrow(common.tidy(settle), MARKED)


def verify(proofs: list[np.ndarray]) -> None:
    """All rows (tag, digest) of a tag must have one digest."""
    if proofs:
        p = np.concatenate(proofs)
        p = p[np.argsort(p[:, 0], kind="stable")]
        equal = p[1:, 0] == p[:-1, 0]
        if np.any(p[1:, 1][equal] != p[:-1, 1][equal]):
            raise common.HashClash("two different runs have one 64-bit hash")


def _settle_bucket(head: np.ndarray, body: bytes, method: Method) -> list[tuple]:
    """Rows of MARKED for the runs of a bucket."""
    hit = method.compare(body, head[:, 1], head[:, 3], head[:, 4])
    first = np.concatenate(([0], np.cumsum(head[:, 3])))
    run = common.row_of(first)
    on = np.flatnonzero(hit)
    if not len(on):
        return []
    start = head[run[on], 2] + on - first[run[on]]
    return [(int(a), int(d[0]), _packed_marks(s, s + method.size)) for a, d, s in _by(head[run[on], 0], head[run[on], 1], start)]


def with_marks(docs: DataFrame, method: Method, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(row, id, text, marks): every row of ``docs`` with the item ranges to remove, as a list of packed parts or null."""
    parts = parts or common.partitions(docs.sparkSession)
    rows = addressed(docs, id_col, text_col)
    # joined by the address alone, so that the rows' exchange serves again; an address that ids share is told apart afterwards
    marks = marked(rows, method, parts).groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("id", "marks")).alias("all"))
    found = rows.join(marks, rows["row"] == marks["_row"], "left")
    own = F.transform(F.filter("all", lambda m: m["id"] == F.col("id")), lambda m: m["marks"])
    return found.select("id", "text", own.alias("marks"))


def ranges(parts: list[bytes] | None) -> np.ndarray:
    """Sorted disjoint (start, end) pairs of packed parts."""
    if not parts:
        return np.zeros((0, 2), np.int64)
    p = np.frombuffer(b"".join(parts), np.int64).reshape(-1, 2)
    p = p[np.argsort(p[:, 0], kind="stable")]
    reach = np.maximum.accumulate(p[:, 1])
    new = np.ones(len(p), bool)
    new[1:] = p[1:, 0] > reach[:-1]
    at = np.flatnonzero(new)
    return np.stack([p[at, 0], reach[np.append(at[1:], len(p)) - 1]], 1)

