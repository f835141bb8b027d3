import hashlib
import random

import numpy as np
import pytest

from parcelyard.llm import common, repeats, substring_dedup as W
from parcelyard.llm import suffix_dedup as B


def brute_bytes(rows, size=50):
    first = {}
    for d, t in rows:
        x = (t or "").encode()
        for i in range(len(x) - size + 1):
            w = x[i : i + size]
            if d is not None:
                first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        x = (t or "").encode()
        gone = np.zeros(len(x), bool)
        if d is not None:
            for i in range(len(x) - size + 1):
                if first[x[i : i + size]] < d:
                    gone[i : i + size] = True
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        out.append((d, len(x), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def brute_words(rows, size=50):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - size + 1):
            if d is not None:
                k = tuple(w[i : i + size])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = np.zeros(len(w), bool)
        if d is not None:
            for i in range(len(w) - size + 1):
                if first[tuple(w[i : i + size])] < d:
                    gone[i : i + size] = True
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    bag = [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(20, 90))) for _ in range(6)] + ["a " * 120, "xyxyxy" * 30, "\n" * 80, "b b c " * 60]
    rows = []
    for i in range(60):
        parts = [rng.choice(bag) if rng.random() < 0.6 else " ".join(f"u{rng.randrange(500)}é" for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(0, 5))]
        t = rng.choice([" ", "", "\n"]).join(parts)
        rows.append((i if rng.random() < 0.95 else None, t))
    return rows + [(3, rows[2][1]), (3, rows[2][1]), (100, None), (101, "")]


@pytest.mark.parametrize("hot", [4096, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_against_all_windows(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in B.dedup(df).collect()), key=repr)
    assert got == brute_bytes(rows)


@pytest.mark.parametrize("hot", [4096, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_words_against_all_windows(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in W.dedup(df).collect()), key=repr)
    assert got == brute_words(rows)


@pytest.mark.parametrize(("mod", "method", "brute", "column"), [(B, B.ByteWindows, brute_bytes, "n_bytes"), (W, W.WordWindows, brute_words, "n_words")])
def test_runs_alike_in_few_bits_are_different(spark, mod, method, brute, column):
    """Runs of one anchor whose hashes agree in 24 bits only: nothing but the passage they share is removed."""
    import pyarrow as pa

    passage = " ".join(f"p{k}" for k in range(70))
    texts = [f"{' '.join(f'a{i}x{k}' for k in range(30))} {passage} {' '.join(f'b{i}x{k}' for k in range(30))}" for i in range(14_000)]
    alike, pairs = {}, []
    for lo in range(0, len(texts), 2000):
        r = method(50).runs(pa.array(texts[lo : lo + 2000]))
        for anchor, bits, content, row in zip(r.key.tolist(), (common.mix(r.content) & np.uint64(0xFFFFFF)).tolist(), r.content.tolist(), (r.row + lo).tolist(), strict=True):
            other, before = alike.setdefault((anchor, bits), (content, row))
            if other != content:
                pairs.append((before, row))
    assert pairs
    rows = [(i, texts[i]) for i in sorted({i for pair in pairs for i in pair})]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r[column], r["n_removed"], r["kept_sha256"]) for r in mod.dedup(df).collect()), key=repr)
    assert got == brute(rows)


@pytest.mark.parametrize("method", [B.ByteWindows, W.WordWindows])
def test_what_is_taken_for_equal_is_verified(spark, method):
    """Different runs of one anchor with one hash: the job ends rather than remove what is not repeated."""

    class Clashing(method):
        def runs(self, col):
            r = method.runs(self, col)
            r.content = r.key.copy()
            return r

    passage = " ".join(f"p{k}" for k in range(70))
    df = spark.createDataFrame([(i, f"{' '.join(f'a{i}x{k}' for k in range(30))} {passage} {' '.join(f'b{i}x{k}' for k in range(30))}") for i in range(20)], "doc_id long, text string").repartition(3)
    with pytest.raises(Exception, match="one 64-bit hash"):
        repeats.marked(repeats.addressed(df, "doc_id", "text"), Clashing(50), 4).collect()


def test_exact_names():
    rng = random.Random(2)
    found = [f"w{rng.randrange(40)}".encode() for _ in range(3000)] + [b"w1", b"w12"] * 60
    data = np.frombuffer(b" ".join([*found, b""]), np.uint8)
    end = np.flatnonzero(data == 32)
    name = W.exact_names(data, np.concatenate(([0], end[:-1] + 1)), end)
    assert len({(a, b) for a, b in zip(found, name.tolist(), strict=True)}) == len(set(found)) == len(set(name.tolist()))
    for size in (1, 2, 3, 8, 50):
        got = W.windows_named(name, size)
        want = [tuple(found[i : i + size]) for i in range(len(found) - size + 1)]
        assert len(got) == len(want) and len(set(zip(want, got.tolist(), strict=True))) == len(set(want)) == len(set(got.tolist()))


def test_edges(spark, tricky, nothing):
    for mod, size in ((B, "n_bytes"), (W, "n_words")):
        rows = mod.dedup(tricky).collect()
        assert len(rows) == 11 and mod.dedup(nothing).collect() == []
        assert all(r["n_removed"] == 0 for r in rows if r["doc_id"] in (None, 1, 2, 3))
        assert {r[size] for r in rows if r["doc_id"] in (2, 3)} == {0}
    assert {r["n_removed"] for r in B.dedup(tricky).collect() if r["doc_id"] == 5} == {66}


def test_parse_is_the_same_inside_equal_passages():
    """Every window has an anchor, and equal windows have equal ones, wherever they stand."""
    rng = random.Random(0)
    passage = [f"w{rng.randrange(9)}" for _ in range(80)]
    texts = [" ".join([f"x{rng.randrange(5)}" for _ in range(rng.randrange(70))] + passage + [f"y{rng.randrange(5)}" for _ in range(rng.randrange(70))]) for _ in range(30)]
    import pyarrow as pa

    r = W.WordWindows(50).runs(pa.array(texts))
    seen = {}
    for key, row, start, count in zip(r.key.tolist(), r.row.tolist(), r.start.tolist(), r.count.tolist(), strict=True):
        w = texts[row].split()
        for i in range(start, start + count):
            assert seen.setdefault(tuple(w[i : i + 50]), key) == key
    assert r.count.sum() == sum(max(0, len(t.split()) - 49) for t in texts)


def test_deep_shallow_groups():
    rng = random.Random(3)
    common = bytes(rng.randrange(97, 100) for _ in range(44))
    strings = [common + bytes(rng.randrange(97, 99) for _ in range(6)) for _ in range(300)] + [bytes(rng.randrange(256) for _ in range(50)) for _ in range(300)] * 2
    rng.shuffle(strings)
    data = np.frombuffer(b"".join(strings) + bytes(16), np.uint8)
    members, starts = B.sort_groups(data, np.arange(len(strings)) * 50, 50)
    got = sorted(sorted(members[a:b].tolist()) for a, b in zip(starts, np.append(starts[1:], len(members)), strict=True))
    want = {}
    for i, s in enumerate(strings):
        want.setdefault(s, []).append(i)
    assert got == sorted(v for v in want.values() if len(v) > 1)


def test_blind_trie_orders():
    rng = random.Random(5)
    strings = [bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(200)]
    raw = b"".join(strings)
    trie = B.BlindTrie(raw, np.arange(200) * 12, 0, 12)
    for i in range(200):
        trie.add(i)
    order = [strings[x[0]] for x in trie.leaves()]
    assert order == sorted(set(strings)) and sum(len(x) for x in trie.leaves()) == 200
