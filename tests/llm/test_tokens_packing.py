import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from parcelyard.llm import packing, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", "I'm it's 'Sx x. 12. 3,", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "É. é, ÉCOLE. é. ²Ⅷ.", "aaaaaaa aaaa aa", "日本語 word😀😀!!!", "ΑΣ ΣΑΣ İ ﬁ \x85\xa0 z\x1cq", ".,., a.. ,", "x" * 5000, "don’t … — «»"]


def library(texts):
    t = Tokenizer.from_file(PATH)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def some_texts(spark):
    return [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ODD


def test_counts_equal_the_library(spark):
    texts = some_texts(spark)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in token_counts.count_tokens(df, PATH).collect()}
    for i, ids in enumerate(library(texts)):
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["n_bytes"] == len((texts[i] or "").encode()) and got[i]["over_limit"] == (len(ids) > 2048)


def test_full_cache_changes_nothing(monkeypatch):
    texts = ["some words here to count", "other words here", "<|endoftext|>", "some words here to count"]
    want = [len(x) for x in library(texts)]
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 2)
    monkeypatch.setattr(packing, "CACHE_WORDS", 2)
    assert [token_counts.count_batch(PATH, [t])[0] for t in texts] == want
    assert [len(packing.encode_batch(PATH, [t])[0]) // 4 for t in texts] == want


def test_pieces_and_places(spark):
    texts = some_texts(spark)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = packing.pack_documents(df, PATH).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for i, ids in enumerate(library(texts)):
        ids = [*ids, 0]
        own = sorted(by[i], key=lambda r: r["piece"])
        assert [r["start"] for r in own] == list(range(0, len(ids), 2048))
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["length"] == min(2048, len(ids) - r["start"])
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in bins.values():
        at = 0
        for off, n in sorted(x):
            assert off == at
            at += n
        assert at <= 2048
    total = sum(r["length"] for r in rows)
    assert len(bins) <= -(-total // 2048) + 2


def test_edges(tricky, nothing):
    rows = packing.pack_documents(tricky, PATH).collect()
    assert sum(1 for r in rows if r["piece"] == 0) == 11
    assert {r["length"] for r in rows if r["doc_id"] in (2, 3, 4)} == {1}
    assert packing.pack_documents(nothing, PATH).collect() == []
    assert {r["n_tokens"] for r in token_counts.count_tokens(tricky, PATH).collect() if r["doc_id"] in (2, 3, 4)} == {0}
    assert token_counts.count_tokens(nothing, PATH).collect() == []


def valid(bins, sizes, limit):
    return sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= limit for b in bins)


def test_local_search_empties_bins():
    rng = random.Random(0)
    better = 0
    for _ in range(60):
        limit = 100
        sizes = []
        for _ in range(12):  # cut full bins into pieces, so that a perfect packing exists
            left = limit
            while left:
                x = min(left, rng.randrange(15, 60))
                sizes.append(x)
                left -= x
        rng.shuffle(sizes)
        plain, searched = packing.pack(sizes, limit, False), packing.pack(sizes, limit)
        assert valid(plain, sizes, limit) and valid(searched, sizes, limit)
        assert 12 <= len(searched) <= len(plain)
        better += len(searched) < len(plain)
    assert better > 10


def first_bins(sizes, limit):
    bins = packing.BestFit(limit)
    for i, s in enumerate(sizes):
        bins.put(i, s)
    return bins


def test_each_step_raises_the_squared_fill():
    rng = random.Random(1)
    sizes = [rng.randrange(20, 70) for _ in range(200)]
    bins = first_bins(sizes, 100)
    fill = lambda: sum(sum(sizes[i] for i in b) ** 2 for b in bins.items)
    before, total = fill(), 0
    while (steps := packing.improve(bins.items, bins.room, sizes, 100, total % 2 == 1)):
        assert fill() > before
        before, total = fill(), total + steps
    assert total
    while packing.shift(bins.items, bins.room, sizes, 100):
        assert fill() == before
    assert valid([b for b in bins.items if b], sizes, 100)


def test_two_for_one():
    """Only both pieces of the fuller bin for the larger piece of the other fill it."""
    sizes = [41, 43, 97]
    stock = packing.Stock(100, sizes)
    stock.add(2, 1)
    assert packing._two_for_one([0, 1], sizes, {41: 0, 43: 1}, 16, 100, stock, 0, 0, ()) == (13, 97, (0, 1))


def test_search_reaches_the_bound_on_documents(spark):
    """Lengths as those of the documents, in order of arrival: best fit alone uses more bins, and the search makes steps."""
    rows = packing.pieces(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"), PATH).select("length").collect()
    sizes = [r[0] for r in rows if r[0] < 2048]
    least = -(-sum(sizes) // 2048)
    bins = first_bins(sizes, 2048)
    assert len(bins.items) > least
    assert packing.local_search(bins.items, bins.room, sizes, 2048, least) > 100
    assert sum(1 for b in bins.items if b) == least


def test_registered_query(spark):
    from parcelyard.llm import queries

    rows = queries.QUERIES["op3_best_fit_packing"](spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    ids = {d: [*x, 0] for d, x in zip(texts, library(list(texts.values())), strict=True)}
    assert {d: sum(r["length"] for r in rows if r["doc_id"] == d) for d in ids} == {d: len(x) for d, x in ids.items()}
    assert len({r["sequence_id"] for r in rows}) == -(-sum(map(len, ids.values())) // 2048)
    counts = {r["doc_id"]: r["n_tokens"] for r in queries.QUERIES["op9_token_counts"](spark, "/root/testdata/sf0.001").collect()}
    assert counts == {d: len(x) - 1 for d, x in ids.items()}


def test_marks_around_letters():
    texts = ["(abc) «abc» abc. abc.. ...abc!? it's. o'clock, é, (É). ÷x x÷. a_b _a_ a-b a1. 1a. ß. ÿ.) ab\u0301. \ufb1d. İ."] * 2
    assert [list(np.frombuffer(x, "<u4")) for x in packing.encode_batch(PATH, texts)] == library(texts)


def test_large_pieces_and_small_shards(spark):
    df = spark.createDataFrame([(i, 2048 if i % 3 else 700) for i in range(300)], "doc_id long, length long")
    rows = packing.pack_pieces(df, shard_rows=50).collect()
    assert len(rows) == 300
    full = {}
    for r in rows:
        full[r["sequence_id"]] = full.get(r["sequence_id"], 0) + r["length"]
    assert max(full.values()) <= 2048
