import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelyard.llm import common, jaccard_join as J
from parcelyard.llm import repeats
from parcelyard.llm.components import components


def brute(texts, percent=80):
    """Smallest id reachable by links, by comparing all pairs."""
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                r, s = sorted((find(a), find(b)))
                root[s] = r
    return {d: find(d) for d in texts}


def families(seed, n_families, size, words=60, vocab=400):
    rng = random.Random(seed)
    out, i = {}, 0
    passage = [f"p{k}" for k in range(20)]
    for _ in range(n_families):
        base = [f"w{rng.randrange(vocab)}" for _ in range(rng.randrange(3, words))]
        if rng.random() < 0.6:
            base[1:1] = passage
        for _ in range(rng.randrange(1, size)):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(vocab)}"
            out[i] = " ".join(w)
            i += 1
    return out


def run(spark, texts):
    df = spark.createDataFrame([(d, t) for d, t in texts.items()], "doc_id long, text string").repartition(3)
    return {r["id"]: r["component_id"] for r in J.join_sets(df).collect()}


def test_against_all_pairs(spark):
    for seed in (1, 2):
        texts = families(seed, 40, 9)
        assert run(spark, texts) == brute(texts)


def test_exact_rest_alone_finds_all_links(spark, monkeypatch):
    """Without the linking rounds, and with tiny blocks and frequent shingles, the rest still finds every link."""
    monkeypatch.setattr(J, "likely_members", lambda members, *a: members.sparkSession.createDataFrame([], J.CALLED))
    monkeypatch.setattr(J, "BLOCK", 4)
    monkeypatch.setattr(J, "HOT_LEAST", 9)
    texts = families(3, 25, 12)
    assert run(spark, texts) == brute(texts)


def test_exact_rest_links_by_frequent_shingles_alone(spark, monkeypatch):
    """A star: copies are linked to the original but not to each other, and share frequent shingles only."""
    monkeypatch.setattr(J, "likely_members", lambda members, *a: members.sparkSession.createDataFrame([], J.CALLED))
    rng = random.Random(6)
    base = [f"w{k}" for k in range(200)]
    texts = {}
    for i in range(120):
        w = list(base)
        for k in rng.sample(range(1, 39), 4) if i != 50 else ():
            w[5 * k] = f"own{i}x{k}"
        texts[i] = " ".join(w)
    want = brute(texts)
    assert set(want.values()) == {0} and len(set(brute({d: t for d, t in texts.items() if d != 50}).values())) > 60
    assert run(spark, texts) == want


@pytest.mark.parametrize("alone", [False, True])
def test_texts_of_shared_paragraphs(spark, monkeypatch, alone):
    """Texts of 12 of 24 paragraphs, so that every paragraph is in half of them; those of 11 equal paragraphs are linked or not by a
    few words. Whole, and by the exact rest alone."""
    if alone:
        monkeypatch.setattr(J, "likely_members", lambda members, *a: members.sparkSession.createDataFrame([], J.CALLED))
    rng = random.Random(8)
    para = [" ".join(f"p{k}w{i}" for i in range(40)) for k in range(24)]
    texts = {}
    while len(texts) < 400:
        own = sorted(rng.sample(range(24), 12))
        parts = [para[k] for k in own]
        texts[len(texts)] = " sep ".join(parts)
        if rng.random() < 0.25:  # a copy with one paragraph changed
            at = rng.randrange(12)
            words = [f"n{len(texts)}w{i}" for i in range(rng.choice([5, 40, 70]))]
            texts[len(texts)] = " sep ".join([*parts[:at], " ".join(words), *parts[at + 1 :]])
    want = brute(texts)
    assert 250 < len(set(want.values())) < 400
    assert run(spark, texts) == want


def opened(spark, monkeypatch, texts):
    """The result, and how many sets the exact rest sent to shards."""
    sent, rest = [], J.rest_members

    def counted(open_points, *a):
        sent.append(open_points.count())
        return rest(open_points, *a)

    monkeypatch.setattr(J, "rest_members", counted)
    return run(spark, texts), sent[0]


@pytest.mark.parametrize("planted", [False, True])
def test_single_shared_shingles_open_no_shards(spark, monkeypatch, planted):
    """Texts of own words with phrases of five words from a pool: pairs share a leading shingle or two by chance, which sends nobody
    to the exact rest, without the linking rounds as well; linked texts among them are found."""
    monkeypatch.setattr(J, "likely_members", lambda members, *a: members.sparkSession.createDataFrame([], J.CALLED))
    rng = random.Random(9)
    pool = [" ".join(f"f{k}w{i}" for i in range(5)) for k in range(300)]
    texts = {}
    for d in range(0, 400, 2):
        parts = [f"{pool[k]} own{d}x{i}" for i, k in enumerate(rng.sample(range(300), 12))]
        texts[d] = " ".join([*parts, *[f"own{d}y{i}" for i in range(40)]])
        if planted and d % 20 == 0:
            texts[d + 1] = texts[d].replace(f"own{d}y20", "another")
    got, sent = opened(spark, monkeypatch, texts)
    assert got == brute(texts)
    assert len(set(got.values())) == 200
    assert sent == (40 if planted else 0)


@pytest.mark.parametrize("paired", [1, 2, 64])
def test_pairs_of_components_lose_no_link(spark, monkeypatch, paired):
    """Whether a shingle of few components counts for pairs or opens a shard, in small portions, the links are the same."""
    monkeypatch.setattr(J, "likely_members", lambda members, *a: members.sparkSession.createDataFrame([], J.CALLED))
    monkeypatch.setattr(J, "PAIRED", paired)
    monkeypatch.setattr(J, "PAIRS", 50)
    texts = families(7, 30, 10, words=40, vocab=60)
    assert run(spark, texts) == brute(texts)


def test_linked_sets_share_as_many_leading_shingles_as_said():
    rng = np.random.default_rng(2)
    hot = J.Hot(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for percent in (50, 66, 80, 90, 100):
        seen = 0
        for _ in range(3000):
            base = np.unique(rng.integers(0, 2**62, rng.integers(1, 30), dtype=np.uint64))
            x, y = base[rng.random(len(base)) > 0.1], base[rng.random(len(base)) > 0.1]
            if len(x) and len(y) and len(x) + len(y) > 2 * len(np.intersect1d(x, y)) and J.linked(x, y, percent):
                a, b = (J.prefix(z, np.array([0, len(z)]), hot, percent)[0] for z in (x, y))
                assert len(np.intersect1d(a, b)) >= J.meet(percent)
                seen += 1
        assert seen > 100 or percent == 100


def test_edges(spark, tricky, nothing):
    rows = J.join_sets(tricky).collect()
    assert len(rows) == 11
    comp = {(r["id"], r["n_shingles"]): r["component_id"] for r in rows}
    assert comp[(1, 8)] == 1 and comp[(5, 8)] == 1 and comp[(None, 8)] == 1
    assert comp[(2, 0)] == 2 and comp[(3, 0)] == 3 and comp[(4, 0)] == 4
    assert comp[(7, 1)] == 7
    assert J.join_sets(nothing).collect() == []
    kept = J.keep_one(tricky)
    assert kept.columns == tricky.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == [1, 2, 3, 4, 6, 7, 8, 9] and None not in ids


def test_one_of_equal_rows_stays(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(1, text, "a"), (1, text, "b"), (1, text, "b"), (1, text + " nu", "c"), (2, text, "d"), (1, "another text of the same id stays as well", "e"), (3, "", "f"), (3, "", "f"), (None, "no id here but words enough", "g"), (None, "no id here but words enough", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in J.keep_one(df).collect()]
    group = [x for x in got if x[1].startswith(text)]
    assert len(group) == 1 and group[0][0] == 1
    assert sorted((x for x in got if x not in group), key=repr) == sorted([(1, rows[5][1]), (3, ""), (3, ""), (None, rows[8][1])], key=repr)


def test_bound_never_misses():
    rng = np.random.default_rng(0)
    sets = []
    for _ in range(30):
        base = np.unique(rng.integers(0, 2**63, rng.integers(1, 1500), dtype=np.uint64))
        for _ in range(4):
            keep = rng.random(len(base)) > rng.choice([0.02, 0.08, 0.15])
            more = rng.integers(0, 2**63, int(len(base) * 0.05), dtype=np.uint64)
            sets.append(np.unique(np.concatenate([base[keep], more])))
    sets = [s for s in sets if len(s)]
    forest = J.Forest(np.array([len(s) for s in sets]), [J.point(s) for s in sets], 80)
    found = {frozenset((i, int(j))) for i in range(len(sets)) for j in forest.before(i)[0]}
    links = {frozenset((i, j)) for i in range(len(sets)) for j in range(i) if J.linked(sets[i], sets[j], 80)}
    assert links and links <= found


def test_saturated_counts_stay_an_upper_bound():
    a = np.arange(600, dtype=np.uint64)  # all in one group
    forest = J.Forest(np.array([600, 600]), [J.point(a), J.point(a)], 80)
    assert forest.before(1)[0].tolist() == [0]


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        r, s = sorted((find(a), find(b)))
        root[s] = r
    assert {r["node"]: r["component"] for r in components(df).collect()} == {x: find(x) for x in root}
    assert components(df.filter("a < 0")).collect() == []


def test_even_ids_match_spark(spark):
    for parts in (3, 8, 50):
        ids = repeats.even_ids(parts)
        df = spark.createDataFrame([(int(x),) for x in ids], "bucket int").select(F.pmod(F.hash("bucket"), F.lit(parts)).alias("p"))
        assert [r["p"] for r in df.collect()] == list(range(parts))


def test_shared_tables_survive(spark):
    t = common.table(spark.range(5))
    assert t.count() == 5 and common.shared_dir(spark) != common.shared_dir(spark)


def test_stars():
    rng = random.Random(5)
    links = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(70)] + [(7, 7)]
    got = J.stars(links)
    root = {x: x for pair in links for x in pair}
    for _ in range(len(root)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert sorted(got) == sorted((x, r) for x, r in root.items() if x != r)
    assert J.stars([]) == []
