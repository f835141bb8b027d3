import glob
import gzip
import hashlib
import io
import os
import random
import re

import pyarrow as pa
import pytest

from parcelyard.llm import common, decontamination as D
from parcelyard.llm import secret_ledger as S
from parcelyard.llm import warc

KEY = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def brute_spans(t):
    t = t or ""
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(KEY, t) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def secret_texts():
    rng = random.Random(2)
    bits = ["password = hunter22", 'API_KEY: "abc"', "secret=token:abcdefgh", "token=token", "AKIA" + "Q" * 16, "AKIAAKIA" + "7" * 12, "AKIA123", "a" * 24, "0123456789abcdef" * 2, "deadbeef" * 2, "é😀", " ", "\n", "pass", "apikey='Zz9+/_.=-'", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20]
    return ["".join(rng.choice(bits) + rng.choice(["", " ", "x", '"']) for _ in range(rng.randrange(12))) for _ in range(200)]


def test_spans_against_python(spark):
    texts = [*secret_texts(), None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in S.scan(df).collect():
        got = [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] in S.BASE_KINDS]
        assert got == brute_spans(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_ledger_scans_only_what_is_new(spark):
    old = spark.createDataFrame([(1, "password = hunter22"), (2, "nothing")], "doc_id long, text string")
    path, rules = common.shared_dir(spark), S.RULES[:2]
    S.scan(old, None, path, rules).collect()
    book = S.ledger_at(spark, path)
    assert book.count() == 2
    new = spark.createDataFrame([(3, "password = hunter22"), (4, "token: abcdefg " + "a" * 24)], "doc_id long, text string")
    p2 = common.shared_dir(spark)
    rows = {r["doc_id"]: r for r in S.scan(new, book, p2, S.RULES[:3]).collect()}
    added = {r["blob"]: r["rules"] for r in S.ledger_at(spark, p2).collect()}
    seen, fresh = (hashlib.sha256(x.encode()).hexdigest() for x in ("password = hunter22", "token: abcdefg " + "a" * 24))
    assert added == {seen: ["hex@1"], fresh: ["assign@1", "access@1", "hex@1"]} or set(added) == {seen, fresh, hashlib.sha256(b"nothing").hexdigest()}
    assert added[seen] == ["hex@1"] and added[fresh] == ["assign@1", "access@1", "hex@1"]
    assert [s["kind"] for s in rows[3]["spans"]] == ["assign"] and [s["kind"] for s in rows[4]["spans"]] == ["assign", "hex"]


def test_other_versions_findings_stay_in_the_ledger(spark):
    """A new version of a rule finds anew; what the old version found is neither returned nor lost."""
    from dataclasses import replace

    docs = spark.createDataFrame([(1, "AKIA" + "Q" * 16 + " AKIB" + "R" * 16), (2, "none"), (3, None)], "doc_id long, text string")
    old = (S.RULES[1],)
    new = (replace(S.RULES[1], version=2, pattern="AKIB[A-Z0-9]+", hints=("AKIB",)),)
    path = common.shared_dir(spark)
    S.scan(docs, None, path, old).collect()
    book = S.ledger_at(spark, path)
    spans = lambda rules, ledger: [[(s["kind"], s["version"], s["start"]) for s in r["spans"]] for r in S.scan(docs, ledger, common.shared_dir(spark), rules).orderBy("doc_id").collect()]
    assert spans(new, book) == [[("access", 2, 21)], [], []]
    both = book.unionByName(S.scan_blobs(docs.selectExpr("sha2(coalesce(text, ''), 256) as blob", "coalesce(text, '') as text", "array('access@2') as todo"), new))
    assert spans(old, both) == [[("access", 1, 0)], [], []] and spans((*new, *old), both) == [[("access", 1, 0), ("access", 2, 21)], [], []]


def test_seen_texts_do_not_move(spark):
    """With a ledger, what is left to scan comes from addresses alone, and nothing is left of what was scanned."""
    docs = spark.createDataFrame([(i, f"text {i} password = hunter{i}") for i in range(50)], "doc_id long, text string")
    path = common.shared_dir(spark)
    first = S.digest(S.scan(docs.filter("doc_id < 40"), None, path)).collect()
    book = S.ledger_at(spark, path)
    more = common.shared_dir(spark)
    rows = S.digest(S.scan(docs, book, more)).collect()
    assert S.ledger_at(spark, more).count() == 10 and len(rows) == 50
    assert sorted(map(tuple, first)) == sorted(tuple(r) for r in rows if r["doc_id"] < 40)
    versions = docs.selectExpr("sha2(text, 256) as blob", "text")
    assert S.unseen(versions, book.unionByName(S.ledger_at(spark, more)), S.RULES).count() == 0
    assert sorted(map(tuple, S.digest(S.scan_in_runs(docs, [S.RULES[:3], S.RULES])).collect())) == sorted(map(tuple, rows))


def test_secret_edges(tricky, nothing):
    assert S.scan(tricky).count() == 11 and S.scan(nothing).collect() == []
    kept = S.redact(tricky)
    assert kept.columns == tricky.columns
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, tricky.collect()))


def test_long_text_and_many_matches(spark):
    df = spark.createDataFrame([(1, ("x" * 500 + " " + "a" * 24 + " ") * 300)], "doc_id long, text string")
    spans = S.scan(df).first()["spans"]
    assert len(spans) == 300 and spans[299]["start"] == 299 * 526 + 501


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        body = rng.choice(["", "tiny", "<html>" + "same " * 50, "\x1f\x8b\x08 not gzip " * 20, "é\r\n\r\nWARC/1.1 fake " * 30, "n\n" * 500])
        rows.append((i, f"http://x/{i}?q=é\r\n", body + ("" if rng.random() < 0.5 else str(i))))
    rows += [(500, None, None), (None, "u", "<html>" + "same " * 50), (7, "again", rows[7][2])]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)


def in_ranges(spark, split, run):
    """``run`` with byte ranges of about ``split`` bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    try:
        for k in keys:
            spark.conf.set(k, str(split))
        return run()
    finally:
        for k in keys:
            spark.conf.unset(k)


def test_ranges_of_any_size():
    rng = random.Random(3)
    raw, want = b"", []
    for i in range(40):
        payload = rng.randbytes(rng.choice([0, 10, 3000]))
        want.append((i, payload))
        raw += warc.member(i, None, payload, hashlib.sha256(payload).hexdigest(), None) + rng.choice([b"", b"\x1f\x8b\x08", b"junk\x1f\x8b\x08\x00"])
    for size in (1, 7, 100, 1000, 5000, len(raw)):
        got, open_end = [], b""
        for lo in range(0, len(raw), size):
            chunks = iter([raw[lo : lo + size][k : k + 13] for k in range(0, size, 13)])
            for kind, data in warc.pieces(lambda: next(chunks, b"")):  # noqa: B023
                if kind == "head":
                    open_end += data
                    continue
                got += [warc.parse(x)[::2][:2] for _, x in warc.records(io.BytesIO(open_end), 0, len(open_end))] if open_end else []
                open_end = data if kind == "tail" else b""
                if kind == "record":
                    got.append(warc.parse(data)[::2][:2])
        got += [warc.parse(x)[::2][:2] for _, x in warc.records(io.BytesIO(open_end), 0, len(open_end))]
        assert got == want, size


def test_archive_edges(spark, pages):
    """An empty table, a payload of many ranges, and files named .gz."""
    rows, df = pages
    path = common.shared_dir(spark)
    warc.write_archives(df.filter("false"), path)
    assert warc.read_archives(spark, path).collect() == []
    big = "".join(chr(65 + (i * i) % 1009) for i in range(1_500_000))
    path = common.shared_dir(spark)
    warc.write_archives(spark.createDataFrame([(1, "u", big), (2, "v", "x"), (3, "w", big)], "page_id long, url string, html string").coalesce(1), path)
    got = in_ranges(spark, 5000, lambda: {r["page_id"]: r for r in warc.read_archives(spark, path).collect()})
    assert bytes(got[1]["payload"]).decode() == big and got[3]["refers_to"] == 1 and got[2]["payload_bytes"] == 1
    path = common.shared_dir(spark)
    os.makedirs(path.removeprefix("file://"))
    with open(path.removeprefix("file://") + "/a.warc.gz", "wb") as f:
        f.write(b"".join(warc.member(i, None, b"p%d" % i, hashlib.sha256(b"p%d" % i).hexdigest(), None) for i in range(9)))
    assert sorted(r["page_id"] for r in warc.read_archives(spark, path).collect()) == list(range(9))


def test_archives_round_trip(spark, pages):
    rows, df = pages
    path = common.shared_dir(spark)
    warc.write_archives(df, path)
    got = [in_ranges(spark, split, lambda: sorted(map(tuple, warc.read_archives(spark, path).drop("url", "payload").collect()), key=repr)) for split in (700, 1 << 20)]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    least = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            least[b] = min(i, least.get(b, i))
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = b in least and i != least[b]
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", least[b] if again else None))
    assert got[0] == sorted(want, key=repr)
    back = {r["page_id"]: r for r in warc.read_archives(spark, path).filter("record_type = 'response'").collect()}
    assert bytes(back[0]["payload"] or b"") == rows[0][2].encode() and back[0]["url"] == rows[0][1]


def test_files_are_gzip_for_other_readers(spark, pages):
    _, df = pages
    path = common.shared_dir(spark)
    warc.write_archives(df, path)
    n = 0
    for f in glob.glob(path.removeprefix("file://") + "/part-*"):
        raw = open(f, "rb").read()
        assert raw.endswith(b"\n")
        n += gzip.GzipFile(fileobj=io.BytesIO(raw[:-1])).read().count(b"\r\nWARC-Record-ID: ")
    assert n >= 123


def test_damage_is_an_error():
    m = warc.member(1, "u", b"payload" * 50, hashlib.sha256(b"payload" * 50).hexdigest(), None)
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(m[:-30]), 0, 10))
    assert list(warc.records(io.BytesIO(b"\x1f\x8b\x08junk" + m), 0, 500))[0][0] == 7
    empty = warc.records(io.BytesIO(b""), 0, 10)
    assert list(empty) == []


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_hits(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(0, len(w) - 7)) if len(w) >= 8 else ([0] if w else []):
            wins.setdefault(tuple(w[k : k + 8]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[x]
        out.append((d, len(w), len(hit), len(found), D.items_digest(found), len(found) >= 2))
    return sorted(out, key=repr)


def test_hits_against_brute_force(spark):
    rng = random.Random(0)
    rnd = lambda n: " ".join(rng.choice(["Aa", "b", "é-É", "c1", "D", "e"]) for _ in range(n))
    items = [(i, rnd(rng.choice([1, 2, 3, 5, 7, 8, 9, 20]) + (20 if i % 2 else 0))) for i in range(25)] + [(50, None), (51, ""), (3, rnd(12))]
    docs = [(i, " ".join([rnd(rng.randrange(10)), rng.choice(items)[1] or "", rnd(rng.randrange(30))])) for i in range(80)] + [(200, None), (201, ""), (201, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 24, 40):  # one block of items, and many, which take turns
        got = sorted(map(tuple, D.digest(D.find(d, b, block_bytes=size)).collect()), key=repr)
        assert got == brute_hits(docs, items)


def test_longest_matches_and_removal(spark, tricky, nothing):
    b = spark.createDataFrame([(1, "p q r s t u v w x y z")], "item_id long, text string")
    d = spark.createDataFrame([(1, "0 1 P q, r s t u v w x y! 2"), (2, "p q r s t u v")], "doc_id long, text string")
    rows = {r["doc"]["doc_id"]: r for r in D.find(d, b).collect()}
    assert [tuple(m) for m in rows[1]["matches"]] == [(1, 2, 0, 10)] and rows[2]["matches"] == []
    assert [r["doc_id"] for r in D.remove(d, b).collect()] == [2]
    assert D.remove(tricky, b).columns == tricky.columns and D.remove(tricky, b).count() == 11
    assert D.find(nothing, b).collect() == [] and D.find(tricky, b.filter("false")).count() == 11


def test_clashing_names_and_item_ids(spark):
    d = spark.createDataFrame([(1, "a b c d e f g h", 5, "y", 7), (2, None, 6, "z", 8)], "doc_id long, text string, _items long, items string, n_hit long")
    for kind, ids in (("string", ["i", "j"]), ("int", [4, 5]), ("date", None)):
        import datetime

        ids = ids or [datetime.date(2020, 1, 1), datetime.date(2020, 1, 2)]
        b = spark.createDataFrame([(ids[0], "A b c d e f g h"), (ids[1], "other"), (None, "c d")], f"item_id {kind}, text string")
        rows = {r["doc"]["doc_id"]: r for r in D.find(d, b).collect()}
        assert set(rows[1]["items"]) == {ids[0], None} and rows[1]["doc"]["_items"] == 5 and rows[2]["items"] == []
        assert [tuple(r) for r in D.remove(d, b).collect()] == [(2, None, 6, "z", 8)]


def test_a_worker_holds_one_block(spark, monkeypatch):
    """Many blocks, and shards searched a few at a time: each worker keeps none of the blocks it has searched."""
    monkeypatch.setattr(D, "HELD_BYTES", 200)
    items = [(i, " ".join(f"w{i}x{k}" for k in range(12))) for i in range(60)]
    docs = [(i, " ".join(f"w{i}x{k}" for k in range(2, 11))) for i in range(60)] + [(100, "w1x1 w2x2")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = D.find(d, b, block_bytes=100).collect()
    assert {r["doc"]["doc_id"]: r["items"] for r in rows} == {i: [i] for i in range(60)} | {100: []}
    assert all([(m["doc_word"], m["item_word"], m["words"]) for m in r["matches"]] == [(0, 2, 9)] for r in rows if r["doc"]["doc_id"] < 60)


def test_slices_hold_whole_texts():
    col = pa.record_batch([pa.array(["a" * 10, None, "b" * 5000, "", "c"])], ["text"])
    parts = list(common.slices(col, "text", 20))
    assert sum(p.num_rows for p in parts) == 5 and [x for p in parts for x in p.column(0).to_pylist()] == col.column(0).to_pylist()


