import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from parcelyard.llm import quality_classifier as C
from parcelyard.llm import quality_rules as R
from parcelyard.llm import queries, text_stats

SF = "/root/testdata/sf0.01"


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = set()
    for i, x in enumerate(win):
        if win.count(x) > 1:
            hit |= set(range(i, i + 5))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), len(lines)


def test_stats_against_brute_force():
    rng = random.Random(0)
    texts = ["", "\n", "a\n", "\na\na", "a\n\n a\na \n", "x y é ü #|<", "a b c d e a b c d e", "a a a a a a a"]
    texts += ["".join(rng.choice("ab \n\t#é") for _ in range(rng.randrange(120))) for _ in range(200)]
    s = text_stats.batch_stats(pa.array([*texts, None]))
    for i, t in enumerate([*texts, None]):
        got = tuple(int(s[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"))
        assert got == brute(t), repr(t)


def test_binomial_bound():
    from math import comb

    for n, a in ((50, 0.1), (200, 0.02), (1000, 0.01)):
        for d in (0.05, 0.001):
            k = R.allowed(n, a, d)
            cdf = lambda k, n=n, a=a: sum(comb(n, i) * a**i * (1 - a) ** (n - i) for i in range(k + 1))
            assert (k < 0 or cdf(k) <= d) and cdf(k + 1) > d
    assert R.allowed(10, 0.01, 0.05) == -1


def test_false_rejections_stay_limited(spark):
    docs, labels = queries.read(spark, "/root/testdata/sf0.1", "documents"), queries.read(spark, "/root/testdata/sf0.1", "labels")
    out = R.verdicts(docs, labels).join(labels, "doc_id").filter("not base_failed")
    good, lost, bad, caught = out.agg(F.sum("quality"), F.sum(F.when(~F.col("kept"), F.col("quality")).otherwise(0)), F.sum(1 - F.col("quality")), F.sum(F.when(~F.col("kept"), 1 - F.col("quality")).otherwise(0))).first()
    print(good, lost, bad, caught)
    assert lost <= R.ALPHA * good and caught >= 0.3 * bad


def test_rules_edges(tricky, nothing, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    rows = R.verdicts(tricky, labels).collect()
    assert len(rows) == 11
    for r in rows:
        if r["doc_id"] in (2, 3, 4, 7, 8):
            assert r["base_failed"] and not r["kept"]
        if r["doc_id"] == 1:
            assert r["kept"]
    assert R.verdicts(nothing, labels).collect() == []
    assert len(R.verdicts(tricky, labels.filter("false")).collect()) == 11


def test_classifier_on_held_out_rows(spark):
    docs, labels = queries.read(spark, "/root/testdata/sf0.1", "documents"), queries.read(spark, "/root/testdata/sf0.1", "labels")
    out = C.classify(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    y, s = out["quality"].to_numpy(), out["score"].to_numpy()
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    print("held-out AUC", auc, "accuracy", (out["predicted"] == y).mean())
    assert auc > 0.85 and (out["predicted"] == y).mean() > 0.9
    assert s.min() >= 0 and s.max() <= 1


def test_held_out_labels_are_never_read(spark):
    docs, labels = queries.read(spark, SF, "documents"), queries.read(spark, SF, "labels")
    turned = labels.withColumn("quality", F.when(C.fold("doc_id") == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r["doc_id"]: r["score"] for r in C.classify(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in C.classify(docs, turned).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_classifier_edges(tricky, nothing, spark):
    labels = spark.createDataFrame([(1, 1), (5, 1), (8, 0), (9, 0), (None, 1), (6, None)], "doc_id long, quality int")
    rows = C.classify(tricky, labels).collect()
    assert len(rows) == 11 and all(0 <= r["score"] <= 1 for r in rows)
    assert C.classify(nothing, labels).collect() == []
    assert {r["score"] for r in C.classify(tricky, labels.filter("false")).collect()} == {0.5}
    assert C.keep(tricky, labels).columns == tricky.columns


def test_pooling():
    y = C.pool(np.array([0.1, 0.5, 0.3, 0.2, 0.9]), np.ones(5))
    assert (np.diff(y) >= 0).all() and abs(y[1] - 1 / 3) < 1e-12
