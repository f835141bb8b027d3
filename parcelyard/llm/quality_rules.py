"""Quality rules with risk-controlled thresholds.

Each rule rejects a document whose statistic lies beyond a cutoff. Cutoffs are
chosen per stratum (language) from labelled holdouts: for every candidate the
exact upper binomial (Clopper-Pearson) bound on the share of good documents that
it rejects must not exceed the rule's part of ``alpha``, at confidence
1 - ``delta``. Two corrections keep that for all of them together: ``delta`` is
shared by Bonferroni among strata and rules, and a rule's candidates are tested
in a fixed sequence from the most lenient on, ending at the first that fails.
Among certified cutoffs, the one that rejects most bad documents for its good
ones wins; without one, the stratum has no such rule.

Counts are pre-aggregated to stratum, rule and candidate before they are
gathered, so what a task holds is fixed by the grids. Null and empty
languages form one stratum; documents of strata without labels meet base rules
only. Empty documents give no rows. Columns other than the three named take no part.
Labels with a null id or quality are not used; a document with several labels
counts once each. Null and empty texts fail the base rules.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, text_stats

#: Share of a stratum's good documents that all rules together may reject, and the chance of breaking that anywhere.
ALPHA, DELTA = 0.02, 0.05
#: Statistic (an expression over s_ columns) and whether large values are rejected, with its candidate cutoffs.
RULES: dict[str, tuple[str, bool, tuple[float, ...]]] = {
    "symbols": ("s_n_symbols / greatest(s_word_chars, 1)", True, tuple(round(0.005 * i, 4) for i in range(1, 61))),
    "exclaim": ("s_n_exclaim / greatest(s_n_words, 1)", True, tuple(round(0.02 * i, 4) for i in range(1, 51))),
    "upper": ("s_n_upper / greatest(s_n_upper + s_n_lower, 1)", True, tuple(round(0.02 * i, 4) for i in range(1, 51))),
    "dup_lines": ("s_n_dup_lines / greatest(s_n_lines, 1)", True, tuple(round(0.02 * i, 4) for i in range(1, 51))),
    "repeats": ("s_n_repeat_words / greatest(s_n_words, 1)", True, tuple(round(0.02 * i, 4) for i in range(1, 51))),
    "digits": ("s_n_digits / greatest(s_word_chars, 1)", True, tuple(round(0.01 * i, 4) for i in range(1, 51))),
}


def base_failed() -> Column:
    return (F.col("s_n_words") < 10) | (100 * F.col("s_n_repeat_words") > 20 * F.col("s_n_words"))


def _beyond(x: Column, high: bool):
    return lambda c: x > c if high else x < c


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), summed exactly from its largest term down."""
    if k >= n:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(log)
    return math.exp(top) * sum(math.exp(x - top) for x in log)


def allowed(n: int, alpha: float, delta: float) -> int:
    """The most rejections among n good documents whose exact upper bound stays within ``alpha`` at level ``delta``; -1 if none does.

    The bound for k is at most alpha just if P(X <= k) <= delta for X binomial(n, alpha).
    """
    lo, hi = -1, int(n * alpha) + 1
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if tail(mid, n, alpha) <= delta:
            lo = mid
        else:
            hi = mid - 1
    return lo


def choose(counts: pd.DataFrame, alpha: float, delta: float, price: float) -> pd.DataFrame:
    """Cutoffs (stratum, rule, cutoff) from counts (stratum, rule, candidate, good, bad, n_good) with good and bad rejected."""
    out = []
    for (stratum, rule), g in counts.groupby(["stratum", "rule"], sort=True, dropna=False):
        k = allowed(int(g["n_good"].iloc[0]), alpha, delta)
        # rejections of good documents only grow along the sequence, so what passes is its beginning
        ok = g[(g["good"] <= k) & (g["bad"] > price * g["good"])]
        if len(ok):
            best = ok.assign(gain=ok["bad"] - price * ok["good"], strict=ok["candidate"] * (-1 if RULES[rule][1] else 1)).sort_values(["gain", "strict"]).iloc[-1]
            out.append((stratum, rule, float(best["candidate"])))
    return pd.DataFrame(out, columns=["stratum", "rule", "cutoff"])


def thresholds(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, price: float = 4.0, id_col: str = "doc_id", stratum_col: str = "lang") -> DataFrame:
    """(stratum, rule, cutoff) fitted on the labelled rows of ``stats`` that pass the base rules."""
    marks = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isin(0, 1)).select(F.col(id_col).alias("_id"), F.col("quality").alias("_good"))
    known = stats.filter(~base_failed()).join(marks, F.col(id_col) == F.col("_id"))
    # each document counts at the last candidate that rejects it; sums over the grid follow
    names = list(RULES)
    grids = {r: sorted(RULES[r][2], reverse=not RULES[r][1]) for r in names}
    bins = []
    for r in names:
        expr, high, _ = RULES[r]
        x = F.expr(expr)
        grid = F.array(*[F.lit(c) for c in grids[r]])
        crossed = F.size(F.filter(grid, _beyond(x, high)))
        bins.append(F.struct(F.lit(r).alias("rule"), crossed.alias("bin")))
    rows = known.select(F.coalesce(F.col(stratum_col), F.lit("")).alias("stratum"), "_good", F.explode(F.array(*bins)).alias("b"))
    counts = rows.groupBy("stratum", F.col("b.rule").alias("rule"), F.col("b.bin").alias("bin")).agg(F.sum("_good").alias("g"), F.sum(1 - F.col("_good")).alias("b"))
    strata = counts.select("stratum").distinct().count()
    tests = max(1, strata * len(names))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cols = []
        for rule, g in pdf.groupby("rule"):
            size = len(grids[rule])
            good, bad = np.zeros(size + 1), np.zeros(size + 1)
            np.add.at(good, g["bin"].to_numpy(), g["g"].to_numpy(float))
            np.add.at(bad, g["bin"].to_numpy(), g["b"].to_numpy(float))
            cols += [(pdf["stratum"].iloc[0], rule, c, int(good[i + 1 :].sum()), int(bad[i + 1 :].sum()), int(good.sum())) for i, c in enumerate(grids[rule])]
        return choose(pd.DataFrame(cols, columns=["stratum", "rule", "candidate", "good", "bad", "n_good"]), alpha / len(names), delta / tests, price)

    return counts.groupBy("stratum").applyInPandas(run, "stratum string, rule string, cutoff double")


def verdicts(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, id_col: str = "doc_id", stratum_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Statistics (s_ columns), base_failed, kept and the failed rules of every document."""
    rows = docs.select(id_col, stratum_col, text_col)
    stats = common.table(text_stats.with_stats(rows, text_col))
    cuts = thresholds(stats, labels, alpha, delta, id_col=id_col, stratum_col=stratum_col)
    # one row per stratum with a map of cutoffs: as many entries as there are rules
    cuts = cuts.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cuts"))
    cuts = common.table(cuts)
    joined = stats.join(cuts, F.coalesce(F.col(stratum_col), F.lit("")) == F.col("stratum"), "left")
    fails = [F.when(F.expr(expr) > F.col("_cuts")[r] if high else F.expr(expr) < F.col("_cuts")[r], F.lit(r)) for r, (expr, high, _) in RULES.items()]
    failed = F.array_compact(F.array(*fails))
    return joined.withColumn("base_failed", base_failed()).withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("_cuts", "stratum")
