"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration.

Size-free statistics of each whole text are standardised and mapped to random
cosine features, which approximate a Gaussian kernel. Every partition adds up
its own part of the normal equations; the parts are summed by row of the matrix
and the small system is solved once. Scores of a second fold of labelled rows,
counted in a fixed number of bins, are calibrated by pooling adjacent violators.

Folds come from crc32 of the id as text modulo 3: 0 fits the ridge, 2
calibrates, 1 is held out and never read for its labels. A score is a function
of the text alone. Null and empty texts have zero statistics and get a score.
Labels other than 0 and 1 or without an id are not used. With no usable labels
every score is 0.5. Repeated rows each get their row. Empty documents give no
rows. Other columns take no part in a score, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, text_stats

FEATURES = 192
#: Width of the kernel in standard deviations of the statistics.
WIDTH = 3.0
RIDGE = 1.0
BINS = 2000
SEED = 20240611


def fold(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))) % 3


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    s = {c: batch.column(batch.schema.get_field_index(f"s_{c}")).to_numpy(zero_copy_only=False) for c in text_stats.COLUMNS}
    r = text_stats.ratios(s)
    for k in ("symbols", "digits", "exclaim", "dup_lines", "repeats", "wide"):  # small shares matter
        r[f"{k}_root"] = np.sqrt(r[k])
    return np.column_stack(list(r.values())) if batch.num_rows else np.zeros((0, 19))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        w = rng.normal(0, 1 / WIDTH, (x.shape[1], FEATURES))
        b = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.ones(len(z)), np.sqrt(2 / FEATURES) * np.cos(z @ w + b)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.values)


def pool(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Isotonic fit of y by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(y, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def _per_partition(df: DataFrame, schema: str, add, finish) -> DataFrame:
    """One fold over each partition's batches; ``finish`` turns its state into a record batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            if b.num_rows:
                state = add(state, b)
        if state is not None:
            yield finish(state)

    return df.mapInArrow(common.tidy(run), schema)


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """The model from all labelled rows of folds 0 and 2. Only sums of a fixed size reach the driver."""
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (fold(id_col) != 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("long").alias("_y"))
    rows = common.table(stats.join(marks, F.col(id_col) == F.col("_id")).withColumn("_fold", fold(id_col)).drop("_id"))
    train, held = rows.filter("_fold = 0"), rows.filter("_fold = 2")

    def add_moments(state, b):
        x = _matrix(b)
        new = np.stack([np.full(x.shape[1], float(len(x))), x.sum(0), (x * x).sum(0)])
        return new if state is None else state + new

    moments = [np.array(r["m"]).reshape(3, -1) for r in _per_partition(train, "m array<double>", add_moments, lambda s: pa.RecordBatch.from_arrays([pa.array([s.ravel().tolist()])], ["m"])).groupBy().agg(F.collect_list("m").alias("all")).selectExpr("inline(transform(all, x -> struct(x as m)))").toLocalIterator()]
    if not moments:
        d = 19
        return Model(np.zeros(d), np.ones(d), np.zeros(FEATURES + 1), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    n, s1, s2 = sum(moments)
    mean = s1 / n
    scale = np.sqrt(np.maximum(s2 / n - mean**2, 1e-12))
    scale[scale < 1e-5] = 1.0
    model = Model(mean, scale, np.zeros(FEATURES + 1), np.array([0.0, 1.0]), np.array([0.5, 0.5]))

    def add_normal(state, b):
        z = model.features(_matrix(b))
        y = b.column(b.schema.get_field_index("_y")).to_numpy(zero_copy_only=False).astype(float)
        new = z.T @ np.column_stack([z, y])
        return new if state is None else state + new

    def rows_of(s):
        return pa.RecordBatch.from_arrays([pa.array(range(len(s)), pa.int32()), pa.array(s.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "row": [np.sum(np.stack(pdf["row"].to_list()), axis=0)]})

    parts = _per_partition(train, "i int, row array<double>", add_normal, rows_of)
    summed = sorted(((r["i"], r["row"]) for r in parts.groupBy("i").applyInPandas(add_up, "i int, row array<double>").collect()), key=lambda r: r[0])
    system = np.array([r for _, r in summed])
    model.weights = np.linalg.solve(system[:, :-1] + RIDGE * np.eye(FEATURES + 1), system[:, -1])

    lo, hi = -0.5, 1.5

    def add_bins(state, b):
        r = model.raw(_matrix(b))
        y = b.column(b.schema.get_field_index("_y")).to_numpy(zero_copy_only=False).astype(float)
        at = np.clip(((r - lo) / (hi - lo) * BINS).astype(int), 0, BINS - 1)
        new = np.stack([np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS), np.bincount(at, weights=r, minlength=BINS)]).astype(float)
        return new if state is None else state + new

    def bins_of(s):
        at = np.flatnonzero(s[0])
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *[pa.array(x[at], pa.float64()) for x in s]], ["bin", "n", "y", "r"])

    counted = _per_partition(held, "bin int, n double, y double, r double", add_bins, bins_of)
    bins = sorted(counted.groupBy("bin").agg(F.sum("n"), F.sum("y"), F.sum("r")).collect(), key=lambda r: r[0])
    if bins:
        b = np.array([list(r)[1:] for r in bins])
        x = b[:, 2] / b[:, 0]
        order = np.argsort(x, kind="stable")
        # half a document of either kind keeps scores inside (0, 1)
        y = (b[order, 1] + 0.02) / (b[order, 0] + 0.04)
        model.knots, model.values = x[order], np.clip(pool(y, b[order, 0]), 0, 1)
    else:
        model.knots, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """``stats`` with a column score."""
    names = stats.columns
    schema = T.StructType([*stats.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(_matrix(b)), pa.float64())], [*names, "score"])

    return stats.mapInArrow(common.tidy(run), schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    stats = common.table(text_stats.with_stats(docs.select(id_col, text_col), text_col))
    out = score(stats, fit(stats, labels, id_col))
    return out.select(id_col, (fold(id_col) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those scored under ``least``; all columns stay. The text is read twice rather than shuffled."""
    stats = common.table(text_stats.with_stats(docs.select(id_col, text_col), text_col))
    model = fit(stats, labels, id_col)
    scored = score(text_stats.with_stats(common.fold(docs, text_col), "text", keep_text=True), model)
    return common.unfold(scored.filter(F.col("score") >= least), docs, text_col)
