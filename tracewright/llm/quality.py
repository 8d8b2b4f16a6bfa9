"""Quality classifier: naive Bayes support vectors on n-gram indicators.

Features of a text are the distinct hashed words, word pairs, word shapes (letter and digit runs collapsed, punctuation
kept), shape pairs and triples, and repeats of the previous words. Each indicator is scaled by its log-count ratio between
the classes; a linear hinge-loss model is fitted to the scaled indicators by dual coordinate descent, its weights are drawn
towards their mean magnitude, and a logistic curve fitted to out-of-fold margins turns margins into probabilities.

The model is fitted on at most MAX_TRAIN labelled rows, those of least hashed doc_id: a documented bound; scores cover all
rows. Ids, languages and sources are no features, and labels are only read for rows that may be learned from.

Defined cases: null texts count as empty; an empty text has no features and gets the curve's value at the bias; without
labels of both classes every score is the share of label 1, or 0.5; repeated rows each get a row; of different texts under
one id the one of least hash is learned.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm import shared
from tracewright.llm.words import U64, mix, split_words, steps, text_bytes

BITS, MAX_TRAIN, THRESHOLD = 18, 8000, 0.7
SMOOTH, COST, EPOCHS, DRAWN, FOLDS = 1.0, 1.0, 12, 0.25, 4

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = ord("a")
_CLASS[48:58] = ord("0")


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each row, sorted, and their bounds per row."""
    data, offsets = text_bytes(column)
    rows = len(offsets) - 1
    words = split_words(data, offsets)
    shape = _CLASS[data]
    keep = np.ones(len(shape), dtype=bool)
    keep[1:] = (shape[1:] != shape[:-1]) | ((shape[1:] != ord("a")) & (shape[1:] != ord("0")))
    starts = offsets[:-1][offsets[:-1] < len(shape)]
    keep[starts] = True
    kept = np.zeros(len(shape) + 1, dtype=np.int64)
    np.cumsum(keep, out=kept[1:])
    shapes = split_words(shape[keep], kept[offsets])
    n = len(words.hashes)
    row = np.repeat(np.arange(rows, dtype=np.uint64), np.diff(words.bounds))
    found = []
    with np.errstate(over="ignore"):
        def add(kind: int, values: np.ndarray, at: np.ndarray) -> None:
            found.append(at << U64(BITS) | mix(values + U64(kind * 0x632BE59BD9B4E019 & (1 << 64) - 1)) >> U64(64 - BITS))

        w, s = words.hashes, shapes.hashes
        add(1, w, row)
        add(2, s, row)
        for k, h in ((1, w), (1, s), (2, s)):
            if n > k:
                same = row[k:] == row[:-k]
                joined = h[k:] * U64(3) + h[:-k] * U64(0x9E3779B97F4A7C15) + (h[k - 1 : -1] * U64(0xC2B2AE3D27D4EB4F) if k == 2 else U64(0))
                add(3 + k if h is s else 3, joined[same], row[k:][same])
        for k in (1, 2, 3):
            if n > k:
                again = (row[k:] == row[:-k]) & (w[k:] == w[:-k])
                at, many = np.unique(row[k:][again], return_counts=True)
                share = np.minimum(7, np.log2(1 + 64 * many / np.diff(words.bounds)[at.astype(np.int64)])).astype(np.uint64)
                add(10 + k, share, at)
    flat = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
    bounds = np.searchsorted(flat >> U64(BITS), np.arange(rows + 1, dtype=np.uint64))
    return (flat & U64((1 << BITS) - 1)).astype(np.int32), bounds


class Model(NamedTuple):
    weights: np.ndarray  #: per feature, log-count ratio times the linear model's weight
    scale: np.ndarray  #: per feature, square of the log-count ratio, for the length of a row
    bias: float
    slope: float
    offset: float


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = np.full((2, 1 << BITS), SMOOTH)
    for x, label in zip(rows, y):
        counts[int(label > 0)][x] += 1
    seen = np.log(counts / counts.sum(axis=1, keepdims=True))
    return np.where(counts.sum(axis=0) > 2 * SMOOTH, seen[1] - seen[0], 0.0)


def dual_descent(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, seed: int = 7, epochs: int = EPOCHS, drawn: float = DRAWN) -> tuple[np.ndarray, float]:
    """L2-regularised hinge loss over unit-length scaled indicators; classes weigh alike. Weights, drawn to their mean, and bias."""
    values = [r[x] / (np.sqrt((r[x] ** 2).sum()) or 1.0) for x in rows]
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * COST
    square = np.array([(v * v).sum() + 1.0 for v in values])
    w, bias, alpha, rng = np.zeros(len(r)), 0.0, np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            x, v = rows[i], values[i]
            slope = y[i] * (w[x] @ v + bias) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), weight[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[x] += step * v
                bias += step
                alpha[i] = new
    return (1 - drawn) * np.abs(w).mean() + drawn * w, bias


def margins(rows: list[np.ndarray], r: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    return np.array([(w[x] @ r[x]) / (np.sqrt((r[x] ** 2).sum()) or 1.0) + bias for x in rows])


def logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve by Newton steps, with Platt's smoothed targets."""
    up, down = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, float(np.log((up + 1) / (down + 1)))
    x = np.stack([m, np.ones_like(m)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -35, 35)))
        h = (x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x @ (p - t))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """The model of rows (feature numbers) and labels (0 or 1)."""
    zero = np.zeros(1 << BITS, dtype=np.float32)
    if not len(rows) or labels.min() == labels.max():
        share = float(labels.mean()) if len(rows) else 0.5
        return Model(zero, zero, 0.0, 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    y = np.where(labels > 0, 1.0, -1.0)
    out = np.zeros(len(y))
    fold = np.random.default_rng(11).permutation(len(y)) % FOLDS
    for k in range(FOLDS):
        train = [rows[i] for i in np.flatnonzero(fold != k)]
        if len({*y[fold != k]}) < 2:
            continue
        r = log_count_ratios(train, y[fold != k])
        out[fold == k] = margins([rows[i] for i in np.flatnonzero(fold == k)], r, *dual_descent(train, y[fold != k], r))
    slope, offset = logistic(out, y)
    r = log_count_ratios(rows, y)
    w, bias = dual_descent(rows, y, r)
    return Model((r * w).astype(np.float32), (r * r).astype(np.float32), bias, slope, offset)


def learnable(key: str = "doc_id"):
    """False for rows held out: those whose crc32 of the id as text leaves 2 modulo 4."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 != 2


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_TRAIN) -> Model:
    """Fits on at most max_rows labelled documents; only their feature numbers come to the driver."""
    k = F.col(key).cast("long")
    chosen = labels.where(learnable(key) & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(k.alias("k")).agg(F.min(F.col(label).cast("int")).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("k"), "k").limit(max_rows)
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    picked = docs.select(k.alias("k"), value.alias("t"), F.xxhash64(value).alias("h")).join(F.broadcast(chosen), "k")  # at most max_rows rows of two numbers

    def rows(batches):
        for b in batches:
            for p in steps(b, "t"):
                flat, bounds = features(p.column(1))
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(2), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat)), p.column(3)], names=["k", "y", "x", "h"])

    got = picked.select("k", "t", "y", "h").mapInArrow(shared.released(rows), "k long, y int, x array<int>, h long").toArrow()
    keys = got.column("k").to_numpy()
    sort = np.lexsort((got.column("h").to_numpy(), keys))
    order = sort[np.unique(keys[sort], return_index=True)[1]]  # a repeated id is learned once, by its text of least hash
    xs = got.column("x")
    model = fit([xs[int(i)].values.to_numpy() for i in order], got.column("y").to_numpy()[order])
    del got, xs
    shared.give_back()  # the driver's Python would keep what the fit has freed
    return model


def score_texts(column: pa.Array, model: Model) -> np.ndarray:
    flat, bounds = features(column)
    sums = [np.concatenate([[0.0], np.cumsum(v[flat], dtype=np.float64)]) for v in (model.weights, model.scale)]
    dot, square = (s[bounds[1:]] - s[bounds[:-1]] for s in sums)
    m = dot / np.sqrt(np.where(square > 1e-12, square, 1.0)) + model.bias
    return 1 / (1 + np.exp(-np.clip(model.slope * m + model.offset, -35, 35)))


def scored(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """All rows and columns with the score of their text in a last column, which replaces one of its name. No shuffle."""
    docs = docs.drop(column)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(tuple(model))  # two tables of 2**BITS floats
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])

    def rows(batches):
        m = Model(*sent.value)
        for b in batches:
            for p in steps(b, text):
                s = score_texts(p.column(p.schema.get_field_index(text)), m)
                yield pa.RecordBatch.from_arrays([*p.columns, pa.array(s)], names=[*p.schema.names, column])

    return docs.mapInArrow(shared.released(rows), schema)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, shared.table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", (~learnable()).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
