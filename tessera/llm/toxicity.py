"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct character n-grams (ORDERS, hashed to 2**BITS) within the words of a
text, words being case-folded and framed by boundary marks. Training takes a bounded, stratified
sample of labelled rows (PER_CLASS): each feature is scaled by the log ratio of its share in toxic
and clean texts, and a logistic regression with an L2 penalty is fitted to the scaled features, the
classes weighing the same.

Defined results: a null or empty text has no features and gets the model's bias as its score.
Without training rows of both classes the score is the share of toxic rows, or 0. Repeated rows
give repeated results; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

ORDERS = (3, 4, 5, 6, 7)
BITS = 18
#: Training rows of each class, about.
PER_CLASS = 4000
#: A feature counts if it occurs in so many training texts and its ratio is so far from 0. Held out, on 10,000
#: documents: 119 of 144 toxic ones caught and 5 of 1,200 others marked; with all features 112 and 4.
MIN_TEXTS, MIN_RATIO = 5, 1.5
STEPS, RATE, PENALTY = 200, 0.05, 1e-3

_SPLIT = re.compile(r"[\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words, one word after the other, and how many each word has."""
    framed = ["\x02" + _SPLIT.sub("\x01", w.casefold()).strip("\x01") + "\x03" for w in words]
    size = np.fromiter(map(len, framed), np.int64, len(framed))
    points = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    word = np.repeat(np.arange(len(framed)), size)
    end = np.repeat(np.cumsum(size), size)
    ids, owner = [], []
    for n in ORDERS:
        m = len(points) - n + 1
        if m <= 0:
            continue
        h = points[:m].copy()
        for k in range(1, n):
            h = h * _BASE + points[k : m + k]
        inside = np.arange(n, m + n) <= end[:m]
        h = (h[inside] + np.uint64(n)) * _MIX
        ids.append(((h ^ (h >> np.uint64(29))) * _MIX >> np.uint64(64 - BITS)).astype(np.int32))
        owner.append(word[:m][inside])
    if not ids:
        return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
    ids, owner = np.concatenate(ids), np.concatenate(owner)
    return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))


def features(table: common.WordTable, text: str) -> np.ndarray:
    """The text's distinct features."""
    rows = table.rows(list(set(text.split())))
    return np.unique(table.gather(rows))


class Model:
    """weight per feature, already multiplied by its log-count ratio; and a bias."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias

    def table(self) -> common.WordTable:
        """Words to those of their features that have a weight."""

        def compute(words):
            ids, sizes = ngrams(words)
            used = self.weight[ids] != 0
            return ids[used], np.bincount(np.repeat(np.arange(len(words)), sizes)[used], minlength=len(words))

        return common.WordTable(compute)

    def score(self, table: common.WordTable, text: str) -> float:
        z = self.bias + float(self.weight[features(table, text)].sum())
        return float(1 / (1 + np.exp(-min(max(z, -30), 30))))


def log_ratio(toxic, clean, n_toxic: int, n_clean: int) -> np.ndarray:
    """Naive Bayes log-count ratio of features held by so many toxic and clean texts."""
    return np.log((toxic + 1.0) / (n_toxic + 2.0)) - np.log((clean + 1.0) / (n_clean + 2.0))


def fit(label: np.ndarray, size: np.ndarray, flat: np.ndarray) -> Model:
    """From 0/1 labels and the joined features of the training texts."""
    weight = np.zeros(1 << BITS)
    if label.min(initial=1) == label.max(initial=0) or not len(label):
        share = float(label.mean()) if len(label) else 0.0
        return Model(weight, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    row = np.repeat(np.arange(len(label)), size)
    toxic = np.bincount(flat[label[row] == 1], minlength=1 << BITS)
    clean = np.bincount(flat[label[row] == 0], minlength=1 << BITS)
    ratio = log_ratio(toxic, clean, label.sum(), (1 - label).sum())
    used = (toxic + clean >= MIN_TEXTS) & (abs(ratio) >= MIN_RATIO)
    new = np.cumsum(used) - 1
    kept = used[flat]
    row, col, r = row[kept], new[flat[kept]], ratio[used]
    share = np.where(label == 1, 0.5 / label.sum(), 0.5 / (1 - label).sum())
    w, bias = np.zeros(len(r)), 0.0
    m, v, mb, vb = np.zeros(len(r)), np.zeros(len(r)), 0.0, 0.0
    for t in range(1, STEPS + 1):
        z = bias + np.bincount(row, weights=(w * r)[col], minlength=len(label))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) * share
        grad, gb = r * np.bincount(col, weights=g[row], minlength=len(r)) + PENALTY * w, float(g.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix = np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= RATE * fix * m / (np.sqrt(v) + 1e-8)
        bias -= RATE * fix * mb / (np.sqrt(vb) + 1e-8)
    weight[used] = w * r
    return Model(weight, bias)


def train(docs: DataFrame, labels: DataFrame, rows: Column, per_class: int = PER_CLASS) -> Model:
    """Fit on about ``per_class`` rows of each class.

    Counts of all features are summed on the executors; the driver gets 2**BITS counts at most,
    and then of every training text only the features that those select.
    """
    sample = common.labelled_sample(docs, labels, "toxic", rows, per_class).select("label", "text")
    sample = common.materialize(sample.repartition(8), "toxic-sample")  # bounded rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = common.WordTable(ngrams), np.zeros((2, 1 << BITS), np.int64)
        for batch in common.blocks(batches):
            for label, text in zip(batch.column(0).to_pylist(), common.texts(batch)):
                n[int(label > 0), features(table, text)] += 1
        some = np.flatnonzero(n.sum(0))
        yield common.arrow_batch({"id": some, "clean": n[0, some], "toxic": n[1, some]}, {"id": pa.int32(), "clean": pa.int64(), "toxic": pa.int64()})

    n = {r["toxic"]: r["count"] for r in sample.groupBy((F.col("label") > 0).alias("toxic")).count().collect()}
    counted = common.map_arrow(sample, count, "id int, clean long, toxic long").groupBy("id").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    got = counted.where(F.col("clean") + F.col("toxic") >= MIN_TEXTS).toArrow()
    ids, clean, toxic = (got[c].to_numpy() for c in ("id", "clean", "toxic"))
    select = np.zeros(1 << BITS, bool)
    select[ids] = abs(log_ratio(toxic, clean, n.get(True, 0), n.get(False, 0))) >= MIN_RATIO

    def selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compute(words):
            flat, sizes = ngrams(words)
            own = select[flat]
            return flat[own], np.bincount(np.repeat(np.arange(len(words)), sizes)[own], minlength=len(words))

        table = common.WordTable(compute)
        for batch in common.blocks(batches):
            yield common.arrow_batch({"label": batch.column(0), "ids": [features(table, t).astype(np.int32).tobytes() for t in common.texts(batch)]}, {"label": pa.int32(), "ids": pa.binary()})

    got = common.map_arrow(sample, selected, "label int, ids binary").toArrow()
    texts = sorted(zip(got["ids"].to_pylist(), got["label"].to_pylist()))  # the same sums at every run
    common.release(sample)
    ids = [np.frombuffer(b, np.int32) for b, _ in texts]
    label = np.array([k for _, k in texts], np.int64).clip(0, 1)
    return fit(label, np.array([len(x) for x in ids], np.int64), np.concatenate([*ids, np.zeros(0, np.int32)]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        table = own.table()
        for batch in common.blocks(batches):
            yield common.arrow_batch({"doc_id": batch.column(0), "score": [own.score(table, t) for t in common.texts(batch)]}, {"doc_id": pa.int64(), "score": pa.float64()})

    return common.map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, score double")
