"""Quality: a factorisation machine over hashed words, structure statistics and metadata.

    y = b + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

so all pairs of features are weighed in time linear in the features. Features: the distinct words
of a text hashed to 2**BITS (each 1 / sqrt(number of them)), statistics of its structure, and its
recorded length. Training takes a bounded, stratified sample of labelled rows (PER_CLASS).

Defined results: a null text counts as empty and is scored by its statistics. A missing n_chars
counts as the text's own length. Without training rows of both classes the score is the share of
good rows, or 1. Repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

BITS, FACTORS = 16, 8
#: Training rows of each class, about.
PER_CLASS = 2500
#: Held-out loss and accuracy are the same after 20, 30, 50 and 100 steps (0.0105 to 0.0110, 99.8 %).
STEPS, RATE, PENALTY, SEED = 40, 0.05, 1e-4, 7

_LETTER = bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_UPPER, _DIGIT, _SPACE, _STOP = bytes(range(0x41, 0x5B)), b"0123456789", b" \t\n\r\x0b\x0c", b".,;:!?'\"()-"
STATS = 14


def statistics(text: bytes, words: list[bytes], distinct: int, n_chars: int | None) -> list[float]:
    """STATS numbers about the text's structure and its recorded length."""
    n, count = len(text), len(words)
    share = lambda kind: (n - len(text.translate(None, kind))) / max(1, n)
    letter, digit, space, stop = share(_LETTER), share(_DIGIT), share(_SPACE), share(_STOP)
    lines = text.split(b"\n")
    ends = sum(line.rstrip().endswith((b".", b"!", b"?")) for line in lines)
    recorded = n_chars if n_chars is not None and n_chars >= 0 else len(text.decode("utf-8", "replace"))
    return [
        math.log1p(n), math.log1p(count), letter, share(_UPPER), digit, stop, 1 - letter - digit - space - stop,
        (n - n * space) / max(1, count) if count else 0.0, distinct / max(1, count), math.log1p(len(lines)),
        len(set(lines)) / len(lines), ends / len(lines), text.count(b"|") / max(1, count), math.log1p(recorded),
    ]


def word_table() -> common.WordTable:
    edge = b".,;:!?'\"()[]{}-*#$%&|_<>/\\@+=~^`"
    return common.WordTable(lambda words: (np.fromiter((zlib.crc32(w.lower().strip(edge) or b"\x00" + w[:1]) & (1 << BITS) - 1 for w in words), np.int32, len(words)), np.ones(len(words), np.int64)), limit=100_000)


def features(table: common.WordTable, text: bytes, n_chars: int | None) -> tuple[np.ndarray, list[float]]:
    """Hashes of the distinct words, and the statistics."""
    words = text.split()
    own = set(words)
    ids = np.unique(table.gather(table.rows(list(own))))
    return ids, statistics(text, words, len(own), n_chars)


class Model:
    """w and v of hashed words (first) and statistics; how statistics are scaled; a bias."""

    def __init__(self, w, v, bias: float, mean, spread):
        self.w, self.v, self.bias, self.mean, self.spread = w, v, bias, mean, spread

    def dense(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.spread, -4, 4) / 2

    def margins(self, ids: list[np.ndarray], stats: np.ndarray) -> np.ndarray:
        """y of each text, over all texts of a block at once."""
        size = np.array([len(x) for x in ids], np.int64)
        row, flat = np.repeat(np.arange(len(ids)), size), np.concatenate([*ids, np.zeros(0, np.int32)])
        x = np.repeat(1 / np.sqrt(np.maximum(size, 1)), size)
        return forward(self, row, flat, x, self.dense(stats))[0]


def _sum(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by ``row``, which ascends."""
    out = np.zeros((n, *values.shape[1:]), values.dtype)
    if len(row):
        first = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])
        out[row[first]] = np.add.reduceat(values, first, axis=0)
    return out


def forward(model: Model, row, flat, x, dense) -> tuple[np.ndarray, np.ndarray]:
    """y and the sums over i of v_if x_i, the words' (row, flat, x) being sparse."""
    n, words = len(dense), 1 << BITS
    vs = model.v[words:]
    part = model.v[flat] * x[:, None]
    total = _sum(row, part, n) + dense @ vs
    square = _sum(row, (part * part).sum(1), n) + (dense**2) @ (vs**2).sum(1)
    linear = _sum(row, model.w[flat] * x, n) + dense @ model.w[words:]
    return model.bias + linear + 0.5 * ((total**2).sum(1) - square), total


def fit(label: np.ndarray, ids: list[np.ndarray], stats: np.ndarray) -> Model:
    """Full-batch Adam on the logistic loss, the classes weighing the same."""
    words, rng = 1 << BITS, np.random.default_rng(SEED)
    width = words + STATS
    if not len(label) or label.min() == label.max():
        share = float(label.mean()) if len(label) else 1.0
        return Model(np.zeros(width), np.zeros((width, FACTORS)), math.log((share + 1e-6) / (1 - share + 1e-6)), np.zeros(STATS), np.ones(STATS))
    model = Model(np.zeros(width), rng.normal(0, 0.05, (width, FACTORS)), 0.0, stats.mean(0), np.maximum(stats.std(0), 1e-3))
    size = np.array([len(x) for x in ids], np.int64)
    row, flat = np.repeat(np.arange(len(ids)), size), np.concatenate([*ids, np.zeros(0, np.int32)])
    seen = np.bincount(flat, minlength=words)
    model.v[:words][seen == 0] = 0  # words that training never met have no part in a score
    x, dense = np.repeat(1 / np.sqrt(np.maximum(size, 1)), size).astype(np.float32), model.dense(stats).astype(np.float32)
    used = np.flatnonzero(seen)
    new = np.zeros(words, np.int64)
    new[used] = np.arange(len(used))
    col = new[flat]
    small = Model(*(np.concatenate([p[:words][used], p[words:]]).astype(np.float32) for p in (model.w, model.v)), 0.0, None, None)  # halves the largest arrays
    share = np.where(label == 1, 0.5 / label.sum(), 0.5 / (1 - label).sum()).astype(np.float32)
    k, moments = len(used), [0.0] * 6
    by_word = np.argsort(col, kind="stable")
    sorted_col = col[by_word]
    for t in range(1, STEPS + 1):
        part = small.v[col] * x[:, None]
        total = _sum(row, part, len(label)) + dense @ small.v[k:]
        square = _sum(row, (part * part).sum(1), len(label)) + (dense**2) @ (small.v[k:] ** 2).sum(1)
        y = small.bias + _sum(row, small.w[col] * x, len(label)) + dense @ small.w[k:] + 0.5 * ((total**2).sum(1) - square)
        g = ((1 / (1 + np.exp(-np.clip(y, -30, 30))) - label) * share).astype(np.float32)
        gx = g[row] * x
        gw = np.concatenate([_sum(sorted_col, gx[by_word], k), dense.T @ g]) + PENALTY * small.w
        gv = np.concatenate([_sum(sorted_col, (gx[:, None] * total[row] - part * gx[:, None])[by_word], k), dense.T @ (g[:, None] * total) - small.v[k:] * ((dense**2).T @ g)[:, None]]) + PENALTY * small.v
        for j, (name, grad) in enumerate((("w", gw), ("v", gv), ("bias", float(g.sum())))):
            moments[j] = 0.9 * moments[j] + 0.1 * grad
            moments[j + 3] = 0.999 * moments[j + 3] + 0.001 * grad * grad
            step = np.float32(RATE * math.sqrt(1 - 0.999**t) / (1 - 0.9**t)) * moments[j] / (np.sqrt(moments[j + 3]) + np.float32(1e-8))
            setattr(small, name, getattr(small, name) - step)
    model.w[:words][used], model.w[words:] = small.w[:k], small.w[k:]
    model.v[:words][used], model.v[words:] = small.v[:k], small.v[k:]
    model.bias = float(small.bias)
    return model


def train(docs: DataFrame, labels: DataFrame, rows: Column, per_class: int = PER_CLASS) -> Model:
    """Fit on about ``per_class`` rows of each class; at most those features reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table()
        for batch in common.blocks(batches):
            got = [features(table, t, n) for t, n in zip(common.raw_texts(batch), batch.column(2).to_pylist())]
            yield common.arrow_batch({"label": batch.column(0), "ids": [a.astype(np.int32).tobytes() for a, _ in got], "stats": [b for _, b in got]}, {"label": pa.int32(), "ids": pa.binary(), "stats": pa.list_(pa.float64())})

    sample = common.labelled_sample(docs, labels, "quality", rows, per_class).select("label", "text", F.col("n_chars").cast("long"))
    got = common.map_arrow(sample, run, "label int, ids binary, stats array<double>").toArrow()
    rows_ = sorted(zip(got["ids"].to_pylist(), got["stats"].to_pylist(), got["label"].to_pylist()))  # the same sums at every run
    ids = [np.frombuffer(b, np.int32) for b, _, _ in rows_]
    return fit(np.array([r[2] for r in rows_], np.int64).clip(0, 1), ids, np.array([r[1] for r in rows_]).reshape(-1, STATS))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # (2**BITS + STATS) * (FACTORS + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = shared.value, word_table()
        for batch in common.blocks(batches):
            got = [features(table, t, n) for t, n in zip(common.raw_texts(batch), batch.column(2).to_pylist())]
            y = own.margins([a for a, _ in got], np.array([b for _, b in got]).reshape(-1, STATS))
            yield common.arrow_batch({"doc_id": batch.column(0), "score": 1 / (1 + np.exp(-np.clip(y, -30, 30)))}, {"doc_id": pa.int64(), "score": pa.float64()})

    return common.map_arrow(common.columns_or_null(docs, doc_id="long", text="string", n_chars="long"), run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows that score ``threshold`` or more, with all their columns.

    Rows without id are judged like others; a table without n_chars counts the texts itself.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = shared.value, word_table()
        for batch in common.blocks(batches):
            at = batch.schema.get_field_index("n_chars")
            recorded = batch.column(at).cast(pa.int64()).to_pylist() if at >= 0 else [None] * batch.num_rows
            got = [features(table, t, n) for t, n in zip(common.raw_texts(batch), recorded)]
            y = own.margins([a for a, _ in got], np.array([b for _, b in got]).reshape(-1, STATS))
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(y, -30, 30))) >= threshold))

    return common.map_arrow(docs, run, docs.schema)
