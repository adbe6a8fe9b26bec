"""Language identification: words first, then shorter and shorter character n-grams.

A word that training knows adds its log frequency in every language. For another word the longest
n-grams (from ORDERS[0] down) of which training knows any are taken, and their mean log frequency
per language is added instead. The language with the largest sum wins; the score is its share
after the sums are brought to the scale of EVIDENCE words.

Training takes a bounded sample of rows of each language (PER_LANGUAGE) and keeps every word and
n-gram that occurs in it.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is every text
when there is nothing to learn from. Rows with a null lang teach nothing. Ties go to the language
that sorts first. Repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

ORDERS = (4, 3, 2, 1)
#: Training rows of each language, about.
PER_LANGUAGE = 3000
SMOOTH, EVIDENCE = 0.5, 20.0

_LETTERS = re.compile(r"[^\W\d_]+")


def words(chunk: str) -> list[str]:
    """Runs of letters, lower case."""
    return [w for w in _LETTERS.findall(chunk.lower()) if w.isalpha() or any(map(str.isalpha, w))]


def grams(word: str, n: int) -> list[str]:
    framed = f"\x02{word}\x03" if n > 1 else word
    return [framed[k : k + n] for k in range(len(framed) - n + 1)]


class Model:
    def __init__(self, counts: dict[str, dict[int, Counter]]):
        """counts: language to order (0 for words) to what was counted."""
        self.languages = sorted(counts)
        self.place: dict[int, dict[str, int]] = {}
        self.logs: dict[int, np.ndarray] = {}
        for order in (0, *ORDERS):
            kept = sorted({gram for language in self.languages for gram in counts[language][order]})
            self.place[order] = {g: k for k, g in enumerate(kept)}
            seen = np.array([[counts[language][order].get(g, 0) for language in self.languages] for g in kept], np.float64).reshape(len(kept), len(self.languages))
            self.logs[order] = np.log((seen + SMOOTH) / (seen.sum(0) + SMOOTH * len(kept))).astype(np.float32)

    def words(self, own: list[str]) -> np.ndarray:
        """Log frequencies of words, a row each and a column per language."""
        at = np.fromiter((self.place[0].get(w, -1) for w in own), np.int64, len(own))
        out = np.zeros((len(own), len(self.languages)), np.float32)
        out[at >= 0] = self.logs[0][at[at >= 0]]
        left = np.flatnonzero(at < 0).tolist()
        for n in ORDERS:
            known, found, size = self.place[n], [], []
            for k in left:
                some = [x for x in map(known.get, grams(own[k], n)) if x is not None]
                found += some
                size.append(len(some))
            size = np.array(size, np.int64)
            hit = np.flatnonzero(size)
            if len(hit):
                sums = np.add.reduceat(self.logs[n][found], (np.cumsum(size) - size)[hit], axis=0)
                out[np.array(left)[hit]] = sums / size[hit, None]
            left = [k for k, x in zip(left, size.tolist()) if not x]
        return out

    def table(self) -> common.WordTable:
        """A chunk to its words' summed log frequencies, and how many words it has."""

        def compute(chunks):
            split = [words(c) for c in chunks]
            size = np.fromiter(map(len, split), np.int64, len(split))
            out = np.zeros((len(chunks), len(self.languages) + 1), np.float32)
            out[:, -1] = size
            full = np.flatnonzero(size)
            if len(full):
                own = self.words([w for part in split for w in part])
                out[full, :-1] = np.add.reduceat(own, (np.cumsum(size) - size)[full], axis=0)
            return out.ravel(), np.full(len(chunks), out.shape[1])

        return common.WordTable(compute, limit=400_000, dtype=np.float32)

    def predict(self, table: common.WordTable, text: str) -> tuple[str, float]:
        width = len(self.languages) + 1
        chunks = text.split()
        if not chunks or width == 1:
            return "und", 0.0
        total = table.gather(table.rows(chunks)).reshape(-1, width).sum(0, dtype=np.float64)
        if not total[-1]:
            return "und", 0.0
        z = total[:-1] * min(1.0, EVIDENCE / total[-1])
        k = int(total[:-1].argmax())
        return self.languages[k], float(1 / np.exp(z - z[k]).sum())


def train(docs: DataFrame, rows: Column, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on about ``per_language`` rows of each language."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & rows)
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    share = F.lit(0.0)
    for language, n in counts.items():
        share = F.when(F.col("lang") == language, F.lit(min(1.0, per_language / n))).otherwise(share)
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1_000_000)) < share * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)
        for batch in common.blocks(batches):
            for language, text in zip(batch.column(0).to_pylist(), common.texts(batch)):
                seen[language].update(text.split())
        out = {"lang": [], "order": [], "gram": [], "n": []}
        for language, chunks in seen.items():
            own = Counter()
            for chunk, c in chunks.items():
                for w in words(chunk):
                    own[w] += c
            levels = {0: own} | {n: Counter() for n in ORDERS}
            for w, c in own.items():
                for n in ORDERS:
                    for g in grams(w, n):
                        levels[n][g] += c
            for order, found in levels.items():
                out["lang"] += [language] * len(found)
                out["order"] += [order] * len(found)
                out["gram"] += found.keys()
                out["n"] += found.values()
        yield common.arrow_batch(out, {"lang": pa.string(), "order": pa.int32(), "gram": pa.string(), "n": pa.int64()})

    counted = common.map_arrow(sample.select(F.col("lang").cast("string"), F.col("text").cast("string")), run, "lang string, order int, gram string, n long")
    counted = counted.groupBy("lang", "order", "gram").agg(F.sum("n").alias("n"))
    found: dict[str, dict[int, Counter]] = {language: {n: Counter() for n in (0, *ORDERS)} for language in counts}
    for batch in counted.toArrow().to_batches():  # bounded by the sample
        for language, order, gram, n in zip(*(batch.column(k).to_pylist() for k in range(4))):
            found[language][order][gram] = n
    return Model(found)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample, PER_LANGUAGE rows of each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        table = own.table()
        for batch in common.blocks(batches):
            got = [own.predict(table, t) for t in common.texts(batch)]
            yield common.arrow_batch({"doc_id": batch.column(0), "lang_pred": [a for a, _ in got], "score": [b for _, b in got]}, {"doc_id": pa.int64(), "lang_pred": pa.string(), "score": pa.float64()})

    return common.map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, lang_pred string, score double")
