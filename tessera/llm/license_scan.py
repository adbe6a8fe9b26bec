"""Licence scan with a positional index of rare words.

Templates are whole licence texts and one-line notices. Document frequencies of all their words are
counted over all documents. The index has every place of every template word; a template's rare words
are those of highest inverse document frequency that together make up more than 1 - AGREE of its weight
(the sum of its words' frequencies), so a place where AGREE of the weight agrees holds one of them.

A file's licence words are those of its words that are rare in some template. Each of them, wherever it
stands, is looked up, the file's rarest first, and votes for (template, file place - template place). Postings are
intersected by that relative position: places within DRIFT of each other count together, as names and
years shift the words behind them. What can still reach AGREE of the template's weight is compared word
by word, and holds when it does reach it and every mandatory key phrase stands in that stretch of the file.
The score is the share of the template's weight that agrees.

Beside that, base phrases are found wherever their words stand consecutively.

Defined results: a null or empty text has no words, no label and score 0. Repeated rows give
repeated results, a null id stays null, an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common, licence_texts

# Phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = [*licence_texts.WHOLE, *licence_texts.NOTICES]
#: Share of a template's weight that must agree.
AGREE = 0.5
#: Words by which a template's words may be shifted against each other, and a key phrase against its place.
DRIFT, SLACK = 12, 2

#: Separators become spaces and A-Z lower case; bytes of non-ASCII characters are word bytes.
WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,words:long,score:double>>"
TYPES = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int64()), ("score", pa.float64())]))}


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def split(text: str) -> list[bytes]:
    return words(text.encode())


def frequencies(docs: DataFrame, vocabulary: set[bytes]) -> tuple[int, dict[bytes, int]]:
    """Documents, and how many hold each word of the vocabulary (that of the templates)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, Counter()
        for batch in common.blocks(batches):
            for text in common.raw_texts(batch):
                n += 1
                df.update(vocabulary.intersection(words(text)))
        rows = [(b"", n), *df.items()]
        yield common.arrow_batch({"word": [w.decode() for w, _ in rows], "n": [c for _, c in rows]}, {"word": pa.string(), "n": pa.int64()})

    counted = common.map_arrow(docs.select(F.col("text").cast("string")), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"].encode(): r["n"] for r in counted.collect()}  # one row per template word
    return found.pop(b"", 0), found


class Index:
    """Postings of the templates' words, and which of them are rare."""

    def __init__(self, templates, n: int, df: dict[bytes, int]):
        self.templates = [(label, split(text), [split(p) for p in phrases]) for label, text, phrases in templates]
        self.idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for _, own, _ in self.templates for w in own}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.weight, self.from_rare = [], []
        for t, (_, own, _) in enumerate(self.templates):
            total = sum(self.idf[w] for w in own)
            rare, rest = set(), total
            for w in sorted(set(own), key=lambda w: (-self.idf[w], w)):
                if rest < AGREE * total:
                    break
                rare.add(w)
                rest -= self.idf[w] * own.count(w)
            for q, w in enumerate(own):
                if w in rare:
                    self.postings[w].append((t, q))
            self.weight.append(total)
            self.from_rare.append(AGREE * total - rest)  # what rare words must bring at least
        self.keys = frozenset(self.postings)

    def scan(self, own: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first word, words, score) of the templates that stand in the file."""
        if self.keys.isdisjoint(own):
            return []
        where: dict[bytes, list[int]] = defaultdict(list)
        for p, w in enumerate(own):
            if w in self.keys:
                where[w].append(p)
        votes: dict[int, list[tuple[int, int, float]]] = defaultdict(list)
        for w in sorted(where, key=lambda w: (-self.idf[w], w)):
            for t, q in self.postings[w]:
                votes[t] += [(p - q, q, self.idf[w]) for p in where[w]]
        found = []
        for t, cast in votes.items():
            last = None  # of templates found within DRIFT of each other the best counts
            for at in self._stretches(sorted(cast), self.from_rare[t]):
                score = self._agrees(own, t, at)
                if score and last and at - last[0] <= DRIFT:
                    last = max(last, (at, score), key=lambda x: x[1])
                elif score:
                    found += [self._span(t, *last)] if last else []
                    last = (at, score)
            found += [self._span(t, *last)] if last else []
        return sorted(found, key=lambda s: (s[1], s[0]))

    def _span(self, t: int, at: int, score: float) -> tuple[str, int, int, float]:
        return self.templates[t][0], max(0, at), len(self.templates[t][1]), score

    @staticmethod
    def _stretches(cast: list[tuple[int, int, float]], need: float) -> Iterator[int]:
        """Relative positions from which on, within DRIFT, rare words of enough weight agree, each place of the template once."""
        held: Counter = Counter()
        end, weight = 0, 0.0
        for k, (at, q, w) in enumerate(cast):
            while end < len(cast) and cast[end][0] <= at + DRIFT:
                held[cast[end][1]] += 1
                weight += cast[end][2] if held[cast[end][1]] == 1 else 0.0
                end += 1
            if (not k or cast[k - 1][0] < at) and weight >= need - 1e-9:
                yield at
            held[q] -= 1
            weight -= w if not held[q] else 0.0

    def _agrees(self, own: list[bytes], t: int, at: int) -> float:
        """The share of the template's weight that agrees from relative position ``at``; 0 if it does not hold."""
        _, text, phrases = self.templates[t]
        shift, same = 0, 0.0
        for q, w in enumerate(text):
            p = at + q
            if 0 <= p + shift < len(own) and own[p + shift] == w:
                same += self.idf[w]
                continue
            for d in range(DRIFT + 1):
                if 0 <= p + d < len(own) and own[p + d] == w:
                    shift, same = d, same + self.idf[w]
                    break
        if same < AGREE * self.weight[t]:
            return 0.0
        near = own[max(0, at - SLACK) : at + len(text) + DRIFT + SLACK]
        return min(1.0, same / self.weight[t]) if all(_holds(near, p) for p in phrases) else 0.0


def _holds(own: list[bytes], phrase: list[bytes]) -> bool:
    return any(own[q : q + len(phrase)] == phrase for q, w in enumerate(own) if w == phrase[0])


def base_places(own: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a base phrase stands."""
    found = []
    for phrase, label in phrases:
        at = -1
        while True:
            try:
                at = own.index(phrase[0], at + 1)
            except ValueError:
                break
            if own[at : at + len(phrase)] == phrase:
                found.append((at, label))
    return found


def scan(docs: DataFrame, templates=TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """One row per document, with the spans of all templates found."""
    vocabulary = {w for _, text, _ in templates for w in split(text)}
    index = Index(templates, *frequencies(docs, vocabulary))
    phrases = [(split(p), label) for p, label in base.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.blocks(batches):
            out = {k: [] for k in TYPES}
            for doc_id, text in zip(batch.column(0).to_pylist(), common.raw_texts(batch)):
                own = words(text)
                places = base_places(own, phrases)
                spans = index.scan(own)
                labels = {label for _, label in places}
                out["doc_id"].append(doc_id)
                out["n_words"].append(len(own))
                out["n_base"].append(len(places))
                out["first_word"].append(min(places)[0] if places else None)
                out["last_word"].append(max(places)[0] if places else None)
                out["base_labels"].append(",".join(sorted(labels)))
                out["labels"].append(",".join(sorted(labels | {s[0] for s in spans})))
                out["score"].append(1.0 if places else max((s[3] for s in spans), default=0.0))
                out["spans"].append([dict(zip(("label", "start", "words", "score"), s)) for s in spans])
            yield common.arrow_batch(out, TYPES)

    return common.map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA)
