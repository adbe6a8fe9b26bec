"""Benchmark decontamination by latent semantic retrieval.

The benchmark is a stated query set, searched for in blocks of MOST_ITEMS items; of each block:

1. One pass turns every document into a sequence of term numbers, a term being any word of the
   benchmark and all other words one blank, and writes it to the shared folder; no later step needs
   the text, as other words match no item. The pass also counts in how many of the corpus's
   passages (runs of WINDOW words) each term occurs; terms in over MAX_SHARE of them carry no weight,
   but the rarest terms of every item, a KEPT part of its words at least, always do, so that an item whose
   own leaks make its words frequent keeps a latent vector.
2. Randomised SVD. With A the TF-IDF matrix of all passages, one distributed pass makes
   Y = A'A Omega for a random Omega of RANK + EXTRA columns; the Nystroem form of A'A from Y and
   Omega gives the right singular vectors and values (V x l matrices only, V the benchmark terms).
3. Items and windows (WINDOW words, every WINDOW / 2) are projected on the singular vectors, scaled
   by the singular values; windows with cosine COSINE or more to an item are its candidates. So is
   every other window that can hold: where the words around it, common ones of the item left aside,
   are as many of the item's as step 4 needs at least. No passage that holds is left out this way.
4. A candidate holds if the longest common subsequence of the item and the text around the window
   covers COVER of the item's words; or COVER_ANSWER of them and ANSWER_COVER of its answer, the
   item's last ANSWER words. Without the cosine, COVER_ANSWER and ANSWER_COVER count only where that
   part of the text is at most twice as long as the item: over more, a few common words do by chance.

Defined results: null and empty texts and items match nothing, as does everything when the
benchmark is empty. Equal items match alike. Rows without id are scanned but
not removed. Repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

WINDOW, MAX_SHARE, KEPT = 32, 0.03, 0.25
RANK, EXTRA, SEED = 128, 10, 5
COSINE = 0.5
COVER, COVER_ANSWER, ANSWER, ANSWER_COVER = 0.6, 0.5, 8, 0.75
ASIDE = 0.35
#: Items that are searched for at once, and their number times their distinct words: a table of that size is in every task.
MOST_ITEMS, MOST_CELLS = 1024, 8_000_000

#: Punctuation beyond ASCII that ends words; other characters beyond ASCII belong to them.
_MARKS = re.compile("[\u00a0-\u00bf\u2000-\u206f\u3000-\u3003\uff0c\uff0e]")
#: Of UTF-8 bytes: ASCII letters, digits and bytes of other characters stay, the rest separates.
_BYTES = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words(text: str) -> list[bytes]:
    """Lower-case words in UTF-8."""
    low = text.lower()
    if not low.isascii():
        low = _MARKS.sub(" ", low)
    return low.encode("utf-8", "replace").translate(_BYTES).split()


def segment_sums(table: np.ndarray, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of table[rows] over the runs of ``rows`` that begin at ``first``; the j-th rows of all runs at once."""
    size = np.diff([*first, len(rows)])
    out, longest = table[rows[first]], np.argsort(-size, kind="stable")
    ends = np.searchsorted(-size[longest], -np.arange(1, size.max(initial=1)), side="left")
    for j, n in enumerate(ends, 1):
        k = longest[:n]
        out[k] += table[rows[first[k] + j]]
    return out


def lcs(a: list, b: list) -> list[int]:
    """Positions in ``a`` of one longest common subsequence with ``b``, by bit-parallel rows."""
    where: dict = defaultdict(int)
    for k, x in enumerate(a):
        where[x] |= 1 << k
    full, row, rows = (1 << len(a)) - 1, (1 << len(a)) - 1, []
    for x in b:
        match = row & where.get(x, 0)
        row = (row + match | row & ~match) & full
        rows.append(row)
    out, k = [], len(a) - 1
    length = lambda r, j: (~r & (1 << j + 1) - 1).bit_count() if j >= 0 else 0  # noqa: E731  LCS of a[:j+1] and b so far
    j = len(b) - 1
    while k >= 0 and j >= 0:
        here = length(rows[j], k)
        if here == length(rows[j], k - 1):
            k -= 1
        elif j and here == length(rows[j - 1], k):
            j -= 1
        else:
            out.append(k)
            k, j = k - 1, j - 1
            if not here:
                break
    return out[::-1]


def lcs_length(masks: list[int], size: int, b: list[int]) -> int:
    """Length of the longest common subsequence of b and a sequence of ``size``; masks has the places of each entry in it."""
    full = row = (1 << size) - 1
    for x in b:
        match = row & masks[x]
        row = (row + match | row - match) & full
    return size - row.bit_count()


SCHEMA = "doc_id long, item_id long, cosine double, cover double, answer_cover double"


class Items(NamedTuple):
    ids: list
    words: list[list[bytes]]

    @property
    def terms(self) -> list[bytes]:
        return sorted({w for own in self.words for w in own})


def item_blocks(benchmark: DataFrame, most: int = MOST_ITEMS, cells: int = MOST_CELLS) -> Iterator[Items]:
    """The benchmark in blocks of at most ``most`` items whose number times their distinct words is ``cells`` at most.

    Items come one partition at a time; what a block needs in the driver and in every task is bounded by
    its size (an item that exceeds it alone is a block).
    """
    rows = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t"))
    held, terms = [], set()
    for r in rows.distinct().orderBy("i", "t").toLocalIterator():
        own = words(r["t"])
        if not own:
            continue
        more = terms.union(own)
        if held and (len(held) == most or (len(held) + 1) * len(more) > cells):
            yield Items([i for i, _ in held], [w for _, w in held])
            held, more = [], set(own)
        held.append((r["i"], own))
        terms = more
    if held:
        yield Items([i for i, _ in held], [w for _, w in held])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers of all words of a block's documents, joined; and the documents' word counts."""
    parts = [np.frombuffer(b, "<i4") for b in column.to_pylist()]
    return np.concatenate([*parts, np.zeros(0, np.int32)]), np.array([len(p) for p in parts], np.int64)


def _slices(batches: Iterator[pa.RecordBatch], words_: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Slices of batches (doc_id, seq) with about so many words, one row at least."""
    for batch in batches:
        if batch.num_rows:
            size = np.asarray(pc.binary_length(batch.column(1))).astype(np.int64) // 4
            group = (np.cumsum(size) - size) // words_
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]))


def _runs(size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the run of ``width`` words, from each text's start, that each word is in; runs per text; their total."""
    per = -(-size // width)
    first = np.repeat(np.cumsum(per) - per, size)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return first + place // width, per, int(per.sum())


def index(docs: DataFrame, terms: list[bytes]) -> tuple[DataFrame, int, np.ndarray]:
    """A table with (doc_id, seq) of all documents among its rows; the corpus's passages, and how many of them hold each term."""
    place = {w: k for k, w in enumerate(terms)}
    types = {"doc_id": pa.int64(), "seq": pa.binary(), "term": pa.int64(), "n": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(len(terms), np.int64)
        for batch in common.blocks(batches):
            parts = []
            for text in common.texts(batch):
                own = words(text)
                parts.append(np.fromiter(map(place.get, own, repeat(-1)), "<i4", len(own)))
            t, size = np.concatenate([*parts, np.zeros(0, np.int32)]), np.array([len(p) for p in parts], np.int64)
            passage, _, count = _runs(size, WINDOW)
            n += count
            some = t >= 0
            both = passage[some] * len(terms) + t[some]
            both = np.sort(both.astype(np.int32) if count * len(terms) < 2**31 else both)
            df += np.bincount(both[np.diff(both, prepend=-1) != 0] % len(terms), minlength=len(terms))
            none = pa.nulls(len(parts), pa.int64())
            yield common.arrow_batch({"doc_id": batch.column(0), "seq": [p.tobytes() for p in parts], "term": none, "n": none}, types)
        none = len(terms) + 1
        yield common.arrow_batch({"doc_id": pa.nulls(none, pa.int64()), "seq": pa.nulls(none, pa.binary()), "term": np.arange(-1, len(terms)), "n": np.concatenate([[n], df])}, types)

    table = common.materialize(common.map_arrow(_texts(docs), run, "doc_id long, seq binary, term long, n long"), "leak-terms")
    got = table.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row per benchmark term
    found = {r["term"]: r["n"] for r in got}
    return table, found.get(-1, 0), np.array([found.get(k, 0) for k in range(len(terms))], np.int64)


def sketch(sequences: DataFrame, idf: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """A'A omega over all passages."""
    n_terms, width = omega.shape
    shared = sequences.sparkSession.sparkContext.broadcast(((idf * omega.T).T.astype(np.float32), idf > 0))  # the benchmark's terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scaled, used = shared.value
        total = np.zeros((n_terms, width))
        for batch in _slices(batches):
            t, size = _sequences(batch.column(1))
            passage, _, _ = _runs(size, WINDOW)
            some = used[t] & (t >= 0)
            t, passage = t[some], passage[some]
            if not len(t):
                continue
            first = np.concatenate([[0], np.flatnonzero(np.diff(passage)) + 1])
            row = segment_sums(scaled, t, first)  # A omega
            own = np.repeat(np.arange(len(first)), np.diff([*first, len(t)]))
            order = np.argsort(t, kind="stable")
            begin = np.concatenate([[0], np.flatnonzero(np.diff(t[order])) + 1])
            total[t[order][begin]] += segment_sums(row, own[order], begin)
        used = np.flatnonzero(total.any(1))
        yield common.arrow_batch({"term": used, "row": [total[k].astype("<f8").tobytes() for k in used]}, {"term": pa.int64(), "row": pa.binary()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(row, "<f8")
                sums[k] = sums[k] + x if k in sums else x
        yield common.arrow_batch({"term": list(sums), "row": [x.tobytes() for x in sums.values()]}, {"term": pa.int64(), "row": pa.binary()})

    # a term's rows, one per task, are summed by the task that owns the term
    parts = common.map_arrow(common.map_arrow(sequences, run, "term long, row binary").repartition("term"), add, "term long, row binary")
    out = np.zeros((n_terms, width))
    for r in parts.toLocalIterator():
        out[r["term"]] = np.frombuffer(r["row"], "<f8")
    return (idf * out.T).T


def singular(y: np.ndarray, omega: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvectors of G and roots of its eigenvalues, from y = G omega (Nystroem)."""
    shift = 1e-6 * np.linalg.norm(y) + 1e-12
    y = y + shift * omega
    core = omega.T @ y
    low = np.linalg.cholesky((core + core.T) / 2 + 1e-9 * np.trace(core) / len(core) * np.eye(len(core)))
    u, s, _ = np.linalg.svd(np.linalg.solve(low, y.T).T, full_matrices=False)
    keep = s[:rank] > 1e-6 * s[0]
    return u[:, :rank][:, keep], s[:rank][keep]


def rarest(targets: list[np.ndarray], df: np.ndarray, share: float) -> np.ndarray:
    """Whether a term is among the rarest of some item that together make up ``share`` of its words, or as rare as those."""
    out = np.zeros(len(df), bool)
    for t in targets:
        own = np.sort(df[t])
        out[t[df[t] <= own[max(0, int(np.ceil(share * len(t))) - 1)]]] = True
    return out


def projection(sequences: DataFrame, n: int, df: np.ndarray, targets: list[np.ndarray]) -> np.ndarray:
    """A row per term: what a word adds to the latent vector of a passage. n passages, df of them with the term."""
    rare = ((df <= max(1.0, MAX_SHARE * n)) | rarest(targets, df, KEPT)) & (n > 0)
    idf = np.where(rare, np.log((1 + n) / (1 + df)) + 1, 0.0)
    if not rare.any():
        return np.zeros((len(df), 1), np.float32)
    width = min(RANK + EXTRA, int(rare.sum()))
    omega = np.random.default_rng(SEED).normal(size=(len(df), width))
    omega[~rare] = 0
    y = sketch(sequences, idf, omega)
    if not y.any():
        return np.zeros((len(df), 1), np.float32)
    u, s = singular(y, omega, min(RANK, width))
    return ((idf * u.T).T / s).astype(np.float32)


class Screen(NamedTuple):
    """Which windows can hold an item: ``need`` words of ``table`` at least must lie within ``reach`` half windows."""

    table: np.ndarray  # a row per term, and an empty one for other words: the items that count it
    need: np.ndarray
    reach: np.ndarray

    def windows(self, every: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and windows (numbers of half windows) that can hold; for documents of ``size`` words, joined."""
        run, per, count = _runs(size, WINDOW // 2)
        some = self.table.any(1)[every]
        t, run = every[some], run[some]
        if not len(t):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])
        hits = np.zeros((count + 1, len(self.need)), np.uint8)
        hits[run[first] + 1] = segment_sums(self.table, t, first)
        # differences are right modulo 2**16 as long as they are smaller
        hits = np.cumsum(hits, axis=0, dtype=np.uint16 if WINDOW * (int(self.reach.max()) + 1) < 2**16 else np.int64)
        window, stop = np.arange(count), np.repeat(np.cumsum(per), per)
        start, out = np.repeat(np.cumsum(per) - per, per), []
        for reach in np.unique(self.reach).tolist():
            own = np.flatnonzero(self.reach == reach)
            few = hits[:, own]
            near = few[np.minimum(window + 2 + reach, stop)] - few[np.maximum(window - reach, start)]
            w, k = np.nonzero(near >= self.need[own].astype(near.dtype))
            out.append((own[k], w))
        return np.concatenate([k for k, _ in out]), np.concatenate([w for _, w in out])


def screen(targets: list[np.ndarray], df: np.ndarray) -> Screen:
    """Leaves aside the commonest terms of each item, up to ASIDE of its words; as many fewer words are needed."""
    table, need = np.zeros((len(df) + 1, len(targets)), np.uint8), []
    for k, t in enumerate(targets):
        own, count = np.unique(t, return_counts=True)
        order = np.argsort(-df[own], kind="stable")
        total = np.cumsum(count[order])
        aside = int((total <= ASIDE * len(t)).sum())
        table[own[order[aside:]], k] = 1
        need.append(int(np.ceil(min(COVER, COVER_ANSWER) * len(t))) - (int(total[aside - 1]) if aside else 0))
    return Screen(table, np.array(need), np.array([-(-len(t) // (WINDOW // 2)) for t in targets]))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Matcher:
    """Checks candidates: an item and a run of a document's windows."""

    def __init__(self, targets: list[np.ndarray], n_terms: int):
        self.place, self.targets, self.counts, self.masks = [], [], [], []
        for t in targets:
            own, local, count = np.unique(t, return_inverse=True, return_counts=True)
            place = np.full(n_terms + 1, -1, np.int16 if len(own) < 2**15 else np.int32)  # term -1 is the last entry
            place[own] = np.arange(len(own))
            self.place.append(place)
            self.targets.append(local.tolist())
            self.counts.append(count)
            self.masks.append([sum(1 << k for k in np.flatnonzero(local == x).tolist()) for x in range(len(own))])
        self.places, self.need = np.stack(self.place), np.array([min(COVER, COVER_ANSWER) * len(t) for t in targets])
        self.place = list(self.places)
        self.count = np.zeros((len(targets), max(map(len, self.counts))), np.int32)
        for k, count in enumerate(self.counts):
            self.count[k, : len(count)] = count

    def bags(self, every: np.ndarray, item: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether the terms every[begin:end] can hold the item as a bag of words, for each item."""
        out, wide = np.zeros(len(item), bool), self.count.shape[1]
        step = max(1, (1 << 18) // wide)
        for k in range(0, len(item), step):
            i, size = item[k : k + step], (end - begin)[k : k + step]
            pair = np.repeat(np.arange(len(i)), size)
            at = np.arange(len(pair)) + np.repeat(begin[k : k + step] - np.cumsum(size) + size, size)
            local = self.places[i[pair], every[at]]
            own = local >= 0
            found = np.bincount(pair[own] * wide + local[own], minlength=len(i) * wide).reshape(len(i), wide)
            out[k : k + step] = np.minimum(found, self.count[i]).sum(1) >= self.need[i]
        return out

    def check_close(self, own: np.ndarray, item: int, begin: int, end: int) -> tuple[float, float] | None:
        """As check; but less than COVER counts only within twice the item's length."""
        held, long = self.check(own, item, begin, end), len(self.targets[item])
        if held is None or held[0] >= COVER:
            return held
        near = self.place[item][own[max(0, begin - long) : end + long]]
        parts = [near[k : k + 2 * long] for k in range(0, max(1, len(near) - long), max(1, long // 4))]
        return max(filter(None, (self.cover(item, x[x >= 0]) for x in parts)), default=None)

    def check(self, own: np.ndarray, item: int, begin: int, end: int) -> tuple[float, float] | None:
        """Shares of the item and of its answer that the terms around own[begin:end] cover, if it holds."""
        target, count = self.targets[item], self.counts[item]
        need = min(COVER, COVER_ANSWER) * len(target)
        near = self.place[item][own[max(0, begin - len(target)) : end + len(target)]]
        near = near[near >= 0]
        if len(near) < need or np.minimum(np.bincount(near, minlength=len(count)), count).sum() < need:
            return None  # not even as a bag of words
        return self.cover(item, near)

    def cover(self, item: int, near: np.ndarray) -> tuple[float, float] | None:
        """The shares that a text of the item's terms covers, if it holds."""
        target, near = self.targets[item], near.tolist()
        if lcs_length(self.masks[item], len(target), near) < min(COVER, COVER_ANSWER) * len(target):
            return None
        found = lcs(target, near)
        answer = min(ANSWER, len(target))
        cover, last = len(found) / len(target), sum(k >= len(target) - answer for k in found) / answer
        return (cover, last) if cover >= COVER or cover >= COVER_ANSWER and last >= ANSWER_COVER else None


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, cover, answer_cover): a row per document and item found in it.

    A benchmark of several blocks is searched for block by block, each over all documents.
    """
    out = None
    for items in item_blocks(benchmark):
        one = block_matches(docs, items)
        out = one if out is None else common.reading(out.union(one), out, one)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def block_matches(docs: DataFrame, items: Items) -> DataFrame:
    """As ``matches``, for one block of items."""
    terms = items.terms
    place = {w: k for k, w in enumerate(terms)}
    targets = [np.array([place[w] for w in own], np.int32) for own in items.words]
    table, n, df = index(docs, terms)
    sequences = table.where(F.col("seq").isNotNull()).select("doc_id", "seq")
    rows = projection(sequences, n, df, targets)
    latent = _unit(np.stack([rows[t].sum(0) for t in targets])).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((rows, latent, targets, items.ids, screen(targets, df)))  # bounded by MOST_ITEMS and MOST_CELLS
    types = {"doc_id": pa.int64(), "item_id": pa.int64(), "cosine": pa.float64(), "cover": pa.float64(), "answer_cover": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, latent, targets, item_ids, able = shared.value
        half, matcher, used = WINDOW // 2, Matcher(targets, len(rows)), rows.any(1)
        lengths = np.array([len(t) for t in targets])
        for batch in _slices(batches):
            ids, out = batch.column(0).to_pylist(), {k: [] for k in types}
            every, size = _sequences(batch.column(1))
            run_, per, count = _runs(size, half)
            some = used[every] & (every >= 0)
            t, run_ = every[some], run_[some]
            halves = np.zeros((count + 1, rows.shape[1]), np.float32)
            if len(t):
                first = np.concatenate([[0], np.flatnonzero(np.diff(run_)) + 1])
                halves[run_[first]] = segment_sums(rows, t, first)
            after = halves[1:].copy()
            after[np.cumsum(per)[per > 0] - 1] = 0  # a document's last half stands alone
            cosine = _unit(halves[:-1] + after) @ latent.T
            begun, words_at, of = np.cumsum(per) - per, np.cumsum(size) - size, np.repeat(np.arange(len(per)), per)
            best: dict[tuple[int, int], tuple] = {}

            def take(d: int, i: int, held: tuple | None, c: float) -> None:
                if held:
                    best[d, i] = max(best.get((d, i), ((-1.0, 0.0), 0.0)), (held, c))

            item, window = np.nonzero(cosine.T >= COSINE)
            if len(item):
                # windows of an item that follow each other in one document are one candidate
                new = np.concatenate([[True], (np.diff(item) != 0) | (np.diff(window) != 1) | (np.diff(of[window]) != 0)])
                start = np.flatnonzero(new)
                stop = np.append(start[1:], len(item))
                top = np.maximum.reduceat(cosine[window, item], start)
                for a, b, c in zip(start.tolist(), stop.tolist(), top.tolist()):
                    d, i = int(of[window[a]]), int(item[a])
                    own = every[words_at[d] : words_at[d] + size[d]]
                    take(d, i, matcher.check(own, i, int(window[a] - begun[d]) * half, int(window[b - 1] - begun[d]) * half + WINDOW), c)
            item, window = able.windows(every, size)  # each is a candidate
            doc = of[window]
            place, long = (window - begun[doc]) * half, lengths[item]
            fits = matcher.bags(every, item, words_at[doc] + np.maximum(place - long, 0), words_at[doc] + np.minimum(place + WINDOW + long, size[doc]))
            for d, i, p, c in zip(*(x[fits].tolist() for x in (doc, item, place, cosine[window, item]))):
                take(d, i, matcher.check_close(every[words_at[d] : words_at[d] + size[d]], i, p, p + WINDOW), c)
            for (d, i), ((cover, last), c) in sorted(best.items()):
                for key, x in zip(types, (ids[d], item_ids[i], c, cover, last)):
                    out[key].append(x)
            yield common.arrow_batch(out, types)

    return common.reading(common.map_arrow(sequences, run, SCHEMA), table)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    found = matches(docs, benchmark)
    gone = common.materialize(found.where(F.col("doc_id").isNotNull()).select("doc_id").distinct(), "leaks")
    common.release(found)
    return common.reading(common.keep_ids(docs, gone, "doc_id", "left_anti"), gone)
