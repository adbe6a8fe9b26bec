"""Line deduplication by pairwise alignment.

1. Every line is hashed; lines of MIN_WORDS words or more, by white space of any kind, are keys, and
   so are lines of MIN_CHARS characters or more, or of MIN_UNSPACED in scripts without spaces.
2. A key's first document (smallest id) owns it. Documents overlap through the keys that they share,
   rare ones first: a document is paired with the owner of its rarest shared key, which for a copy is
   its original rather than the page that first had some common line.
3. Each pair is aligned with patience diff: lines that occur once in both, in their longest common
   order, are anchors; equal lines beside anchors join them; gaps between anchors are aligned again.
4. Aligned blocks with a key line are deleted from the later document.
5. What one alignment leaves of the keys that the pair shares, as it crosses others or occurs twice,
   is aligned place by place: each such line goes, with the longest block around it that the earlier
   document holds.
6. Keys that a document still has, though an earlier document owns them, lead to further partners: their
   owners, all at once. So after two rounds no key line stays that any earlier document holds, however
   many hold it, with one pair per (document, key) at most.

Defined results: a null text has no lines and stays null, an empty one stays empty. Rows without id
own nothing and stay whole. Rows that share an id share what is deleted by line number. An empty
table gives no rows. All other columns are kept; a column named n_removed is replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

MIN_WORDS, MIN_CHARS, MIN_UNSPACED = 5, 40, 10

#: Characters of scripts that put no space between words: Thai to Tibetan, Burmese, Khmer, kana, Han.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def is_key(line: bytes) -> bool:
    """Whether a line is long enough to lead to a partner."""
    if line.count(b" ") + 1 >= MIN_WORDS:
        return True
    if len(line) < 2 * MIN_WORDS - 1:
        return False
    text = line.decode("utf-8", "replace")
    return len(text) >= MIN_CHARS or len(text.split()) >= MIN_WORDS or not line.isascii() and len(_UNSPACED.findall(text)) >= MIN_UNSPACED


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of equal entries, ascending in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: k for k, x in enumerate(b[b0:b1], b0) if in_b[x] == 1}
        once = [(k, place[x]) for k, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and x in place]
        anchors = _longest_ascending(once)
        if not anchors:
            continue
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        out += anchors
        todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:])]
    return sorted(out)


def _longest_ascending(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of the pairs (ascending in the first) that ascends in the second too."""
    tops, last, before = [], [], []
    for k, (_, y) in enumerate(pairs):
        at = bisect_left(tops, y)
        before.append(last[at - 1] if at else -1)
        if at == len(tops):
            tops.append(y), last.append(k)
        else:
            tops[at], last[at] = y, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def blocks(pairs: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Runs of aligned positions that follow each other in both."""
    out: list[list[tuple[int, int]]] = []
    for p in pairs:
        if out and (p[0] - 1, p[1] - 1) == out[-1][-1]:
            out[-1].append(p)
        else:
            out.append([p])
    return out


def left_over(a: list[int], b: list[int], keys: set[int], done: set[int]) -> set[int]:
    """Positions of b, beyond ``done``, in runs around key lines that a holds too, though elsewhere or more often."""
    rest = {b[q] for q in range(len(b)) if q not in done and b[q] in keys}.intersection(a)
    if not rest:
        return set()
    places: dict[int, list[int]] = {}
    for p, x in enumerate(a):
        if x in rest:
            places.setdefault(x, []).append(p)
    out: set[int] = set()
    known: dict[tuple, int] = {}
    for q, x in enumerate(b):
        if q in done or x not in rest:
            continue
        out.add(q)
        for step in (-1, 1):
            end = q + step
            while 0 <= end < len(b) and b[end] not in keys:
                end += step
            around = tuple(b[q + step : end : step] if end >= 0 else b[q - 1 :: -1] if q else ())
            if not around:
                continue
            best = known.get((x, step, around), 0)
            for p in places[x] if (x, step, around) not in known else ():
                n = 0
                while n < len(around) and 0 <= p + step * (n + 1) < len(a) and a[p + step * (n + 1)] == around[n]:
                    n += 1
                best = max(best, n)
                if best == len(around):
                    break
            known[x, step, around] = best
            out.update(q + step * k for k in range(1, best + 1))
    return out


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, hashes, keys): hashes of all lines in order; and which are keys, as the distinct ones' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.blocks(batches):
            hashes, keys = [], []
            for text in common.raw_texts(batch):
                own = [x.strip() for x in text.split(b"\n")]
                h = [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in own]
                hashes.append(h)
                keys.append(list({y for x, y in zip(own, h) if is_key(x)}))
            yield common.arrow_batch({"doc_id": batch.column(0), "hashes": hashes, "keys": keys}, {"doc_id": pa.int64(), "hashes": pa.list_(pa.int64()), "keys": pa.list_(pa.int64())})

    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return common.map_arrow(rows, run, "doc_id long, hashes array<long>, keys array<long>")


def aligned(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """(doc_id, removed, left): for each pair (first_id, doc_id) the lines that go, and the keys that stay."""
    side = lambda x: own.select(F.col("doc_id").alias(x), F.col("hashes").alias(f"{x}_lines"), F.col("keys").alias(f"{x}_keys"))
    both = pairs.select("first_id", "doc_id").join(side("doc_id").hint("merge"), "doc_id")
    both = both.join(side("first_id").drop("first_id_keys").hint("merge"), "first_id").select("doc_id", "doc_id_lines", "doc_id_keys", "first_id_lines")
    types = {"doc_id": pa.int64(), "removed": pa.list_(pa.int32()), "left": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in types}
            for doc_id, late, keys, early in zip(*(batch.column(k).to_pylist() for k in range(4))):
                keys = set(keys)
                gone = {q for part in blocks(patience(early, late)) if any(late[q] in keys for _, q in part) for _, q in part}
                gone |= left_over(early, late, keys, gone)
                out["doc_id"].append(doc_id)
                out["removed"].append(np.array(sorted(gone), np.int32))
                out["left"].append(list({x for q, x in enumerate(late) if q not in gone and x in keys}))
            yield common.arrow_batch(out, types)

    return common.map_arrow(both, run, "doc_id long, removed array<int>, left array<long>")


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, removed): numbers of the lines to delete, for documents that have any."""
    own = common.materialize(lines(docs), "line-hashes")
    keyed = own.select("doc_id", F.explode("keys").alias("key"))
    owners = keyed.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("holders"))
    # written, so that both sides of the join are plain exchanges and a line that many documents hold is split over tasks
    owners = common.materialize(owners.where("first_id < last_id").select("key", "first_id", "holders"), "line-owners")
    shared = common.materialize(keyed.join(owners.hint("merge"), "key").where("doc_id > first_id"), "line-shared")
    rarest = shared.groupBy("doc_id").agg(F.min(F.struct("holders", "first_id", "key")).alias("r")).select("doc_id", F.col("r.first_id").alias("first_id"))
    first = common.materialize(aligned(rarest, own), "line-first")
    rest = shared.join(first.select("doc_id", "left").hint("merge"), "doc_id").where(F.array_contains("left", F.col("key"))).select("first_id", "doc_id").distinct()
    rest = common.materialize(rest, "line-rest")
    second = aligned(rest, own)
    found = first.select("doc_id", "removed").union(second.select("doc_id", "removed")).where(F.size("removed") > 0)
    # a document has no more partners than key lines, so its lists are bounded by its own size
    out = common.materialize(found.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("removed"))).alias("removed")), "line-removed")
    common.release(own, owners, shared, first, rest)
    return out


def remove_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents with aligned repeated blocks deleted from their texts, and n_removed lines."""
    own = "removed"
    while own in docs.columns:
        own += "_"
    joined = docs.drop("n_removed").join(repeated(docs).withColumnRenamed("removed", own).hint("merge"), "doc_id", "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, k: ~F.array_contains(own, k)), "\n")
    text = F.when(F.col(own).isNull(), F.col("text")).otherwise(kept)
    count = F.when(F.col(own).isNull(), F.lit(0)).otherwise(F.size(own)).cast("long")
    return joined.withColumn("text", text).withColumn("n_removed", count).select(*[c for c in docs.columns if c != "n_removed"], "n_removed")
