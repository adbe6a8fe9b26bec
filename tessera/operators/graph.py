"""Navigable neighbour graphs over shards of rows: an approximate index that a cluster can build and search.

Rows are dealt to shards by a hash of their ids, so that a shard's graph is built and searched by one task and its
size is bounded; rows that come later make shards of their own. A walk takes nearly as long in a small shard as in a
large one, and every query walks all: so there are SHARDS at most until they hold LARGEST rows. In a shard every
row is linked with near rows that are not already reached through a nearer link (so links lead in different
directions), both ways. A search walks each shard's graph from a few entry rows, keeping the ``width`` best rows
seen, and brings the shards' best together. All queries of a block walk at once, as array operations, and each goes
on from its STEPS best open rows; walks compare in single precision where that is safe, scores are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import knn

SHARD, SHARDS, LARGEST, NEIGHBOURS, ENTRIES = 4096, 16, 32_768, 16, 8
#: Queries that walk at once; rows that each goes on from; products that are held while links are sought.
WALKERS, STEPS, CELLS = 256, 8, 2_097_152

SCHEMA = "shard long, vec_id long, u array<double>, links array<int>"


def neighbours(x: np.ndarray, count: int) -> list[np.ndarray]:
    """Links of each row: of its 3 * count nearest those nearer to it than to a link before them, and the way back."""
    n = len(x)
    out: list[list[int]] = [[] for _ in range(n)]
    step = max(1, min(knn.ROWS, CELLS // max(1, n)))
    for begin in range(0, n, step):
        score = x[begin : begin + step] @ x.T
        score[np.arange(len(score)), np.arange(begin, begin + len(score))] = -np.inf
        wide = min(n - 1, 3 * count)
        if wide < 1:
            break
        near = np.argpartition(-score, wide - 1, axis=1)[:, :wide]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(score, near, 1), axis=1, kind="stable"), 1)
        for i, own in enumerate(near):
            apart, close, kept = (x[own] @ x[own].T).tolist(), score[i, own].tolist(), []
            for k in range(len(own)):
                if len(kept) < count and all(apart[k][j] < close[k] for j in kept):
                    kept.append(k)
            for k in range(len(own)):  # equal rows hide each other: fill up with the nearest
                if len(kept) >= count // 2:
                    break
                if k not in kept:
                    kept.append(k)
            out[begin + i] = own[kept].tolist()
    back: list[list[int]] = [[] for _ in range(n)]
    for i, own in enumerate(out):
        for j in own:
            back[j].append(i)
    last: dict[bytes, int] = {}
    for i, row in enumerate(x):  # equal rows make a chain, however many they are
        j = last.get(key := row.tobytes())
        if j is not None:
            out[i].append(j)
            out[j].append(i)
        last[key] = i
    return [np.array(list(dict.fromkeys([*a, *b[: 2 * count]])), np.int32) for a, b in zip(out, back)]


def build(vectors: DataFrame, count: int = NEIGHBOURS, shard: int = SHARD, first: int = 0) -> DataFrame:
    """(shard, vec_id, u, links): links are places within the shard's rows in order of their ids; shards from ``first``.

    Cached, as every block of queries walks it. ``shard``: rows of a shard while there are SHARDS or fewer.
    """
    n = vectors.count()
    size = max(shard, min(LARGEST, -(-n // SHARDS)))
    dealt = vectors.select((F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n // size)))) + first).alias("shard"), "vec_id", "u")

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("vec_id")
        links = neighbours(knn.matrix(part.column(2)), count)
        return part.append_column("links", pa.array(links, pa.list_(pa.int32())))

    return dealt.groupBy("shard").applyInArrow(run, SCHEMA).cache()


def insert(graph: DataFrame, vectors: DataFrame, count: int = NEIGHBOURS, shard: int = SHARD) -> DataFrame:
    """The graph with more rows, as further shards; those that exist stay as they are."""
    last = graph.agg(F.max("shard")).first()[0]
    return graph.unionByName(build(vectors, count, shard, 0 if last is None else last + 1))


def walk(x: np.ndarray, links: np.ndarray, entries: np.ndarray, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores (queries, width) of the best rows met; places are -1 where fewer were."""
    entries, steps = entries[:width], min(width, STEPS)
    seen = np.full((len(q), len(x)), -1, np.int32)
    seen[:, entries] = 0
    seen = seen.ravel()
    place, score, done = np.full((len(q), width), -1), np.full((len(q), width), -np.inf, x.dtype), np.zeros((len(q), width), bool)
    place[:, : len(entries)], score[:, : len(entries)] = entries, q @ x[entries].T
    while True:
        open_ = np.where(done, -np.inf, score)
        best = np.argpartition(-open_, steps - 1, axis=1)[:, :steps]
        row, k = np.nonzero(np.take_along_axis(open_, best, 1) > -np.inf)
        if not len(row):
            return place, score
        best = best[row, k]
        done[row, best] = True
        near = links[place[row, best]]
        who, near = np.repeat(row, near.shape[1])[(linked := near.ravel() >= 0)], near.ravel()[linked]
        at = who * len(x) + near
        new = seen[at] < 0
        who, near, at = who[new], near[new], at[new]
        seen[at] = number = np.arange(len(at), dtype=np.int32)
        new = seen[at] == number  # a row that several lead to counts once
        who, near = who[new], near[new]
        fresh = np.einsum("md,md->m", x[near], q[who])
        new = fresh > score.min(1)[who]
        who, near, fresh = who[new], near[new], fresh[new]
        going, first, many = np.unique(who, return_index=True, return_counts=True)
        if not len(going):
            continue
        line, column = np.repeat(np.arange(len(going)), many), np.arange(len(who)) - np.repeat(first, many)
        wide = (len(going), int(many.max()))
        places, scores = np.full(wide, -1), np.full(wide, -np.inf, x.dtype)
        places[line, column], scores[line, column] = near, fresh
        both, at, old = np.concatenate([score[going], scores], 1), np.concatenate([place[going], places], 1), np.concatenate([done[going], np.zeros(wide, bool)], 1)
        top = np.argpartition(-both, width - 1, axis=1)[:, :width]
        score[going], place[going], done[going] = (np.take_along_axis(y, top, 1) for y in (both, at, old))


def search(graph: DataFrame, queries: DataFrame, width: int, k: int, exclude_self: bool = True) -> DataFrame:
    """(query_id, doc_id, score, rank) of the best k rows met; queries (vec_id, u) go out in blocks."""
    spark, parts = graph.sparkSession, None
    asked = queries.select("vec_id", "u").orderBy("vec_id").toLocalIterator(prefetchPartitions=True)
    for block in _blocks(asked):
        one = graph.groupBy("shard").applyInArrow(_walker(spark.sparkContext.broadcast(block), width, k, exclude_self), knn.SCHEMA)
        parts = one if parts is None else parts.union(one)
    return knn.ranked(parts if parts is not None else spark.createDataFrame([], knn.SCHEMA), k)


def _walker(shared, width: int, k: int, exclude_self: bool):
    def run(part: pa.Table) -> pa.Table:
        ids, q = shared.value
        part = part.sort_by("vec_id")
        own, x = np.asarray(part.column(1)), knn.matrix(part.column(2))
        sizes = np.asarray(pc.list_value_length(part.column(3).combine_chunks()))
        links = np.full((len(x), max(1, sizes.max(initial=1))), -1)
        links[np.arange(links.shape[1])[None, :] < sizes[:, None]] = np.asarray(part.column(3).combine_chunks().flatten())
        entries = np.unique(np.linspace(0, len(x) - 1, ENTRIES).astype(np.int64))
        best = knn.Best(len(ids), k)
        a, b, _ = knn.screens(q, x)
        for begin in range(0, len(ids), WALKERS):
            place, _ = walk(b, links, entries, a[begin : begin + WALKERS], max(width, k + 1))
            r, c = np.nonzero(place >= 0)
            at = place[r, c]
            if exclude_self:
                other = ids[begin + r] != own[at]
                r, at = r[other], at[other]
            best.add(begin + r, own[at], knn.exact(q, x, begin + r, at))
        return pa.Table.from_pydict(knn.found(best, ids))

    return run


def _blocks(asked: Iterator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    from itertools import islice

    while block := list(islice(asked, knn.QUERY_BLOCK)):
        yield np.array([r[0] for r in block], np.int64), np.array([r[1] for r in block])


def two_stage(graph: DataFrame, signatures: DataFrame, vectors: DataFrame, queries: DataFrame, width: int, pool: int, k: int) -> DataFrame:
    """The pool that a walk over the signatures' graph finds, ranked by the vectors themselves."""
    ids = queries.select("vec_id")
    asked = signatures.join(ids, "vec_id", "left_semi").select("vec_id", F.col("sig").alias("u"))
    first = search(graph, asked, width, pool).select("query_id", "doc_id")
    return knn.ranked(knn.rescore(first, vectors, vectors.join(ids, "vec_id", "left_semi")), k)
