"""TF-IDF weights, lexical search, hybrid candidates and the deterministic reranker."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import knn

#: Weights in the dense matrix of a block of queries; folds of the terms; terms that are dealt to folds by what they share.
QUERY_CELLS, FOLDS, DEALT = 8_000_000, 1280, 4096
#: Weights that are gathered at once when pairs are scored; lengths in the matrix of a tile of documents.
GATHERED, ROW_CELLS = 100_000, 2_000_000
#: Texts that are counted before their rows go on.
TEXTS = 256
TOKEN = re.compile(T.TOKEN)
CODED = "doc_id long, at binary, w binary"


def counts(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, term, tf). A text is counted by itself, so no task holds more than a batch; only rows of an id that occurs twice are grouped."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, TEXTS):
                part = batch.slice(begin, TEXTS)
                each = [_tokens(x) for x in part.column(1).to_pylist()]
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(each)), [len(c) for c in each])))
                terms, tf = ([x for c in each for x in f(c)] for f in (dict.keys, dict.values))
                yield pa.RecordBatch.from_arrays([ids, pa.array(terms, pa.string()), pa.array(tf, pa.int64())], names=["doc_id", "term", "tf"])

    rows = own.where("text IS NOT NULL").mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, term string, tf long")
    return rows if _unique(own) else rows.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))


def _tokens(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for x, n in Counter(TOKEN.findall(text)).items():
        x = x.lower()
        out[x] = out.get(x, 0) + n
    return out


def _unique(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").limit(1).count()


def frequencies(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(term, df, total): documents that hold a term, and how often it occurs."""
    return counts(docs, id_col).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))


def vocabulary(docs: DataFrame, max_features: int, min_df: int, id_col: str = "doc_id", tf: DataFrame | None = None) -> DataFrame:
    """(term, idf) of the ``max_features`` most frequent terms with df of ``min_df`` or more; ``tf``: counts made before."""
    n = docs.count()
    own = tf if tf is not None else counts(docs, id_col)
    df = own.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    some = df.where(F.col("df") >= min_df).orderBy(F.desc("total"), "term").limit(max_features)
    return some.select("term", (F.ln((1 + F.lit(float(n))) / (1 + F.col("df"))) + 1).alias("idf"))


def weights(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", tf: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, w): tf * idf over the document's norm."""
    raw = (tf if tf is not None else counts(docs, id_col)).join(terms, "term").withColumn("x", F.col("tf") * F.col("idf"))
    norm = F.greatest(F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("doc_id"))), F.lit(V.EPS))
    return raw.select("doc_id", "term", (F.col("x") / norm).alias("w"))


def fitted_weights(docs: DataFrame, max_features: int, min_df: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, term, w) by a vocabulary of the documents themselves."""
    return weights(docs, vocabulary(docs, max_features, min_df, id_col), id_col)


def fitted_rows(docs: DataFrame, max_features: int, min_df: int, id_col: str = "doc_id") -> tuple[DataFrame, int]:
    """The same as one coded row per document (doc_id, at, w), cached by Spark, and the number of terms.

    The vocabulary goes to every task, where a text is counted and weighed by itself; nothing is shuffled.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    if not _unique(own):
        long = fitted_weights(docs, max_features, min_df, id_col)
        numbers = coded_terms(long)
        return coded(long, numbers), numbers.count()
    got = vocabulary(docs, max_features, min_df, id_col).collect()  # max_features at most
    shared = docs.sparkSession.sparkContext.broadcast(({r["term"]: k for k, r in enumerate(got)}, np.array([r["idf"] for r in got])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, idf = shared.value
        for batch in batches:
            for begin in range(0, batch.num_rows, TEXTS):
                ids, ats, ws = [], [], []
                for i, text in zip(*(c.to_pylist() for c in batch.slice(begin, TEXTS).columns)):
                    known = sorted((place[t], n) for t, n in _tokens(text).items() if t in place)
                    if known:
                        at, n = np.array(known).T
                        x = n * idf[at]
                        ids.append(i)
                        ats.append(at.astype(np.int32).tobytes())
                        ws.append((x / max(np.sqrt((x * x).sum()), V.EPS)).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ats, pa.binary()), pa.array(ws, pa.binary())], names=["doc_id", "at", "w"])

    return own.mapInArrow(run, CODED).cache(), len(got)


def coded_terms(terms: DataFrame) -> DataFrame:
    """(term, p): the distinct terms, numbered from 0; the vocabulary reaches the driver."""
    every = terms.select("term").distinct().orderBy("term").toArrow().column(0).to_pylist()
    return terms.sparkSession.createDataFrame(list(zip(every, range(len(every)))), "term string, p int")


def coded(doc_weights: DataFrame, numbers: DataFrame) -> DataFrame:
    """(doc_id, at, w) of weights (doc_id, term, w): a document's numbers of terms and weights as bytes; cached by Spark."""
    rows = doc_weights.join(numbers, "term").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("p", "w"))).alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, w = (pa.array([np.array(x, kind).tobytes() for x in batch.column(k).to_pylist()], pa.binary()) for k, kind in ((1, np.int32), (2, np.float64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), at, w], names=["doc_id", "at", "w"])

    return rows.select("doc_id", F.col("r.p").alias("at"), F.col("r.w").alias("w")).mapInArrow(run, CODED).cache()


def search(doc_weights: DataFrame, query_weights: DataFrame, k: int) -> DataFrame:
    """Best k documents per query by the cosine of their term weights (doc_id, term, w), the query itself excluded.

    Documents that share no term with a query are not found.
    """
    numbers = coded_terms(doc_weights.select("term").unionByName(query_weights.select("term")))
    width = numbers.count()
    return search_rows(coded(doc_weights, numbers), coded(query_weights, numbers), width, k)


def search_rows(rows: DataFrame, asked: DataFrame, width: int, k: int) -> DataFrame:
    """The same for coded rows (doc_id, at, w) of ``width`` terms.

    Queries are a stated set: blocks of QUERY_CELLS / width of them go to every task, which keeps its own top k of
    the documents it scans; there is no join on terms, and what is shuffled is tasks * queries * k rows.

    Terms are dealt to FOLDS folds. A text's part in a fold counts by its length, so the product of two texts' lengths,
    fold by fold, is at least their score (Cauchy and Schwarz), and is that of the terms themselves where every fold
    has one. Only pairs whose product reaches the query's k-th best so far are scored, by the weights themselves.
    """
    spark, parts, fold = rows.sparkSession, None, None
    found = asked.orderBy("doc_id").toLocalIterator(prefetchPartitions=True)
    while block := list(islice(found, max(1, QUERY_CELLS // max(1, width)))):
        ids = np.array([r["doc_id"] for r in block], np.int64)
        at, w = (np.frombuffer(b"".join(r[c] for r in block), kind) for c, kind in (("at", np.int32), ("w", np.float64)))
        size = np.array([len(r["at"]) // 4 for r in block])
        if fold is None:
            fold = folds(size, at, w, width)
        shared = spark.sparkContext.broadcast((ids, size, at, w, fold))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, size, at, w, fold = shared.value
            best, q = knn.Best(len(ids), k), np.zeros((len(ids), width))
            q[np.repeat(np.arange(len(ids)), size), at] = w
            short, step = lengths(size, at, w, fold), max(1, ROW_CELLS // max(1, min(width, FOLDS)))
            for batch in batches:
                for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                    own = np.asarray(part.column(0))
                    x = [np.frombuffer(b"".join(part.column(c).to_pylist()), kind) for c, kind in ((1, np.int32), (2, np.float64))]
                    many = np.array([len(b) // 4 for b in part.column(1).to_pylist()])
                    _nearest(best, ids, q, short, own, many, *x, fold)
            yield pa.RecordBatch.from_pydict(knn.found(best, ids))

        one = rows.mapInArrow(run, knn.SCHEMA)
        parts = one if parts is None else parts.union(one)
    return knn.ranked(parts if parts is not None else spark.createDataFrame([], knn.SCHEMA), k)


def folds(size: np.ndarray, at: np.ndarray, w: np.ndarray, width: int) -> np.ndarray:
    """The fold of each term: the heaviest have their own while there are some, each further one goes where it is least met by these texts."""
    if width <= FOLDS:
        return np.arange(width)
    order = np.argsort(-np.bincount(at, w * w, width), kind="stable")
    fold = np.empty(width, np.int64)
    fold[order] = np.arange(width) % FOLDS
    some = np.sort(order[:DEALT])
    place = np.full(width, -1)
    place[some] = np.arange(len(some))
    row, known = np.repeat(np.arange(len(size)), size), place[at] >= 0
    x = np.zeros((len(size), len(some)), np.float32)
    x[row[known], place[at[known]]] = w[known]
    met = x.T @ x
    cost = np.zeros((len(some), FOLDS), np.float32)
    for k, t in enumerate(order[:DEALT]):
        fold[t] = f = k if k < FOLDS else int(cost[place[t]].argmin())
        cost[:, f] += met[:, place[t]]
    return fold


def lengths(size: np.ndarray, at: np.ndarray, w: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """(texts, folds): the length of each text's part in each fold."""
    n = int(fold.max(initial=0)) + 1
    return np.sqrt(np.bincount(np.repeat(np.arange(len(size)) * n, size) + fold[at], w * w, len(size) * n)).reshape(len(size), n).astype(np.float32)


def _nearest(best: knn.Best, ids: np.ndarray, q: np.ndarray, short: np.ndarray, own: np.ndarray, many: np.ndarray, at: np.ndarray, w: np.ndarray, fold: np.ndarray) -> None:
    """Shows ``best`` the documents (own, and their weights) for the queries (ids, their dense weights, their lengths by fold)."""
    x = lengths(many, at, w, fold)
    ends = np.cumsum(many)
    top = float(np.sqrt(np.einsum("ij,ij->i", short, short).max(initial=0.0)) * np.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0.0)))
    slack = 1e-9 + 8 * (x.shape[1] + 4) * 2.0**-24 * top

    def show(r: np.ndarray, c: np.ndarray) -> None:
        score = products(q, ends, many, at, w, r, c)
        some = (score > 0) & (score >= best.least[r])
        best.add(r[some], own[c[some]], score[some])

    for i in range(0, len(ids), knn.ROWS):
        bound = short[i : i + knn.ROWS] @ x.T
        knn.drop_self(bound, ids[i : i + knn.ROWS], own)
        fresh = np.flatnonzero(best.least[i : i + knn.ROWS] == -np.inf)
        if len(fresh) and bound.shape[1] > 2 * best.k:  # what has the largest bounds first, for a score to compare with
            c = np.argpartition(-bound[fresh], 2 * best.k - 1, axis=1)[:, : 2 * best.k].ravel()
            r = np.repeat(fresh, 2 * best.k)
            c, r = c[(held := bound[r, c] > 0)], r[held]
            bound[r, c] = -np.inf
            show(r + i, c)
            best.settle(i // knn.ROWS)
        cut = np.maximum(best.least[i : i + knn.ROWS] - slack, np.finfo(np.float32).tiny).astype(np.float32)
        r, c = np.divmod(np.flatnonzero(bound >= cut[:, None]), bound.shape[1])
        show(r + i, c)


def products(q: np.ndarray, ends: np.ndarray, many: np.ndarray, at: np.ndarray, w: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Scores of the pairs of query r and document c, to 9 digits; a document's weights end at ``ends``."""
    out, flat, width = np.zeros(len(r)), q.ravel(), q.shape[1]
    total = np.cumsum(many[c])
    begin = 0
    while begin < len(r):
        before = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + GATHERED)))
        n = many[c[begin:end]]
        first = np.cumsum(n) - n
        here = np.arange(n.sum()) + np.repeat(ends[c[begin:end]] - n - first, n)
        out[begin:end] = np.add.reduceat(flat[at[here] + np.repeat(r[begin:end] * width, n)] * w[here], first)
        begin = end
    return np.round(out, 9)


def hybrid(lexical: DataFrame, dense: DataFrame, ids: DataFrame, size: int, each: int) -> DataFrame:
    """(query_id, rank, doc_id): lexical ones in rank order, then unseen dense ones, then the smallest unused ids."""
    rows = lexical.where(F.col("rank") <= each).select("query_id", "doc_id", F.lit(0).alias("part"), "rank")
    rows = rows.union(dense.where(F.col("rank") <= each).select("query_id", "doc_id", F.lit(1).alias("part"), "rank"))
    fill = ids.orderBy("doc_id").limit(size + 2 * each + 1)  # enough whatever is used already
    asked = dense.select("query_id").union(lexical.select("query_id")).distinct()
    rows = rows.union(asked.join(F.broadcast(fill)).where("query_id <> doc_id").select("query_id", "doc_id", F.lit(2).alias("part"), F.col("doc_id").alias("rank")))
    first = rows.groupBy("query_id", "doc_id").agg(F.min(F.struct("part", "rank")).alias("at"))
    w = Window.partitionBy("query_id").orderBy("at", "doc_id")
    return first.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= size).select("query_id", "rank", "doc_id")


def blend(candidates: DataFrame, vectors: DataFrame, docs: DataFrame, k: int, token_weight: float = 0.35) -> DataFrame:
    """Rerank by (1 - w) * cosine + w * Jaccard of the token sets."""
    both = knn.rescore(candidates, vectors, vectors)
    tokens = docs.select("doc_id", T.token_set(F.col("text")).alias("td"))
    both = both.join(tokens, "doc_id").join(tokens.select(F.col("doc_id").alias("query_id"), F.col("td").alias("tq")), "query_id")
    score = (1 - token_weight) * F.col("score") + token_weight * T.jaccard(F.col("tq"), F.col("td"))
    return knn.rerank(both, score, k).select("query_id", "rank", "doc_id", "score")
