"""Anchor selection. Every strategy returns (anchor_pos, vec_id) in selection order.

Samples are ordered by md5(seed:id), so they are the same in every engine. Every strategy covers all
rows; only anchors, and pools of a fixed size, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import knn

SEED = 7
#: Rows that a pass of farthest-point selection brings to the driver.
POOL = 2048


def shuffle_key(seed: int = SEED, id_col: str = "vec_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """A bounded frame's rows with their place in the given order."""
    return df.withColumn("anchor_pos", F.row_number().over(Window.orderBy(*order)).cast("long") - 1).select("anchor_pos", "vec_id")


def random(vectors: DataFrame, count: int, seed: int = SEED) -> DataFrame:
    """The first ``count`` of the shuffled ids; a smaller count is a prefix of a larger one."""
    return numbered(vectors.select("vec_id").orderBy(shuffle_key(seed), "vec_id").limit(count), shuffle_key(seed), F.col("vec_id"))


def stratified(labelled: DataFrame, count: int, seed: int = SEED) -> DataFrame:
    """``count // strata`` of each stratum, then others until ``count``, in shuffled order."""
    strata = labelled.select("stratum").distinct().count()
    each = max(1, count // max(1, strata))
    w = Window.partitionBy("stratum").orderBy(shuffle_key(seed), "vec_id")
    rows = labelled.withColumn("late", (F.row_number().over(w) > each).cast("int")).orderBy("late", shuffle_key(seed), "vec_id").limit(count)
    return numbered(rows, F.col("late"), shuffle_key(seed), F.col("vec_id"))


def _frame(spark: SparkSession, ids) -> DataFrame:
    return spark.createDataFrame([(k, int(i)) for k, i in enumerate(ids)], "anchor_pos long, vec_id long")


def _least_near(vectors: DataFrame, chosen: np.ndarray, pool: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all rows, the ``pool`` least similar to their nearest anchor (then smallest ids): that similarity, ids, vectors."""
    shared = vectors.sparkSession.sparkContext.broadcast(chosen)  # the anchors so far
    schema = "near double, vec_id long, u array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, ids, rows = np.zeros(0), np.zeros(0, np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = knn.matrix(batch.column(1))
            top = np.full(len(x), -np.inf)
            for k in range(0, len(shared.value), knn.ROWS):
                top = np.maximum(top, (x @ shared.value[k : k + knn.ROWS].T).max(1))
            near, ids = np.concatenate([near, np.round(top, knn.SCORE_DIGITS)]), np.concatenate([ids, np.asarray(batch.column(0))])
            rows = x if rows is None else np.concatenate([rows, x])
            keep = np.lexsort((ids, near))[:pool]
            near, ids, rows = near[keep], ids[keep], rows[keep]
        if rows is not None:
            yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(ids), pa.array(list(rows), pa.list_(pa.float64()))], names=["near", "vec_id", "u"])

    got = vectors.select("vec_id", "u").mapInArrow(run, schema).orderBy("near", "vec_id").limit(pool).toArrow()
    return np.asarray(got.column(0)), np.asarray(got.column(1)), knn.matrix(got.column(2))


def _first(vectors: DataFrame, seed: int, start: str) -> tuple[int, np.ndarray] | None:
    """The id and vector that selection begins with."""
    if start == "centroid":
        sums = vectors.select(F.posexplode("u").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("x")).orderBy("d").collect()  # one row per dimension
        mean = np.array([r["x"] for r in sums])
        centre = vectors.sparkSession.createDataFrame([(-1, (mean / max(np.linalg.norm(mean), V.EPS)).tolist())], "vec_id long, u array<double>")
        best = knn.top_k(vectors, centre, 1, exclude_self=False).join(vectors.withColumnRenamed("vec_id", "doc_id"), "doc_id") if len(mean) else vectors.withColumn("doc_id", F.col("vec_id")).limit(0)
        row = best.select("doc_id", "u").first()
    else:
        row = vectors.orderBy(shuffle_key(seed), "vec_id").select("vec_id", "u").first()
    return (row[0], np.array(row[1])) if row else None


def farthest(vectors: DataFrame, count: int, seed: int = SEED, start: str = "random", pool: int = POOL) -> DataFrame:
    """Farthest-point selection: each next anchor is least similar to its nearest anchor so far.

    It begins with the first of the shuffled ids, or with the vector nearest the centroid; ties go
    to the smallest id. A pass over all rows brings the ``pool`` least similar ones to the driver. As
    similarities to the nearest anchor only grow, the next anchor is among them while their least one is
    below what the rows left behind had; then another pass is due. So the result is that of a pass per
    anchor, whatever ``pool`` is.
    """
    begin = _first(vectors, seed, start)
    if begin is None:
        return _frame(vectors.sparkSession, [])
    ids, chosen = [begin[0]], [begin[1]]
    while len(ids) < count:
        near, own, x = _least_near(vectors.where(~F.col("vec_id").isin(ids)), np.array(chosen), pool)
        if not len(own):
            break
        bound = (near[-1], own[-1]) if len(own) == pool else (np.inf, 0)
        order = np.argsort(own)
        near, own, x = near[order], own[order], x[order]
        while len(ids) < count and np.isfinite(near).any():
            k = int(near.argmin())
            if (near[k], own[k]) > bound:
                break
            ids.append(int(own[k]))
            chosen.append(x[k])
            near = np.maximum(near, np.round(x @ x[k], knn.SCORE_DIGITS))
            near[k] = np.inf
    return _frame(vectors.sparkSession, ids)


def density(vectors: DataFrame, count: int, mode: str, k: int = 20, seed: int = SEED) -> DataFrame:
    """By mean cosine distance to the k nearest of all rows: ``dense`` smallest first, ``sparse`` largest, or half and half."""
    near = knn.top_k(vectors, vectors, k).groupBy(F.col("query_id").alias("vec_id")).agg(F.round(F.avg(1 - F.col("score")), 9).alias("d"))
    dense = lambda n: numbered(near.orderBy("d", "vec_id").limit(n), F.col("d"), F.col("vec_id"))
    sparse = lambda n: numbered(near.orderBy(F.desc("d"), "vec_id").limit(n), F.desc("d"), F.col("vec_id"))
    if mode == "mixed":
        half = count // 2
        return unique_fill([dense(half), sparse(count - half)], vectors, count, seed)
    return dense(count) if mode == "dense" else sparse(count)


def unique_fill(parts: list[DataFrame], vectors: DataFrame, count: int, seed: int = SEED) -> DataFrame:
    """The parts' ids in order without repeats, filled up with shuffled ids to ``count``."""
    fill = random(vectors, count + sum(p.count() for p in parts), seed)
    both = None
    for k, p in enumerate([*parts, fill]):
        p = p.withColumn("part", F.lit(k))
        both = p if both is None else both.unionByName(p)
    first = both.groupBy("vec_id").agg(F.min(F.struct("part", "anchor_pos")).alias("at")).orderBy("at").limit(count)
    return numbered(first, F.col("at"))


def hard_negative(vectors: DataFrame, base: DataFrame, queries: DataFrame, truth: DataFrame, found: DataFrame, count: int, seed: int = SEED) -> DataFrame:
    """Base anchors, then documents most often missed in ``found`` by truth, then the queries that missed.

    Mining queries should not be those an evaluation uses later.
    """
    missed = truth.select("query_id", "doc_id").join(found.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    docs = missed.groupBy(F.col("doc_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("n"))
    docs = numbered(docs.orderBy(F.desc("n"), "vec_id").limit(count), F.desc("n"), F.col("vec_id"))
    asked = missed.select(F.col("query_id").alias("vec_id")).distinct()
    return unique_fill([base, docs, numbered(asked.orderBy("vec_id").limit(count), F.col("vec_id"))], vectors, count, seed)


def _kmeans(vectors: DataFrame, k: int, seed: int):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select("vec_id", "u", array_to_vector("u").alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=20).fit(rows)
    centres = np.array(model.clusterCenters())
    centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), V.EPS)
    return model.transform(rows).select("vec_id", "u", F.col("prediction").alias("cluster")), centres


def kmeans(vectors: DataFrame, count: int, boundary: bool = False, seed: int = SEED) -> DataFrame:
    """Per k-means cluster the member nearest its normalised centre, or the farthest (``boundary``)."""
    rows, centres = _kmeans(vectors, count, seed)
    c = rows.sparkSession.createDataFrame([(k, list(map(float, x))) for k, x in enumerate(centres)], "cluster int, c array<double>")
    near = rows.join(F.broadcast(c), "cluster").withColumn("s", V.dot(F.col("u"), F.col("c")))
    best = near.groupBy("cluster").agg(F.min(F.struct(F.col("s") if boundary else -F.col("s"), "vec_id"))["vec_id"].alias("vec_id"))  # no row is shuffled
    return unique_fill([numbered(best, F.col("cluster"))], vectors, count, seed)


def stratified_kmeans(labelled: DataFrame, count: int, seed: int = SEED) -> DataFrame:
    """k-means medoids per stratum, in number by its share of the rows (one at least)."""
    sizes = {r["stratum"]: r["count"] for r in labelled.groupBy("stratum").count().orderBy("stratum").collect()}
    n, parts = sum(sizes.values()), []
    for stratum, size in sizes.items():
        k = min(size, max(1, round(count * size / n)))
        own = labelled.where(F.col("stratum") == stratum)
        parts.append(kmeans(own, k, seed=seed) if k > 1 else random(own, 1, seed))
    return unique_fill(parts, labelled, count, seed)


def pca_extremes(vectors: DataFrame, count: int, components: int = 32, seed: int = SEED) -> DataFrame:
    """The lowest and the highest row of each principal component."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select("vec_id", array_to_vector("u").alias("features"))
    width = len(vectors.select("u").first()[0])
    k = min(components, width, max(1, count // 2))
    scores = PCA(k=k, inputCol="features", outputCol="p").fit(rows).transform(rows).select("vec_id", F.posexplode(vector_to_array("p")).alias("c", "x"))
    ends = scores.groupBy("c").agg(F.min_by("vec_id", F.struct("x", "vec_id")).alias("lo"), F.max_by("vec_id", F.struct("x", "vec_id")).alias("hi"))
    both = ends.select("c", F.posexplode(F.array("lo", "hi")).alias("e", "vec_id")).groupBy("vec_id").agg(F.min(F.struct("c", "e")).alias("at"))
    return unique_fill([numbered(both.orderBy("at").limit(count), F.col("at"))], vectors, count, seed)


def candidates(vectors: DataFrame, most: int, seed: int = SEED) -> DataFrame:
    """At most ``most`` rows, the first by md5(seed:id), for strategies that are to work on a sample."""
    return vectors.orderBy(shuffle_key(seed), "vec_id").limit(most)


def multi_scale(vectors: DataFrame, count: int, seed: int = SEED) -> DataFrame:
    """k-means medoids for a quarter (16 at least), then farthest points from the centroid."""
    return unique_fill([kmeans(vectors, min(count, max(16, count // 4)), seed=seed), farthest(vectors, count, seed, "centroid")], vectors, count, seed)


def heaviest(bank: DataFrame, weights: list[float], count: int) -> DataFrame:
    """The anchors of a bank with the largest learned weights."""
    w = bank.sparkSession.createDataFrame(list(enumerate(map(float, weights))), "anchor_pos long, w double")
    return numbered(bank.join(F.broadcast(w), "anchor_pos").orderBy(F.desc("w"), "anchor_pos").limit(count), F.desc("w"), F.col("anchor_pos"))


def prefix(bank: DataFrame, count: int) -> DataFrame:
    return bank.where(F.col("anchor_pos") < count)


def with_vectors(anchors: DataFrame, vectors: DataFrame) -> DataFrame:
    """(anchor_pos, vec_id, u)."""
    return anchors.join(vectors, "vec_id").select("anchor_pos", "vec_id", "u")
