"""Anchor-relative signatures and their transforms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators.knn import matrix

#: Transforms of a row by itself.
ROW: dict[str, Callable[[Column], Column]] = {
    "raw": lambda s: s,
    "raw_l2": V.l2_normalize,
    "row_zscore": V.row_zscore,
    "rank": V.rank_transform,
    "softmax_0.1": lambda s: V.softmax(s, 0.1),
    "top8": lambda s: V.keep_largest(s, 8),
    "binary_top8": lambda s: V.keep_largest(s, 8, binary=True),
}
#: Transforms by statistics of each anchor's column.
COLUMN = ("centered", "zscore", "col_zscore", "row_col_zscore", "sign_centered")


def anchor_matrix(anchors: DataFrame) -> np.ndarray:
    """Anchors (anchor_pos, u) in their order; a bounded set."""
    return matrix(anchors.orderBy("anchor_pos").select("u").toArrow().column(0))


def project(df: DataFrame, weights: np.ndarray, source: str, target: str, normalize: bool = False) -> DataFrame:
    """(vec_id, target): ``source @ weights`` in blocks of rows."""
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1)) @ w
            if normalize:
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), V.EPS)
            offsets = pa.array(np.arange(0, x.size + 1, max(1, x.shape[1])), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=["vec_id", target])

    return df.where(F.col(source).isNotNull()).select("vec_id", source).mapInArrow(run, f"vec_id long, {target} array<double>")


def signatures(vectors: DataFrame, anchors: DataFrame) -> DataFrame:
    """(vec_id, sig): cosine to every anchor, in anchor order."""
    return project(vectors, anchor_matrix(anchors).T, "u", "sig")


def column_stats(sigs: DataFrame) -> tuple[list[float], list[float]]:
    """Mean and population deviation (floored) of each anchor's column."""
    rows = sigs.select(F.posexplode("sig").alias("p", "x")).groupBy("p").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("p").collect()
    return [r["m"] for r in rows], [max(r["s"], V.STD_FLOOR) for r in rows]


def transform(sigs: DataFrame, kind: str, train: Column | None = None) -> DataFrame:
    """(vec_id, sig) transformed; ``train`` limits the rows that col_zscore learns its columns from."""
    if kind in ROW:
        return sigs.withColumn("sig", ROW[kind](F.col("sig")))
    if kind not in COLUMN:
        raise ValueError(f"unknown transform: {kind}")
    if kind == "row_col_zscore":
        return transform(transform(sigs, "row_zscore"), "col_zscore", train)
    learned = sigs.where(train) if train is not None and kind == "col_zscore" else sigs
    m, s = (F.array(*map(F.lit, x)) for x in column_stats(learned))
    sig = F.zip_with("sig", m, lambda x, y: x - y)
    if kind == "sign_centered":
        sig = F.transform(sig, lambda x: F.when(x > 0, 1.0).otherwise(0.0))
    elif kind != "centered":
        sig = F.zip_with(sig, s, lambda x, y: x / y)
    return sigs.withColumn("sig", V.l2_normalize(sig))


def weighted(sigs: DataFrame, weights: list[float], after: bool = False) -> DataFrame:
    """Anchor weights before or after the row standard score."""
    w = F.array(*map(F.lit, weights))
    sig = V.l2_normalize(V.weighted(V.row_zscore(F.col("sig")), w)) if after else V.row_zscore(V.weighted(F.col("sig"), w))
    return sigs.withColumn("sig", sig)


def long_form(sigs: DataFrame) -> DataFrame:
    """(vec_id, anchor_pos, value), rounded."""
    return sigs.select("vec_id", F.posexplode("sig").alias("anchor_pos", "value")).select("vec_id", F.col("anchor_pos").cast("long").alias("anchor_pos"), V.rounded(F.col("value")).alias("value"))
