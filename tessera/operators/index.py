"""A vector index as tables: fit, insert with frozen anchors, search, save, load, generations."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import anchors as A
from tessera.operators import ann, drift, knn, models, studies
from tessera.operators import signatures as S

Factory = Callable[[], models.Embedder]


@dataclass(frozen=True)
class Settings:
    anchor_count: int = 256
    transform: str = "row_zscore"
    seed: int = 7
    #: Cells of the inverted lists over signatures and over vectors; none without them. Cells that a query probes.
    cells: int = 0
    probes: int = 8


class VectorIndex:
    """vectors (vec_id, u), anchors (anchor_pos, vec_id, u), sigs (vec_id, sig); centres (space, cell, c) with cells."""

    def __init__(self, settings: Settings, anchors: DataFrame, vectors: DataFrame, sigs: DataFrame, weights: list[float] | None = None, centres: DataFrame | None = None, embedder: Factory | None = None):
        self.settings, self.anchors, self.vectors, self.sigs, self.weights = settings, anchors, vectors, sigs, weights
        self.centres, self.embedder = centres, embedder

    # ------------------------------------------------------------ fit and insert
    @classmethod
    def fit(cls, df: DataFrame, settings: Settings = Settings(), anchors: DataFrame | None = None, weights: list[float] | None = None, embedder: Factory | None = None) -> VectorIndex:
        """From (vec_id, embedding); farthest-point anchors unless (anchor_pos, vec_id) are given."""
        if settings.transform not in S.ROW:
            raise ValueError(f"unknown transform: {settings.transform}")
        vectors = knn.unit(df)
        picked = A.with_vectors(anchors if anchors is not None else A.farthest(vectors, settings.anchor_count, settings.seed), vectors).cache()
        if weights is not None and len(weights) != picked.count():
            raise ValueError("one weight per anchor")
        index = cls(settings, picked, vectors, None, weights, None, embedder)
        index.sigs = index.signatures(vectors)
        if settings.cells:
            spaces = (("sig", _as_vectors(index.sigs)), ("raw", vectors))
            index.centres = studies.together(ann.ivf_build(rows, settings.cells, settings.seed)[1].withColumn("space", F.lit(space)) for space, rows in spaces).cache()
        return index

    @classmethod
    def fit_texts(cls, texts: DataFrame, embedder: Factory, settings: Settings = Settings(), id_col: str = "doc_id") -> VectorIndex:
        """From (id, text), embedded once and cached by Spark; queries and inserts may then be texts too."""
        return cls.fit(models.embed(texts, embedder, id_col).cache(), settings, embedder=embedder)

    def signatures(self, vectors: DataFrame) -> DataFrame:
        sigs = S.signatures(vectors, self.anchors)
        if self.weights is not None:
            sigs = sigs.withColumn("sig", V.weighted(F.col("sig"), F.array(*map(F.lit, self.weights))))
        return S.transform(sigs, self.settings.transform)

    def insert(self, df: DataFrame, check_ids: bool = True) -> VectorIndex:
        """With more rows; anchors, centres and the signatures that exist stay as they are."""
        new = knn.unit(df)
        if check_ids and new.join(self.vectors.select("vec_id"), "vec_id", "left_semi").limit(1).count():
            raise ValueError("ids exist already")
        return VectorIndex(self.settings, self.anchors, self.vectors.unionByName(new), self.sigs.unionByName(self.signatures(new)), self.weights, self.centres, self.embedder)

    def insert_texts(self, texts: DataFrame, id_col: str = "doc_id", check_ids: bool = True) -> VectorIndex:
        return self.insert(self._embedded(texts, id_col).cache(), check_ids)

    def _embedded(self, texts: DataFrame, id_col: str) -> DataFrame:
        if self.embedder is None:
            raise ValueError("the index has no embedder")
        return models.embed(texts, self.embedder, id_col)

    # ------------------------------------------------------------ search
    def _reranked(self, first: DataFrame, q: DataFrame, k: int) -> DataFrame:
        return knn.ranked(knn.rescore(first.select("query_id", "doc_id", F.col("score").alias("relative_score")), self.vectors, q), k)

    def search(self, queries: DataFrame, k: int = 10, pool: int = 250) -> DataFrame:
        """Two-stage search for (vec_id, embedding) queries, which need not be in the index."""
        q = knn.unit(queries)
        return self._reranked(knn.top_k(self.sigs, self.signatures(q), pool, exclude_self=False, vec="sig"), q, k)

    def search_text(self, texts: DataFrame, k: int = 10, pool: int = 250, id_col: str = "doc_id") -> DataFrame:
        """The same for (id, text) queries."""
        return self.search(self._embedded(texts, id_col), k, pool)

    def search_ann(self, queries: DataFrame, k: int = 10, pool: int = 250) -> DataFrame:
        """Two-stage search whose candidates are the best of the signature cells nearest each query."""
        q = knn.unit(queries)
        return self._reranked(self._probe("sig", _as_vectors(self.sigs), _as_vectors(self.signatures(q)), pool), q, k)

    def search_raw_ann(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return self._probe("raw", self.vectors, knn.unit(queries), k)

    def _probe(self, space: str, rows: DataFrame, q: DataFrame, k: int) -> DataFrame:
        if self.centres is None:
            raise ValueError("the index has no cells")
        centres = self.centres.where(F.col("space") == space)
        return ann.cell_search(ann.assign(rows, centres).cache(), centres, q, self.settings.probes, k, exclude_self=False)

    def search_relative(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return knn.top_k(self.sigs, self.signatures(knn.unit(queries)), k, exclude_self=False, vec="sig")

    def search_raw(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return knn.top_k(self.vectors, knn.unit(queries), k, exclude_self=False)

    # ------------------------------------------------------------ state
    def drift(self, df: DataFrame) -> DataFrame:
        return drift.statistics(S.signatures(knn.unit(df), self.anchors))

    def memory(self) -> dict[str, float]:
        return drift.memory(self.vectors.count(), len(self.vectors.first()["u"]), self.anchors.count())

    def save(self, path: str) -> None:
        for name in TABLES if self.centres is not None else TABLES[:3]:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        meta = json.dumps({**asdict(self.settings), "weights": self.weights})
        self.vectors.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str, embedder: Factory | None = None) -> VectorIndex:
        meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        weights = meta.pop("weights")
        settings = Settings(**meta)
        tables = {n: spark.read.parquet(f"{path}/{n}") for n in (TABLES if settings.cells else TABLES[:3])}
        return cls(settings, tables["anchors"], tables["vectors"], tables["sigs"], weights, tables.get("centres"), embedder)


TABLES = ("anchors", "vectors", "sigs", "centres")


def _as_vectors(sigs: DataFrame) -> DataFrame:
    return sigs.select("vec_id", F.col("sig").alias("u"))


def latency(search: Callable[[], DataFrame], queries: int, rounds: int = 3) -> dict[str, float]:
    """Milliseconds a query of a search that is run to its end ``rounds`` times, after once to warm up."""
    took = []
    for _ in range(rounds + 1):
        begin = time.perf_counter()
        search().write.format("noop").mode("overwrite").save()
        took.append(1000 * (time.perf_counter() - begin) / max(1, queries))
    return {"ms_per_query": min(took[1:]), "ms_per_query_mean": sum(took[1:]) / rounds}


def search_generations(generations: list[VectorIndex], queries: DataFrame, k: int = 10, pool: int = 250) -> DataFrame:
    """Each generation's best k, merged: a document once, with its best score."""
    both = None
    for g in generations:
        part = g.search(queries, k, pool).select("query_id", "doc_id", "score")
        both = part if both is None else both.unionByName(part)
    return knn.merge_generations(both, k)
