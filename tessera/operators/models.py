"""Plug-in points for models: embedders and rerankers.

An embedder maps a list of texts to a matrix; it is built once per worker by a factory. The hashing
embedder needs no model files, so pipelines and tests can run without any.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import knn

Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(width: int = 64) -> Embedder:
    """Signed feature hashing of words, unit length."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), width), np.float32)
        for k, text in enumerate(texts):
            for w in re.findall(r"\w+", text.lower()):
                h = zlib.crc32(w.encode())
                out[k, h % width] += 1 if h >> 16 & 1 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def embed(df: DataFrame, factory: Callable[[], Embedder], id_col: str = "doc_id", prefix: str = "", batch: int = 32) -> DataFrame:
    """(vec_id, embedding) of column text; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for part in batches:
            texts = [prefix + (t or "") for t in part.column(1).to_pylist()]
            rows = [x for k in range(0, len(texts), batch) for x in model(texts[k : k + batch])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([np.asarray(x, np.float32) for x in rows], pa.list_(pa.float32()))], names=["vec_id", "embedding"])

    return df.select(F.col(id_col).cast("long"), "text").mapInArrow(run, "vec_id long, embedding array<float>")


def pooled(output, mask: np.ndarray, prefer_pooler: bool = True) -> np.ndarray:
    """Unit vectors from whatever a model returns for a batch: a matrix, token vectors, or a record of either.

    A matrix is taken as it is; token vectors (3 axes) are averaged where the mask is 1. Of a record (mapping or
    object) ``pooler_output`` comes first, if there is one and it is preferred, then ``last_hidden_state``; of a tuple the
    first entry. Anything else raises.
    """
    get = output.get if isinstance(output, dict) else lambda name: getattr(output, name, None)
    if isinstance(output, (tuple, list)) and len(output) and isinstance(output[0], np.ndarray):
        x = output[0]
    elif isinstance(output, np.ndarray):
        x = output
    elif prefer_pooler and get("pooler_output") is not None:
        x = get("pooler_output")
    elif get("last_hidden_state") is not None:
        x = get("last_hidden_state")
    else:
        raise TypeError(f"no vectors in {type(output).__name__}")
    x = np.asarray(x, np.float64)
    if x.ndim == 1:
        x = x[None]
    if x.ndim == 3:
        m = np.asarray(mask, np.float64)[..., None]
        x = (x * m).sum(1) / np.maximum(m.sum(1), 1e-6)
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def wrapped(tokenizer: Callable, model, prefix: str = "", prefer_pooler: bool = True) -> Embedder:
    """An embedder of a tokenizer (texts to arrays by name) and a model, of which an encoder-decoder's encoder alone runs."""
    whole = not getattr(model, "is_encoder_decoder", False)
    run = model if whole else model.encoder

    def embed(texts: list[str]) -> np.ndarray:
        batch = tokenizer([prefix + t for t in texts])
        try:
            output = run(**batch)
        except TypeError:
            output = run(batch["input_ids"])
        return pooled(output, batch["attention_mask"], prefer_pooler)

    return embed


def padded(encode: Callable[[str], list[int]], begin: int, end: int, pad: int, most: int) -> Callable[[list[str]], dict[str, np.ndarray]]:
    """A batch tokenizer from one that gives a text's ids: framed by marks, cut to ``most`` with them, padded to the longest."""

    def tokenize(texts: list[str]) -> dict[str, np.ndarray]:
        rows = [[begin, *encode(t)[: max(0, most - 2)], end] for t in texts]
        width = max(map(len, rows), default=0)
        ids = np.array([r + [pad] * (width - len(r)) for r in rows], np.int64).reshape(len(rows), width)
        return {"input_ids": ids, "attention_mask": np.array([[1] * len(r) + [0] * (width - len(r)) for r in rows], np.int64).reshape(len(rows), width)}

    return tokenize


def embed_models(df: DataFrame, factories: dict[str, Callable[[], Embedder]], path: str, id_col: str = "doc_id", prefixes: dict[str, str] | None = None) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Each model's table (vec_id, embedding) below ``path``, computed unless it is there; and what failed, by model.

    A model that fails does not stop the others; when none ends well, the failures are raised.
    """
    spark, done, failed = df.sparkSession, {}, {}
    for name, factory in factories.items():
        where = f"{path}/{re.sub('[^A-Za-z0-9._-]+', '_', name)}"
        try:
            embed(df, factory, id_col, (prefixes or {}).get(name, "")).write.mode("ignore").parquet(where)
            done[name] = spark.read.parquet(where)
        except Exception as e:  # noqa: BLE001  a model's own code may raise anything
            failed[name] = str(e).split("\n")[0]
    if not done:
        raise RuntimeError(f"no model could be run: {failed}")
    return done, failed


def mean_pool(tokens: DataFrame) -> DataFrame:
    """(vec_id, embedding): mean of the token vectors (vec_id, mask, v) with mask 1; none gives zeros."""
    long = tokens.select("vec_id", F.col("mask").cast("double").alias("mask"), F.posexplode("v").alias("d", "x"))
    per = long.groupBy("vec_id", "d").agg((F.sum(F.col("x") * F.col("mask")) / F.greatest(F.sum("mask"), F.lit(1e-6))).alias("x"))
    return per.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("p")).select("vec_id", F.col("p.x").alias("embedding"))


def rerank_pairs(candidates: DataFrame, texts: DataFrame, factory: Callable[[], Callable[[list[tuple[str, str]]], np.ndarray]], k: int) -> DataFrame:
    """Rerank by a model of text pairs; each distinct pair is scored once."""
    q, d = texts.select(F.col("doc_id").alias("query_id"), F.col("text").alias("tq")), texts.select("doc_id", F.col("text").alias("td"))
    both = candidates.select("query_id", "doc_id").dropDuplicates().join(q, "query_id").join(d, "doc_id").select("query_id", "doc_id", "tq", "td")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for part in batches:
            score = np.asarray(model(list(zip(part.column(2).to_pylist(), part.column(3).to_pylist()))), np.float64)
            score = score[:, -1] if score.ndim == 2 else score  # the last of several classes
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score)], names=["query_id", "doc_id", "score"])

    return knn.ranked(both.mapInArrow(run, "query_id long, doc_id long, score double"), k)
