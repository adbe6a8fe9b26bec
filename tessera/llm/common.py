"""Helpers that the training-data operators share.

* shared storage: intermediate tables go to the folder that the cluster names in
  ``spark.checkpoint.dir``; lineage is cut by writing a table there.
* word tables: a bounded map from a word to what was computed for it once, so that
  per-word work is done per distinct word instead of per occurrence.
* labelled samples: bounded, stratified samples of labelled rows for the classifiers.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Ids up to this count (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Bytes of an Arrow batch that goes to Python, about.
BATCH_BYTES = 4 << 20


# ---------------------------------------------------------------- shared storage
#: Applications that run in this process alone to their folder.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a session on a cluster is an error: executors would not see a folder of the
    driver's own. A local session, whose executors are threads of the driver, gets a temporary folder.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = _own.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="checkpoints-")
        _own[spark.sparkContext.applicationId] = where
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tessera_path = path  # for release()
    return out


def reading(df: DataFrame, *frames: DataFrame) -> DataFrame:
    """``df``, which reads the frames' tables: releasing it releases them too."""
    df.tessera_reads = [*getattr(df, "tessera_reads", []), *frames]
    return df


def release(*frames: DataFrame) -> None:
    """Delete materialised tables that no later plan reads, and those that the frames read."""
    for df in frames:
        path = getattr(df, "tessera_path", None)
        if path:
            delete(df.sparkSession, path)
        release(*getattr(df, "tessera_reads", []))


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- plans
def map_arrow(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with batches of at most BATCH_BYTES, whatever the rows' size.

    The session's limit of bytes in an Arrow batch is lowered to that; a lower one stays. Workers
    outlive tasks, so at the end of each they give memory that is free back to the system.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < size_in_bytes(conf.get(name)) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(lean, schema)


def size_in_bytes(text: str) -> int:
    """A size as Spark writes it (``64m``, ``4096``, ``4kb``) in bytes; what is no such size counts as 0."""
    found = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)b?\s*", str(text).lower())
    return int(found[1]) << 10 * " kmgtp".index(found[2] or " ") if found else 0


def give_back() -> None:
    """Return this process's free memory to the system, as far as its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def fold(column: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def keep_ids(df: DataFrame, ids: DataFrame, column: str, how: str) -> DataFrame:
    """``df`` semi- or anti-joined with ``ids``; broadcast only after a count of the ids.

    Rows whose id is null never match: left_semi drops them, left_anti keeps them.
    """
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    else:
        ids = ids.hint("merge")
    return df.join(ids, column, how)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int) -> DataFrame:
    """(label, text, n_chars) of at most about ``per_class`` training rows of each class.

    ``train`` is a condition on ``doc_id``. Rows are taken by a hash of doc_id against a
    threshold set from the class counts, so the sample is the same at every run. Null labels
    and ids are left out; of repeated label rows of one id the largest label counts.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & train)
    marked = marked.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col("label") == value, F.lit(min(1.0, per_class / n))).otherwise(share)
    taken = marked.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(label)), F.lit(1_000_000)) < share * 1_000_000)
    # about per_class rows of two columns: bounded, so broadcast
    rows = columns_or_null(docs, doc_id="long", text="string", n_chars="long")
    return rows.join(F.broadcast(taken), "doc_id").select("label", "text", "n_chars")


def columns_or_null(df: DataFrame, **types: str) -> DataFrame:
    """The named columns; one that ``df`` lacks is null."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


# ---------------------------------------------------------------- words
class _Index(dict):
    """word -> row number; a word seen for the first time gets the next one."""

    def __init__(self):
        super().__init__()
        self.fresh: list = []

    def __missing__(self, word):
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


class WordTable:
    """Ragged integer rows computed once per distinct word, in bounded memory.

    ``compute(words)`` returns one sequence per word, or all of them joined and their sizes. Beyond ``limit`` words the table
    starts anew between texts; results never depend on what it holds.
    """

    def __init__(self, compute: Callable[[list], list], limit: int = 300_000, dtype=np.int32):
        self.compute, self.limit, self.dtype = compute, limit, dtype
        self.reset()

    def reset(self) -> None:
        self.index = _Index()
        self.flat = np.zeros(1024, self.dtype)
        self.start = np.zeros(1024, np.int64)
        self.size = np.zeros(1024, np.int32)
        self.used = 0

    def rows(self, words: list) -> np.ndarray:
        """Row numbers of ``words``; valid until the next call."""
        if len(self.index) > self.limit:
            self.reset()
        out = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.index.fresh:
            self._add(self.index.fresh)
            self.index.fresh = []
        return out

    def _add(self, words: list) -> None:
        done = len(self.index) - len(words)
        parts = self.compute(words)
        if isinstance(parts, tuple):
            flat, sizes = parts
        else:
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            flat = np.fromiter(chain.from_iterable(parts), self.dtype, int(sizes.sum()))
        total = int(sizes.sum())
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(self.used + total, self.dtype)])
        if len(self.index) > len(self.start):
            more = len(self.index)
            self.start = np.concatenate([self.start, np.zeros(more, np.int64)])
            self.size = np.concatenate([self.size, np.zeros(more, np.int32)])
        self.start[done : done + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.size[done : done + len(words)] = sizes
        self.flat[self.used : self.used + total] = flat
        self.used += total

    def gather(self, rows: np.ndarray) -> np.ndarray:
        """The rows' values, one row after the other."""
        size = self.size[rows].astype(np.int64)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[rows] - (ends - size), size) + np.arange(total)]


def blocks(batches: Iterator[pa.RecordBatch], chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``chars`` bytes of column ``text``, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index("text"))
        size = np.asarray(pc.fill_null(pc.binary_length(text), 0)).astype(np.int64)
        group = (np.cumsum(size) - size) // chars
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def texts(batch: pa.RecordBatch) -> list[str]:
    """Column ``text``, null as empty."""
    return [t if t is not None else "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]


def raw_texts(batch: pa.RecordBatch) -> list[bytes]:
    """Column ``text`` in UTF-8, null as empty."""
    column = batch.column(batch.schema.get_field_index("text"))
    return [t if t is not None else b"" for t in column.cast(pa.binary()).to_pylist()]


def arrow_batch(columns: dict, types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], type=t) if not isinstance(columns[k], pa.Array) else columns[k] for k, t in types.items()], names=list(types))


def connected_components(edges: DataFrame, name: str = "cc", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges(u, v)``, for nodes with an edge.

    Large-star and small-star steps by turns until nothing changes; every step is a grouped
    minimum and an equi-join, written to the shared folder. The minima are written first, so that
    both sides of the join are plain exchanges and adaptive execution splits a node with very
    many neighbours.
    """

    def key(df):
        r = df.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")).first()
        return r["n"], r["h"]

    cur = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    was = key(cur)
    for _ in range(rounds):
        if not was[0]:
            break
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        a = materialize(large, name)
        low2 = materialize(a.groupBy("u").agg(F.min("v").alias("m")), name)
        small = a.join(low2.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        nxt = materialize(small, name)
        now = key(nxt)
        release(cur, a, low, low2)
        cur = nxt
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("connected components did not settle")
    roots = cur.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    out = cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    out.tessera_path = cur.tessera_path  # for release()
    return out
