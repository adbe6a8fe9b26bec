"""Dense matrices in NPY files: a scan through Spark's reader, and a sink of one file."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 4096


def read_npy(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(model, vec_id, embedding): rows of each matrix, the model being the file's stem."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select(F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("model"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for model, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.load(io.BytesIO(content), allow_pickle=False)[:limit]
                for k in range(0, len(x), ROWS):
                    part = np.ascontiguousarray(x[k : k + ROWS], np.float32)
                    offsets = pa.array(np.arange(0, part.size + 1, max(1, x.shape[1])), pa.int32())
                    columns = [pa.array([model] * len(part)), pa.array(np.arange(k, k + len(part))), pa.ListArray.from_arrays(offsets, pa.array(part.ravel()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["model", "vec_id", "embedding"])

    return files.mapInArrow(run, "model string, vec_id long, embedding array<float>")


def cached(df: DataFrame, path: str) -> DataFrame:
    """The table at ``path``, written first unless it is there already."""
    df.write.mode("ignore").parquet(path)
    return df.sparkSession.read.parquet(path)


def resume(source: DataFrame, path: str, id_col: str, compute) -> DataFrame:
    """Append ``compute`` of the rows whose ids the table at ``path`` lacks; returns the table."""
    spark = source.sparkSession
    try:
        done = spark.read.parquet(path).select(id_col)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
        done = None
    left = source if done is None else source.join(done, id_col, "left_anti")
    compute(left).write.mode("append").parquet(path)
    return spark.read.parquet(path)
