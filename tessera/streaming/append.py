"""Incremental growth: new vectors become signatures against frozen anchors as a stateless stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import knn
from tessera.operators import signatures as S

SCHEMA = "vec_id long, embedding array<float>, label int"


def read(spark: SparkSession, path: str, per_batch: int = 100) -> DataFrame:
    """Vector files that appear below ``path``."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_batch).parquet(path)


def append_signatures(stream: DataFrame, anchors: DataFrame, kind: str, path: str, checkpoint: str) -> StreamingQuery:
    """Transformed signatures of arriving rows, appended to a table exactly once.

    A signature depends on its row and the anchors alone, so the stream keeps no state.
    """
    if kind not in S.ROW:
        raise ValueError("only row transforms are stateless")
    sigs = S.transform(S.signatures(knn.unit(stream), anchors), kind)
    return sigs.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
