"""A training corpus from raw documents: filter, deduplicate, decontaminate, pack.

Every stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a
DataFrame; ``run`` writes each stage's result as Parquet to the shared folder and reads it again.
All stages but the last return the columns of ``documents``; other columns come along unchanged.

Defined results: null texts count as empty. Quality judges every row by itself, empty texts by their
statistics and repeated rows alike. Exact dedup keeps one empty text; near-dedup keeps all that are left
without words, as they link with nothing. Rows without id, which no decision can name, are judged by quality and
stay in the three stages after it. Rows that share an id stay or go together in those. Ties go to the smallest
id. Long texts are read whole. An empty table passes all stages and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, decontaminate, exact_dedup, near_dedup, packing, quality

#: Documents that score less are rejected.
MIN_QUALITY = 0.5


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a factorisation machine fitted on all labels does not reject."""
    model = quality.train(docs, common.table(spark, sf_dir, "labels"), F.lit(True))
    return quality.keep(docs, model, MIN_QUALITY)


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles link at 0.8 or more."""
    return near_dedup.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", filter_quality),
    ("exact_dedup", drop_exact_duplicates),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: Learned scores, minhashes and token ids are no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES, 1):
        kept = stage(spark, docs, sf_dir)
        if k == len(STAGES):
            return kept
        before, docs = docs, common.materialize(kept, f"pipeline-{name}")
        common.release(kept, before)  # nothing reads the stage before any more
