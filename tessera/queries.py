"""All registered queries of the retrieval operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import corpus, search, studies


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.two_stage_search(spark, sf_dir)


def queries() -> dict:
    return {**search.QUERIES, **corpus.QUERIES, **studies.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**search.SQL, **corpus.SQL, **studies.SQL}
