"""JSON lines and judgements: scans with stated error behaviour, and sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X
from tessera.operators import corpus as C


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line): lines of text files, from 1 within each file; blank lines count but are left out.

    Files are read in blocks like any others: lines are numbered within a block, and a block's first
    number is one more than the lines of the file's blocks before it.
    """
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, k = None, 0
        for batch in batches:
            numbers = []
            for own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                k = k + 1 if own == at else 1
                at = own
                numbers.append(k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=["path", "block", "value", "k"])

    numbered = rows.mapInArrow(number, "path string, block long, value string, k long")
    sizes = numbered.groupBy("path", "block").agg(F.max("k").alias("n"))  # a row per block
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    out = numbered.join(first, ["path", "block"]).select("path", (F.col("first") + F.col("k")).alias("line_no"), F.regexp_replace("value", "\r$", "").alias("line"))
    return out.where(X.strip(F.col("line")) != "")


def read_strict(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; a broken line ends the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_lenient(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; broken lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of lines that are no JSON object."""
    rows = numbered_lines(spark, path)
    return rows.where(F.expr("try_parse_json(line) IS NULL") | ~F.ltrim("line").startswith("{"))


def load_texts(df: DataFrame, limit: int, order: str, field: str | None = None, missing: str = "raise") -> DataFrame:
    """The first ``limit`` rows with their text; a missing text raises, or counts as empty."""
    rows = C.with_text(df.orderBy(order).limit(limit), field)
    error = F.raise_error(F.concat(F.lit("row without text: "), F.col(order).cast("string")))
    return rows.withColumn("text", F.coalesce("text", error.cast("string") if missing == "raise" else F.lit("")))


def titled(df: DataFrame) -> DataFrame:
    """(_id, text): title and text of labelled corpora on two lines, stripped."""
    return df.select("_id", X.strip(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))).alias("text"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, rel) from a white-space separated file with a header; the last of repeated lines counts."""
    parts = numbered_lines(spark, path).where("line_no > 1").select("line_no", F.split(X.collapse(F.col("line")), " ").alias("p")).where(F.size("p") >= 3)
    rows = parts.select("line_no", F.col("p")[0].alias("query_id"), F.col("p")[1].alias("doc_id"), F.col("p")[2].cast("int").alias("rel"))
    return rows.groupBy("query_id", "doc_id").agg(F.max_by("rel", "line_no").alias("rel"))


def languages_by_folder(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines below folders that name a language, with that language."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").option("mode", "DROPMALFORMED").json(path)
    return rows.withColumn("language", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1))


def ordered_parquet(spark: SparkSession, files: list[str], limit: int, keep=None) -> DataFrame:
    """The first ``limit`` rows of the files in the order given, that pass ``keep``; later files are not read.

    Files are counted one by one until they hold enough rows, and only those are in the plan.
    """
    used, have = [], 0
    for file in files:
        rows = spark.read.parquet(file)
        have += (rows if keep is None else rows.where(keep)).count()
        used.append(file)
        if have >= limit:
            break
    out = None
    for k, file in enumerate(used):
        one = spark.read.parquet(file).withColumns({"_file": F.lit(k), "_row": F.col("_metadata.row_index")})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    out = out if keep is None else out.where(keep)
    return out.orderBy("_file", "_row").limit(limit).drop("_file", "_row")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_prefixes(df: DataFrame, order: str, limits: list[int], path: str) -> None:
    """One folder per limit with the first rows by ``order``; the rows are numbered once."""
    first = df.orderBy(order).limit(max(limits))
    rows = first.withColumn("_n", F.row_number().over(Window.orderBy(order))).cache()
    for n in limits:
        rows.where(F.col("_n") <= n).drop("_n").write.mode("overwrite").json(f"{path}/{n}")
    rows.unpersist()


def write_csv(rows: list[DataFrame], path: str, order: list[str] | None = None, append: bool = False) -> None:
    """Metric rows of any columns in one CSV: preferred columns first, the others sorted."""
    both = rows[0]
    for df in rows[1:]:
        both = both.unionByName(df, allowMissingColumns=True)
    first = [c for c in order or [] if c in both.columns]
    both.select(*first, *sorted(set(both.columns) - set(first))).write.mode("append" if append else "overwrite").option("header", True).csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Adds rows to a table of CSV files, each with its header; other columns than it has raise."""
    spark = df.sparkSession
    try:
        have = spark.read.option("header", True).csv(path).columns
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
        have = df.columns
    if have != df.columns:
        raise ValueError(f"{path} has columns {have}, not {df.columns}")
    df.write.mode("append").option("header", True).csv(path)


def write_metrics(rows: list[dict], spark: SparkSession, path: str) -> None:
    """Records of any shape as one JSON document."""
    spark.createDataFrame([(json.dumps(rows, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_metrics(spark: SparkSession, path: str) -> list[dict]:
    return json.loads(_whole(spark, path))


def read_config(spark: SparkSession, path: str) -> dict:
    """A YAML file of settings; needs PyYAML."""
    import yaml

    return yaml.safe_load(_whole(spark, path)) or {}


def _whole(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one small file


def labels(df: DataFrame, id_col: str, label: str, n: int | None = None) -> DataFrame:
    """(id, label): missing labels as ``unknown``, and so are ids from 0 to n - 1 that have no row."""
    own = df.select(F.col(id_col), F.coalesce(F.col(label).cast("string"), F.lit("unknown")).alias("label"))
    if n is None:
        return own
    return df.sparkSession.range(n).withColumnRenamed("id", id_col).join(own, id_col, "left").select(id_col, F.coalesce("label", F.lit("unknown")).alias("label"))


def read_csv(spark: SparkSession, path: str, seed: int | None = None) -> DataFrame:
    df = spark.read.option("header", True).csv(path)
    return df if seed is None else df.withColumn("seed", F.lit(seed))


def manifest(scanned: DataFrame, kept: DataFrame, seconds: float) -> dict:
    return {"scanned_rows": scanned.count(), "distinct_rows": kept.count(), "columns": kept.columns, "seconds": round(seconds, 3)}


def markdown(df: DataFrame, digits: int = 4, most: int = 1000) -> str:
    """A small result as a Markdown table; one of over ``most`` rows raises."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    show = lambda x: f"{x:.{digits}f}" if isinstance(x, float) else "" if x is None else str(x)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in rows])
