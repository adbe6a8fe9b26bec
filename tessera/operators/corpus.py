"""Corpus preparation: scans' rows to clean, deduplicated, sampled and chunked texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

DEFAULT_FIELDS = ("text", "sentence", "code", "content", "docstring", "description")


def with_text(df: DataFrame, preferred: str | None = None, fields=DEFAULT_FIELDS) -> DataFrame:
    """Adds text (first field that is not blank, stripped) and text_field (which one)."""
    names = [c for c in dict.fromkeys([preferred, *fields]) if c and c in df.columns]
    if not names:
        return df.withColumn("text", F.lit(None).cast("string")).withColumn("text_field", F.lit(None).cast("string"))
    value, field = T.first_text(*names)
    return df.withColumn("_t", value).withColumn("text_field", field).drop("text").withColumnRenamed("_t", "text")


def picked(df: DataFrame, names: tuple[str, ...], target: str) -> DataFrame:
    """``target``: the first of the columns that is not blank, null as empty."""
    some = [F.when(T.strip(F.col(c).cast("string")) != "", F.col(c).cast("string")) for c in names if c in df.columns]
    return df.withColumn(target, F.coalesce(*some, F.lit("")))


#: Names of columns in code corpora, in the order in which they are asked.
CODE = ("code", "func_code_string", "original_string", "text")
DOCSTRING = ("docstring", "func_documentation_string", "summary")


def first_of_text(df: DataFrame, order: str, key: str = "text", digest: bool = False) -> DataFrame:
    """The first row of each text by ``order``, one even if ids repeat; texts are compared, or their SHA-256.

    Rows are combined before they are shuffled, so a task sends one row per text at most.
    """
    by = F.sha2(F.col(key), 256) if digest else F.col(key)
    first = df.groupBy(by.alias("_k")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.col(order)).alias("_r"))
    return first.select(*[F.col(f"_r.`{c}`").alias(c) for c in df.columns])


def prepared(df: DataFrame, order: str, least: int, most: int, truncate: bool = True) -> DataFrame:
    """Texts of ``least`` characters or more, cut to ``most`` (or dropped beyond), each once."""
    kept = df.where(F.length("text") >= least)
    kept = kept.withColumn("text", F.substring("text", 1, most)) if truncate else kept.where(F.length("text") <= most)
    return first_of_text(kept, order)


def profile(df: DataFrame, order: str, least: int = 50, most: int = 4000) -> DataFrame:
    """(status, n): every row in the first bucket it falls into, of empty, too_short, too_long, duplicate_text, kept."""
    w = Window.partitionBy("_k").orderBy(order)
    t = df.withColumn("_t", T.strip(F.coalesce(F.col("text"), F.lit("")))).withColumn("_n", F.length("_t"))
    early = F.when(F.col("_n") == 0, "empty").when(F.col("_n") < least, "too_short").when(F.col("_n") > most, "too_long")
    t = t.withColumn("_s", early).withColumn("_k", F.when(F.col("_s").isNull(), F.sha2("_t", 256)).otherwise(F.concat(F.lit("-"), F.col(order).cast("string"))))
    status = F.coalesce("_s", F.when(F.row_number().over(w) > 1, "duplicate_text"), F.lit("kept"))
    return t.select(status.alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def coerced(x: Column, kind: str = "string") -> Column:
    """Null as empty, bytes as UTF-8 (what is no UTF-8 replaced), lists joined by spaces."""
    if kind == "binary":
        x = x.cast("string")  # Spark replaces what is no UTF-8 when it leaves the engine
    elif kind.startswith("array"):
        x = F.concat_ws(" ", x.cast("array<string>"))
    return F.coalesce(x.cast("string"), F.lit(""))


def validation(df: DataFrame, line: str, id_col: str = "id", preferred: str | None = None, least: int = 50, most: int = 4000, language: str = "lang", top: int = 20) -> DataFrame:
    """(kind, name, n): what a corpus's rows come to.

    ``rows``: all, and every row in the first bucket it falls into (empty_text, too_short, too_long, duplicate_texts,
    kept); ``ids``: generated ones, and rows beyond the first of an id, rejected rows included; ``fields`` that gave
    the kept texts; the ``top`` languages of kept rows.
    """
    rows = with_text(df, preferred).withColumn("text", F.coalesce("text", F.lit("")))
    path = F.col("path") if "path" in df.columns else F.lit(None).cast("string")
    rows = rows.withColumn("_sid", T.stable_id(F.col(id_col), path, F.col(line), F.col("text"))).withColumn("_gen", T.strip(F.coalesce(F.col(id_col), F.lit(""))) == "")
    n = F.length("text")
    early = F.when(n == 0, "empty_text").when(n < least, "too_short").when(n > most, "too_long")
    first = rows.where(early.isNull()).groupBy(F.sha2("text", 256).alias("_k")).agg(F.min(line).alias("_first"), F.count(F.lit(1)).alias("_n"))
    kept = rows.join(first.select(F.col("_first").alias(line)), line, "left_semi").where(early.isNull())
    count = F.count(F.lit(1)).alias("n")
    out = rows.select(F.lit("rows").alias("kind"), F.coalesce(early, F.lit("_")).alias("name")).groupBy("kind", "name").agg(count).where("name <> '_'")
    out = out.union(rows.agg(count).select(F.lit("rows"), F.lit("total_rows"), "n"))
    sums = first.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("d"), count)
    out = out.union(sums.where("d > 0").select(F.lit("rows"), F.lit("duplicate_texts"), "d")).union(sums.where("n > 0").select(F.lit("rows"), F.lit("kept"), "n"))
    out = out.union(rows.where("_gen").agg(count).select(F.lit("ids"), F.lit("generated_ids"), "n"))
    ids = rows.groupBy("_sid").agg(count)
    out = out.union(ids.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).select(F.lit("ids"), F.lit("duplicate_ids"), "n"))
    out = out.union(kept.groupBy("text_field").agg(count).select(F.lit("fields"), "text_field", "n"))
    names = histogram(kept, language, top) if language in df.columns else kept.agg(count).select(F.lit("unknown"), "n")
    return out.union(names.select(F.lit("languages"), "*"))


def id_profile(df: DataFrame, id_col: str) -> DataFrame:
    """(rows, missing, duplicate): ids that are absent, and rows beyond the first of an id."""
    sizes = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    own = F.col(id_col).isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return sizes.agg(zero(F.sum("n")).alias("n_rows"), zero(F.sum(F.when(~own, F.col("n")))).alias("missing"), zero(F.sum(F.when(own, F.col("n") - 1))).alias("duplicate"))


def histogram(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """(value, n), missing values as ``unknown``; the ``top`` most frequent if given."""
    out = df.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), "value").limit(top) if top else out


def shuffled(df: DataFrame, id_col: str, n: int, seed: int = 7) -> DataFrame:
    """A sample of n rows, the first by md5(seed:id)."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), id_col).limit(n)


def stratified_sample(df: DataFrame, stratum: str, id_col: str, per_stratum: int, total: int, seed: int = 7) -> DataFrame:
    """Of the first 3 * per_stratum rows of each stratum, per_stratum shuffled ones; of all those, ``total``."""
    first = Window.partitionBy(stratum).orderBy(id_col)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    drawn = Window.partitionBy(stratum).orderBy(key, id_col)
    some = df.withColumn("_a", F.row_number().over(first)).where(F.col("_a") <= 3 * per_stratum)
    some = some.withColumn("_b", F.row_number().over(drawn)).where(F.col("_b") <= per_stratum)
    return some.orderBy(key, id_col).limit(total).drop("_a", "_b")


def chunked(df: DataFrame, id_col: str, chunk: int = 320, stride: int = 120, least: int = 80) -> DataFrame:
    """(id, source id, chunk_index, text) of overlapping windows."""
    parts = df.select(F.col(id_col).alias("source_index"), F.posexplode(T.chunks(F.col("text"), chunk, stride, least)).alias("chunk_index", "text"))
    return parts.select(F.concat_ws(":", "source_index", "chunk_index").alias("id"), "source_index", F.col("chunk_index").cast("long").alias("chunk_index"), "text")


def chunk_corpus(df: DataFrame, id_col: str, count: int, chunk: int = 320, stride: int = 120, least: int = 80) -> DataFrame:
    """The first ``count`` windows by source and place; fewer raise."""
    parts = chunked(df, id_col, chunk, stride, least)
    first = parts.orderBy("source_index", "chunk_index").limit(count)
    have = first.count()
    if have < count:
        raise ValueError(f"{have} chunks, not {count}")
    return first


def query_sample(df: DataFrame, id_col: str, n: int, seed: int = 7) -> DataFrame:
    """n rows drawn without replacement, by md5(seed:id), in order of their ids."""
    return shuffled(df, id_col, n, seed).orderBy(id_col)


def split_at(df: DataFrame, id_col: str, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Rows below and from the cut of dense ids at ``share`` of their number."""
    cut = int(df.count() * share)
    return df.where(F.col(id_col) < cut), df.where(F.col(id_col) >= cut)


def expanded(vectors: DataFrame, n: int, noise: float = 0.01, seed: int = 7) -> DataFrame:
    """n unit vectors: the given ones, or resampled with Gaussian noise beyond their number."""
    from tessera.functions import vectors as V

    have = vectors.count()
    if n <= have:
        return vectors.where(F.col("vec_id") < n)
    base = vectors.select(F.col("vec_id").alias("base"), "u")
    drawn = vectors.sparkSession.range(n).withColumn("base", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(have)))
    parts = drawn.join(base, "base").select(F.col("id").alias("vec_id"), F.posexplode("u").alias("k", "x"))
    # Box-Muller from two hashes, so a value depends on its row and place alone
    u = lambda s: (F.pmod(F.xxhash64("vec_id", "k", F.lit(seed + s)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    normal = F.sqrt(-2 * F.ln(u(1))) * F.cos(2 * 3.141592653589793 * u(2))
    noisy = parts.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("k", (F.col("x") + noise * normal).alias("x")))).alias("p"))
    return noisy.select("vec_id", V.l2_normalize(F.col("p.x")).alias("u"))
