"""Retrieval quality over ranked rows (query_id, rank, doc_id), ranks from 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import rounded


def _long(c: str):
    return F.col(c).cast("long").alias(c)


def hits(truth: DataFrame, found: DataFrame, k: int, pool: int) -> DataFrame:
    """(query_id, hits, size): how many of a query's first k true documents are among ``pool`` candidates."""
    t = truth.where(F.col("rank") <= k).select("query_id", "doc_id")
    f = found.where(F.col("rank") <= pool).select("query_id", "doc_id", F.lit(1).alias("hit"))
    return t.join(f, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("size"))


def recall(truth: DataFrame, found: DataFrame, grid: list[tuple[int, int]]) -> DataFrame:
    """Per (top_k, pool): mean recall, share of queries with all and with any true document found."""
    spark = truth.sparkSession
    g = F.broadcast(spark.createDataFrame(grid, "top_k long, pool_size long"))
    t = truth.join(g, F.col("rank") <= F.col("top_k")).select("top_k", "pool_size", "query_id", "doc_id")
    f = found.select("query_id", "doc_id", F.col("rank").alias("at"))
    per = t.join(f, ["query_id", "doc_id"], "left").groupBy("top_k", "pool_size", "query_id").agg(F.sum((F.coalesce("at", F.lit(1 << 60)) <= F.col("pool_size")).cast("long")).alias("hits"), F.count(F.lit(1)).alias("size"))
    out = per.groupBy("top_k", "pool_size").agg(
        F.count(F.lit(1)).alias("query_count"),
        rounded(F.avg(F.col("hits") / F.col("size"))).alias("mean_recall"),
        rounded(F.avg((F.col("hits") == F.col("size")).cast("double"))).alias("all_top_k_contained"),
        rounded(F.avg((F.col("hits") > 0).cast("double"))).alias("any_hit"),
    )
    return out


def containment(truth: DataFrame, found: DataFrame, k: int, pool: int) -> DataFrame:
    """Share of queries whose true documents are all among the candidates."""
    per = hits(truth, found, k, pool)
    return per.agg(F.count(F.lit(1)).alias("query_count"), rounded(F.avg((F.col("hits") == F.col("size")).cast("double"))).alias("containment"))


def overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Mean share of a's top k that b's top k holds."""
    per = hits(a, b, k, k)
    return per.agg(rounded(F.avg(F.col("hits") / F.col("size"))).alias("overlap"))


def top1(a: DataFrame, b: DataFrame) -> DataFrame:
    """Share of queries whose first documents agree."""
    x = a.where("rank = 1").select("query_id", "doc_id")
    y = b.where("rank = 1").select("query_id", F.col("doc_id").alias("other"))
    return x.join(y, "query_id").agg(rounded(F.avg((F.col("doc_id") == F.col("other")).cast("double"))).alias("top1_overlap"))


def mrr(reference: DataFrame, found: DataFrame, limit: int, k: int = 1) -> DataFrame:
    """Mean reciprocal rank, in ``found`` down to ``limit``, of the first of the reference's top k; 0 beyond."""
    t = reference.where(F.col("rank") <= k).select("query_id", "doc_id")
    f = found.where(F.col("rank") <= limit).select("query_id", "doc_id", "rank")
    per = t.join(f, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.min("rank").alias("r"))
    return per.agg(rounded(F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0)))).alias("mrr"))


def mean_ranks(pairs: DataFrame, column: str, buckets: int = 256) -> DataFrame:
    """(column, rank): every distinct value's rank, ties at their mean.

    Values are counted, then numbered within ``buckets`` ranges of about as many values each, so that no
    task orders all of them.
    """
    own = pairs.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where(F.col(column).isNotNull())
    edges = own.approxQuantile(column, [k / buckets for k in range(1, buckets)], 1 / (4 * buckets))
    cuts = F.array(*map(F.lit, sorted(set(edges)))).cast("array<double>")
    own = own.withColumn("_b", F.size(F.filter(cuts, lambda x: x < F.col(column))))
    sums = own.groupBy("_b").agg(F.sum("n").alias("of"))
    before = sums.select("_b", F.coalesce(F.sum("of").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row per bucket
    upto = F.sum("n").over(Window.partitionBy("_b").orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return own.join(F.broadcast(before), "_b").select(column, (F.col("_before") + upto - (F.col("n") - 1) / 2.0).alias("rank"))


def spearman(pairs: DataFrame) -> DataFrame:
    """Rank correlation of columns a and b, ties at their mean rank."""
    both = pairs.select("a", "b")
    for c in ("a", "b"):
        both = both.join(mean_ranks(pairs, c).withColumnRenamed("rank", f"r{c}"), c)
    return both.agg(F.count(F.lit(1)).alias("n"), rounded(F.corr("ra", "rb"), 5).alias("spearman"))


def graded_by_class(classes: DataFrame, queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """As ``graded``, where the documents of a query's own class count, each by its grade.

    classes is (vec_id, label, rel), queries (vec_id); a query is no document of its own. The ideal needs
    no more than how many documents of each grade a class holds, so no (query, document) pair is made but
    those in ``found``.
    """
    sizes = classes.where("rel > 0").groupBy("label", "rel").agg(F.count(F.lit(1)).alias("n"))
    grades = sizes.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("rel", "n")), asc=False).alias("grades"))  # one entry per grade
    own = queries.select("vec_id").join(classes, "vec_id").join(grades, "label")
    less = F.transform("grades", lambda g: F.struct(g["rel"].alias("rel"), (g["n"] - (g["rel"] == F.col("rel")).cast("long")).alias("n")))
    best = F.slice(F.flatten(F.transform(less, lambda g: F.array_repeat(g["rel"], F.least(g["n"], F.lit(k)).cast("int")))), 1, k)
    gain = lambda rel, at: (F.pow(F.lit(2.0), rel) - 1) / F.log2(at + 1)
    ideal = F.aggregate(F.transform(best, lambda rel, at: gain(rel, at + 1)), F.lit(0.0), lambda a, b: a + b)
    total = F.aggregate(F.transform(less, lambda g: g["n"]), F.lit(0).cast("long"), lambda a, b: a + b)
    own = own.select(F.col("vec_id").alias("query_id"), "label", ideal.alias("ideal"), total.alias("n")).where("n > 0")
    docs = classes.where("rel > 0").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("other"), "rel")
    got = found.where((F.col("rank") <= k) & (F.col("query_id") != F.col("doc_id"))).join(docs, "doc_id").join(own.select("query_id", "label"), "query_id").where("label = other")
    got = got.groupBy("query_id").agg(F.sum(gain(F.col("rel"), F.col("rank"))).alias("dcg"), F.count(F.lit(1)).alias("hit"), F.min("rank").alias("first"))
    return _graded_means(own.join(got, "query_id", "left"))


def _graded_means(per: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return per.agg(
        F.count(F.lit(1)).alias("query_count"),
        rounded(F.avg(zero(F.col("hit") / F.col("n")))).alias("recall"),
        rounded(F.avg(zero(1.0 / F.col("first")))).alias("mrr"),
        rounded(F.avg(zero(F.col("dcg") / F.col("ideal")))).alias("ndcg"),
    )


def graded(qrels: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Recall, MRR and nDCG at k by graded judgements (query_id, doc_id, rel); queries without a positive one are skipped."""
    positive = qrels.where("rel > 0")
    w = Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id")
    gain = lambda r: (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col(r) + 1)
    ideal = positive.withColumn("i", F.row_number().over(w)).groupBy("query_id").agg(F.sum(F.when(F.col("i") <= k, gain("i"))).alias("ideal"), F.count(F.lit(1)).alias("n"))
    got = found.where(F.col("rank") <= k).join(positive, ["query_id", "doc_id"])
    got = got.groupBy("query_id").agg(F.sum(gain("rank")).alias("dcg"), F.count(F.lit(1)).alias("hit"), F.min("rank").alias("first"))
    return _graded_means(ideal.join(got, "query_id", "left"))


def binary(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Recall, MRR and nDCG at k against true neighbours; the ideal has k hits."""
    t = truth.where(F.col("rank") <= k).select("query_id", "doc_id", F.lit(1).alias("t"))
    f = found.where(F.col("rank") <= k).select("query_id", "doc_id", "rank")
    ideal = sum(1 / __import__("math").log2(r + 1) for r in range(1, k + 1))
    per = t.join(f, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.count("rank").alias("hit"), F.count(F.lit(1)).alias("size"), F.min("rank").alias("first"), F.sum(1.0 / F.log2(F.col("rank") + 1)).alias("dcg"))
    return per.agg(
        F.count(F.lit(1)).alias("query_count"),
        rounded(F.avg(F.col("hit") / F.col("size"))).alias("recall"),
        rounded(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0)))).alias("mrr"),
        rounded(F.avg(F.coalesce(F.col("dcg") / ideal, F.lit(0.0)))).alias("ndcg"),
        rounded(F.avg((F.col("hit") == F.col("size")).cast("double"))).alias("all_contained"),
    )


def recall_by_type(truth: DataFrame, found: DataFrame, types: DataFrame, k: int) -> DataFrame:
    """(system, query_type): queries and mean recall at k; found has a system column, types (query_id, query_type)."""
    t = truth.where(F.col("rank") <= k).select("query_id", "doc_id").join(types, "query_id")
    systems = found.select("system").distinct()
    f = found.where(F.col("rank") <= k).select("system", "query_id", "doc_id", F.lit(1).alias("hit"))
    per = t.join(F.broadcast(systems)).join(f, ["system", "query_id", "doc_id"], "left").groupBy("system", "query_type", "query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("r"))
    return per.groupBy("system", "query_type").agg(F.count(F.lit(1)).alias("query_count"), rounded(F.avg("r")).alias("recall"))


def label_precision(found: DataFrame, labels: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Mean share of a query's k neighbours with its label; queries without neighbours count 0."""
    l = labels.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("ld"))  # noqa: E741
    q = queries.select(F.col("vec_id").alias("query_id")).join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("lq")), "query_id")
    per = q.join(found.where(F.col("rank") <= k).join(l, "doc_id"), "query_id", "left").groupBy("query_id").agg(F.avg((F.col("ld") == F.col("lq")).cast("double")).alias("p"))
    return per.agg(F.count(F.lit(1)).alias("query_count"), rounded(F.avg(F.coalesce("p", F.lit(0.0)))).alias("label_precision"))


def missed(truth: DataFrame, found: DataFrame, k: int, pool: int) -> DataFrame:
    """(doc_id, n): how often a true document was not among the candidates."""
    t = truth.where(F.col("rank") <= k).select("query_id", "doc_id")
    return t.join(found.where(F.col("rank") <= pool).select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, population deviation, least, most and number of a value."""
    return rows.groupBy(*by).agg(rounded(F.avg(value)).alias("mean"), rounded(F.stddev_pop(value)).alias("std"), rounded(F.min(value)).alias("min"), rounded(F.max(value)).alias("max"), F.count(F.lit(1)).alias("runs"))


def paired_delta(rows: DataFrame, keys: list[str], group: str, a: str, b: str, value: str, out: list[str]) -> DataFrame:
    """Mean, least and most of value(b) - value(a) over rows of the same keys."""
    x = rows.where(F.col(group) == a).select(*keys, F.col(value).alias("x"))
    y = rows.where(F.col(group) == b).select(*keys, F.col(value).alias("y"))
    d = x.join(y, keys).withColumn("d", F.col("y") - F.col("x"))
    return d.groupBy(*out).agg(rounded(F.avg("d")).alias("mean"), rounded(F.min("d")).alias("min"), rounded(F.max("d")).alias("max"), F.count(F.lit(1)).alias("runs"))


def best(rows: DataFrame, by: list[str], value: str, n: int, ties: list[str]) -> DataFrame:
    """The n best rows of each group."""
    w = Window.partitionBy(*by).orderBy(F.desc(value), *ties)
    return rows.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= n)


def pivoted(rows: DataFrame, by: list[str], column: str, values: list, value: str) -> DataFrame:
    """A column per value of ``column``, with the mean of ``value``."""
    wide = rows.groupBy(*by).pivot(column, values).agg(F.avg(value))
    return wide.select(*by, *[rounded(F.col(f"`{v}`")).alias(f"at_{v}") for v in values])


def sampled_pairs(n: int, size: int, spark, seed: int = 7) -> DataFrame:
    """(i, j): ``size`` draws of two of n rows by hashes of the draw's number, those of a row with itself left out."""
    drawn = lambda s: F.pmod(F.xxhash64("id", F.lit(seed + s)), F.lit(n))
    return spark.range(size).select(drawn(0).alias("i"), drawn(1).alias("j")).where("i <> j")
