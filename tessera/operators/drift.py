"""How signatures and neighbours change as a corpus grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import metrics
from tessera.operators import signatures as S


def statistics(sigs: DataFrame) -> DataFrame:
    """Of raw signatures: documents, mean and mean top similarity, entropy of their softmax, Gini of top-anchor use."""
    top = F.array_max("sig")
    e = V.let(top, lambda t: F.transform("sig", lambda x: F.exp(x - t)))
    p = V.let(e, lambda a: V.let(V.total(a), lambda z: F.transform(a, lambda x: x / z)))
    entropy = -V.total(F.transform(p, lambda x: x * F.ln(F.greatest(x, F.lit(V.EPS)))))
    best = F.array_position(F.col("sig"), top) - 1
    per = sigs.select(V.mean(F.col("sig")).alias("m"), top.alias("t"), entropy.alias("e"), best.alias("anchor_pos"), F.size("sig").alias("width"))
    means = per.agg(F.count(F.lit(1)).alias("doc_count"), V.rounded(F.avg("m")).alias("mean_anchor_similarity"), V.rounded(F.avg("t")).alias("mean_top_anchor_similarity"), V.rounded(F.avg("e")).alias("mean_signature_entropy"), F.max("width").alias("width"))
    used = per.groupBy("anchor_pos").agg(F.count(F.lit(1)).alias("c"))
    return means.join(F.broadcast(gini(used, means.select("width"))), how="cross").drop("width")


def gini(used: DataFrame, width: DataFrame) -> DataFrame:
    """Gini coefficient of counts (anchor_pos, c), of ``width`` anchors; unused ones count 0."""
    every = width.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("width").cast("long") - 1)).alias("anchor_pos"))
    counts = every.join(used, "anchor_pos", "left").select(F.coalesce("c", F.lit(0)).alias("c"))
    counts = counts.withColumn("i", F.row_number().over(Window.orderBy("c")))  # as many rows as anchors
    n, total = F.count(F.lit(1)), F.sum("c")
    value = F.sum(2 * F.col("i") * F.col("c")) - (n + 1) * total
    return counts.agg(V.rounded(F.when(total > 0, value / (n * total)).otherwise(0.0)).alias("anchor_usage_gini"))


def perturbation(before: DataFrame, after: DataFrame) -> DataFrame:
    """1 - mean cosine of a row's two signatures."""
    both = before.join(after.select("vec_id", F.col("sig").alias("other")), "vec_id")
    return both.agg(V.rounded(1 - F.avg(V.dot(V.l2_normalize(F.col("sig")), V.l2_normalize(F.col("other"))))).alias("drift"))


def neighbour_change(before: DataFrame, after: DataFrame, first_new: int, k: int) -> DataFrame:
    """Changed queries, mean inserted neighbours, and mean share of k kept, of two top-k results."""
    b = before.where(F.col("rank") <= k).select("query_id", "doc_id", F.lit(1).alias("old"))
    a = after.where(F.col("rank") <= k).select("query_id", "doc_id", F.lit(1).alias("new"))
    per = a.join(b, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.count("old").alias("kept"), F.sum((F.col("doc_id") >= first_new).cast("long")).alias("inserted"))
    return per.agg(
        F.count(F.lit(1)).alias("query_count"),
        V.rounded(F.avg((F.col("kept") < k).cast("double"))).alias("changed_fraction"),
        V.rounded(F.avg("inserted")).alias("mean_inserted"),
        V.rounded(F.avg(F.col("kept") / k)).alias("retained_overlap"),
    )


def memory(n: int, width: int, anchors: int) -> dict[str, float]:
    """MB of vectors and of signatures in 4, 2 and 1 bytes."""
    return {"raw_float32_mb": n * width * 4 / 1e6, "relative_float32_mb": n * anchors * 4 / 1e6, "relative_float16_mb": n * anchors * 2 / 1e6, "relative_int8_mb": n * anchors / 1e6}


def instability(vectors: DataFrame, a: DataFrame, b: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """MRR and overlap of neighbours under two anchor sets."""
    from tessera.operators import knn

    found = []
    for anchors in (a, b):
        sigs = S.transform(S.signatures(vectors, anchors), "raw_l2").cache()
        found.append(knn.top_k(sigs, sigs.join(queries.select("vec_id"), "vec_id", "left_semi"), k, vec="sig"))
    return metrics.mrr(found[0], found[1], k).join(metrics.overlap(found[0], found[1], k), how="cross")
