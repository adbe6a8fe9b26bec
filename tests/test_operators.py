"""Invariants, numpy references and edge cases of the retrieval operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import anchors as A
from tessera.operators import ann, corpus, drift, graph, knn, learn, lexical, metrics, models
from tessera.operators import signatures as S
from tessera.operators.index import Settings, VectorIndex, latency, search_generations


@pytest.fixture(scope="module")
def table(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").cache()


@pytest.fixture(scope="module")
def unit(table):
    return knn.unit(table).cache()


def array(df, col="u"):
    return np.array([r[0] for r in df.orderBy("vec_id").select(col).collect()])


def one(spark, values, column):
    return spark.createDataFrame([(values,)], "s array<double>").select(column(F.col("s")).alias("o")).first()["o"]


# ---------------------------------------------------------------- vectors
def test_unit_norms_and_zero_vectors(spark, unit):
    assert np.allclose(np.linalg.norm(array(unit), axis=1), 1)
    assert one(spark, [0.0, 0.0], V.l2_normalize) == [0.0, 0.0]


def test_constant_rows_become_zero(spark):
    assert one(spark, [0.5] * 4, V.row_zscore) == [0.0] * 4


def test_ties_go_to_the_first_place(spark):
    ranks = one(spark, [1.0, 3.0, 3.0], V.rank_transform)
    assert np.allclose(ranks, np.array([0, 1, 0.5]) / np.sqrt(1.25))
    assert one(spark, [1.0, 3.0, 3.0], lambda s: V.keep_largest(s, 1, binary=True)) == [0.0, 1.0, 0.0]


def test_clipped_distance(spark):
    d = spark.createDataFrame([([1.0, 1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert d.select(V.cosine_distance(F.col("a"), F.col("b"))).first()[0] == 0 and d.select(V.cosine_distance(F.col("a"), F.col("b"), False)).first()[0] == -1


# ---------------------------------------------------------------- search
def test_blocks_of_queries_change_nothing(unit, monkeypatch):
    want = sorted(map(tuple, knn.top_k(unit, unit.where("vec_id < 20"), 5).collect()))
    monkeypatch.setattr(knn, "QUERY_BLOCK", 7)
    assert sorted(map(tuple, knn.top_k(unit, unit.where("vec_id < 20"), 5).collect())) == want
    assert all(q != d for q, d, *_ in want)


def test_tiles_give_what_broadcast_blocks_give(unit, monkeypatch):
    doubled = unit.union(unit.where("vec_id < 40").withColumn("vec_id", F.col("vec_id") + 1000)).cache()  # equal vectors tie
    want = sorted(map(tuple, knn.top_k(doubled, doubled, 7).collect()))
    for name, value in {"BROADCAST_QUERIES": 10, "QUERY_TILE": 130, "CORPUS_TILE": 90, "ROWS": 11, "COLUMNS": 16}.items():
        monkeypatch.setattr(knn, name, value)
    assert sorted(map(tuple, knn.top_k(doubled, doubled, 7).collect())) == want
    x, ids = array(doubled), sorted(r["vec_id"] for r in doubled.select("vec_id").collect())
    score = np.round(np.array([[(a * b).sum() for b in x] for a in x[:5]]), 12)
    for i in range(5):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-score[i, j], ids[j]))[:7]
        assert [d for q, d, *_ in sorted(want, key=lambda r: (r[0], r[3])) if q == ids[i]] == [ids[j] for j in order]


def test_tiles_of_queries_drawn_from_the_rows_by_a_join(unit, monkeypatch):
    ids = unit.where("vec_id < 30").select("vec_id")
    want = sorted(map(tuple, knn.two_stage(unit, S.signatures(unit, A.with_vectors(A.random(unit, 8), unit)), unit.join(ids, "vec_id", "left_semi"), 9, 3).collect()))
    monkeypatch.setattr(knn, "BROADCAST_QUERIES", 10)  # failed: both sides of the squares were the same frame
    assert sorted(map(tuple, knn.two_stage(unit, S.signatures(unit, A.with_vectors(A.random(unit, 8), unit)), unit.join(ids, "vec_id", "left_semi"), 9, 3).collect())) == want


def test_blocks_are_ordered_seldom(monkeypatch):
    """What a tile shows waits until as much waits as a block holds; the k best are those of one sort."""
    rng = np.random.default_rng(3)
    q, x, calls, order = rng.normal(size=(600, 8)), np.repeat(rng.normal(size=(2000, 8)), 2, axis=0), [], knn.Best._order
    monkeypatch.setattr(knn, "COLUMNS", 64)
    monkeypatch.setattr(knn.Best, "_order", lambda self, own: (calls.append(1), order(self, own))[1], raising=True)
    best = knn.Best(len(q), 40)
    knn.nearest(best, np.arange(len(q)) - 1000, q, np.arange(len(x)), x, True)
    got = sorted(zip(*best.held()))
    score = knn.exact(np.repeat(q, len(x), axis=0), np.tile(x, (len(q), 1))).reshape(len(q), -1)
    assert got == sorted((i, j, score[i, j]) for i in range(len(q)) for j in np.lexsort((np.arange(len(x)), -score[i]))[:40])
    assert len(calls) < 40  # before: one per tile, 126


def test_places_are_ranks_of_the_whole_order(unit, monkeypatch):
    both = unit.union(unit.where("vec_id < 40").withColumn("vec_id", F.col("vec_id") + 1000)).cache()  # equal vectors tie
    monkeypatch.setattr(knn, "QUERY_TILE", 13)
    monkeypatch.setattr(knn, "CORPUS_TILE", 90)
    whole = {(q, d): r for q, d, _, r in knn.top_k(both, both.where("vec_id < 20"), 10_000).collect()}
    targets = sorted(whole)[:: 97]
    got = knn.places(both, both.sparkSession.createDataFrame(targets, "query_id long, doc_id long").dropDuplicates(["query_id"])).collect()
    assert len(got) == 20 and all(whole[q, d] == r for q, d, r in got) and max(r for *_, r in got) > 250


def test_mrr_full_counts_ranks_beyond_1001(spark, tmp_path):
    from tessera.plans import search

    rng = np.random.default_rng(5)
    rows = [(i, 0, rng.normal(size=48).tolist()) for i in range(4000)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    v = search.Vectors(spark, str(tmp_path))
    deep = [r["rank"] for r in knn.places(v.sigs("row_zscore"), v.truth(1), "sig").collect()]
    assert max(deep) > 1001  # they counted 0
    assert search.mrr_full(spark, str(tmp_path)).first()[0] == round(sum(1 / r for r in deep) / len(deep), 6)


def _of_cells(index, asked, unit, pool):
    pairs = asked.withColumnRenamed("vec_id", "query_id").join(index, "cell").select("query_id", F.col("vec_id").alias("doc_id")).where("query_id <> doc_id").distinct()
    return sorted((q, d, r) for q, d, r in knn.ranked(knn.rescore(pairs, unit, unit).withColumn("score", F.round("score", 12)), pool).select("query_id", "doc_id", "rank").collect())


def test_leaves_and_cells_meet_without_pairs(unit, monkeypatch):
    """What a join of cells gives, with leaves cut into squares; copies make a large leaf."""
    both = unit.union(unit.where("vec_id < 3").crossJoin(unit.sparkSession.range(1000, 1040)).select((F.col("id") * 3 + F.col("vec_id")).alias("vec_id"), "u")).cache()
    q = both.where("vec_id % 11 = 0")
    monkeypatch.setattr(ann, "LEAF", 16)
    forest = ann.forest_build(both, trees=3, leaf=30)
    got = ann.forest_search(both, q, forest, 2, 9)
    assert sorted(map(tuple, got.select("query_id", "doc_id", "rank").collect())) == _of_cells(ann.forest_cells(both, forest), ann.forest_cells(q, forest, 2), both, 9)
    monkeypatch.setattr(knn, "QUERY_TILE", 13)
    got = ann.lsh_search(both, q, 64, 9, tables=3, bits=3)
    assert sorted(map(tuple, got.select("query_id", "doc_id", "rank").collect())) == _of_cells(ann.lsh_cells(both, 64, 3, 3), ann.lsh_cells(q, 64, 3, 3), both, 9)
    for found in (got, ann.forest_search(both, q, forest, 2, 9)):
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroups")[0]  # pairs were joined with their vectors


def test_k_beyond_the_corpus(unit):
    some = unit.where("vec_id < 4")
    assert knn.top_k(some, some, 10).count() == 12 and knn.top_k(some, some.limit(0), 3).count() == 0


def test_whole_pool_is_exact(unit):
    sigs = S.transform(S.signatures(unit, A.with_vectors(A.random(unit, 8), unit)), "row_zscore")
    q = unit.where("vec_id < 10")
    got = knn.two_stage(unit, sigs, q, 500, 5, exclude_self=True).select("query_id", "rank", "doc_id").collect()
    assert sorted(got) == sorted(knn.top_k(unit, q, 5).select("query_id", "rank", "doc_id").collect())


def test_recall_grows_with_the_pool(unit):
    sigs = S.transform(S.signatures(unit, A.with_vectors(A.random(unit, 16), unit)), "raw_l2")
    q = unit.where("vec_id >= 450")
    found = knn.top_k(sigs, sigs.where("vec_id >= 450"), 499, vec="sig")
    r = {x["pool_size"]: x["mean_recall"] for x in metrics.recall(knn.top_k(unit, q, 10), found, [(10, 25), (10, 100), (10, 499)]).collect()}
    assert r[25] <= r[100] <= r[499] == 1


def test_generations_merge_without_repeats(spark):
    rows = [(1, 5, 0.9), (1, 5, 0.7), (1, 6, 0.8), (1, 7, 0.8)]
    got = knn.merge_generations(spark.createDataFrame(rows, "query_id long, doc_id long, score double"), 3).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in got] == [(5, 0.9), (6, 0.8), (7, 0.8)]


@pytest.mark.parametrize("kind", ["ivf", "lsh", "forest"])
def test_approximate_search_has_exact_scores(unit, kind):
    q = unit.where("vec_id >= 480")
    if kind == "ivf":
        found = ann.ivf_search(unit, *ann.ivf_build(unit, 4), q, 4, 10)
    elif kind == "lsh":
        found = ann.lsh_search(unit, q, 64, 10, tables=16, bits=2)
    else:
        found = ann.forest_search(unit, q, ann.forest_build(unit, trees=12, leaf=100), 4, 10)
    recall = metrics.overlap(knn.top_k(unit, q, 10), found, 10).first()[0]
    assert recall == 1 if kind == "ivf" else recall > 0.5  # all clusters probed


def test_graphs_find_what_exact_search_finds(unit):
    q = unit.where("vec_id >= 400")
    truth = knn.top_k(unit, q, 10).cache()
    whole = graph.build(unit, shard=200).cache()
    assert whole.select("shard").distinct().count() == 3 and whole.count() == unit.count()
    found = graph.search(whole, q, 60, 10)
    assert metrics.overlap(truth, found, 10).first()[0] >= 0.95 and found.where("query_id = doc_id").count() == 0
    exact = {(r["query_id"], r["doc_id"]): r["score"] for r in truth.collect()}
    assert all(r["score"] == exact[r["query_id"], r["doc_id"]] for r in found.collect() if (r["query_id"], r["doc_id"]) in exact)
    grown = graph.insert(graph.build(unit.where("vec_id < 300"), shard=200), unit.where("vec_id >= 300"), shard=200)
    assert grown.count() == unit.count() and metrics.overlap(truth, graph.search(grown, q, 60, 10), 10).first()[0] >= 0.95


def test_graphs_are_few_and_built_once(unit, monkeypatch):
    monkeypatch.setattr(graph, "SHARDS", 2, raising=False)
    built = graph.build(unit, shard=50)
    assert built.select("shard").distinct().count() == 2 and built.storageLevel.useMemory
    q = unit.where("vec_id >= 400")
    assert metrics.overlap(knn.top_k(unit, q, 10), graph.search(built, q, 60, 10), 10).first()[0] >= 0.95


def test_graphs_of_equal_and_single_rows(spark):
    rows = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(50)] + [(99, [0.0, 1.0])], "vec_id long, u array<double>")
    found = graph.search(graph.build(rows, 4), rows.where("vec_id in (0, 99)"), 60, 60).collect()
    assert {(r["query_id"], r["doc_id"]) for r in found if r["score"] == 1.0} == {(0, k) for k in range(1, 50)}
    one = graph.build(rows.where("vec_id = 99"))
    assert [r["doc_id"] for r in graph.search(one, rows.where("vec_id = 0"), 5, 3).collect()] == [99] and graph.search(one, rows.limit(0), 5, 3).count() == 0


# ---------------------------------------------------------------- anchors
def test_smaller_anchor_sets_are_prefixes(unit):
    big, small = ([r["vec_id"] for r in A.random(unit, n).orderBy("anchor_pos").collect()] for n in (16, 8))
    assert big[:8] == small


def test_farthest_points_by_numpy(unit):
    x = array(unit)
    got = [r["vec_id"] for r in A.farthest(unit, 12).orderBy("anchor_pos").collect()]
    near = x @ x[got[0]]
    for nxt in got[1:]:
        near[np.array(got[: got.index(nxt)])] = np.inf
        assert nxt == near.argmin()
        near = np.maximum(near, x @ x[nxt])


@pytest.mark.parametrize("start", ["random", "centroid"])
def test_pool_size_changes_no_anchor(unit, start):
    pick = lambda pool: [tuple(r) for r in A.farthest(unit, 20, start=start, pool=pool).orderBy("anchor_pos").collect()]
    assert pick(3) == pick(50) == pick(10_000)


def test_more_anchors_than_rows(unit):
    assert A.farthest(unit.where("vec_id < 5"), 9).count() == 5 and A.farthest(unit.limit(0), 3).count() == 0


@pytest.mark.parametrize("pick", [A.kmeans, A.multi_scale, A.pca_extremes])
def test_sets_are_full_and_distinct(unit, pick):
    ids = [r["vec_id"] for r in pick(unit, 20).collect()]
    assert len(ids) == len(set(ids)) == 20


# ---------------------------------------------------------------- learning
def test_ridge_residual(unit):
    sigs = S.signatures(unit, A.with_vectors(A.random(unit, 24), unit))
    s, x = array(sigs, "sig"), array(unit)
    w = learn.ridge(sigs, unit, 0.3)
    assert abs((s.T @ s + 0.3 * np.eye(24)) @ w - s.T @ x).max() < 1e-6


def test_weight_gradient_by_differences():
    rng = np.random.default_rng(0)
    q, d, theta = rng.normal(size=(6, 5)), rng.normal(size=(6, 4, 5)), rng.normal(size=5)
    g = learn.weight_loss(theta, q, d, 0.5)[1]
    for k in range(5):
        e = np.eye(5)[k] * 1e-6
        assert np.isclose(g[k], (learn.weight_loss(theta + e, q, d, 0.5)[0] - learn.weight_loss(theta - e, q, d, 0.5)[0]) / 2e-6, atol=1e-5)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(1)
    q = rng.normal(size=(40, 8))
    p = q + np.where(np.arange(8) < 4, 0.1, 3.0) * rng.normal(size=q.shape)
    w = learn.anchor_weights(q, p, rng.normal(size=(40, 6, 8)), steps=80)
    assert w[:4].mean() > w[4:].mean()
    assert learn.contrastive(q, p, rng.normal(size=(40, 6, 8)), 8, steps=5).shape == (8, 8)


# ---------------------------------------------------------------- metrics and drift
def test_graded_metrics(spark):
    qrels = spark.createDataFrame([(1, 10, 2), (1, 11, 1), (2, 10, 0), (3, 12, 1)], "query_id long, doc_id long, rel int")
    found = spark.createDataFrame([(1, 1, 11), (1, 2, 10), (2, 1, 10)], "query_id long, rank long, doc_id long")
    r = metrics.graded(qrels, found, 10).first()
    ideal, got = 3 + 1 / np.log2(3), 1 + 3 / np.log2(3)
    assert (r["query_count"], r["recall"], r["mrr"]) == (2, 0.5, 0.5) and np.isclose(r["ndcg"], got / ideal / 2, atol=1e-6)


def test_grades_by_class_equal_judgements(spark, unit, table):
    classes = table.select("vec_id", "label", (F.col("vec_id") % 3).cast("int").alias("rel"))
    q = unit.where("vec_id >= 400")
    near = knn.top_k(unit, q, 10)
    pairs = q.select(F.col("vec_id").alias("query_id")).join(classes.select(F.col("vec_id").alias("query_id"), "label"), "query_id").join(classes.withColumnRenamed("vec_id", "doc_id"), "label").where("query_id <> doc_id")
    assert metrics.graded_by_class(classes, q, near, 10).first() == metrics.graded(pairs.select("query_id", "doc_id", "rel"), near, 10).first()


@pytest.mark.parametrize("buckets", [2, 256])
def test_ranks_with_ties(spark, buckets):
    values = [3.0, 1.0, 1.0, 2.0, 3.0, 3.0, -1.0, None]
    got = {r["a"]: r["rank"] for r in metrics.mean_ranks(spark.createDataFrame([(x,) for x in values], "a double"), "a", buckets).collect()}
    assert got == {-1.0: 1.0, 1.0: 2.5, 2.0: 4.0, 3.0: 6.0}
    pairs = spark.createDataFrame([(float(i % 7), float(i * i % 11)) for i in range(100)], "a double, b double")
    import pandas as pd

    want = pd.DataFrame(pairs.collect(), columns=["a", "b"]).rank().corr().iloc[0, 1]
    assert metrics.spearman(pairs).first()["spearman"] == round(want, 5)


@pytest.mark.parametrize("counts, want", [([2, 2, 2, 2], 0.0), ([8, 0, 0, 0], 0.75)])
def test_gini(spark, counts, want):
    used = spark.createDataFrame([(k, c) for k, c in enumerate(counts) if c], "anchor_pos long, c long")
    assert drift.gini(used, spark.createDataFrame([(4,)], "width int")).first()[0] == want


def test_fixed_anchors_do_not_drift(unit):
    sigs = S.signatures(unit, A.with_vectors(A.random(unit, 8), unit))
    assert drift.perturbation(sigs, sigs).first()[0] == 0


# ---------------------------------------------------------------- index
def test_insert_equals_fit_on_all(spark, table, tmp_path):
    anchors = A.random(knn.unit(table.where("vec_id < 300")), 16)
    part = VectorIndex.fit(table.where("vec_id < 300"), Settings(16), anchors).insert(table.where("vec_id >= 300"))
    whole = VectorIndex.fit(table, Settings(16), anchors)
    q = table.where("vec_id >= 490")
    rows = lambda i: sorted((r["query_id"], r["rank"], r["doc_id"]) for r in i.search(q, 5, 50).collect())
    assert rows(part) == rows(whole)
    part.save(str(tmp_path / "index"))
    assert rows(VectorIndex.load(spark, str(tmp_path / "index"))) == rows(whole)
    with pytest.raises(ValueError):
        part.insert(table.where("vec_id = 3"))
    halves = [VectorIndex.fit(table.where(F.col("vec_id") % 2 == g), Settings(16)) for g in (0, 1)]
    merged = search_generations(halves, q, 5, 500).select("query_id", "rank", "doc_id").collect()
    assert sorted(map(tuple, merged)) == sorted((r["query_id"], r["rank"], r["doc_id"]) for r in whole.search_raw(q, 5).collect())


def test_cells_that_are_all_probed_are_exact(spark, table, unit, tmp_path):
    settings = Settings(16, cells=6, probes=6)
    whole = VectorIndex.fit(table.where("vec_id < 400"), settings).insert(table.where("vec_id >= 400"))
    q = table.where("vec_id >= 470")
    rows = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"]) for r in df.collect())
    assert rows(whole.search_ann(q, 5, 60)) == rows(whole.search(q, 5, 60))
    assert rows(whole.search_raw_ann(q, 5)) == rows(whole.search_raw(q, 5))
    whole.save(str(tmp_path / "cells"))
    back = VectorIndex.load(spark, str(tmp_path / "cells"))
    assert back.settings == settings and rows(back.search_ann(q, 5, 60)) == rows(whole.search(q, 5, 60))
    few = VectorIndex(Settings(16, cells=6, probes=2), whole.anchors, whole.vectors, whole.sigs, None, whole.centres)
    found = set(rows(few.search_raw_ann(q, 5)))
    assert 0.3 < len(found & set(rows(whole.search_raw(q, 5)))) / 150
    with pytest.raises(ValueError):
        VectorIndex.fit(table, Settings(4)).search_ann(q)


def test_blocks_of_queries_probe_the_same_cells(unit, monkeypatch):
    index, centres = ann.ivf_build(unit, 8)
    find = lambda: sorted(map(tuple, ann.ivf_search(unit, index, centres, unit.where("vec_id < 60"), 2, 7).collect()))
    want = find()
    c = np.array([r["c"] for r in centres.orderBy("cell").collect()])
    assert all(r["cell"] == int((c @ np.array(r["u"])).argmax()) for r in ann.assign(unit, centres).collect())
    monkeypatch.setattr(knn, "QUERY_BLOCK", 13)
    monkeypatch.setattr(knn, "ROWS", 3)
    assert find() == want and all(q != d for q, d, *_ in want)


class Captured:
    """Stands for rows: keeps the function that a search sends to the tasks."""

    def __init__(self, spark):
        self.sparkSession = spark

    def where(self, *_):
        return self

    select = where

    def mapInArrow(self, run, schema):
        self.run = run
        return self.sparkSession.createDataFrame([], schema)


def peak(f):
    """MB that a call holds at most, in numpy and in Arrow."""
    import tracemalloc

    import pyarrow as pa

    usual = pa.default_memory_pool()
    pool = pa.proxy_memory_pool(usual)
    pa.set_memory_pool(pool)
    tracemalloc.start()
    try:
        f()
        return (tracemalloc.get_traced_memory()[1] + pool.max_memory()) / 1e6
    finally:
        tracemalloc.stop()
        pa.set_memory_pool(usual)


def test_cell_search_gathers_few_pairs_at_once(spark):
    import pyarrow as pa

    rng, held = np.random.default_rng(3), Captured(spark)
    x = rng.normal(size=(10_000, 64))
    q = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x[:1023])], "vec_id long, u array<double>")
    ann.cell_search(held, spark.createDataFrame([(0, [1.0] * 64)], "cell long, c array<double>"), q, 1, 100)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), pa.array(list(x)), pa.array(np.zeros(len(x), np.int64))], names=["vec_id", "u", "cell"])
    assert peak(lambda: list(held.run(iter([batch])))) < 80


def test_squares_hold_rows_once(spark, monkeypatch):
    import pyarrow as pa

    rng, sent = np.random.default_rng(3), []
    monkeypatch.setattr(knn, "squares", lambda rows, asked, run, schema: sent.append(run))
    knn._tiled(None, None, 5, True)
    x = rng.normal(size=(65_536, 64))
    table = pa.table({"vec_id": np.arange(len(x)), "u": pa.array(list(x))})
    table = pa.concat_tables([table.slice(i, 10_000) for i in range(0, len(x), 10_000)])
    assert peak(lambda: sent[0](table.slice(0, 100), table)) < 40


def test_texts_in_an_index(spark):
    rows = [(k, f"word{k} word{k + 1} common") for k in range(40)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    index = VectorIndex.fit_texts(texts.where("doc_id < 30"), models.hashing_embedder, Settings(12)).insert_texts(texts.where("doc_id >= 30"))
    found = index.search_text(texts.where("doc_id in (3, 35)"), 2, 40).where("rank = 1").collect()
    assert {r["query_id"]: r["doc_id"] for r in found} == {3: 3, 35: 35}
    index.embedder = None
    with pytest.raises(ValueError):
        index.search_text(texts)
    took = latency(lambda: texts, 40, 1)
    assert took["ms_per_query"] > 0


def test_wrong_settings():
    with pytest.raises(ValueError):
        VectorIndex.fit(None, Settings(transform="other"))


# ---------------------------------------------------------------- texts
@pytest.mark.parametrize("n, want", [(79, 0), (80, 1), (320, 1), (321, 2), (440, 2), (441, 3)])
def test_chunks(spark, n, want):
    got = corpus.chunked(spark.createDataFrame([(1, "x" * n)], "doc_id long, text string"), "doc_id").collect()
    assert len(got) == want and all(80 <= len(r["text"]) <= 320 for r in got)


def test_rules_in_order(spark):
    rows = ["class A:\n  assert x", "class A:", "x.__y__", "raise E", "open(f)", "a", "a\n" * 10, "a\n" * 30]
    df = spark.createDataFrame(list(enumerate(rows)), "k int, t string").select("k", T.query_type(F.col("t")).alias("q")).orderBy("k")
    assert [r["q"] for r in df.collect()] == ["test_assert", "class_def", "dunder", "error_handling", "io", "short", "medium", "long"]


def test_stable_ids_and_fields(spark):
    import hashlib

    df = spark.createDataFrame([("a", " ", 1, None, "x"), (None, "p/q", 2, " ", "y"), ("  ", None, 3, "z", None)], "id string, path string, line long, text string, code string")
    out = corpus.with_text(df, "code").withColumn("sid", T.stable_id(F.col("id"), F.col("path"), F.col("line"), F.col("text"))).orderBy("line").collect()
    h = lambda t: hashlib.sha1(t.encode()).hexdigest()[:16]
    assert [(r["text"], r["text_field"], r["sid"]) for r in out] == [("x", "code", "a"), ("y", "code", f"p/q-{h('y')}"), ("z", "text", f"generated-3-{h('z')}")]


def test_tokens_and_jaccard(spark):
    r = spark.createDataFrame([("Ab_1 c 42 ab_1",)], "t string").select(T.tokenize(F.col("t")).alias("a"), T.jaccard(F.array(), F.array()).alias("j")).first()
    assert r["a"] == ["ab_1", "42", "ab_1"] and r["j"] == 0


def test_lexical_search_scores_few_pairs(spark, monkeypatch):
    """Folds of terms bound the scores, so only pairs near the k best are scored; coded rows are those of the weights."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1000, (60, 30))  # ten near copies of each
    texts = [" ".join(f"w{x}" for x in [*base[i // 10, 3:], *rng.integers(0, 1000, 3)]) for i in range(600)]
    docs = spark.createDataFrame([*enumerate(texts), (600, "none"), (601, None)], "doc_id long, text string").coalesce(1)
    w = lexical.fitted_weights(docs, 1000, 2).cache()
    at = {t: k for k, t in enumerate(sorted({r["term"] for r in w.collect()}))}
    x = np.zeros((602, len(at)))
    for r in w.collect():
        x[r["doc_id"], at[r["term"]]] = r["w"]
    score = np.round(x @ x.T, 9)
    np.fill_diagonal(score, -1)
    want = [(q, k + 1, int(d), score[q, d]) for q in range(0, 600, 7) for k, d in enumerate(np.lexsort((np.arange(602), -score[q]))[:5]) if score[q, d] > 0]
    monkeypatch.setattr(lexical, "FOLDS", 300)
    rows, width = lexical.fitted_rows(docs, 1000, 2)
    got = lexical.search_rows(rows, rows.where("doc_id % 7 = 0 AND doc_id < 600"), width, 5)
    assert sorted(map(tuple, got.select("query_id", "rank", "doc_id", "score").collect())) == want and width == len(at) > 300
    held = sorted(map(tuple, rows.collect()))
    size = np.array([len(r[1]) // 4 for r in held])
    p, v = (np.frombuffer(b"".join(r[k] for r in held), kind) for k, kind in ((1, np.int32), (2, np.float64)))
    q = np.zeros((len(held), width))
    q[np.repeat(np.arange(len(held)), size), p] = v
    fold, ids, scored = lexical.folds(size, p, v, width), np.array([r[0] for r in held]), []
    assert sorted(set(fold.tolist())) == list(range(300))
    own = lexical.products
    monkeypatch.setattr(lexical, "products", lambda *a: scored.append(len(a[-1])) or own(*a))
    lexical._nearest(lexical.knn.Best(len(held), 5), ids, q, lexical.lengths(size, p, v, fold), ids, size, p, v, fold)
    assert sum(scored) < len(held) ** 2 / 10


def test_counts_need_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "B b a_1 7"), (2, "b \u212a\u0130x1 cc"), (3, None), (4, "")], "doc_id long, text string")
    got = lexical.counts(docs)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(1, "7", 1), (1, "a_1", 1), (2, "cc", 1), (2, "x1", 1)]
    assert sorted(map(tuple, lexical.frequencies(docs.where("doc_id = 1").union(docs.where("doc_id = 1"))).collect())) == [("7", 1, 2), ("a_1", 1, 2)]
    names = docs.select(F.concat(F.lit("d"), "doc_id").alias("name"), "text")
    assert {r["doc_id"] for r in lexical.counts(names, "name").collect()} == {"d1", "d2"}


def test_lexical_search_by_numpy(spark, monkeypatch):
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in rng.integers(0, 12, 6))) for i in range(60)] + [(60, "other"), (61, None)], "doc_id long, text string")
    w = lexical.fitted_weights(docs, 100, 1).cache()
    monkeypatch.setattr(lexical, "QUERY_CELLS", 60)
    monkeypatch.setattr(lexical, "ROW_CELLS", 30)
    got = sorted(map(tuple, lexical.search(w, w.where("doc_id % 5 = 0"), 4).select("query_id", "rank", "doc_id", "score").collect()))
    by: dict = {}
    for r in w.collect():
        by.setdefault(r["doc_id"], {})[r["term"]] = r["w"]
    want = []
    for q in (i for i in by if i % 5 == 0):
        score = {d: round(sum(x * by[d].get(t, 0) for t, x in by[q].items()), 9) for d in by if d != q}
        order = sorted((d for d, x in score.items() if x > 0), key=lambda d: (-score[d], d))[:4]
        want += [(q, k, d, score[d]) for k, d in enumerate(order, 1)]
    assert [r[:3] for r in got] == [r[:3] for r in sorted(want)] and np.allclose([r[3] for r in got], [r[3] for r in sorted(want)])


def test_first_of_text_with_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (1, "b", 2), (2, "a", 3), (0, None, 4)], "doc_id long, text string, x int")
    assert sorted((r["doc_id"], r["text"] or "") for r in corpus.first_of_text(df, "doc_id").collect()) == [(0, ""), (1, "a"), (1, "b")]


def test_hybrid_order(spark):
    lex = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "query_id long, doc_id long, rank long")
    dense = spark.createDataFrame([(1, 8, 1), (1, 9, 2)], "query_id long, doc_id long, rank long")
    ids = spark.range(20).withColumnRenamed("id", "doc_id")
    assert [r["doc_id"] for r in lexical.hybrid(lex, dense, ids, 6, 2).orderBy("rank").collect()] == [7, 8, 9, 0, 2, 3]


def test_plug_ins(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red fox"), (3, None)], "doc_id long, text string")
    got = {r["vec_id"]: r["embedding"] for r in models.embed(docs, models.hashing_embedder).collect()}
    assert got[1] == got[2] and set(got[3]) == {0.0}
    pairs = spark.createDataFrame([(1, 2), (1, 2), (1, 3)], "query_id long, doc_id long")
    out = models.rerank_pairs(pairs, docs.fillna(""), lambda: lambda p: np.array([[0, float(a == b)] for a, b in p]), 2).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in out] == [(2, 1.0), (3, 0.0)]
    tokens = spark.createDataFrame([(1, 1, [2.0]), (1, 0, [9.0]), (2, 0, [1.0])], "vec_id long, mask int, v array<double>")
    assert {r["vec_id"]: r["embedding"] for r in models.mean_pool(tokens).collect()} == {1: [2.0], 2: [0.0]}


def test_what_models_return(spark, tmp_path):
    mask, tokens, flat = np.array([[1, 1], [1, 0]]), np.array([[[3.0, 0], [0, 4]], [[0, 2], [9, 9]]]), np.array([[0.0, 5], [1, 0]])
    mean = np.array([[0.6, 0.8], [0, 1]])
    record = type("Output", (), {"pooler_output": flat, "last_hidden_state": tokens})
    for output, want in ((tokens, mean), ((tokens,), mean), ({"last_hidden_state": tokens}, mean), (record, [[0, 1], [1, 0]]), (flat, [[0, 1], [1, 0]])):
        assert np.allclose(models.pooled(output, mask), want)
    assert np.allclose(models.pooled(record, mask, prefer_pooler=False), mean) and models.pooled(np.array([3.0, 4]), mask).shape == (1, 2)
    with pytest.raises(TypeError):
        models.pooled("text", mask)

    class Both:
        is_encoder_decoder = True

        def encoder(self, ids):  # takes no names
            return np.array([[len(i), 1.0] for i in ids])

    embed = models.wrapped(lambda t: {"input_ids": t, "attention_mask": None}, Both(), "passage: ")
    assert np.allclose(embed(["ab"]), np.array([[11, 1]]) / np.sqrt(122))

    def broken():
        raise OSError("no such model")

    docs = spark.createDataFrame([(1, "red fox")], "doc_id long, text string")
    done, failed = models.embed_models(docs, {"a/b": models.hashing_embedder, "c": broken}, str(tmp_path))
    assert set(done) == {"a/b"} and set(failed) == {"c"} and done["a/b"].count() == 1
    again, _ = models.embed_models(docs, {"a/b": broken}, str(tmp_path))  # cached: not computed again
    assert again["a/b"].count() == 1
    with pytest.raises(RuntimeError):
        models.embed_models(docs, {"c": broken}, str(tmp_path / "none"))


def test_padding():
    got = models.padded(lambda t: [ord(c) for c in t], 1, 2, 0, 5)(["abcdef", "x", ""])
    assert got["input_ids"].tolist() == [[1, 97, 98, 99, 2], [1, 120, 2, 0, 0], [1, 2, 0, 0, 0]] and got["attention_mask"].sum(1).tolist() == [5, 3, 2]


def test_pairs_of_two_rows(spark):
    got = metrics.sampled_pairs(7, 500, spark).collect()
    assert 350 < len(got) < 500 and {i for i, _ in got} == set(range(7)) and all(i != j for i, j in got)


def test_coerced_values(spark):
    df = spark.createDataFrame([(bytearray(b"a\xc3\xa9"), ["x", None, "y"]), (None, None)], "b binary, l array<string>")
    got = df.select(corpus.coerced(F.col("b"), "binary"), corpus.coerced(F.col("l"), "array<string>"), corpus.coerced(F.lit(None).cast("int"))).collect()
    assert [tuple(r) for r in got] == [("a\u00e9", "x y", ""), ("", "", "")]


def test_chunk_corpus_needs_enough(spark):
    df = spark.createDataFrame([(1, "x" * 500), (2, "y" * 500)], "doc_id long, text string")
    assert [r["id"] for r in corpus.chunk_corpus(df, "doc_id", 4).collect()] == ["1:0", "1:1", "1:2", "2:0"]
    with pytest.raises(ValueError):
        corpus.chunk_corpus(df, "doc_id", 9)


def test_expansion(unit):
    out = corpus.expanded(unit, 700, noise=0.01)
    assert out.count() == 700 and np.allclose(np.linalg.norm(array(out), axis=1), 1) and corpus.expanded(unit, 10).count() == 10


def test_signatures_are_made_once(spark, sf):
    """Not once per block of queries: what is scanned is cached."""
    from tessera.plans.search import Vectors

    v = Vectors(spark, sf)
    for found in (v.near(v.sigs("rank"), 5), v.truth(5)):
        assert "InMemoryTableScan" in found._jdf.queryExecution().executedPlan().toString()
    spark.catalog.clearCache()


def test_medoids_shuffle_no_rows(spark, monkeypatch):
    """A cluster's medoid is found on the map side; equal rows go by their ids."""
    from tessera.operators import anchors as A

    rows = spark.createDataFrame([(5, [1.0, 0.0], 0), (3, [1.0, 0.0], 0), (1, [0.6, 0.8], 0), (4, [0.0, 1.0], 1), (2, [-1.0, 0.0], 1)], "vec_id long, u array<double>, cluster int")
    monkeypatch.setattr(A, "_kmeans", lambda *a: (rows, np.array([[1.0, 0.0], [0.0, 1.0]])))
    monkeypatch.setattr(A, "unique_fill", lambda parts, *a: parts[0])
    for boundary, want in ((False, [(0, 3), (1, 4)]), (True, [(0, 1), (1, 2)])):
        found = A.kmeans(rows, 2, boundary)
        assert "partial_min" in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, found.collect())) == want
