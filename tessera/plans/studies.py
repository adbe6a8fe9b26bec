"""Study tables: models against each other, anchors by transforms, growth, inserts, scale, systems."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import anchors as A
from tessera.operators import ann, knn, learn, models, studies
from tessera.operators import corpus as C
from tessera.operators import signatures as S
from tessera.operators.index import Settings, VectorIndex
from tessera.plans import corpus
from tessera.plans.search import ANCHORS, SIG, TRUTH, R, U, Vectors, a_sql, near_sql, s_sql, scored, v_sql, z_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ models
#: Stand-ins for three models of the same rows: all dimensions, the first half, the second half.
MODELS = {"full": (1, 64), "head": (1, 32), "tail": (33, 64)}
KINDS = ("raw_embedding_neighbors", "anchor_relative_signature_neighbors")
_NEAR = """{name} AS (SELECT * FROM (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.v, b.v) DESC, b.vec_id) AS rank
  FROM {of} a JOIN {of} b ON a.vec_id <> b.vec_id) WHERE rank <= 10)"""
_MRR = "(SELECT {r} FROM (SELECT t.query_id, min(c.rank) AS r FROM {a} t LEFT JOIN {b} c ON c.query_id = t.query_id AND c.doc_id = t.doc_id WHERE t.rank = 1 GROUP BY 1))"


def _grid_sql() -> str:
    parts, rows = [], []
    for m, (lo, hi) in MODELS.items():
        parts += [
            f"e_{m} AS (SELECT vec_id, list_transform(e, lambda x: x / greatest(sqrt(list_inner_product(e, e)), 1e-12)) AS v FROM (SELECT vec_id, CAST(embedding AS DOUBLE[])[{lo}:{hi}] AS e FROM embeddings))",
            f"a_{m} AS (SELECT * FROM (SELECT row_number() OVER (ORDER BY md5('7:' || vec_id), vec_id) - 1 AS p, v AS av FROM e_{m}) WHERE p < {ANCHORS})",
            f"s_{m} AS (SELECT vec_id, p, list_inner_product(v, av) AS x FROM e_{m}, a_{m})",
            z_sql(f"z_{m}", f"s_{m}"),
            v_sql(f"g_{m}", f"z_{m}"),
            _NEAR.format(name=f"n0_{m}", of=f"e_{m}"),
            _NEAR.format(name=f"n1_{m}", of=f"g_{m}"),
        ]
    parts.append("pairs AS (SELECT vec_id AS i, (vec_id * 31 + 7) % (SELECT count(*) FROM embeddings) AS j FROM embeddings)")
    for a, b in studies.model_pairs(MODELS):
        for k, kind in enumerate(KINDS):
            of = ("e_", "g_")[k]
            d = lambda m: f"round(1 - list_inner_product((SELECT v FROM {of}{m} WHERE vec_id = i), (SELECT v FROM {of}{m} WHERE vec_id = j)), 9)"  # noqa: E731, B023
            r = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"
            mrr = lambda x, y: _MRR.format(r=R("avg(coalesce(1.0 / r, 0.0))"), a=f"n{k}_{x}", b=f"n{k}_{y}")  # noqa: E731, B023
            rows.append(
                f"SELECT '{kind}' AS representation, '{a}' AS a, '{b}' AS b, {mrr(a, b)} AS mrr_a_to_b, {mrr(b, a)} AS mrr_b_to_a, "
                f"(SELECT {R('avg(h)')} FROM (SELECT t.query_id, count(c.rank) / count(*) AS h FROM n{k}_{a} t LEFT JOIN n{k}_{b} c ON c.query_id = t.query_id AND c.doc_id = t.doc_id GROUP BY 1)) AS topk_overlap, "
                f"(SELECT {R('corr(ra, rb)', 5)} FROM (SELECT {r.format('da')} AS ra, {r.format('db')} AS rb FROM (SELECT {d(a)} AS da, {d(b)} AS db FROM pairs WHERE i <> j))) AS sampled_spearman"
            )
    return "WITH " + ",\n".join(parts) + "\n" + "\nUNION ALL ".join(rows)


@query(_grid_sql())
def cross_model_grid(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    models = {}
    for m, (lo, hi) in MODELS.items():
        part = v.table.select("vec_id", F.slice("embedding", lo, hi - lo + 1).alias("embedding"))
        own = knn.unit(part)
        sigs = S.transform(S.signatures(own, A.with_vectors(A.random(own, ANCHORS), own)), "row_zscore")
        models[m] = dict(zip(KINDS, (own, sigs.withColumnRenamed("sig", "u"))))
    pairs = v.all.select(F.col("vec_id").alias("i"), ((F.col("vec_id") * 31 + 7) % v.n).alias("j"))
    return studies.model_grid(models, v.all, pairs, 10)


# ------------------------------------------------------------------ anchors by transforms
STRATEGIES, TRANSFORMS, POOLS = ("random", "random_8", "stratified"), ("raw_l2", "row_zscore", "rank", "top8", "binary_top8", "centered", "zscore"), (25, 100)


def _ablation_sql() -> str:
    stratified = f"""(SELECT vec_id FROM (SELECT vec_id, h, CAST(k > greatest(1, {ANCHORS} // (SELECT count(DISTINCT label) FROM embeddings)) AS INT) AS late FROM
      (SELECT vec_id, md5('7:' || vec_id) AS h, row_number() OVER (PARTITION BY label ORDER BY md5('7:' || vec_id), vec_id) AS k FROM embeddings)) ORDER BY late, h, vec_id LIMIT {ANCHORS})"""
    parts = [U, TRUTH, a_sql(name="a_random"), a_sql(seed=8, name="a_random_8"), f"a_stratified AS (SELECT row_number() OVER (ORDER BY md5('7:' || vec_id), vec_id) - 1 AS p, vec_id AS aid, u AS au FROM u WHERE vec_id IN {stratified})"]
    rows = []
    for st in STRATEGIES:
        parts.append(s_sql(f"s_{st}", f"a_{st}"))
        for tr in TRANSFORMS:
            own = SIG[tr].replace("FROM s WINDOW", f"FROM s_{st} WINDOW").replace("FROM s)", f"FROM s_{st})")
            parts += [own.replace("o AS (", f"o_{st}_{tr} AS (", 1), v_sql(f"v_{st}_{tr}", f"o_{st}_{tr}"), near_sql(f"c_{st}_{tr}", max(POOLS), f"v_{st}_{tr}", digits=knn.SCORE_DIGITS)]
            for p in POOLS:
                rows.append(
                    f"SELECT '{st}' AS anchor_strategy, '{tr}' AS transform, CAST(10 AS BIGINT) AS top_k, CAST({p} AS BIGINT) AS pool_size, count(*) AS query_count, {R('avg(hits / 10)')} AS mean_recall, {R('avg(CAST(hits = 10 AS DOUBLE))')} AS all_top_k_contained, {R('avg(CAST(hits > 0 AS DOUBLE))')} AS any_hit "
                    f"FROM (SELECT t.query_id, count(c.rank) AS hits FROM t LEFT JOIN c_{st}_{tr} c ON c.query_id = t.query_id AND c.doc_id = t.doc_id AND c.rank <= {p} GROUP BY 1)"
                )
    return "WITH " + ",\n".join(parts) + "\n" + "\nUNION ALL ".join(rows)


@query(_ablation_sql())
def anchor_ablation(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    strata = v.table.select("vec_id", F.col("label").alias("stratum"))
    chosen = {"random": A.random(v.all, ANCHORS), "random_8": A.random(v.all, ANCHORS, 8), "stratified": A.stratified(strata, ANCHORS)}
    systems = {}
    for strategy, anchors in chosen.items():
        raw = S.signatures(v.all, A.with_vectors(anchors, v.all)).cache()
        for kind in TRANSFORMS:
            systems[strategy, kind] = v.near(S.transform(raw, kind), max(POOLS))
    return studies.sweep(v.truth(), systems, ["anchor_strategy", "transform"], [(10, p) for p in POOLS])


# ------------------------------------------------------------------ growth, inserts, scale
_N = "(SELECT count(*) FROM embeddings)"
_HALF = f"CAST(floor({_N} * 0.5) AS BIGINT)"
FRACTIONS = (0.1, 0.25, 0.5, 1.0)


def _growth_sql() -> str:
    full = lambda f: f"least({_N}, {_HALF} + CAST(round_even({_HALF} * {f}, 0) AS BIGINT))"
    anchors = lambda limit: f"(SELECT row_number() OVER (ORDER BY md5('7:' || vec_id), vec_id) - 1 AS p, u AS au FROM u WHERE vec_id < {limit} ORDER BY md5('7:' || vec_id), vec_id LIMIT {ANCHORS})"
    sigs = lambda limit: f"(SELECT u.vec_id, p, list_inner_product(u, au) AS x FROM u, {anchors(limit)} WHERE vec_id < {_HALF})"
    rows = []
    for f in FRACTIONS:
        both = f"SELECT sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))) AS c FROM {sigs(_HALF)} a JOIN {sigs(full(f))} b USING (vec_id, p) GROUP BY vec_id"
        rows.append(f"SELECT CAST({f} AS DOUBLE) AS expansion_fraction, {_HALF} AS baseline_docs, {full(f)} AS full_docs, CAST(0 AS DOUBLE) AS stable_anchor_drift, (SELECT {R('1 - avg(c)')} FROM ({both})) AS refit_anchor_drift")
    return f"WITH {U} " + " UNION ALL ".join(rows)


@query(_growth_sql())
def growth_drift(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    return studies.growth(v.all, int(v.n * 0.5), A.random(v.all, v.n), FRACTIONS, ANCHORS)


def _sizes(n: int) -> list[int]:
    return [int(n * 0.5), int(n * 0.75), n]


_SIZES = {k: f"CAST(floor({_N} * {k}) AS BIGINT)" for k in (0.5, 0.75, 1)}
INSERT_POOLS = [25, 100]


def _insert_sql() -> str:
    parts = [U, f"a AS (SELECT row_number() OVER (ORDER BY md5('7:' || vec_id), vec_id) - 1 AS p, u AS au FROM u WHERE vec_id < {_HALF} ORDER BY md5('7:' || vec_id), vec_id LIMIT {ANCHORS})", s_sql(), z_sql(), v_sql()]
    rows = []
    for k, (share, size) in enumerate(_SIZES.items()):
        near = lambda name, of, col, n: f"{name} AS (SELECT * FROM (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.{col}, b.{col}) DESC, b.vec_id) AS rank FROM {of} a JOIN {of} b ON a.vec_id <> b.vec_id AND a.vec_id % 5 = 0 AND a.vec_id < {size} AND b.vec_id < {size}) WHERE rank <= {n})"  # noqa: E731, B023
        parts += [near(f"t{k}", "u", "u", 10), near(f"c{k}", "zv", "v", max(INSERT_POOLS))]
        for method, pool in [("relation_only", 10), *(("rerank", p) for p in INSERT_POOLS)]:
            if method == "rerank":
                found = f"(SELECT query_id, doc_id FROM (SELECT c.query_id, c.doc_id, row_number() OVER (PARTITION BY c.query_id ORDER BY list_inner_product(x.u, y.u) DESC, c.doc_id) AS rank FROM c{k} c JOIN u x ON x.vec_id = c.query_id JOIN u y ON y.vec_id = c.doc_id WHERE c.rank <= {pool}) WHERE rank <= 10)"
            else:
                found = f"(SELECT query_id, doc_id FROM c{k} WHERE rank <= 10)"
            rows.append(
                f"SELECT {size} AS doc_count, '{method}' AS method, CAST({pool} AS BIGINT) AS pool, count(*) AS query_count, {R('avg(hits / 10)')} AS mean_recall, {R('avg(CAST(hits = 10 AS DOUBLE))')} AS all_top_k_contained, {R('avg(CAST(hits > 0 AS DOUBLE))')} AS any_hit, "
                f"(SELECT {R('avg(p)')} FROM (SELECT avg(CAST(x.label = y.label AS DOUBLE)) AS p FROM {found} f JOIN u x ON x.vec_id = f.query_id JOIN u y ON y.vec_id = f.doc_id GROUP BY f.query_id)) AS label_precision "
                f"FROM (SELECT t.query_id, count(f.doc_id) AS hits FROM t{k} t LEFT JOIN {found} f ON f.query_id = t.query_id AND f.doc_id = t.doc_id GROUP BY 1)"
            )
    return "WITH " + ",\n".join(parts) + "\n" + "\nUNION ALL ".join(rows)


def _stages(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    half = v.all.where(F.col("vec_id") < int(v.n * 0.5))
    anchors = A.with_vectors(A.random(half, ANCHORS), half)
    return studies.stages(v.all, anchors, _sizes(v.n), lambda c: c.where("vec_id % 5 = 0"), "row_zscore", 10, INSERT_POOLS, v.table.select("vec_id", "label"))


@query(_insert_sql())
def dynamic_insert(spark, sf_dir):
    """Frozen anchors while rows are inserted: quality at half, three quarters and all of the rows."""
    return _stages(spark, sf_dir)[0]


@query()
def dynamic_insert_drift(spark, sf_dir):
    return _stages(spark, sf_dir)[1]


def _scale_sql() -> str:
    rows, parts = [], [U]
    for k, share in enumerate((0.25, 0.5, 1)):
        n = f"CAST(floor({_N} * {share}) AS BIGINT)"
        cut = f"CAST(floor({n} * 0.8) AS BIGINT)"
        near = lambda name, of, col, m: f"{name} AS (SELECT * FROM (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.{col}, b.{col}) DESC, b.vec_id) AS rank FROM {of} a JOIN {of} b ON a.vec_id <> b.vec_id AND a.vec_id >= {cut} AND a.vec_id < {n} AND b.vec_id < {n}) WHERE rank <= {m})"  # noqa: E731, B023
        parts += [
            f"a{k} AS (SELECT row_number() OVER (ORDER BY md5('7:' || vec_id), vec_id) - 1 AS p, u AS au FROM u WHERE vec_id < {cut} ORDER BY md5('7:' || vec_id), vec_id LIMIT {ANCHORS})",
            s_sql(f"s{k}", f"a{k}"),
            z_sql(f"z{k}", f"s{k}"),
            v_sql(f"v{k}", f"z{k}"),
            near(f"t{k}", "u", "u", 10),
            near(f"c{k}", f"v{k}", "v", 25),
        ]
        for p in (10, 25):
            rows.append(f"SELECT {n} AS doc_count, CAST(10 AS BIGINT) AS top_k, CAST({p} AS BIGINT) AS pool_size, count(*) AS query_count, {R('avg(hits / 10)')} AS mean_recall, {R('avg(CAST(hits = 10 AS DOUBLE))')} AS all_top_k_contained, {R('avg(CAST(hits > 0 AS DOUBLE))')} AS any_hit, {R(f'{n} * {ANCHORS} * 4 / 1e6')} AS vector_mb FROM (SELECT t.query_id, count(c.rank) AS hits FROM t{k} t LEFT JOIN c{k} c ON c.query_id = t.query_id AND c.doc_id = t.doc_id AND c.rank <= {p} GROUP BY 1)")
    return "WITH " + ",\n".join(parts) + "\n" + "\nUNION ALL ".join(rows)


def _scaled(v: Vectors, n: int):
    """The first n rows, their training part, queries, truth and signatures by anchors of the training part."""
    own = v.all.where(F.col("vec_id") < n)
    train, q = own.where(F.col("vec_id") < int(n * 0.8)), own.where(F.col("vec_id") >= int(n * 0.8))
    sigs = S.transform(S.signatures(own, A.with_vectors(A.random(train, ANCHORS), train)), "row_zscore").cache()
    return own, train, q, knn.top_k(own, q, 10), sigs


@query(_scale_sql())
def scale_relation(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    rows = []
    for n in (int(v.n * 0.25), int(v.n * 0.5), v.n):
        _, _, q, truth, sigs = _scaled(v, n)
        found = knn.top_k(sigs, sigs.join(q.select("vec_id"), "vec_id", "left_semi"), 25, vec="sig")
        one = studies.sweep(truth, {(n,): found}, ["doc_count"], [(10, 10), (10, 25)])
        rows.append(one.withColumn("doc_count", F.col("doc_count").cast("long")).withColumn("vector_mb", V.rounded(F.lit(n * ANCHORS * 4 / 1e6))))
    return studies.together(rows)


@query()
def ridge_sweep(spark, sf_dir):
    """Signature search as it is, and after ridge projections of several penalties and targets."""
    v = Vectors(spark, sf_dir)
    own, train, q, truth, sigs = _scaled(v, v.n)
    near = lambda s: knn.top_k(s, s.join(q.select("vec_id"), "vec_id", "left_semi"), 25, vec="sig")
    systems = {("cosine_relation", "none", 0.0): near(sigs)}
    fit = sigs.join(train.select("vec_id"), "vec_id", "left_semi")
    for target in ("raw", "pca_raw"):
        for penalty in (0.01, 0.1, 1.0):
            w = learn.ridge(fit, train, penalty, rotated=target == "pca_raw")
            systems["ridge_bilinear", target, penalty] = near(S.project(sigs, w, "sig", "sig", normalize=True))
    return studies.sweep(truth, systems, ["method", "target", "ridge_reg"], [(10, 10), (10, 25)])


# ------------------------------------------------------------------ systems
_HIT = "LEFT JOIN {0} c ON c.query_id = t.query_id AND c.doc_id = t.doc_id AND c.rank <= {1}"
_SYSTEMS = {"raw_dense_pool25": ("d", 25), "ridge_free_relation_pool25": ("rc", 25), "ridge_free_relation_pool50": ("rc", 50), "lexical_dense_hybrid": ("h", 50)}


def _router_sql() -> str:
    parts = f""", tt AS (SELECT * FROM d WHERE rank <= 10), {a_sql()}, {s_sql().replace('s AS', 'sg AS', 1)}, {z_sql('z', 'sg')}, {v_sql()}, {near_sql('rc', 50)},
k AS (SELECT doc_id, list_distinct({corpus.TOKENS}) AS t FROM documents)"""
    rows = []
    for name, (of, pool) in _SYSTEMS.items():
        parts += f""", f_{name} AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
 SELECT g.query_id, g.doc_id, round({corpus._BLEND}, 9) AS score FROM {of} g JOIN u x ON x.vec_id = g.query_id JOIN u y ON y.vec_id = g.doc_id JOIN k s ON s.doc_id = g.query_id JOIN k e ON e.doc_id = g.doc_id WHERE g.rank <= {pool}))"""
        held = f"SELECT {R('avg(CAST(hits = 10 AS DOUBLE))')} FROM (SELECT t.query_id, count(c.rank) AS hits FROM tt t {_HIT.format(of, pool)} GROUP BY 1)"
        rows.append(f"""SELECT '{name}' AS system, CAST({pool} AS BIGINT) AS candidate_pool, ({held}) AS containment, count(*) AS query_count, {R('avg(hit / 10)')} AS final_recall, {R('avg(coalesce(1.0 / first, 0.0))')} AS final_mrr,
 {R('avg(coalesce(dcg / (SELECT sum(1.0 / log2(k + 1)) FROM range(1, 11) r(k)), 0.0))')} AS final_ndcg, {R('avg(CAST(hit = 10 AS DOUBLE))')} AS final_all_contained
 FROM (SELECT t.query_id, count(c.rank) AS hit, min(c.rank) AS first, sum(1.0 / log2(c.rank + 1)) AS dcg FROM tt t {_HIT.format(f'f_{name}', 10)} GROUP BY 1)""")
    return corpus._BOTH + parts + " " + " UNION ALL ".join(rows)


def _candidates(spark, sf_dir):
    v, both, hybrid = corpus._hybrid(spark, sf_dir)
    dense, relation = v.truth(30), v.near(v.sigs("row_zscore"), 50)
    return v, both, {"raw_dense_pool25": (dense, 25), "ridge_free_relation_pool25": (relation, 25), "ridge_free_relation_pool50": (relation, 50), "lexical_dense_hybrid": (hybrid, 50)}


def _blended(v: Vectors, docs):
    tokens = docs.select("doc_id", T.token_set(F.col("text")).alias("td")).cache()

    def final(found):
        both = knn.rescore(found.select("query_id", "doc_id"), v.all, v.all).join(tokens, "doc_id").join(tokens.select(F.col("doc_id").alias("query_id"), F.col("td").alias("tq")), "query_id")
        return knn.rerank(both, F.round(0.65 * F.col("score") + 0.35 * T.jaccard(F.col("tq"), F.col("td")), 9), 10)

    return final


@query(_router_sql())
def router_systems(spark, sf_dir):
    """Candidates of several routers, all reranked by the same blend of cosine and token overlap."""
    v, docs, systems = _candidates(spark, sf_dir)
    return studies.routed(systems, v.truth(10), _blended(v, docs), 10)


@query()
def router_systems_ivf(spark, sf_dir):
    """The same for inverted lists, and for a ridge projection of the signatures."""
    v = Vectors(spark, sf_dir)
    docs = corpus.docs(spark, sf_dir).join(v.all.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    index, centres = ann.ivf_build(v.all, 16)
    train = v.all.where(F.col("vec_id") < v.cut)
    ridge = v.near(learn.relation_vectors(v.all, train, ANCHORS), 50)
    systems = {"cluster_ivf_baseline": (ann.ivf_search(v.all, index, centres, v.queries, 4, 50), 50), "ridge_relation_pool25": (ridge, 25), "ridge_relation_pool50": (ridge, 50)}
    return studies.routed(systems, v.truth(10), _blended(v, docs), 10)


# ------------------------------------------------------------------ validation
_ROWS = "SELECT doc_id AS line, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN '13' ELSE CAST(doc_id AS VARCHAR) END AS id, text, source AS description, lang FROM documents"


@query(f"""WITH r AS ({_ROWS}), w AS (SELECT *, {corpus.STRIP.replace('text', "coalesce(text, '')")} AS own, {corpus.STRIP.replace('text', "coalesce(description, '')")} AS other FROM r),
t AS (SELECT line, id, lang, CASE WHEN own <> '' THEN own ELSE other END AS t, CASE WHEN own <> '' THEN 'text' ELSE 'description' END AS field FROM w),
s AS (SELECT *, coalesce(id, 'generated-' || line || '-' || left(sha1(t), 16)) AS sid, CASE WHEN length(t) = 0 THEN 'empty_text' WHEN length(t) < 50 THEN 'too_short' WHEN length(t) > 4000 THEN 'too_long' END AS early FROM t),
k AS (SELECT *, coalesce(early, CASE WHEN row_number() OVER (PARTITION BY CASE WHEN early IS NULL THEN t ELSE CAST(line AS VARCHAR) || early END ORDER BY line) > 1 THEN 'duplicate_texts' ELSE 'kept' END) AS status FROM s)
SELECT 'rows' AS kind, 'total_rows' AS name, count(*) AS n FROM k UNION ALL SELECT 'rows', status, count(*) FROM k GROUP BY 2
UNION ALL SELECT 'ids', 'generated_ids', count(*) FROM k WHERE id IS NULL UNION ALL SELECT 'ids', 'duplicate_ids', count(*) - count(DISTINCT sid) FROM k
UNION ALL SELECT 'fields', field, count(*) FROM k WHERE status = 'kept' GROUP BY 2 UNION ALL (SELECT 'languages', coalesce(lang, 'unknown'), count(*) AS n FROM k WHERE status = 'kept' GROUP BY 2 ORDER BY n DESC, 2 LIMIT 20)""")
def corpus_validation(spark, sf_dir):
    rows = corpus.docs(spark, sf_dir).select(
        F.col("doc_id").alias("line"),
        F.when(F.col("doc_id") % 11 == 0, None).when(F.col("doc_id") % 13 == 0, "13").otherwise(F.col("doc_id").cast("string")).alias("id"),
        "text",
        F.col("source").alias("description"),
        "lang",
    )
    return C.validation(rows, "line")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN left(text, 20) ELSE lang || ' ' || source END AS value FROM documents")
def coerced_texts(spark, sf_dir):
    """Null, bytes and lists as texts."""
    d = corpus.docs(spark, sf_dir)
    none = d.where("doc_id % 3 = 0").select("doc_id", C.coerced(F.lit(None).cast("string")).alias("value"))
    raw = d.where("doc_id % 3 = 1").select("doc_id", F.substring("text", 1, 20).cast("binary").alias("b"))
    raw = raw.select("doc_id", C.coerced(F.col("b"), "binary").alias("value"))
    lists = d.where("doc_id % 3 = 2").select("doc_id", C.coerced(F.array("lang", "source"), "array<string>").alias("value"))
    return none.union(raw).union(lists)


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN text ELSE source END AS code, CASE WHEN lang = 'de' THEN source WHEN lang = 'fr' THEN lang ELSE '' END AS docstring FROM documents")
def code_pickers(spark, sf_dir):
    """The first column that is not blank, of those that code corpora use."""
    d = corpus.docs(spark, sf_dir)
    only = lambda c, lang: F.when(F.col("lang") == lang, F.col(c))
    rows = d.select("doc_id", only("text", "en").alias("code"), F.lit(" ").alias("func_code_string"), F.col("source").alias("original_string"), F.lit(None).cast("string").alias("docstring"), only("source", "de").alias("func_documentation_string"), only("lang", "fr").alias("summary"))
    rows = C.picked(rows, C.CODE, "picked_code")
    return C.picked(rows, C.DOCSTRING, "picked_docstring").select("doc_id", F.col("picked_code").alias("code"), F.col("picked_docstring").alias("docstring"))


@query(f"SELECT doc_id FROM (SELECT doc_id FROM documents WHERE doc_id >= {corpus._N} ORDER BY md5('7:' || doc_id), doc_id LIMIT 100)")
def query_sample(spark, sf_dir):
    """A seeded sample of held-out queries."""
    d = corpus.docs(spark, sf_dir)
    return C.query_sample(d.where(F.col("doc_id") >= int(d.count() * 0.8)), "doc_id", 100).select("doc_id")


@query(f"""WITH m AS (SELECT label, md5('7:' || vec_id) AS h, vec_id FROM embeddings), a AS (SELECT row_number() OVER (ORDER BY h, vec_id) - 1 AS p, vec_id FROM m ORDER BY h, vec_id LIMIT 64)
SELECT row_number() OVER (ORDER BY (p * 37) % 64 DESC, p) - 1 AS anchor_pos, vec_id FROM (SELECT * FROM a ORDER BY (p * 37) % 64 DESC, p LIMIT 16)""")
def anchors_heaviest(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    return A.heaviest(A.random(v.all, 64), [float(p * 37 % 64) for p in range(64)], 16).select("anchor_pos", "vec_id")


# ------------------------------------------------------------------ the index
@query()
def index_ann_search(spark, sf_dir):
    """Two-stage search of an index with inverted lists, half of whose rows were inserted after it was fitted."""
    v = Vectors(spark, sf_dir)
    half = F.col("vec_id") < int(v.n * 0.5)
    index = VectorIndex.fit(v.table.where(half), Settings(ANCHORS, cells=16, probes=4)).insert(v.table.where(~half), check_ids=False)
    return scored(index.search_ann(v.table.where(F.col("vec_id") >= v.cut), 10, 100))


@query()
def index_text_search(spark, sf_dir):
    """Documents as texts, by the hashing embedder; queries are the documents whose id 100 divides."""
    d = corpus.docs(spark, sf_dir).select("doc_id", "text")
    index = VectorIndex.fit_texts(d, models.hashing_embedder, Settings(ANCHORS))
    return scored(index.search_text(d.where("doc_id % 100 = 0"), 10, 100))
