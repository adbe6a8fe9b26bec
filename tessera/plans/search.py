"""Queries over embeddings: neighbours, signatures, anchors, search, quality, drift, learning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import anchors as A
from tessera.operators import ann, drift, graph, knn, learn, metrics
from tessera.operators import signatures as S

ANCHORS, POOLS = 32, (25, 50, 100, 250)
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


class Vectors:
    """The frames that most queries begin with."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
        self.all = knn.unit(self.table).cache()  # every block of queries scans it
        self.n = self.table.count()
        self.cut = int(self.n * 0.8)
        self.queries = self.all.where(F.col("vec_id") >= self.cut)

    def anchors(self, count: int = ANCHORS, seed: int = A.SEED) -> DataFrame:
        return A.with_vectors(A.random(self.all, count, seed), self.all)

    def sigs(self, kind: str = "raw", count: int = ANCHORS, seed: int = A.SEED) -> DataFrame:
        train = F.col("vec_id") < self.cut
        return S.transform(S.signatures(self.all, self.anchors(count, seed)), kind, train)

    def near(self, sigs: DataFrame, k: int) -> DataFrame:
        """Top k by signature, the query excluded; signatures are made once, and not per block of queries."""
        sigs = sigs.cache()
        return knn.top_k(sigs, sigs.where(F.col("vec_id") >= self.cut), k, vec="sig")

    def truth(self, k: int = 10) -> DataFrame:
        return knn.top_k(self.all, self.queries, k)


def scored(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", "doc_id", V.rounded(F.col("score")).alias("score"))


# ------------------------------------------------------------------ SQL pieces
U = """u AS (SELECT vec_id, label, list_transform(e, lambda x: x / greatest(sqrt(list_inner_product(e, e)), 1e-12)) AS u
  FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)),
q AS (SELECT * FROM u WHERE vec_id >= (SELECT CAST(floor(count(*) * 0.8) AS BIGINT) FROM embeddings))"""


def a_sql(count=ANCHORS, seed=7, name="a"):
    return f"{name} AS (SELECT * FROM (SELECT row_number() OVER (ORDER BY md5('{seed}:' || vec_id), vec_id) - 1 AS p, vec_id AS aid, u AS au FROM u) WHERE p < {count})"


def s_sql(name="s", of="a"):
    return f"{name} AS (SELECT u.vec_id, p, list_inner_product(u, au) AS x FROM u, {of})"


def norm_sql(inner, name):
    return f"{name} AS (SELECT vec_id, p, t / greatest(sqrt(sum(t * t) OVER (PARTITION BY vec_id)), 1e-12) AS y FROM ({inner}))"


def z_sql(name="z", of="s"):
    return norm_sql(f"SELECT vec_id, p, (x - avg(x) OVER w) / greatest(stddev_pop(x) OVER w, 1e-6) AS t FROM {of} WINDOW w AS (PARTITION BY vec_id)", name)


def v_sql(name="zv", of="z"):
    return f"{name} AS (SELECT vec_id, list(y ORDER BY p) AS v FROM {of} GROUP BY vec_id)"


def near_sql(name, k, of="zv", own=True, digits=None):
    """``digits``: ranked by the score to so many digits, for signatures of few distinct values, whose products tie."""
    keep = "AND a.vec_id <> b.vec_id" if own else ""
    by = "list_inner_product(a.v, b.v)" if digits is None else f"round(list_inner_product(a.v, b.v), {digits})"
    return f"""{name} AS (SELECT * FROM (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_inner_product(a.v, b.v) AS score,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY {by} DESC, b.vec_id) AS rank
  FROM {of} a JOIN {of} b ON a.vec_id IN (SELECT vec_id FROM q) {keep}) WHERE rank <= {k})"""


UV = "uv AS (SELECT vec_id, u AS v FROM u)"
TRUTH = f"{UV}, {near_sql('t', 10, 'uv')}"
CAND = f"{a_sql()}, {s_sql()}, {z_sql()}, {v_sql()}, {near_sql('c', 250)}"
BASE = f"WITH {U}, {TRUTH}, {CAND} "
R = lambda x, d=6: f"round({x}, {d}) + 0.0"


# ------------------------------------------------------------------ vectors
@query(f"WITH {U} SELECT u.vec_id, {R('sqrt(list_inner_product(e, e))')} AS norm, {R('u[1]')} AS first_value FROM u JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) USING (vec_id)")
def vec_l2_normalize(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", V.doubles("embedding").alias("e"))
    return t.select("vec_id", V.rounded(F.sqrt(V.dot(F.col("e"), F.col("e")))).alias("norm"), V.rounded(V.l2_normalize(F.col("e"))[0]).alias("first_value"))


@query(f"WITH {U}, {TRUTH} SELECT query_id, rank, doc_id, {R('score')} AS score FROM t")
def knn_exact_top10(spark, sf_dir):
    return scored(Vectors(spark, sf_dir).truth())


PAIRS_SQL = "SELECT a.vec_id AS i, b.vec_id AS j, a.u AS ua, b.u AS ub FROM u a JOIN u b ON b.vec_id = (a.vec_id * 31 + 7) % (SELECT count(*) FROM u) AND a.vec_id <> b.vec_id"


def _pairs(v: Vectors, frame: DataFrame, col: str) -> DataFrame:
    """(i, j, a, b): each row with one other, drawn by a rule."""
    a = frame.select(F.col("vec_id").alias("i"), F.col(col).alias("a")).withColumn("j", (F.col("i") * 31 + 7) % v.n)
    return a.join(frame.select(F.col("vec_id").alias("j"), F.col(col).alias("b")), "j").where("i <> j")


@query(f"WITH {U} SELECT i, j, {R('1 - greatest(-1.0, least(1.0, list_inner_product(ua, ub)))')} AS distance FROM ({PAIRS_SQL})")
def cosine_distance_pairs(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    return _pairs(v, v.all, "u").select("i", "j", V.rounded(V.cosine_distance(F.col("a"), F.col("b"))).alias("distance"))


@query(f"""WITH {U}, {a_sql()}, {s_sql()}, {z_sql()}, {v_sql()}, p AS (SELECT i, j, list_inner_product(ua, ub) AS a FROM ({PAIRS_SQL})),
d AS (SELECT round(1 - a, 9) AS a, round(1 - list_inner_product(x.v, y.v), 9) AS b FROM p JOIN zv x ON x.vec_id = i JOIN zv y ON y.vec_id = j),
r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM d)
SELECT count(*) AS n, {R('corr(ra, rb)', 5)} AS spearman FROM r""")
def spearman_dist_pairs(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    d = lambda f, c, n: _pairs(v, f, c).select("i", "j", F.round(1 - V.dot(F.col("a"), F.col("b")), 9).alias(n))
    return metrics.spearman(d(v.all, "u", "a").join(d(v.sigs("row_zscore"), "sig", "b"), ["i", "j"]))


# ------------------------------------------------------------------ signatures
COLSTAT = "avg(x) OVER (PARTITION BY p)"
COLSTD = "greatest(stddev_pop(x) OVER (PARTITION BY p), 1e-6)"
TRAIN = "vec_id < (SELECT CAST(floor(count(*) * 0.8) AS BIGINT) FROM embeddings)"
PLACE = "row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, p)"
SIG = {
    "raw": "SELECT vec_id, p, x AS y FROM s",
    "raw_l2": norm_sql("SELECT vec_id, p, x AS t FROM s", "o"),
    "row_zscore": z_sql("o"),
    "rank": norm_sql(f"SELECT vec_id, p, 1.0 - ({PLACE} - 1) / {ANCHORS - 1}.0 AS t FROM s", "o"),
    "centered": norm_sql(f"SELECT vec_id, p, x - {COLSTAT} AS t FROM s", "o"),
    "zscore": norm_sql(f"SELECT vec_id, p, (x - {COLSTAT}) / {COLSTD} AS t FROM s", "o"),
    "col_zscore": norm_sql(f"SELECT vec_id, p, (x - m) / sd AS t FROM s JOIN (SELECT p, avg(x) AS m, greatest(stddev_pop(x), 1e-6) AS sd FROM s WHERE {TRAIN} GROUP BY p) USING (p)", "o"),
    "row_col_zscore": f"{z_sql()}, " + norm_sql(f"SELECT vec_id, p, (y - m) / sd AS t FROM z JOIN (SELECT p, avg(y) AS m, greatest(stddev_pop(y), 1e-6) AS sd FROM z WHERE {TRAIN} GROUP BY p) USING (p)", "o"),
    "softmax_0.1": norm_sql("SELECT vec_id, p, exp((x - max(x) OVER (PARTITION BY vec_id)) / 0.1) AS t FROM s", "o"),
    "top8": norm_sql(f"SELECT vec_id, p, CASE WHEN {PLACE} <= 8 THEN x ELSE 0.0 END AS t FROM s", "o"),
    "binary_top8": norm_sql(f"SELECT vec_id, p, CASE WHEN {PLACE} <= 8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS t FROM s", "o"),
    "sign_centered": norm_sql(f"SELECT vec_id, p, CASE WHEN x > {COLSTAT} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS t FROM s", "o"),
}
for _kind, _sql in SIG.items():
    _o = f"o AS ({_sql})" if _kind == "raw" else _sql
    QUERIES[f"sig_{_kind.replace('.', '_')}"] = lambda spark, sf_dir, kind=_kind: S.long_form(Vectors(spark, sf_dir).sigs(kind))
    SQL[f"sig_{_kind.replace('.', '_')}"] = f"WITH {U}, {a_sql()}, {s_sql()}, {_o} SELECT vec_id, p AS anchor_pos, {R('y')} AS value FROM o"


@query(f"WITH {U}, {a_sql()}, s AS (SELECT u.vec_id, p, list_inner_product(u, au) * (0.5 + p / 32.0) AS x FROM u, a), {z_sql('o')} SELECT vec_id, p AS anchor_pos, {R('y')} AS value FROM o")
def sig_weighted_before(spark, sf_dir):
    return S.long_form(S.weighted(Vectors(spark, sf_dir).sigs("raw"), [0.5 + k / 32 for k in range(ANCHORS)]))


@query(f"WITH {U}, {a_sql()}, {s_sql()}, {z_sql()}, {norm_sql('SELECT vec_id, p, y * (0.5 + p / 32.0) AS t FROM z', 'o')} SELECT vec_id, p AS anchor_pos, {R('y')} AS value FROM o")
def sig_weighted_after(spark, sf_dir):
    return S.long_form(S.weighted(Vectors(spark, sf_dir).sigs("raw"), [0.5 + k / 32 for k in range(ANCHORS)], after=True))


# ------------------------------------------------------------------ anchors
def _placed(df: DataFrame) -> DataFrame:
    return df.select("anchor_pos", "vec_id")


@query(f"WITH {U}, {a_sql()} SELECT p AS anchor_pos, aid AS vec_id FROM a")
def anchors_random(spark, sf_dir):
    return _placed(A.random(Vectors(spark, sf_dir).all, ANCHORS))


@query(f"""WITH r AS (SELECT vec_id, md5('7:' || vec_id) AS h, row_number() OVER (PARTITION BY label ORDER BY md5('7:' || vec_id), vec_id) AS k FROM embeddings),
o AS (SELECT vec_id, h, CAST(k > greatest(1, {ANCHORS} // (SELECT count(DISTINCT label) FROM embeddings)) AS INT) AS late FROM r)
SELECT row_number() OVER (ORDER BY late, h, vec_id) - 1 AS anchor_pos, vec_id FROM (SELECT * FROM o ORDER BY late, h, vec_id LIMIT {ANCHORS})""")
def anchors_stratified(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("label").alias("stratum"))
    return _placed(A.stratified(t, ANCHORS))


def _farthest_sql(first: str) -> str:
    return f"""WITH RECURSIVE {U}, f AS ({first}),
g(k, id, near) AS (SELECT 0, f.id, (SELECT list(list_inner_product(u.u, x.u) ORDER BY u.vec_id) FROM u, u x WHERE x.vec_id = f.id) FROM f
 UNION ALL SELECT k + 1, n.id, (SELECT list(greatest(m, list_inner_product(u.u, x.u)) ORDER BY u.vec_id) FROM (SELECT unnest(n.masked) AS m, unnest(range(0, len(n.masked))) AS vec_id) mm JOIN u USING (vec_id), u x WHERE x.vec_id = n.id)
 FROM (SELECT k, masked, list_position(masked, list_min(masked)) - 1 AS id FROM (SELECT k, list_transform(near, lambda s, i: CASE WHEN i - 1 = id THEN 9.0 ELSE s END) AS masked FROM g WHERE k < {ANCHORS - 1})) n)
SELECT CAST(k AS BIGINT) AS anchor_pos, CAST(id AS BIGINT) AS vec_id FROM g"""


@query(_farthest_sql("SELECT vec_id AS id FROM u ORDER BY md5('7:' || vec_id), vec_id LIMIT 1"))
def anchors_farthest(spark, sf_dir):
    return _placed(A.farthest(Vectors(spark, sf_dir).all, ANCHORS))


@query(_farthest_sql("SELECT arg_max(vec_id, s) AS id FROM (SELECT u.vec_id, sum(x * m) AS s FROM (SELECT vec_id, unnest(u) AS x, unnest(range(0, len(u))) AS d FROM u) u JOIN (SELECT d, avg(x) AS m FROM (SELECT unnest(u) AS x, unnest(range(0, len(u))) AS d FROM u) GROUP BY d) USING (d) GROUP BY u.vec_id)"))
def anchors_farthest_centroid(spark, sf_dir):
    return _placed(A.farthest(Vectors(spark, sf_dir).all, ANCHORS, start="centroid"))


_DENSITY = f"""WITH {U}, n AS (SELECT a.vec_id, 1 - list_inner_product(a.u, b.u) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.u, b.u) DESC, b.vec_id) AS r FROM u a JOIN u b ON a.vec_id <> b.vec_id),
m AS (SELECT vec_id, round(avg(d), 9) AS d FROM n WHERE r <= 20 GROUP BY vec_id), """
_TOP = "{n} AS (SELECT * FROM (SELECT row_number() OVER (ORDER BY d {o}, vec_id) - 1 AS anchor_pos, vec_id FROM m) WHERE anchor_pos < {k})"
SQL["anchors_density_dense"] = _DENSITY + _TOP.format(n="x", o="ASC", k=ANCHORS) + " SELECT * FROM x"
SQL["anchors_density_sparse"] = _DENSITY + _TOP.format(n="x", o="DESC", k=ANCHORS) + " SELECT * FROM x"
SQL["anchors_density_mixed"] = _DENSITY + _TOP.format(n="x", o="ASC", k=ANCHORS // 2) + ", " + _TOP.format(n="y", o="DESC", k=ANCHORS // 2) + f"""
SELECT row_number() OVER (ORDER BY part, anchor_pos) - 1 AS anchor_pos, vec_id FROM (SELECT 0 AS part, * FROM x UNION ALL SELECT 1, * FROM y)"""
for _mode in ("dense", "sparse", "mixed"):
    QUERIES[f"anchors_density_{_mode}"] = lambda spark, sf_dir, mode=_mode: _placed(A.density(Vectors(spark, sf_dir).all, ANCHORS, mode))


@query(BASE + f""", x AS (SELECT t.query_id, t.doc_id FROM t LEFT JOIN c ON c.query_id = t.query_id AND c.doc_id = t.doc_id AND c.rank <= 25 WHERE c.doc_id IS NULL),
b AS (SELECT 0 AS part, p AS k, aid AS vec_id FROM a WHERE p < 8
 UNION ALL SELECT 1, row_number() OVER (ORDER BY n DESC, doc_id) - 1, doc_id FROM (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id)
 UNION ALL SELECT 2, row_number() OVER (ORDER BY query_id) - 1, query_id FROM (SELECT DISTINCT query_id FROM x)
 UNION ALL SELECT 3, row_number() OVER (ORDER BY md5('7:' || vec_id), vec_id) - 1, vec_id FROM u),
f AS (SELECT vec_id, part, k FROM b QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY part, k) = 1)
SELECT row_number() OVER (ORDER BY part, k) - 1 AS anchor_pos, vec_id FROM f ORDER BY part, k LIMIT {ANCHORS}""")
def anchors_hard_negative(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    return _placed(A.hard_negative(v.all, A.random(v.all, 8), v.queries, v.truth(), v.near(v.sigs("row_zscore"), 25), ANCHORS))


@query()
def anchors_kmeans_medoid(spark, sf_dir):
    return _placed(A.kmeans(Vectors(spark, sf_dir).all, ANCHORS))


@query()
def anchors_kmeans_boundary(spark, sf_dir):
    return _placed(A.kmeans(Vectors(spark, sf_dir).all, ANCHORS, boundary=True))


@query()
def anchors_stratified_kmeans(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = table.select("vec_id", V.l2_normalize(V.doubles("embedding")).alias("u"), F.col("label").alias("stratum"))
    return _placed(A.stratified_kmeans(rows.cache(), ANCHORS))


@query()
def anchors_pca_extremes(spark, sf_dir):
    return _placed(A.pca_extremes(Vectors(spark, sf_dir).all, ANCHORS))


@query()
def anchors_multi_scale(spark, sf_dir):
    return _placed(A.multi_scale(Vectors(spark, sf_dir).all, ANCHORS))


# ------------------------------------------------------------------ search
@query(f"""WITH {U}, {UV}, {a_sql()}, {s_sql()}, {z_sql()}, {v_sql()}, {near_sql('c', 100, own=False)},
r AS (SELECT c.query_id, c.doc_id, c.score AS relative_score, list_inner_product(x.u, y.u) AS score FROM c JOIN u x ON x.vec_id = c.query_id JOIN u y ON y.vec_id = c.doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r)
SELECT query_id, rank, doc_id, {R('score')} AS score, {R('relative_score')} AS relative_score FROM o WHERE rank <= 10""")
def two_stage_search(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    found = knn.two_stage(v.all, v.sigs("row_zscore"), v.queries, 100, 10)
    return found.select("query_id", "rank", "doc_id", V.rounded(F.col("score")).alias("score"), V.rounded(F.col("relative_score")).alias("relative_score"))


@query(f"WITH {U}, {CAND} SELECT query_id, rank, doc_id, {R('score')} AS score FROM c WHERE rank <= 10")
def relation_only_search(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    return scored(v.near(v.sigs("row_zscore"), 10))


_GEN = "round(list_inner_product(x.u, y.u), 9)"


@query(f"""WITH {U}, g AS (SELECT x.vec_id AS query_id, y.vec_id AS doc_id, {_GEN} AS score,
 row_number() OVER (PARTITION BY x.vec_id, y.vec_id % 2 ORDER BY {_GEN} DESC, y.vec_id) AS r FROM q x JOIN u y ON x.vec_id <> y.vec_id),
m AS (SELECT query_id, doc_id, max(score) AS score FROM g WHERE r <= 10 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM m)
SELECT query_id, rank, doc_id, {R('score')} AS score FROM o WHERE rank <= 10""")
def multi_generation_search(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    parts = [knn.top_k(v.all.where(F.col("vec_id") % 2 == g), v.queries, 10).select("query_id", "doc_id", F.round("score", 9).alias("score")) for g in (0, 1)]
    return scored(knn.merge_generations(parts[0].union(parts[1]), 10))


# ------------------------------------------------------------------ quality
def _recall_sql(grid):
    g = ", ".join(f"({k}, {p})" for k, p in grid)
    return BASE + f""", g(top_k, pool_size) AS (VALUES {g}),
h AS (SELECT top_k, pool_size, t.query_id, count(*) AS size, sum(CAST(coalesce(c.rank, 99999) <= pool_size AS INT)) AS hits FROM g JOIN t ON t.rank <= top_k LEFT JOIN c ON c.query_id = t.query_id AND c.doc_id = t.doc_id GROUP BY ALL)
SELECT CAST(top_k AS BIGINT) AS top_k, CAST(pool_size AS BIGINT) AS pool_size, count(*) AS query_count, {R('avg(hits / size)')} AS mean_recall, {R('avg(CAST(hits = size AS DOUBLE))')} AS all_top_k_contained, {R('avg(CAST(hits > 0 AS DOUBLE))')} AS any_hit FROM h GROUP BY ALL"""


_POOL_GRID = [(10, p) for p in POOLS]
_FULL_GRID = [(k, p) for k in (1, 5, 10) for p in (10, 25, 50, 75, 100)]


@query(_recall_sql(_POOL_GRID))
def recall_by_pool(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    return metrics.recall(v.truth(), v.near(v.sigs("row_zscore"), 250), _POOL_GRID)


@query(_recall_sql(_FULL_GRID))
def recall_grid(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    return metrics.recall(v.truth(), v.near(v.sigs("row_zscore"), 100), [(k, p) for k, p in _FULL_GRID if k < v.n and p < v.n])


_HIT = "LEFT JOIN c ON c.query_id = t.query_id AND c.doc_id = t.doc_id AND c.rank <= {p}"


@query(BASE + f", h AS (SELECT t.query_id, count(*) AS size, count(c.rank) AS hits FROM t {_HIT.format(p=100)} GROUP BY 1) SELECT count(*) AS query_count, {R('avg(CAST(hits = size AS DOUBLE))')} AS containment FROM h")
def containment(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    return metrics.containment(v.truth(), v.near(v.sigs("row_zscore"), 100), 10, 100)


@query(BASE + f", h AS (SELECT t.query_id, count(*) AS size, count(c.rank) AS hits FROM t {_HIT.format(p=10)} GROUP BY 1) SELECT {R('avg(hits / size)')} AS overlap FROM h")
def topk_overlap(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    return metrics.overlap(v.truth(), v.near(v.sigs("row_zscore"), 10), 10)


@query(BASE + f"SELECT {R('avg(CAST(t.doc_id = c.doc_id AS DOUBLE))')} AS top1_overlap FROM t JOIN c ON c.query_id = t.query_id AND c.rank = 1 WHERE t.rank = 1")
def top1_overlap(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    return metrics.top1(v.truth(1), v.near(v.sigs("row_zscore"), 1))


def _mrr_sql(limit):
    return BASE + f", h AS (SELECT t.query_id, min(c.rank) AS r FROM t {_HIT.format(p=limit)} WHERE t.rank = 1 GROUP BY 1) SELECT {R('avg(coalesce(1.0 / r, 0.0))')} AS mrr FROM h"


@query(_mrr_sql(10))
def mrr_windowed(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    return metrics.mrr(v.truth(1), v.near(v.sigs("row_zscore"), 10), 10)


_ALL = 9223372036854775807  # every rank


@query(f"WITH {U}, {TRUTH}, {a_sql()}, {s_sql()}, {z_sql()}, {v_sql()}, {near_sql('c', _ALL)}" + _mrr_sql(_ALL).removeprefix(BASE))
def mrr_full(spark, sf_dir):
    """The rank counts however deep it is."""
    v = Vectors(spark, sf_dir)
    truth = v.truth(1).cache()
    return metrics.mrr(truth, knn.places(v.sigs("row_zscore").cache(), truth, "sig"), v.n)


@query(f"WITH {U}, {TRUTH}, h AS (SELECT t.query_id, avg(CAST(x.label = y.label AS DOUBLE)) AS p FROM t JOIN u x ON x.vec_id = t.query_id JOIN u y ON y.vec_id = t.doc_id GROUP BY 1) SELECT count(*) AS query_count, {R('avg(p)')} AS label_precision FROM h")
def label_precision(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    return metrics.label_precision(v.truth(), v.table.select("vec_id", "label"), v.queries, 10)


@query(f"""WITH {U}, {TRUTH}, r AS (SELECT x.vec_id AS query_id, y.vec_id AS doc_id, 1 + y.vec_id % 2 AS rel FROM q x JOIN u y ON x.label = y.label AND x.vec_id <> y.vec_id),
i AS (SELECT query_id, sum(CASE WHEN k <= 10 THEN (2.0 ** rel - 1) / log2(k + 1) END) AS ideal, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS k FROM r) GROUP BY 1),
g AS (SELECT t.query_id, sum((2.0 ** rel - 1) / log2(rank + 1)) AS dcg, count(*) AS hit, min(rank) AS first FROM t JOIN r USING (query_id, doc_id) GROUP BY 1)
SELECT count(*) AS query_count, {R('avg(coalesce(hit / n, 0.0))')} AS recall, {R('avg(coalesce(1.0 / first, 0.0))')} AS mrr, {R('avg(coalesce(dcg / ideal, 0.0))')} AS ndcg FROM i LEFT JOIN g USING (query_id)""")
def ir_metrics_graded(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    classes = v.table.select("vec_id", "label", (1 + F.col("vec_id") % 2).alias("rel"))
    return metrics.graded_by_class(classes, v.queries, v.truth(), 10)


@query(BASE + f""", h AS (SELECT t.query_id, count(*) AS size, count(c.rank) AS hit, min(c.rank) AS first, sum(1.0 / log2(c.rank + 1)) AS dcg FROM t {_HIT.format(p=10)} GROUP BY 1)
SELECT count(*) AS query_count, {R('avg(hit / size)')} AS recall, {R('avg(coalesce(1.0 / first, 0.0))')} AS mrr,
 {R('avg(coalesce(dcg / (SELECT sum(1.0 / log2(k + 1)) FROM range(1, 11) r(k)), 0.0))')} AS ndcg, {R('avg(CAST(hit = size AS DOUBLE))')} AS all_contained FROM h""")
def ir_metrics_binary(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    return metrics.binary(v.truth(), v.near(v.sigs("row_zscore"), 10), 10)


@query(BASE + f"SELECT t.doc_id, count(*) AS n FROM t {_HIT.format(p=25)} WHERE c.doc_id IS NULL GROUP BY 1")
def missed_documents(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    return metrics.missed(v.truth(), v.near(v.sigs("row_zscore"), 25), 10, 25)


# ------------------------------------------------------------------ drift
_DRIFT = f"""e AS (SELECT vec_id, avg(x) AS m, max(x) AS t, arg_max(p, x) AS best, list(x ORDER BY p) AS l FROM s GROUP BY vec_id),
n AS (SELECT vec_id, sum(-w / z * ln(greatest(w / z, 1e-12))) AS h FROM (SELECT s.vec_id, exp(x - t) AS w, sum(exp(x - t)) OVER (PARTITION BY s.vec_id) AS z FROM s JOIN e USING (vec_id)) GROUP BY vec_id),
c AS (SELECT a.p, count(e.vec_id) AS c FROM a LEFT JOIN (SELECT vec_id, list_position(l, t) - 1 AS best FROM e) e ON e.best = a.p GROUP BY a.p),
g AS (SELECT sum((2 * i - {ANCHORS} - 1) * c) / ({ANCHORS}.0 * sum(c)) AS gini FROM (SELECT c, row_number() OVER (ORDER BY c) AS i FROM c))
SELECT count(*) AS doc_count, {R('avg(m)')} AS mean_anchor_similarity, {R('avg(t)')} AS mean_top_anchor_similarity, {R('avg(h)')} AS mean_signature_entropy, (SELECT {R('CAST(gini AS DOUBLE)')} FROM g) AS anchor_usage_gini FROM e JOIN n USING (vec_id)"""


@query(f"WITH {U}, {a_sql()}, {s_sql()}, {_DRIFT}")
def drift_stats(spark, sf_dir):
    return drift.statistics(Vectors(spark, sf_dir).sigs("raw"))


@query(f"WITH {U}, {a_sql()}, {a_sql(seed=8, name='b')}, {s_sql()}, {s_sql('r', 'b')}, {norm_sql('SELECT vec_id, p, x AS t FROM s', 'x')}, {norm_sql('SELECT vec_id, p, x AS t FROM r', 'y')} SELECT {R('1 - avg(d)')} AS drift FROM (SELECT x.vec_id, sum(x.y * y.y) AS d FROM x JOIN y ON x.vec_id = y.vec_id AND x.p = y.p GROUP BY 1)")
def perturbation_drift(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    return drift.perturbation(v.sigs("raw"), v.sigs("raw", seed=8))


_HALF = "(SELECT CAST(floor(count(*) * 0.5) AS BIGINT) FROM embeddings)"


@query(f"""WITH {U}, p AS (SELECT x.vec_id AS query_id, y.vec_id AS doc_id, list_inner_product(x.u, y.u) AS s FROM u x JOIN u y ON x.vec_id <> y.vec_id AND x.vec_id < {_HALF}),
b AS (SELECT query_id, doc_id FROM p WHERE doc_id < {_HALF} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) <= 10),
a AS (SELECT query_id, doc_id FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) <= 10),
h AS (SELECT a.query_id, count(b.doc_id) AS kept, sum(CAST(a.doc_id >= {_HALF} AS INT)) AS inserted FROM a LEFT JOIN b USING (query_id, doc_id) GROUP BY 1)
SELECT count(*) AS query_count, {R('avg(CAST(kept < 10 AS DOUBLE))')} AS changed_fraction, {R('avg(inserted)')} AS mean_inserted, {R('avg(kept / 10)')} AS retained_overlap FROM h""")
def neighbor_change(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    half = int(v.n * 0.5)
    old = v.all.where(F.col("vec_id") < half)
    return drift.neighbour_change(knn.top_k(old, old, 10), knn.top_k(v.all, old, 10), half, 10)


_COUNTS = (8, 16, 32, 64)


@query("WITH " + ", ".join([U, TRUTH, *(x for m in _COUNTS for x in (a_sql(m, name=f"a{m}"), s_sql(f"s{m}", f"a{m}"), norm_sql(f"SELECT vec_id, p, x AS t FROM s{m}", f"z{m}"), v_sql(f"v{m}", f"z{m}"), near_sql(f"c{m}", 10, f"v{m}")))]) + " " + " UNION ALL ".join(f"SELECT CAST({m} AS BIGINT) AS anchor_count, {R('avg(h)')} AS overlap FROM (SELECT t.query_id, count(c.rank) / count(*) AS h FROM t LEFT JOIN c{m} c ON c.query_id = t.query_id AND c.doc_id = t.doc_id GROUP BY 1)" for m in _COUNTS))
def anchor_count_sweep(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    truth, out = v.truth().cache(), None
    sigs = S.signatures(v.all, v.anchors(max(_COUNTS))).cache()
    for m in _COUNTS:  # smaller sets are prefixes
        own = sigs.withColumn("sig", V.l2_normalize(F.slice("sig", 1, m)))
        row = metrics.overlap(truth, v.near(own, 10), 10).select(F.lit(m).cast("long").alias("anchor_count"), "overlap")
        out = row if out is None else out.union(row)
    return out


@query(f"WITH {U}, {a_sql()}, {a_sql(seed=8, name='b')}, {s_sql()}, {s_sql('r', 'b')}, {norm_sql('SELECT vec_id, p, x AS t FROM s', 'x')}, {norm_sql('SELECT vec_id, p, x AS t FROM r', 'y')}, {v_sql('xv', 'x')}, {v_sql('yv', 'y')}, {near_sql('t', 10, 'xv')}, {near_sql('c', 10, 'yv')}, m AS (SELECT t.query_id, min(c.rank) AS r FROM t {_HIT.format(p=10)} WHERE t.rank = 1 GROUP BY 1), o AS (SELECT t.query_id, count(c.rank) / count(*) AS h FROM t {_HIT.format(p=10)} GROUP BY 1) SELECT (SELECT {R('avg(coalesce(1.0 / r, 0.0))')} FROM m) AS mrr, (SELECT {R('avg(h)')} FROM o) AS overlap")
def reselection_instability(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    return drift.instability(v.all, v.anchors(), v.anchors(seed=8), v.queries, 10)


@query(f"SELECT {R('n * d * 4 / 1e6')} AS raw_float32_mb, {R('n * 32 * 4 / 1e6')} AS relative_float32_mb, {R('n * 32 * 2 / 1e6')} AS relative_float16_mb, {R('n * 32 / 1e6')} AS relative_int8_mb FROM (SELECT count(*) AS n, max(len(embedding)) AS d FROM embeddings)")
def memory_estimate(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    sizes = drift.memory(t["n"], t["d"], ANCHORS)
    return spark.createDataFrame([tuple(round(x, 6) for x in sizes.values())], ", ".join(f"{k} double" for k in sizes))


# ------------------------------------------------------------------ learning
@query(BASE + ", x AS (SELECT c.query_id, c.doc_id, row_number() OVER (PARTITION BY c.query_id ORDER BY c.score DESC, c.doc_id) AS rank FROM c LEFT JOIN t ON t.query_id = c.query_id AND t.doc_id = c.doc_id WHERE t.doc_id IS NULL) SELECT query_id, rank, doc_id FROM x WHERE rank <= 20")
def hard_negatives(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    return learn.hard_negatives(v.near(v.sigs("row_zscore"), 250), v.truth(), 20)


@query(f"WITH {U}, {a_sql()}, {s_sql()}, {z_sql()} SELECT a.p AS i, b.p AS j, {R('sum(a.y * b.y)', 4)} AS value FROM z a JOIN z b USING (vec_id) GROUP BY 1, 2")
def gram_matrix(spark, sf_dir):
    return learn.gram_rows(Vectors(spark, sf_dir).sigs("row_zscore"))


@query()
def ridge_projection_search(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    return scored(v.near(learn.relation_vectors(v.all, v.all.where(F.col("vec_id") < v.cut), 64), 10))


@query()
def ridge_recall(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    near = v.near(learn.relation_vectors(v.all, v.all.where(F.col("vec_id") < v.cut), 64), 25)
    return metrics.recall(v.truth(), near, [(10, 10), (10, 25)])


@query()
def learned_anchor_weights(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    sigs = v.sigs("row_zscore").cache()
    truth = v.truth()
    q, p, n = learn.triples(sigs, truth, learn.hard_negatives(v.near(sigs, 100), truth, 32), 16)
    w = learn.anchor_weights(q, p, n, steps=60)
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(w)], "anchor_pos long, weight double")


@query()
def contrastive_search(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    sigs = v.sigs("row_zscore").cache()
    truth = v.truth()
    q, p, n = learn.triples(sigs, truth, learn.hard_negatives(v.near(sigs, 100), truth, 32), 16)
    w = learn.contrastive(q, p, n, ANCHORS, steps=60)
    return scored(v.near(S.project(sigs, w, "sig", "sig", normalize=True), 10))


@query()
def ivf_search(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    index, centres = ann.ivf_build(v.all, 16)
    return scored(ann.ivf_search(v.all, index, centres, v.queries, 4, 50))


@query()
def lsh_search(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    return scored(ann.lsh_search(v.all, v.queries, 64, 50, bits=4))


@query()
def rp_forest_search(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    return scored(ann.forest_search(v.all, v.queries, ann.forest_build(v.all, trees=8), 2, 50))


@query()
def graph_search(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    return scored(graph.search(graph.build(v.all), v.queries, 100, 10))


@query()
def graph_two_stage(spark, sf_dir):
    """A graph over signatures, of rows that were there and rows inserted later; candidates ranked by the vectors."""
    v = Vectors(spark, sf_dir)
    sigs = v.sigs("row_zscore").cache()
    rows = sigs.select("vec_id", F.col("sig").alias("u"))
    index = graph.insert(graph.build(rows.where(F.col("vec_id") < v.cut)), rows.where(F.col("vec_id") >= v.cut))
    return scored(graph.two_stage(index, sigs, v.all, v.queries, 120, 100, 10))
