"""Queries over documents: preparation, profiles, chunks, lexical search, hybrid candidates, reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import corpus as C
from tessera.operators import knn, lexical, metrics
from tessera.plans import search
from tessera.plans.search import R, TRUTH, U, Vectors, near_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: White space by an explicit class in the regular expressions of both engines.
WS = r"[ \t\n\r\x0b\x0c\x{1c}-\x{1f}\x{85}\x{a0}]"
STRIP = f"regexp_replace(text, '^{WS}+|{WS}+$', '', 'g')"
COLLAPSE = f"regexp_replace(regexp_replace(text, '{WS}+', ' ', 'g'), '^{WS}+|{WS}+$', '', 'g')"


# ------------------------------------------------------------------ preparation
@query(f"""WITH t AS (SELECT doc_id, {STRIP.replace('text', "coalesce(text, '')")} AS t FROM documents),
s AS (SELECT doc_id, t, CASE WHEN length(t) = 0 THEN 'empty' WHEN length(t) < 50 THEN 'too_short' WHEN length(t) > 4000 THEN 'too_long' END AS s FROM t),
r AS (SELECT s, row_number() OVER (PARTITION BY CASE WHEN s IS NULL THEN t ELSE CAST(doc_id AS VARCHAR) || s END ORDER BY doc_id) AS k FROM s)
SELECT coalesce(s, CASE WHEN k > 1 THEN 'duplicate_text' ELSE 'kept' END) AS status, count(*) AS n FROM r GROUP BY 1""")
def corpus_profile(spark, sf_dir):
    return C.profile(docs(spark, sf_dir), "doc_id")


@query("SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(sum(n) FILTER (conv_id IS NULL), 0) AS BIGINT) AS missing, CAST(coalesce(sum(n - 1) FILTER (conv_id IS NOT NULL), 0) AS BIGINT) AS duplicate FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)")
def corpus_id_profile(spark, sf_dir):
    return C.id_profile(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id")


@query("SELECT min(doc_id) AS doc_id, text AS body FROM documents GROUP BY text")
def dedup_exact(spark, sf_dir):
    return C.first_of_text(docs(spark, sf_dir), "doc_id").select("doc_id", F.col("text").alias("body"))


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_no, doc_id, h AS code_hash FROM (SELECT min(doc_id) AS doc_id, sha256(text) AS h FROM documents WHERE length(text) >= 40 GROUP BY 2)")
def dedup_hash(spark, sf_dir):
    from pyspark.sql import Window

    kept = C.first_of_text(docs(spark, sf_dir).where(F.length("text") >= 40), "doc_id", digest=True).select("doc_id", F.sha2("text", 256).alias("code_hash"))
    # sequential ids in acceptance order: counts per id range, then a running number within each
    span = kept.select("doc_id", "code_hash", (F.col("doc_id") / 4096).cast("long").alias("b"))
    sizes = span.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = span.join(before, "b").withColumn("k", F.row_number().over(Window.partitionBy("b").orderBy("doc_id")))
    return numbered.select((F.col("before") + F.col("k") - 1).cast("long").alias("row_no"), "doc_id", "code_hash")


@query("SELECT min(doc_id) AS doc_id, t AS body FROM (SELECT doc_id, left(text, 4000) AS t FROM documents WHERE length(text) >= 80) GROUP BY t")
def prepared_truncated(spark, sf_dir):
    return C.prepared(docs(spark, sf_dir), "doc_id", 80, 4000).select("doc_id", F.col("text").alias("body"))


@query("SELECT min(doc_id) AS doc_id, length(text) AS n FROM documents WHERE length(text) BETWEEN 50 AND 4000 GROUP BY text")
def prepared_bounded(spark, sf_dir):
    return C.prepared(docs(spark, sf_dir), "doc_id", 50, 4000, truncate=False).select("doc_id", F.length("text").cast("long").alias("n"))


@query(f"SELECT doc_id, 'src/' || source || '-' || left(sha1({STRIP}), 16) AS with_path, 'generated-' || doc_id || '-' || left(sha1({STRIP}), 16) AS without_path FROM documents")
def stable_ids(spark, sf_dir):
    text = T.strip(F.col("text"))
    none = F.lit(None).cast("string")
    return docs(spark, sf_dir).select("doc_id", T.stable_id(none, F.concat(F.lit("src/"), "source"), F.col("doc_id"), text).alias("with_path"), T.stable_id(none, none, F.col("doc_id"), text).alias("without_path"))


@query(f"SELECT conv_id, turn, CASE WHEN length({STRIP}) > 0 THEN {STRIP} ELSE role END AS body, CASE WHEN length({STRIP}) > 0 THEN 'text' ELSE 'role' END AS text_field FROM conversations")
def infer_text(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return C.with_text(t, None, ("text", "role")).select("conv_id", "turn", F.col("text").alias("body"), "text_field")


@query(f"""WITH t AS (SELECT doc_id, {COLLAPSE} AS t FROM documents),
k AS (SELECT doc_id, t, unnest(range(0, CASE WHEN length(t) <= 320 THEN 1 ELSE CAST(ceil((length(t) - 320) / 120.0) AS BIGINT) + 1 END)) AS k FROM t WHERE length(t) >= 80),
c AS (SELECT doc_id, k, substr(t, k * 120 + 1, 320) AS c FROM k)
SELECT doc_id || ':' || (row_number() OVER w - 1) AS id, doc_id AS source_index, row_number() OVER w - 1 AS chunk_index, c AS body FROM c WHERE length(c) >= 80 WINDOW w AS (PARTITION BY doc_id ORDER BY k)""")
def chunk_text(spark, sf_dir):
    return C.chunked(docs(spark, sf_dir), "doc_id").withColumnRenamed("text", "body")


_ORDER = "md5('7:' || doc_id), doc_id"


@query(f"SELECT doc_id FROM documents ORDER BY {_ORDER} LIMIT 200")
def shuffled_sample(spark, sf_dir):
    return C.shuffled(docs(spark, sf_dir), "doc_id", 200).select("doc_id")


@query(f"""WITH a AS (SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 90),
b AS (SELECT doc_id, lang FROM a QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {_ORDER}) <= 30)
SELECT doc_id, lang FROM b ORDER BY {_ORDER} LIMIT 100""")
def stratified_sample(spark, sf_dir):
    return C.stratified_sample(docs(spark, sf_dir), "lang", "doc_id", 30, 100).select("doc_id", "lang")


@query("SELECT coalesce(lang, 'unknown') AS value, count(*) AS n FROM documents GROUP BY 1")
def language_histogram(spark, sf_dir):
    return C.histogram(docs(spark, sf_dir), "lang")


@query("SELECT source AS value, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def source_top10(spark, sf_dir):
    return C.histogram(docs(spark, sf_dir), "source", 10)


_KIND = f"""CASE WHEN contains(lower(t), 'test') OR contains(lower(t), 'assert') THEN 'test_assert' WHEN starts_with(t, 'class ') THEN 'class_def' WHEN contains(t, '__') THEN 'dunder'
 WHEN contains(lower(t), 'raise ') OR contains(lower(t), 'except ') THEN 'error_handling' WHEN contains(lower(t), 'open(') OR contains(lower(t), 'read(') OR contains(lower(t), 'write(') THEN 'io'
 WHEN length(t) - length(replace(t, chr(10), '')) + 1 <= 4 THEN 'short' WHEN length(t) - length(replace(t, chr(10), '')) + 1 >= 25 THEN 'long' ELSE 'medium' END"""


@query(f"SELECT doc_id, {_KIND} AS query_type FROM (SELECT doc_id, {STRIP} AS t FROM documents)")
def classify_query(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.query_type(F.col("text")).alias("query_type"))


@query("SELECT doc_id, regexp_replace(source || ' / ' || lang, '[^A-Za-z0-9._-]+', '_', 'g') AS slug FROM documents")
def slugs(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.slug(F.concat_ws(" / ", "source", "lang")).alias("slug"))


@query("SELECT vec_id, vec_id >= (SELECT CAST(floor(count(*) * 0.8) AS BIGINT) FROM embeddings) AS held_out FROM embeddings")
def train_split(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    train, rest = C.split_at(v.all, "vec_id")
    return train.select("vec_id", F.lit(False).alias("held_out")).union(rest.select("vec_id", F.lit(True).alias("held_out")))


@query()
def expanded_vectors(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    return C.expanded(v.all, 2 * v.n).select("vec_id", V.rounded(F.col("u")[0]).alias("first_value"))


# ------------------------------------------------------------------ lexical
TOKENS = "list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z_0-9]+|[0-9]+'), lambda x: lower(x))"
TF = f"tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY ALL)"
TFIDF = f"""{TF}, df AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1),
v AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf FROM df WHERE df >= 2 ORDER BY total DESC, term LIMIT 3000),
x AS (SELECT doc_id, term, tf * idf AS x FROM tf JOIN v USING (term)),
w AS (SELECT doc_id, term, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 1e-12) AS w FROM x)"""
_N = "(SELECT CAST(floor(count(*) * 0.8) AS BIGINT) FROM documents)"
LEX = f"""{TFIDF}, l0 AS (SELECT a.doc_id AS query_id, b.doc_id, round(sum(a.w * b.w), 9) AS score FROM w a JOIN w b ON a.term = b.term AND a.doc_id <> b.doc_id AND a.doc_id >= {_N} GROUP BY ALL),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM l0) WHERE rank <= 30)"""


def _weights(spark, sf_dir):
    d = docs(spark, sf_dir)
    return lexical.fitted_weights(d, 3000, 2), int(d.count() * 0.8)


@query(f"WITH {TF} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM tf GROUP BY 1")
def tokenize_df(spark, sf_dir):
    return lexical.frequencies(docs(spark, sf_dir))


@query(f"WITH {TFIDF} SELECT doc_id, term, {R('w')} AS w FROM w")
def tfidf_weights(spark, sf_dir):
    return _weights(spark, sf_dir)[0].select("doc_id", "term", V.rounded(F.col("w")).alias("w"))


@query(f"WITH {LEX} SELECT query_id, rank, doc_id, {R('score')} AS score FROM l WHERE rank <= 10")
def lexical_topk(spark, sf_dir):
    d = docs(spark, sf_dir)
    rows, width = lexical.fitted_rows(d, 3000, 2)
    return search.scored(lexical.search_rows(rows, rows.where(F.col("doc_id") >= int(d.count() * 0.8)), width, 10))


@query(f"SELECT i, j, {R('len(list_intersect(a, b)) / greatest(1, len(list_distinct(list_concat(a, b))))')} AS jaccard FROM (SELECT x.doc_id AS i, y.doc_id AS j, list_distinct({TOKENS.replace('text', 'x.text')}) AS a, list_distinct({TOKENS.replace('text', 'y.text')}) AS b FROM documents x JOIN documents y ON y.doc_id = (x.doc_id * 31 + 7) % (SELECT count(*) FROM documents))")
def token_jaccard(spark, sf_dir):
    d = docs(spark, sf_dir)
    s = d.select("doc_id", T.token_set(F.col("text")).alias("t"))
    a = s.select(F.col("doc_id").alias("i"), F.col("t").alias("a")).withColumn("j", (F.col("i") * 31 + 7) % d.count())
    return a.join(s.select(F.col("doc_id").alias("j"), F.col("t").alias("b")), "j").select("i", "j", V.rounded(T.jaccard(F.col("a"), F.col("b"))).alias("jaccard"))


# Documents and vectors share no key: by convention the vector of a document is the one whose id equals its own.
_DENSE = f"{U}, uv AS (SELECT vec_id, u AS v FROM u), {near_sql('d', 30, 'uv')}"
_BOTH = f"""WITH {_DENSE}, {LEX.replace(_N, '(SELECT min(vec_id) FROM q)')}, lq AS (SELECT * FROM l WHERE query_id IN (SELECT vec_id FROM q) AND doc_id IN (SELECT vec_id FROM u)),
lr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM lq),
m AS (SELECT query_id, doc_id, 0 AS part, rank FROM lr UNION ALL SELECT query_id, doc_id, 1, rank FROM d
 UNION ALL SELECT q.vec_id, i.doc_id, 2, i.doc_id FROM q CROSS JOIN (SELECT doc_id FROM documents WHERE doc_id IN (SELECT vec_id FROM u) ORDER BY doc_id LIMIT 111) i WHERE q.vec_id <> i.doc_id),
f AS (SELECT query_id, doc_id, part, rank FROM m QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY part, rank) = 1),
h AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY part, rank, doc_id) AS rank, doc_id FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY part, rank, doc_id) <= 50)"""


def _hybrid(spark, sf_dir) -> tuple[Vectors, DataFrame, DataFrame]:
    v, d = Vectors(spark, sf_dir), docs(spark, sf_dir)
    both = d.join(v.all.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    rows, width = lexical.fitted_rows(d, 3000, 2)
    lex = lexical.search_rows(rows, rows.where((F.col("doc_id") >= v.cut) & (F.col("doc_id") < v.n)), width, 30)
    lex = knn.ranked(lex.join(both.select("doc_id"), "doc_id", "left_semi").drop("rank"), 30)
    return v, both, lexical.hybrid(lex, v.truth(30), both.select("doc_id"), 50, 30)


@query(_BOTH + " SELECT query_id, rank, doc_id FROM h")
def hybrid_candidates(spark, sf_dir):
    return _hybrid(spark, sf_dir)[2]


_BLEND = f"""0.65 * list_inner_product(x.u, y.u) + 0.35 * len(list_intersect(s.t, e.t)) / greatest(1, len(list_distinct(list_concat(s.t, e.t))))"""


@query(_BOTH + f""", k AS (SELECT doc_id, list_distinct({TOKENS}) AS t FROM documents),
b AS (SELECT h.query_id, h.doc_id, round({_BLEND}, 9) AS score FROM h JOIN u x ON x.vec_id = h.query_id JOIN u y ON y.vec_id = h.doc_id JOIN k s ON s.doc_id = h.query_id JOIN k e ON e.doc_id = h.doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM b)
SELECT query_id, rank, doc_id, {R('score')} AS score FROM o WHERE rank <= 10""")
def rerank_blend(spark, sf_dir):
    v, d, found = _hybrid(spark, sf_dir)
    both = knn.rescore(found, v.all, v.all)
    tokens = d.select("doc_id", T.token_set(F.col("text")).alias("td"))
    both = both.join(tokens, "doc_id").join(tokens.select(F.col("doc_id").alias("query_id"), F.col("td").alias("tq")), "query_id")
    return search.scored(knn.rerank(both, F.round(0.65 * F.col("score") + 0.35 * T.jaccard(F.col("tq"), F.col("td")), 9), 10))


@query(f"""WITH {U}, {TRUTH}, {search.CAND}, k AS (SELECT doc_id AS query_id, {_KIND} AS query_type FROM (SELECT doc_id, {STRIP} AS t FROM documents)),
s AS (SELECT 'relation' AS system, query_id, doc_id FROM c WHERE rank <= 10 UNION ALL SELECT 'raw', query_id, doc_id FROM t),
h AS (SELECT n.system, k.query_type, t.query_id, count(s.doc_id) / count(*) AS r FROM t JOIN k USING (query_id) CROSS JOIN (SELECT DISTINCT system FROM s) n LEFT JOIN s ON s.system = n.system AND s.query_id = t.query_id AND s.doc_id = t.doc_id GROUP BY ALL)
SELECT system, query_type, count(*) AS query_count, {R('avg(r)')} AS recall FROM h GROUP BY ALL""".replace("s AS (SELECT u.vec_id", "sg AS (SELECT u.vec_id").replace("FROM s WINDOW", "FROM sg WINDOW"))
def recall_by_query_type(spark, sf_dir):
    v, d = Vectors(spark, sf_dir), docs(spark, sf_dir)
    truth = v.truth().cache()
    found = v.near(v.sigs("row_zscore"), 10).withColumn("system", F.lit("relation")).unionByName(truth.withColumn("system", F.lit("raw")))
    return metrics.recall_by_type(truth, found, d.select(F.col("doc_id").alias("query_id"), T.query_type(F.col("text")).alias("query_type")), 10)


# ------------------------------------------------------------------ result tables
_RUNS = "r AS (SELECT source AS model, lang AS strategy, doc_id % 3 AS seed, avg(n_chars) / 10000.0 AS mean_recall FROM documents GROUP BY ALL)"


def _runs(spark, sf_dir) -> DataFrame:
    """A derived table of the shape of result rows: model, strategy, seed, mean_recall."""
    return docs(spark, sf_dir).groupBy(F.col("source").alias("model"), F.col("lang").alias("strategy"), (F.col("doc_id") % 3).alias("seed")).agg((F.avg("n_chars") / 10000.0).alias("mean_recall"))


@query(f"WITH {_RUNS} SELECT strategy, {R('avg(mean_recall)')} AS mean, {R('stddev_pop(mean_recall)')} AS std, {R('min(mean_recall)')} AS min, {R('max(mean_recall)')} AS max, count(*) AS runs FROM r GROUP BY 1")
def seed_summary(spark, sf_dir):
    return metrics.summary(_runs(spark, sf_dir), ["strategy"], "mean_recall")


@query(f"WITH {_RUNS} SELECT model, {R('avg(d)')} AS mean, {R('min(d)')} AS min, {R('max(d)')} AS max, count(*) AS runs FROM (SELECT a.model, b.mean_recall - a.mean_recall AS d FROM r a JOIN r b ON a.model = b.model AND a.seed = b.seed AND a.strategy = 'en' AND b.strategy = 'de') GROUP BY 1")
def paired_delta(spark, sf_dir):
    return metrics.paired_delta(_runs(spark, sf_dir), ["model", "seed"], "strategy", "en", "de", "mean_recall", ["model"])


@query(f"WITH {_RUNS} SELECT strategy, model, seed, row_number() OVER w AS place, {R('mean_recall')} AS mean_recall FROM r WINDOW w AS (PARTITION BY strategy ORDER BY mean_recall DESC, model, seed) QUALIFY place <= 3")
def best_configs(spark, sf_dir):
    return metrics.best(_runs(spark, sf_dir), ["strategy"], "mean_recall", 3, ["model", "seed"]).select("strategy", "model", "seed", "place", V.rounded(F.col("mean_recall")).alias("mean_recall"))


@query(f"WITH {_RUNS} SELECT model, " + ", ".join(f"{R(f'avg(mean_recall) FILTER (seed = {k})')} AS at_{k}" for k in (0, 1, 2)) + " FROM r GROUP BY 1")
def strategy_pivot(spark, sf_dir):
    return metrics.pivoted(_runs(spark, sf_dir), ["model"], "seed", [0, 1, 2], "mean_recall")
