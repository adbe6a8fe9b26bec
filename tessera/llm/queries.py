"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, decontaminate, exact_dedup, language_id, license_scan, line_dedup, near_dedup, packing, quality, toxicity, warc_zip

#: Scores from which a query predicts class 1.
THRESHOLD = 0.7


def _scored(scores: DataFrame, held_out) -> DataFrame:
    """A row without id belongs to no fold: it is not held out, and teaches nothing."""
    return scores.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    held_out = common.fold("doc_id", 3) == 1
    return _scored(toxicity.score(docs, toxicity.train(docs, labels, ~held_out)), held_out)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(common.table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held_out = common.fold("doc_id", 4) == 2
    found = language_id.predict(docs, language_id.train(docs, ~held_out))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.remove_repeated_lines(common.table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components(common.table(spark, sf_dir, "documents"), k=2, percent=80)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    held_out = common.fold("doc_id", 4) == 2
    return _scored(quality.score(docs, quality.train(docs, labels, ~held_out)), held_out)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(common.table(spark, sf_dir, "documents"))


def op8_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.round_trip(spark, common.table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", *[F.round(c, 6).alias(c) for c in ("cosine", "cover", "answer_cover")])


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(common.table(spark, sf_dir, "documents")).drop("spans")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""

# the digest's 160 bits in groups of five, by the alphabet A-Z 2-7
OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, body, sha1(body) AS hx, min(page_id) OVER (PARTITION BY body) AS first_id FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i:
        ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111']
        [strpos('0123456789abcdef', substr(hx, i, 1))]), '') AS bits FROM h)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
    + 16 * CAST(substr(bits, 5 * k + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * k + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * k + 3, 1) AS INT)
    + 2 * CAST(substr(bits, 5 * k + 4, 1) AS INT) + CAST(substr(bits, 5 * k + 5, 1) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM b
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# components: the smallest id of the transitive closure of the links
OP5_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE len(w) WHEN 0 THEN [] WHEN 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS own FROM w),
x AS (SELECT doc_id, len(own) AS n, unnest(own) AS shingle FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS nu, any_value(b.n) AS nv, count(*) AS c
  FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT u, v FROM p WHERE 100 * c >= 80 * (nu + nv - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r(node, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.other),
m AS (SELECT node, min(other) AS component_id FROM r GROUP BY 1)
SELECT s.doc_id, len(own) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN m ON m.node = s.doc_id
"""

BASE_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, label, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i : i + len(phrase) - 1] = phrase)) - 1 AS place
  FROM w, (SELECT unnest([['mit', 'license'], ['apache', 'license'], ['general', 'public', 'license']]) AS phrase, unnest(['mit', 'apache', 'gpl']) AS label)),
g AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels FROM p GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM w LEFT JOIN g USING (doc_id)
"""


def license_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op10_license_scan that SQL can express."""
    return op10_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_packing, op3_language_id, op4_line_dedup, op5_near_dedup, op6_quality, op7_exact_dedup, op8_warc_zip, op9_decontamination, op10_license_scan, license_base_places)}


def oracle_sql() -> dict[str, str]:
    return {"op5_near_dedup": OP5_SQL, "op7_exact_dedup": OP7_SQL, "op8_warc_zip": OP8_SQL, "license_base_places": BASE_SQL}
