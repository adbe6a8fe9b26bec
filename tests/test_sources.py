"""Scans, sinks and streams."""

import io
import json
import urllib.error

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import anchors as A
from tessera.operators import knn
from tessera.operators import signatures as S
from tessera.sources import jsonl, npy, rest
from tessera.streaming import append

SCHEMA = "id string, text string"


@pytest.fixture
def lines(tmp_path):
    path = tmp_path / "go" / "a.jsonl"
    path.parent.mkdir()
    path.write_text('{"id":"1","text":"x"}\n\n{broken\n{"id":"2"}\n')
    return path


def test_strict_and_lenient(spark, lines):
    assert jsonl.read_lenient(spark, str(lines), SCHEMA).count() >= 2
    with pytest.raises(Exception):
        jsonl.read_strict(spark, str(lines), SCHEMA).collect()
    assert [(r["line_no"], r["line"]) for r in jsonl.broken_lines(spark, str(lines)).collect()] == [(3, "{broken")]
    assert {r["language"] for r in jsonl.languages_by_folder(spark, str(lines.parent.parent), SCHEMA).collect()} == {"go"}


def test_line_numbers_over_blocks(spark, tmp_path):
    own = [f"line {k}" if k % 7 else " " for k in range(1, 400)]
    (tmp_path / "a.txt").write_text("\r\n".join(own))
    (tmp_path / "b.txt").write_text("only\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = jsonl.numbered_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 1
        got = sorted((r["path"].rsplit("/", 1)[1], r["line_no"], r["line"]) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == sorted([("a.txt", k, x) for k, x in enumerate(own, 1) if x.strip()] + [("b.txt", 1, "only")])


def test_metrics_settings_and_labels(spark, tmp_path):
    rows = [{"a": 1, "b": [0.5, None]}, {"c": "x"}]
    jsonl.write_metrics(rows, spark, str(tmp_path / "m"))
    assert jsonl.read_metrics(spark, str(tmp_path / "m")) == rows
    (tmp_path / "config.yaml").write_text("seed: 7\nmodels:\n  - name: a\n")
    assert jsonl.read_config(spark, str(tmp_path / "config.yaml")) == {"seed": 7, "models": [{"name": "a"}]}
    df = spark.createDataFrame([(0, "x"), (2, None)], "k long, lang string")
    assert sorted(map(tuple, jsonl.labels(df, "k", "lang", 4).collect())) == [(0, "x"), (1, "unknown"), (2, "unknown"), (3, "unknown")]
    assert sorted(map(tuple, jsonl.labels(df, "k", "lang").collect())) == [(0, "x"), (2, "unknown")]


def test_ordered_parquet_stops_early(spark, tmp_path):
    files = []
    for k in range(3):
        files.append(str(tmp_path / f"{k}.parquet"))
        spark.createDataFrame([(10 * k + i, i % 2) for i in range(5)], "id long, odd int").coalesce(1).write.parquet(files[-1])
    files = [files[1], files[0], str(tmp_path / "missing.parquet")]  # never opened
    assert [r["id"] for r in jsonl.ordered_parquet(spark, files, 7).collect()] == [10, 11, 12, 13, 14, 0, 1]
    assert [r["id"] for r in jsonl.ordered_parquet(spark, files, 3, "odd = 1").collect()] == [11, 13, 1]


def test_appending_to_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a long, b string")
    jsonl.append_csv(df, str(tmp_path / "c"))
    jsonl.append_csv(df, str(tmp_path / "c"))
    assert jsonl.read_csv(spark, str(tmp_path / "c")).count() == 2
    with pytest.raises(ValueError):
        jsonl.append_csv(df.drop("b"), str(tmp_path / "c"))
    with pytest.raises(ValueError):
        jsonl.markdown(spark.range(5), most=4)


def test_titles_and_ordered_scans(spark, tmp_path):
    df = spark.createDataFrame([("1", " A ", "b "), ("2", None, "c"), ("3", "d", None)], "_id string, title string, text string")
    assert {r["_id"]: r["text"] for r in jsonl.titled(df).collect()} == {"1": "A \nb", "2": "c", "3": "d"}


def test_missing_texts(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "k long, text string")
    assert [r["text"] for r in jsonl.load_texts(df, 2, "k", missing="empty").orderBy("k").collect()] == ["x", ""]
    with pytest.raises(Exception, match="row without text"):
        jsonl.load_texts(df, 2, "k").collect()


def test_judgements(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\n1\ta\t1\nbroken\n1 a 2\n2\tb\t0\n")
    assert sorted(map(tuple, jsonl.read_qrels(spark, str(tmp_path / "q.tsv")).collect())) == [("1", "a", 2), ("2", "b", 0)]


def test_sinks(spark, tmp_path):
    df = spark.range(10).select(F.col("id"), (F.col("id") * 2).alias("b"))
    jsonl.write_prefixes(df, "id", [3, 5], str(tmp_path / "p"))
    assert [spark.read.json(str(tmp_path / "p" / n)).count() for n in ("3", "5")] == [3, 5]
    jsonl.write_csv([df, spark.createDataFrame([(1, "z")], "id long, a string")], str(tmp_path / "c"), ["id"])
    back = jsonl.read_csv(spark, str(tmp_path / "c"), seed=7)
    assert back.columns == ["id", "a", "b", "seed"] and back.count() == 11
    assert jsonl.markdown(spark.createDataFrame([(1, 0.5, None)], "a int, b double, c string")) == "| a | b | c |\n| --- | --- | --- |\n| 1 | 0.5000 |  |"
    assert jsonl.manifest(df, df.limit(4), 0.1)["distinct_rows"] == 4


def test_matrices_and_resuming(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(tmp_path / "small.npy", x)
    df = npy.read_npy(spark, str(tmp_path))
    assert [(r["model"], r["vec_id"], r["embedding"]) for r in df.orderBy("vec_id").collect()] == [("small", k, x[k].tolist()) for k in range(4)]
    seen = []
    path, run = str(tmp_path / "out"), lambda left: seen.append(left.count()) or left
    npy.resume(df.where("vec_id < 3"), path, "vec_id", run)
    assert npy.resume(df, path, "vec_id", run).count() == 4 and seen == [3, 1]
    assert npy.cached(df.limit(0), path).count() == 4


def test_back_off_and_pages(monkeypatch, tmp_path):
    waits, left = [], [2]

    class Body(io.BytesIO):
        pass

    def open_(url):
        if left[0]:
            left[0] -= 1
            raise urllib.error.HTTPError(url, 429, "", {}, None)
        return Body(b'{"rows": [{"row": {"a": 1}}, {"row": {"a": 2}}]}')

    monkeypatch.setattr(rest.time, "sleep", waits.append)
    assert json.loads(rest.get("u", open_=open_))["rows"] and waits == [1.0, 2.0]
    reader = rest.PagedRows({"url": "u{offset}-{length}", "total": "5", "page": "2"}).reader(None)
    assert [(p.offset, p.length) for p in reader.partitions()] == [(0, 2), (2, 2), (4, 1)]
    monkeypatch.setattr(rest, "get", lambda url: open_(url).read())
    assert list(reader.read(reader.partitions()[1])) == [(2, '{"a": 1}'), (3, '{"a": 2}')]
    assert rest.download("u", str(tmp_path / "f")) == rest.download("never", str(tmp_path / "f"))


def test_stream_equals_batch(spark, sf, tmp_path):
    t = spark.read.parquet(f"{sf}/embeddings.parquet")
    anchors = A.with_vectors(A.random(knn.unit(t), 8), knn.unit(t)).cache()
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (t.where("vec_id < 200"), t.where("vec_id >= 200")):
        part.write.mode("append").parquet(inbox)
        append.append_signatures(append.read(spark, inbox), anchors, "row_zscore", out, str(tmp_path / "cp")).awaitTermination()
    got = {r["vec_id"]: r["sig"] for r in spark.read.parquet(out).collect()}
    want = {r["vec_id"]: r["sig"] for r in S.transform(S.signatures(knn.unit(t), anchors), "row_zscore").collect()}
    assert len(got) == 500 and all(np.allclose(got[k], want[k]) for k in want)
    with pytest.raises(ValueError):
        append.append_signatures(None, anchors, "zscore", out, out)


def test_stratified_corpus_is_made_once(spark, tmp_path):
    rows = lambda n: spark.range(n).select(F.col("id").alias("offset"), F.lit("{}").alias("row"))
    path = str(tmp_path / "corpus")
    first = rest.stratified_corpus({"go": rows(50), "java": rows(5)}, path, 4, 7)
    got = [(r["language"], r["id"]) for r in first.collect()]
    assert len(got) == 7 and sum(a == "go" for a, _ in got) <= 4 and all(int(i.split(":")[1]) < 12 for a, i in got if a == "go")
    again = rest.stratified_corpus({"go": rows(0)}, path, 4, 7)
    assert sorted(map(tuple, again.select("language", "id").collect())) == sorted(got)
