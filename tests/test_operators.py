"""Ties, thresholds, upserts and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import classify, context, evaluate, fusion, maintain, rerank, usage, vector
from lodestone.schema import HITS
from lodestone.sources import files
from lodestone.streaming import ingest


def test_rrf_ties_and_repeats(spark):
    rows = [(1, "vector", 1, "a", "s", "one", 0.5), (1, "vector", 2, "b", "s", "two", 0.5), (1, "fts", 3, "a", "s", "one", 0.9), (1, "fts", 4, "c", "x", "", 0.9), (1, "fts", 5, "b", "s", "two", 0.1)]
    got = fusion.rrf(spark.createDataFrame(rows, HITS)).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["a", "b", "c"]
    assert abs(got[0]["rrf"] - (1 / 61 + 1 / 61)) < 1e-9 and got[0]["track"] == "vector" and got[0]["tracks"] == ["fts", "vector"]
    assert abs(got[1]["rrf"] - (1 / 62 + 1 / 63)) < 1e-9


def test_keep_best_takes_the_first_of_equals(spark):
    rows = [(1, "t", 1, "a", "s", "one", 0.5), (1, "t", 2, "b", "s", "one", 0.5), (1, "t", 3, "c", "s", "one", 0.4)]
    assert [r["id"] for r in fusion.keep_best(spark.createDataFrame(rows, HITS)).collect()] == ["a"]


def test_threshold_keeps_a_minimum(spark):
    def ids(scores, k=5):
        rows = [(1, "t", i, str(i), "s", f"text {i}", s) for i, s in enumerate(scores)]
        return [r["id"] for r in rerank.rerank(spark.createDataFrame(rows, HITS), F.col("score"), k).orderBy("rank").collect()]

    assert ids([0.9, 0.5, 0.4, 0.39]) == ["0", "1", "2"]
    assert ids([0.9, 0.1, 0.2, 0.3]) == ["0", "3", "2"]
    assert ids([0.1, 0.1]) == ["0", "1"]
    assert ids([0.9, 0.8, 0.7, 0.6], 2) == ["0", "1"]


def test_rerankers_by_name():
    assert rerank.from_config({}) is rerank.overlap_score
    try:
        rerank.create("other")
    except ValueError as e:
        assert "overlap" in str(e)
    else:
        raise AssertionError


def test_knn_against_numpy(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[7] = v[3]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "id long, e array<float>").repartition(5)
    q = df.where("id in (3, 11)").select(F.col("id").alias("query_id"), F.col("e").alias("query_vector"))
    got = {(r["query_id"], r["rank"]): r["id"] for r in vector.knn(df, q, "id", "e", 5).collect()}
    for k in (3, 11):
        d = ((v.astype(float) - v[k].astype(float)) ** 2).sum(1).round(6)
        assert [got[k, r] for r in range(1, 6)] == np.lexsort((np.arange(300), d))[:5].tolist()


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_knn_equal_vectors_in_one_batch(spark, metric):
    keys = np.random.default_rng(6).permutation(100).tolist()
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in keys] + [(200, [2.0, 1.0])], "id long, e array<float>").coalesce(1)
    q = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0])], "query_id long, query_vector array<float>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in vector.knn(df, q, "id", "e", 15, metric).collect()}
    assert [got[1, r] for r in range(1, 16)] == list(range(15)) and [got[2, r] for r in range(1, 16)] == [200, *range(14)]


def test_context_budget(spark):
    parts = spark.createDataFrame([(1, i, "x" * 50) for i in range(1, 5)] + [(2, 1, "y" * 500)], "query_id long, rank long, part string")
    got = {r["query_id"]: r for r in context.budgeted(parts, 100).collect()}
    assert got[1]["n_used"] == 2 and got[1]["n_all"] == 4 and "2 of 4" in got[1]["context"]
    assert got[2]["n_used"] == 0 and got[2]["context"].endswith("[cut]") and len(got[2]["context"]) == 150


def test_context_labels_and_prompts(spark):
    df = spark.createDataFrame([("/a/b.md", "text", 0), ("/a/c.pdf", "figure", 3), ("d", "table", 0)], "s string, t string, p int")
    assert [r[0] for r in df.select(context.citation(F.col("s"), F.col("t"), F.col("p"))).collect()] == ["b.md", "c.pdf p.3 figure", "d table"]
    q = spark.createDataFrame([(1, "why {context}?")], "query_id long, query string")
    p = context.render(q, spark.createDataFrame([], "query_id long, context string"), "no such").first()["prompt"]
    assert context.EMPTY in p and "why {context}?" in p
    assert context.context_budget(4000, "default", "q") < 4000 - 100


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("it's", 3)], "source string, n int")
    new = spark.createDataFrame([("a", 9)], "source string, n int")
    once = maintain.upsert(old, new)
    assert sorted(map(tuple, once.collect())) == [("a", 9), ("it's", 3)]
    assert sorted(map(tuple, maintain.upsert(once, new).collect())) == sorted(map(tuple, once.collect()))
    assert maintain.delete(old, spark.createDataFrame([], "source string")).count() == 3
    assert maintain.delete(old, old).count() == 0


def test_isolation_rules(spark):
    rows = [(False, None, "x", "n"), (None, "video_distill", "x", "n"), (True, "video_distill", "x", "VIDEO_a"), (None, None, "has MARK", "n"), (None, None, None, "VIDEO_b"), (None, None, "x", None)]
    df = spark.createDataFrame(rows, "rag boolean, kind string, body string, name string")
    out = df.select(classify.isolated(F.col("rag"), F.col("kind"), F.col("body"), F.col("name"), ["MARK"])).collect()
    assert [r[0] for r in out] == [True, True, False, True, True, False]


def test_judgement_needs_a_source(spark):
    golden = spark.createDataFrame([(1, "doc:a#1", "a"), (2, "doc:b#1", "b")], "query_id long, expected_id string, expected_source string")
    got = spark.createDataFrame([(1, 1, "x", ""), (1, 2, "y", "a")], "query_id long, rank long, id string, source string")
    s = evaluate.summary(evaluate.judged(golden, got)).first()
    assert (s["n_hits"], s["hit_rate"], s["mrr"]) == (1, 0.5, 0.25)


def test_federated_search_takes_the_first_answer():
    def fails(q, n):
        raise RuntimeError("down")

    chain = [("a", fails), ("b", lambda q, n: []), ("c", lambda q, n: [{"title": "t", "url": "u", "snippet": "s" * 400}]), ("d", fails)]
    got = usage.search(chain, "q", 3, lambda p: True)
    assert got["provider"] == "c" and len(got["results"][0]["snippet"]) == 300 and got["errors"] == {"a": "down"}
    assert usage.search(chain, "q", 3, lambda p: p == "b")["provider"] is None


def test_file_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.md", "_hidden.md", "sub/b.md", "sub/c.txt"):
        (tmp_path / name).write_text(f"# {name}\nbody")
    got = files.markdown(spark, str(tmp_path), skip_dirs=["nothing"])
    assert sorted(r["filename"] for r in got.collect()) == ["a", "b"]
    assert [r["filename"] for r in files.markdown(spark, str(tmp_path), skip_dirs=["/sub/"]).collect()] == ["a"]
    assert files.recent(got, 7).count() == 2
    (tmp_path / "list").write_text("x\n\n y \n")
    assert [r["source"] for r in files.work_list(spark, str(tmp_path / "list")).collect()] == ["x", "y"]
    (tmp_path / "p.json").write_text('{"papers": [{"title": "t", "url": "http://h/2401.1", "authors": ["x", "y"]}]}')
    assert files.papers(spark, str(tmp_path / "p.json")).first()["arxiv_id"] == "2401.1"
    raw = spark.read.format("binaryFile").load(str(tmp_path / "sub"))
    pages = files.parsed(raw, lambda content, path: [{"page": i, "text": t} for i, t in enumerate(content.decode().split("\n"))], "page int, text string")
    assert pages.count() == 4
    assert files.chunk_table(spark, str(tmp_path / "none")).count() == 0


def test_upsert_stream(spark, tmp_path):
    schema = "source string, n int"
    src, table = tmp_path / "in", ingest.SnapshotTable(spark, str(tmp_path / "table"))
    for rows in ([("a", 1), ("b", 2)], [("a", 3)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        ingest.upsert_stream(spark.readStream.schema(schema).parquet(str(src)), table, str(tmp_path / "ck")).awaitTermination()
    assert sorted(map(tuple, table.current()[1].collect())) == [("a", 3), ("b", 2)]


def test_streams_find_new_and_cached(spark, tmp_path, small):
    events = spark.read.parquet(f"{small}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key"))
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    keys, hits = [], []
    ingest.run_once(ingest.new_only(stream, "key"), lambda b: keys.extend(r["key"] for r in b.collect()), str(tmp_path / "c1"))
    assert sorted(keys) == sorted({r["key"] for r in events.select("key").collect()})
    ingest.run_once(ingest.cached(stream, "key", 7200), lambda b: hits.extend(b.collect()), str(tmp_path / "c2"))
    want = usage.cache_hits(events, "key", 7200, "event_id")
    assert sum(r["hit"] for r in hits) == want.where("hit").count() and len(hits) == events.count()


def test_knn_in_strips_and_batches(spark, monkeypatch):
    """Queries in strips over many batches of rows, ties among them: the rows of a search that has all at once."""
    from lodestone.operators import vector

    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(500, 4)), 1)
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, vector array<float>").coalesce(1)
    asked = rows.where("id % 5 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    monkeypatch.setattr(vector, "QUERY_STRIP", 7)
    for metric in ("l2", "cosine"):
        whole = vector.knn(rows, asked, "id", "vector", 6, metric).toPandas()
        key, old = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set(key, "37")
        strips = vector.knn(rows, asked, "id", "vector", 6, metric).toPandas()
        spark.conf.set(key, old)
        same = lambda p: sorted(map(tuple, p[["query_id", "id", "distance", "rank"]].to_numpy().tolist()))
        assert same(whole) == same(strips) and len(whole) == 600
