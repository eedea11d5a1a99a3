"""Expiring cache state, watched folders, files that can't be read, embeddings as a column, notes' rules."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import render as R
from lodestone.functions import text as T
from lodestone.operators import classify, ingest, maintain, usage, vector
from lodestone.sources import files, sinks
from lodestone.sources.versions import VersionedTable
from lodestone.streaming.ingest import cached, run_once, watch_folder


def test_cache_state_goes_with_event_time(spark, tmp_path):
    """Hits are those of the whole log; keys that are not asked for any more leave no state."""
    import datetime as dt

    start, rows, hits, left = dt.datetime(2024, 1, 1), [], [], []
    for batch in range(4):
        for k in range(50):
            at = start + dt.timedelta(hours=batch, seconds=7 * k)
            rows.append((f"key {batch} {k}", at))
            rows.append((f"key {batch} {k}", at + dt.timedelta(seconds=300 if k % 2 else 301)))
        rows.append(("always", start + dt.timedelta(hours=batch)))
        spark.createDataFrame(rows[-101:], "key string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/calls")
        stream = cached(spark.readStream.schema("key string, ts timestamp").parquet(f"{tmp_path}/calls"), "key", 300, "10 minutes")
        q = stream.writeStream.foreachBatch(lambda b, _: hits.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination()
        left.append(max(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]) if q.recentProgress else 0)
        last = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    want = usage.cache_hits(spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "key string, ts timestamp, seq long"), "key", 300, "seq")
    assert sorted((r["key"], r["ts"], r["hit"]) for r in hits) == sorted((r["key"], r["ts"], r["hit"]) for r in want.collect())
    # All 201 keys were there; the last hour's are, and what the watermark has not passed.
    assert last <= 102


def test_watched_folder_loses_and_doubles_nothing(spark, tmp_path, monkeypatch):
    root, table = tmp_path / "in", VersionedTable(spark, f"{tmp_path}/t", buckets=4)
    (root / "sub").mkdir(parents=True)
    put = lambda name, text: (root / name).write_text(text)
    put("a.md", "one")
    put("sub/b.md", "two")
    put("c.txt", "no note")
    rows = lambda f: f.select("source", "filename", "content")
    watch = lambda: watch_folder(spark, str(root), table, f"{tmp_path}/check", rows, archive=str(tmp_path / "done")).awaitTermination()
    real = VersionedTable._publish

    def killed(*a):
        raise RuntimeError("killed before the version")

    monkeypatch.setattr(VersionedTable, "_publish", killed)
    with pytest.raises(Exception, match="killed"):
        watch()
    assert table.read() is None and (root / "a.md").exists()

    def killed_after(*a):
        real(*a)
        raise RuntimeError("killed after the version")

    monkeypatch.setattr(VersionedTable, "_publish", killed_after)
    with pytest.raises(Exception, match="killed after"):
        watch()
    monkeypatch.setattr(VersionedTable, "_publish", real)
    watch()
    put("d.md", "three")
    watch()
    put("e.md", "four")
    watch()
    got = sorted((r["filename"], r["content"]) for r in table.read().collect())
    assert got == [("a", "one"), ("b", "two"), ("d", "three"), ("e", "four")]
    gone = [p for p in ("a.md", "sub/b.md") if not (root / p).exists()]
    kept = [os.path.join(d, f) for d, _, fs in os.walk(tmp_path / "done") for f in fs if f.endswith(".md")]
    assert gone == ["a.md", "sub/b.md"] and len(kept) >= 2 and (root / "c.txt").exists()


def test_files_that_cannot_be_read(spark, tmp_path):
    for k in range(6):
        (tmp_path / f"{k}.bin").write_bytes(b"bad" if k % 3 == 0 else f"{k} x".encode())

    def parser(content, path):
        return [{"n": int(w)} for w in content.decode().split()[:1]]

    raw = spark.read.format("binaryFile").load(str(tmp_path))
    rows, counts = files.observed(files.parsed(raw, parser, "n int", "reason"), "parse")
    got = sorted((os.path.basename(r["source"]), r["n"], (r["reason"] or "")[:10]) for r in rows.collect())
    assert got == [(f"{k}.bin", None if k % 3 == 0 else k, "ValueError" if k % 3 == 0 else "") for k in range(6)]
    assert tuple(counts().first()) == ("parse", 2, 4) and sinks.alerts(counts()).first()["level"] == "warning"
    with pytest.raises(Exception, match="bad"):
        files.parsed(raw, parser, "n int").collect()


def test_embedding_is_a_column(spark):
    rows = [(k, t) for k, t in enumerate(["a b c a", "", None, "Ärger über 12 Äpfel!", "机器 学习 " * 40, "x " * 3000])]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r["id"]: r["vector"] for r in vector.hashed_embeddings(df, "id", "text").collect()}
    assert got == {r["id"]: r["vector"] for r in vector.summed_embeddings(df, "id", "text").collect()}
    plan = df.withColumn("v", vector.hashed_embedding(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" in plan
    notes = spark.createDataFrame([("/a.md", "a", "# T\n" + "words and more of them. " * 20)], "source string, filename string, content string")
    assert "Exchange" not in ingest.chunk_rows(notes)._jdf.queryExecution().executedPlan().toString()


def test_a_worker_keeps_its_model(spark, tmp_path):
    """The model is made once for a task's batches."""
    made = str(tmp_path / "made")

    def make():
        with open(made, "a") as f:
            f.write("x")
        return lambda texts: np.array([[len(t)] for t in texts])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        out = spark.range(0, 100, 1, 1).select(vector.embedding(make, F.col("id").cast("string"))[0].alias("n"))
        assert out.agg(F.sum("n")).first()[0] == 190 and len(open(made).read()) == 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_filing(spark):
    folders = spark.createDataFrame([("ml", 0, "model", 0), ("ml", 0, "GPU", 1), ("food", 1, "soup", 0)], "folder string, folder_order int, keyword string, keyword_order int")
    rows = [
        (1, ["Soup"], "x", "model"), (2, [], "PAPER x", "a model and soup"), (3, None, "NEWS (gpu)", ""), (4, [""], "NEWS x", ""), (5, [], "x", "y" * 2000 + "soup"), (6, None, None, None), (7, ["gp"], "x", ""), (1, ["Soup"], "x", "model"),
    ]
    df = spark.createDataFrame(rows[:-1], "id long, tags array<string>, title string, body string")
    got = {r["id"]: (r["folder"], r["by"]) for r in classify.filed(df, "id", "tags", "title", "body", folders, {"PAPER": "papers", "NEWS": "news"}, "inbox").collect()}
    assert got == {1: ("food", "tags"), 2: ("ml", "body"), 3: ("ml", "tags"), 4: ("news", "title"), 5: ("inbox", "default"), 6: ("inbox", "default"), 7: ("ml", "tags")}


def test_front_matter_parts_and_note_fields(spark):
    texts = ["---\na: 1\n---\n body ", "---\nnot closed", "no --- at --- start", "", None, "---x---y---z"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [(r["p"]["yaml"], r["p"]["body"]) for r in df.select("k", T.frontmatter_parts(F.col("t")).alias("p")).orderBy("k").collect()]
    assert got == [("\na: 1\n", "\n body "), (None, "---\nnot closed"), (None, "no --- at --- start"), (None, ""), (None, None), ("x", "y---z")]
    notes = ['title: "A b"\n# Other\nflag: "x y" z\n入库时间：`2024-05-06`', "# Only heading \nflag:  plain text\n入库时间: 2024-05-06", "nothing", 'title: ""\n']
    df = spark.createDataFrame([(k, t) for k, t in enumerate(notes)], "k int, t string")
    got = [tuple(r)[1:] for r in df.select("k", R.note_title(F.col("t")), R.note_field(F.col("t"), "flag"), R.note_date(F.col("t"))).orderBy("k").collect()]
    assert got == [("A b", "x y", "2024-05-06"), ("Only heading ", "plain", "2024-05-06"), (R.NO_TITLE, "", ""), (R.NO_TITLE, "", "")]


def test_keys_that_repeat_and_ties(spark):
    rows = spark.createDataFrame([(1, "A"), (2, "A"), (2, "B"), (3, None)], "id long, text string")
    assert sorted(map(tuple, maintain.first_of_content(rows, "text", "id").collect())) == [(1, "A"), (2, "B")]
    tied = spark.createDataFrame([("k", 1, "a"), ("k", 1, "c"), ("k", 1, "b"), ("j", 2, None)], "key string, at int, v string").repartition(3)
    assert sorted((tuple(r) for r in maintain.last_write(tied, "key", "at").collect()), key=str) == [("j", 2, None), ("k", 1, "c")]
    paths = spark.createDataFrame([("/a/x.md",), ("/b/y.md",), ("/c/z.md",)], "path string")
    pdfs = spark.createDataFrame([("/a/x.pdf",), ("/0/x.pdf",), ("/q/y.pdf",), ("/p/y.pdf",)], "path string")
    assert sorted(map(tuple, maintain.nearest_companions(paths, pdfs).collect())) == [("/a/x.md", "/a/x.pdf"), ("/b/y.md", "/p/y.pdf")]


def test_one_table_of_texts_and_figures(spark):
    pages = spark.createDataFrame([("/a/p.pdf", 2, "second page of it"), ("/a/p.pdf", 1, "first")], "source string, page int, text string")
    figures = spark.createDataFrame([("/a/p.pdf", 2, "a chart", "figure", "/f.png")], "source string, page int, description string, kind string, figure_path string")
    got = ingest.document_rows(pages, figures).collect()
    assert sorted((r["chunk_type"], r["page"], r["raw_text"]) for r in got) == [("figure", 2, "a chart"), ("text", 1, "first"), ("text", 2, "second page of it")]
    assert len({r["id"] for r in got}) == 3 and all(len(r["vector"]) == 64 for r in got)


def test_run_once_hands_batches_over(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in")
    seen = []
    run_once(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), lambda b: seen.extend(r["id"] for r in b.collect()), f"{tmp_path}/c")
    assert sorted(seen) == [0, 1, 2] and hashlib.md5(b"").hexdigest()


def test_appended_rows_are_completed(spark, tmp_path):
    from lodestone.api import Library
    from lodestone.operators import context
    from lodestone.schema import CHUNKS

    (tmp_path / "a.md").write_text("# One\n" + "A note about leeks. " * 9)
    (tmp_path / "b.md").write_text("# Two\n" + "Another about onions. " * 9)
    assert [r["filename"] for r in files.markdown(spark, str(tmp_path / "a.md")).collect()] == ["a"]
    lib = Library(spark, f"{tmp_path}/t")
    lib.add(spark.createDataFrame([("x#0", "Some Words, 12", "/x.md"), ("y#0", None, "/y.md")], "id string, text string, source string"))
    lib.add(spark.createDataFrame([("z#0", "more", "kept tokens")], "id string, text string, tokenized_text string"))
    got = {r["id"]: r for r in lib.chunks().collect()}
    assert lib.chunks().columns == CHUNKS.names and {k: r["tokenized_text"] for k, r in got.items()} == {"x#0": "some words 12", "y#0": "", "z#0": "kept tokens"}
    assert got["x#0"]["chunk_type"] == "text" and got["x#0"]["char_count"] == 14 and len(got["x#0"]["vector"]) == 64 and got["z#0"]["page"] == 0
    q = spark.createDataFrame([(1, "some words")], "query_id long, query string")
    assert lib.search(q, use_rerank=False).where("rank = 1").first()["id"] == "x#0"
    context.register("short", "{context}|{query}")
    assert lib.prompt(q, "short").first()["prompt"].endswith("|some words")
    with pytest.raises(ValueError):
        context.register("bad", "{context}")
