"""End to end: notes on disk, chunks, search, context, prompts, a second index run; sinks."""

from pyspark.sql import functions as F

from lodestone.api import Library
from lodestone.operators import ingest
from lodestone.schema import CHUNKS
from lodestone.sources import sinks

NOTES = {
    "spark.md": "---\ncategory: AI\ntags: [spark, data, joins, more]\n---\n# Joins\nBroadcast joins send a small table to every executor of the cluster. " + "Shuffles move rows by key. " * 8,
    "cook.md": "# Soup\nOnions, carrots and leeks are simmered for an hour with salt. " + "Stir it now and then. " * 8,
    "out.md": "---\nrag: false\n---\n# Hidden\nBroadcast joins that nobody should find. " + "Nothing to see. " * 10,
    "VIDEO_x.md": "# Film\nBroadcast joins in a film that is kept out of the index as well. " + "Words. " * 20,
}


def test_library(spark, tmp_path):
    root = tmp_path / "notes"
    root.mkdir()
    for name, text in NOTES.items():
        (root / name).write_text(text)
    lib = Library(spark, str(tmp_path / "table"))
    assert lib.count() == 0
    lib.index(str(root))
    rows = lib.chunks()
    assert rows.schema.names == CHUNKS.names
    assert {r["filename"] for r in rows.collect()} == {"spark", "cook"}
    one = rows.where("filename = 'spark'").first()
    assert one["category"] == "AI" and one["tags"] == "spark, data, joins, more" and one["id"].endswith("spark.md#0")
    assert "标签: spark, data, joins\n" in one["text"].replace(" | ", "\n") + "\n" and one["char_count"] == len(one["raw_text"])
    q = spark.createDataFrame([(1, "how do broadcast joins work"), (2, "soup with leeks")], "query_id long, query string")
    top = {r["query_id"]: r for r in lib.search(q).where("rank = 1").collect()}
    assert top[1]["source"].endswith("spark.md") and top[2]["source"].endswith("cook.md") and top[1]["rerank_score"] > 0.3
    assert lib.search(q, where="category = 'AI'", use_rerank=False).select("source").distinct().count() == 1
    assert lib.search(q, tracks=("fts",), use_rerank=False).where("query_id = 2").first()["tracks"] == ["fts"]
    ctx = {r["query_id"]: r["context"] for r in lib.context(q).collect()}
    assert "spark.md" in ctx[1] and "Broadcast" in ctx[1]
    assert "soup with leeks" in lib.prompt(q, "summary").where("query_id = 2").first()["prompt"]
    (root / "cook.md").write_text("# Bread\nFlour, water and yeast. " + "Knead it well. " * 12)
    n = lib.count()
    lib.index(str(root))
    assert lib.count() == n and lib.chunks().where(F.col("raw_text").contains("Flour")).count() == 1


def test_figures_and_pages(spark):
    figures = spark.createDataFrame([("/a/p.pdf", 2, "A chart of sales", "figure", "/f.png"), ("/a/p.pdf", 3, "", "table", "")], "source string, page int, description string, kind string, figure_path string")
    got = ingest.figure_rows(figures).collect()
    assert len(got) == 1 and got[0]["page"] == 2 and got[0]["chunk_type"] == "figure" and len(got[0]["vector"]) == 64
    pages = spark.createDataFrame([("/a/p.pdf", 1, "x.  y\n\n\n\nz " * 400), ("/a/p.pdf", 2, "  ")], "source string, page int, text string")
    cut = ingest.page_texts(pages).collect()
    assert len(cut) > 1 and all(len(r["text"]) <= 2000 for r in cut) and {r["page"] for r in cut} == {1}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("A/b: c", "http://u", ["x", "y"], ["p", "q"], "body"), ("d", None, [], [], None)], "title string, url string, tags array<string>, points array<string>, body string")
    got = {r["file_name"]: r["content"] for r in sinks.note_texts(rows).collect()}
    assert "- p\n- q" in got["Ab c.md"] and got["d.md"].startswith("---\ntitle:")
    batches = spark.createDataFrame([("j", 0, 5), ("k", 1, 5), ("l", 5, 1)], "job string, failed long, succeeded long")
    assert {r["job"]: r["level"] for r in sinks.alerts(batches).collect()} == {"k": "warning", "l": "error"}
    sinks.append_json(batches, str(tmp_path / "h"))
    sinks.append_json(batches, str(tmp_path / "h"))
    assert spark.read.json(str(tmp_path / "h")).count() == 6
    hits = spark.createDataFrame([(1, 1, "a", "s", "t" * 900, 0.123456)], "query_id long, rank long, id string, source string, raw_text string, score double")
    assert '"score":0.1235' in sinks.answers(hits).first()["json"]
    assert "| n | 3 |" in sinks.report(batches.agg(F.count("*").alias("n")))


def test_two_streams_fill_one_table(spark, tmp_path):
    from lodestone.streaming.ingest import SnapshotTable, upsert_stream

    table = SnapshotTable(spark, f"{tmp_path}/table")
    for name in ("a", "b"):
        spark.createDataFrame([(name, 1)], "source string, n int").write.json(f"{tmp_path}/in-{name}")
        rows = spark.readStream.schema("source string, n int").json(f"{tmp_path}/in-{name}")
        for _ in range(2):
            upsert_stream(rows, table, f"{tmp_path}/check-{name}").awaitTermination()
    last, out = table.current()
    assert last == 1 and sorted(map(tuple, out.collect())) == [("a", 1), ("b", 1)]
    assert table.has(f"{tmp_path}/check-a", 0) and not table.has(f"{tmp_path}/check-a", 1)
