"""Stored tables and indexes: what a write touches, versions, second writers, vacuum; segments, deletions, bounds."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.api import Library
from lodestone.operators import fulltext, lexical
from lodestone.operators.fulltext import TextIndex
from lodestone.sources.versions import Conflict, VersionedTable
from lodestone.streaming.ingest import upsert_stream


def keyed(spark, n):
    return spark.range(n).select(F.concat(F.lit("s"), "id").alias("source"), F.col("id").alias("n"))


def test_one_source_rewrites_one_bucket(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t", buckets=32)
    assert t.read() is None and t.append(keyed(spark, 10_000)) == 0
    old = t.version()
    t.upsert(spark.createDataFrame([("s5", -1), ("s5", -2)], "source string, n long"))
    new = t.version()
    changed = [b for b in old.files if old.files[b] != new.files[b]]
    assert len(changed) == 1 and len(old.files) == 32
    assert t.read().count() == 10_001 and {r["n"] for r in t.read().where("source = 's5'").collect()} == {-1, -2}
    assert t.read(0).count() == 10_000 and t.read(0).where("source = 's5'").first()["n"] == 5


def test_null_keys_new_columns_and_empty_writes(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t", buckets=4)
    t.append(spark.createDataFrame([(None, 1), ("a", 2)], "source string, n long"))
    t.upsert(spark.createDataFrame([(None, 3, "x")], "source string, n long, extra string"))
    assert sorted((tuple(r) for r in t.read().collect()), key=str) == [("a", 2, None), (None, 3, "x")]
    t.upsert(spark.createDataFrame([], "source string, n long"))
    assert t.read().count() == 2
    t.delete(spark.createDataFrame([(None,)], "source string"))
    assert [tuple(r) for r in t.read().collect()] == [("a", 2, None)]
    t.clear()
    assert t.read().count() == 0 and t.read().columns == ["source", "n", "extra"]
    assert t.read(1).count() == 2


def test_second_writer_is_told(spark, tmp_path):
    one, two = (VersionedTable(spark, f"{tmp_path}/t", buckets=4) for _ in range(2))
    one.append(keyed(spark, 10))
    base = two.version()
    one.append(keyed(spark, 10))
    with pytest.raises(Conflict):
        two.append(keyed(spark, 10), base=base)
    assert one.read().count() == 20 and one.version().number == 1
    two.append(keyed(spark, 10))
    assert one.read().count() == 30 and [r["what"] for r in one.history().orderBy("version").collect()] == ["append"] * 3


def test_vacuum_keeps_what_versions_name(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t", buckets=4)
    t.append(keyed(spark, 100))
    for k in range(3):
        t.upsert(spark.createDataFrame([(f"s{k}", -k)], "source string, n long"))
    whole = {n: sorted(map(tuple, t.read(n).collect())) for n in (2, 3)}
    assert t.vacuum()["versions"] == 0, "all are younger than a week"
    stray = t.folder.path + "/data/stray/x.parquet"
    t.read().coalesce(1).write.parquet(f"{tmp_path}/t/data/unpublished")
    now = t.version().at
    got = t.vacuum(keep=2, older_ms=0, now_ms=now + 1)
    assert got["versions"] == 2 and got["files"] > 0 and got["bytes_after"] < got["bytes_before"], stray
    assert t.versions.numbers() == [2, 3] and {n: sorted(map(tuple, t.read(n).collect())) for n in (2, 3)} == whole
    # A writer may not have published yet: what nobody names goes by age.
    assert any(f.startswith("data/unpublished") for f in t.folder.files("data"))
    t.vacuum(keep=2, older_ms=0, now_ms=now + 3_600_000)
    assert not any(f.startswith("data/unpublished") and f.endswith(".parquet") for f in t.folder.files("data"))
    assert sorted(map(tuple, t.read(3).collect())) == whole[3]


def test_stream_upserts_begin_anew_after_a_conflict(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, f"{tmp_path}/t", buckets=4)
    keyed(spark, 3).write.parquet(f"{tmp_path}/in")
    real, lost = VersionedTable.upsert, []

    def upsert(self, new, stream=None, base=None):
        if not lost:
            lost.append(1)
            VersionedTable(spark, f"{tmp_path}/t", buckets=4).append(keyed(spark, 10).where("n >= 5"))
        return real(self, new, stream, base)

    monkeypatch.setattr(VersionedTable, "upsert", upsert)
    for _ in range(2):
        upsert_stream(spark.readStream.schema("source string, n long").parquet(f"{tmp_path}/in"), t, f"{tmp_path}/check").awaitTermination()
    assert t.read().count() == 8 and t.version().number == 1 and t.has(f"{tmp_path}/check", 0)


def test_library_clear(spark, tmp_path):
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "a.md").write_text("# Soup\n" + "Onions and leeks are simmered. " * 9)
    lib = Library(spark, f"{tmp_path}/t")
    lib.index(f"{tmp_path}/notes")
    n = lib.count()
    lib.clear()
    assert n > 0 and lib.count() == 0
    lib.index(f"{tmp_path}/notes")
    assert lib.count() == n


# The full-text index


def texts(seed, n, vocabulary=200):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)]
    weights = [1 / (k + 1) for k in range(vocabulary)]
    return [(k, " ".join(rng.choices(words, weights, k=rng.randrange(0, 60)))) for k in range(n)]


def ranked(df):
    return sorted(tuple(r) for r in df.select("query_id", "id", "score", "rank").collect())


@pytest.fixture()
def asked(spark):
    return spark.createDataFrame([(1, "w0 w5 w9"), (2, "w150 w3 nothing"), (3, ""), (4, None), (5, "W7, w7 w190")], "query_id long, query string")


def test_index_kept_up_equals_a_fresh_one(spark, tmp_path, asked):
    """Adds, deletions, replacements and merges; after each the search is that of the rows there are."""
    rows = {k: t for k, t in texts(1, 400)} | {1000: None, 1001: "", 1002: "w5 " * 500}
    index, now = TextIndex(spark, f"{tmp_path}/i"), {}
    frame = lambda d: spark.createDataFrame(list(d.items()), "id long, text string")

    def same():
        assert ranked(index.search(asked)) == ranked(lexical.bm25(frame(now), asked, "id"))
        s = index.statistics().first()
        assert (s["n_docs"], s["total_len"]) == tuple(lexical.corpus_stats(frame(now)).first())[:2]

    keys = list(rows)
    for part in (keys[:100], keys[100:150], keys[150:]):
        index.add(frame({k: rows[k] for k in part}))
        now |= {k: rows[k] for k in part}
    same()
    index.delete(spark.createDataFrame([(k,) for k in (*range(0, 100, 3), 1002, 5555)], "id long"))
    now = {k: t for k, t in now.items() if not (k < 100 and k % 3 == 0 or k == 1002)}
    same()
    changed = {k: "w5 w9 w9 anew" for k in (1, 2, 120, 9999)}
    index.upsert(frame(changed))
    now |= changed
    same()
    for k in range(5):
        more = {20_000 + 10 * k + j: f"w{j} w5 late" for j in range(4)}
        index.add(frame(more))
        now |= more
    same()
    assert any(index.state(n).what == "merge" for n in index.versions.numbers()) and len(index.state().segments) < 9
    df = {r["term"]: r["df"] for r in index.frequencies().collect()}
    assert df == {r["term"]: r["df"] for r in lexical.postings(frame(now), "id").groupBy("term").agg(F.count("*").alias("df")).collect()}
    before = ranked(index.search(asked))
    assert index.vacuum(older_ms=-1) > 0 and ranked(index.search(asked)) == before


def test_merge_drops_what_was_deleted(spark, tmp_path, asked):
    index = TextIndex(spark, f"{tmp_path}/i")
    for k in range(3):
        index.add(spark.createDataFrame([(100 * k + j, f"w{j} w5") for j in range(20)], "id long, text string"))
    index.delete(spark.createDataFrame([(j,) for j in range(100, 104)], "id long"))
    index.add(spark.createDataFrame([(900 + j, f"w{j} w7") for j in range(20)], "id long, text string"))
    s = index.state()
    assert s.what == "merge" and len(s.segments) == 1 and s.dead == [] and s.segments[0]["rows"] == 76 and s.segments[0]["dead_rows"] == 0


def test_most_blocks_are_skipped(spark, tmp_path):
    """Shards whose bound stays below the seeds' k-th score are not read; what is found is the same."""
    rng = random.Random(3)
    rows = [(k, "common " * rng.randrange(1, 4) + "filler " * rng.randrange(20, 400) + ("rare " * rng.randrange(1, 9) if k % 40 == 0 else "")) for k in range(8000)]
    docs = spark.createDataFrame(rows, "id long, text string")
    asked = spark.createDataFrame([(1, "common rare"), (2, "common filler")], "query_id long, query string")
    index = TextIndex(spark, f"{tmp_path}/i")
    index.add(docs)
    assert ranked(index.search(asked)) == ranked(lexical.bm25(docs, asked, "id"))
    s = index.state()
    weighted = index.weighted(asked, s)
    rest, _, _ = index.survivors(asked, 10, s, weighted)
    blocks = lambda df: df.agg(F.coalesce(F.sum("n_blocks"), F.lit(0))).first()[0]
    assert blocks(rest) < 0.2 * blocks(index.bounds(asked, s, weighted))


def test_bounds_hold(spark, tmp_path, asked):
    index = TextIndex(spark, f"{tmp_path}/i")
    index.add(spark.createDataFrame(texts(4, 300), "id long, text string"))
    s = index.state()
    weighted = index.weighted(asked, s)
    bounds = index.bounds(asked, s, weighted)
    shards = {(r["query_id"], r["shard"]): r["bound"] for r in bounds.collect()}
    where = {r["id"]: r["shard"] for r in index._of(s, "docs").collect()}
    for r in index._scored(s, bounds, weighted, True).collect():
        assert r["score"] <= shards[r["query_id"], where[r["id"]]] + fulltext.SLACK


def test_large_batches_meet_blocks(spark, tmp_path, asked, monkeypatch):
    """Blocks of documents and of queries give what the plain search does: copies, ties beyond k, string keys, deletions, small blocks."""
    from lodestone.operators import scan

    monkeypatch.setattr(fulltext, "SCAN", -1)
    monkeypatch.setattr(scan, "TERMS", 40)
    rows = texts(6, 300) + [(1000 + j, "w5 w9 w150") for j in range(40)] + [(2000, None), (2001, "")]
    docs = spark.createDataFrame([(f"d{k}", t) for k, t in rows], "id string, text string")
    whole = spark.createDataFrame([(100 + k, t) for k, t in rows[:60]], "query_id long, query string")
    index = TextIndex(spark, f"{tmp_path}/i")
    index.add(docs)
    every = asked.unionByName(whole)
    assert ranked(index.search(every)) == ranked(lexical.bm25(docs, every, "id"))
    index.delete(docs.where("id like 'd1%'").select("id"))
    assert ranked(index.search(every, 3)) == ranked(lexical.bm25(docs.where("id not like 'd1%'"), every, "id", 3))


def test_large_batch_writes_no_pairs(spark, tmp_path, monkeypatch):
    """What leaves the tasks of a large batch is near k rows a query and task, not a row for each (query, shard)."""
    from lodestone.operators import scan

    monkeypatch.setattr(fulltext, "SCAN", -1)
    docs = spark.createDataFrame(texts(7, 3000), "id long, text string")
    index = TextIndex(spark, f"{tmp_path}/i")
    index.add(docs)
    asked = docs.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("text").alias("query"))
    kept, search = [], scan.search
    monkeypatch.setattr(scan, "search", lambda *a: kept.append(search(*a)) or kept[0])
    index.search(asked).count()
    assert 0 < kept[0].count() < index.bounds(asked).count() / 2


def test_postings_are_written_without_a_sort(spark, tmp_path, monkeypatch):
    """Spark sorts a task's rows once as many files are open as it allows: there is room for one more than a task has folders."""
    allowed, setting = {}, fulltext.setting
    monkeypatch.setattr(fulltext, "setting", lambda spark, key, value: allowed.update({key: value}) or setting(spark, key, value))
    docs = spark.createDataFrame(texts(8, 200), "id long, text string")
    index = TextIndex(spark, f"{tmp_path}/i")
    index.add(docs)
    folders = index._of(index.state(), "postings").select("bucket").distinct().count()
    assert folders == index.buckets < int(allowed["spark.sql.maxConcurrentOutputFileWriters"])


def test_index_of_nothing(spark, tmp_path, asked):
    index = TextIndex(spark, f"{tmp_path}/i")
    assert index.search(asked).count() == 0 and index.frequencies().count() == 0
    index.add(spark.createDataFrame([], "id long, text string"))
    assert index.search(asked).count() == 0
    index.delete(spark.createDataFrame([(1,)], "id long"))
    index.add(spark.createDataFrame([(1, "w5")], "id long, text string"))
    assert index.search(asked).count() == 1


def test_second_index_writer_is_told(spark, tmp_path, monkeypatch):
    one, two = (TextIndex(spark, f"{tmp_path}/i") for _ in range(2))
    docs = spark.createDataFrame([(1, "w5")], "id long, text string")
    base = two.state()
    one.add(docs)
    monkeypatch.setattr(two, "state", lambda n=None: base)
    with pytest.raises(Conflict):
        two.add(docs)


def test_index_follows_its_table(spark, tmp_path, asked):
    """After each write the index is brought to the table's version; what did not change is not indexed again."""
    t, index = VersionedTable(spark, f"{tmp_path}/t", buckets=16), TextIndex(spark, f"{tmp_path}/i")
    rows = lambda d: spark.createDataFrame([(f"s{k % 40}", k, x) for k, x in d], "source string, id long, body string")

    def same():
        index.follow(t, F.col("id"), "body")
        assert ranked(index.search(asked)) == ranked(lexical.bm25(t.read().select("id", F.col("body").alias("text")), asked, "id"))
        return index.state()

    assert index.follow(t, F.col("id"), "body").number == -1
    t.append(rows(texts(5, 200)))
    assert same().segments[0]["rows"] == 200 and index.follow(t, F.col("id"), "body").number == 0
    t.upsert(rows([(7, "w5 w9 changed"), (47, dict(texts(5, 200))[47]), (1007, "w5 new")]))
    s = same()
    # Of source s7, rows 7, 87, 127 and 167 are gone or changed, 47 is as it was; two are new.
    assert s.segments[-1]["rows"] == 2 and s.segments[0]["dead_rows"] == 4 and s.of == 1
    t.delete(spark.createDataFrame([("s7",), ("s8",)], "source string"))
    same()
    t.clear()
    assert same().n_docs == 0
    t.append(rows([(5, "w5 w5")]))
    same()
    t.upsert(rows([(5, "w9")]))
    t.vacuum(keep=1, older_ms=-1)
    assert same().n_docs == 1 and len(index.state().segments) == 1


def test_entry_names_every_operator():
    import importlib.util

    import __spark_entry__ as entry

    names = entry.queries()
    if importlib.util.find_spec("lodestone.llm"):
        assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} >= set(range(1, 14)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_blocks_are_full_over_batches():
    """A block goes on in the next Arrow batch: none is a small rest beside each full one."""
    import numpy as np
    import pyarrow as pa

    from lodestone.operators import scan

    def batches(sizes):
        for i, n in enumerate(sizes):
            words = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 3, pa.int32()), pa.array(np.arange(3 * n) % 11 + i, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) + 100 * i), words], ["key", "words"])

    old, scan.DOCS, scan.WORDS = (scan.DOCS, scan.WORDS), 60, 150
    try:
        got = [b.column(0).flatten().to_pylist() for b in scan.pack(batches([53, 53, 7, 0, 90]))]
    finally:
        scan.DOCS, scan.WORDS = old
    assert [len(x) for x in got] == [50, 50, 50, 50, 3] and sum(got, []) == [*range(53), *range(100, 153), *range(200, 207), *range(400, 490)]


@pytest.mark.parametrize("sparse", [0.0, 1.0, 100.0])
def test_thresholds_lose_nothing(spark, tmp_path, asked, monkeypatch, sparse):
    """Many small blocks in a task, a matrix of few rows, a few entries at once: the same hits, and the same ranks of the rows that are expected."""
    from lodestone.operators import scan

    monkeypatch.setattr(fulltext, "SCAN", -1)
    for name, x in (("DOCS", 30), ("QUERIES", 7), ("ENTRIES", 40), ("COMMON", 0.2), ("MATRIX", 3), ("SPARSE", sparse)):
        monkeypatch.setattr(scan, name, x)
    rows = texts(9, 300) + [(1000 + j, "w5 w9 w150") for j in range(40)] + [(1100 + j, "w5") for j in range(40)]
    docs = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    index = TextIndex(spark, f"{tmp_path}/i")
    index.add(docs)
    every = asked.unionByName(docs.select((F.col("id") + 5000).alias("query_id"), F.col("text").alias("query")))
    plain = ranked(lexical.bm25(docs, every, "id"))
    assert ranked(index.search(every)) == plain
    expected = every.where("query_id >= 5000").select("query_id", (F.col("query_id") - 5000).alias("id"))
    places = lambda hits: sorted((r["query_id"], r["rank"]) for r in hits.join(expected, ["query_id", "id"]).collect())
    got = index.search(every, expected=expected)
    assert places(got) == places(lexical.bm25(docs, every, "id")) and got.count() < len(plain)
