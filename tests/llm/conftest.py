"""Awkward tables: nulls in every column, empty and long texts, repeated rows, and columns named like the operators' own."""

import pytest

EXTRA = ", size int, h int, fp int, id int, text_hash int, lines int, spans int, target int, score int, host int, bin int, chunk int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TABLES = {
    "documents": DOCS + EXTRA,
    "benchmark": "item_id long, text string" + EXTRA,
    "labels": "doc_id long, quality int, toxic int" + EXTRA,
    "pages": "page_id long, url string, html string" + EXTRA,
}


def pad(rows):
    return [(*r, *range(EXTRA.count(","))) for r in rows]


@pytest.fixture(scope="session")
def rows(spark, small):
    """The documents' rows."""
    base = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    text = base[3][1]
    odd = [
        (1000, None, None, None, None), (1001, "", "en", "src0", 0), (None, text, "en", None, 5), (None, "Some words of a row without an id", None, "src1", 9),
        (1002, " \t\n\x0b ", "de", "src0", 5), (1003, "\x1c one word", "en", "src0", 5), (1004, "word " * 60000, "en", "src0", 300000), (1005, "12 34\n56 !!", "en", "src2", 11),
        (1006, text + " tail", "en", "src0", 9), (1007, text, "en", "src0", 9), (1008, "x" * 100, "en", "src0", 9), (1009, "x" * 100, "en", "src0", 9), (1010, "é" * 300 + "ab" * 200, "fr", "src3", 9),
        (1011, "A b", "en", "src0", 3), (1012, "a B", "en", "src0", 3),
    ]
    return base + odd + [odd[9], odd[9], odd[2], odd[8]] + [(2000 + k, f"Page {k} of the same report with some words\nOwn line {text[k : k + 40]}", "en", "src4", 0) for k in range(14)]


@pytest.fixture(scope="session")
def awkward(spark, small, rows, tmp_path_factory):
    d = tmp_path_factory.mktemp("awkward")
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()] + [(900, None), (901, ""), (902, "two words"), (None, "of the same report with some"), (903, rows[5][1][:200]), (903, rows[5][1][:200])]
    labels = [(r[0], 1, int(k % 5 == 0)) for k, r in enumerate(rows)] + [(None, None, None), (3, 0, None), (777777, 1, 1)]
    pages = [tuple(r) for r in spark.read.parquet(f"{small}/pages.parquet").limit(20).collect()] + [(None, None, None), (70, "", ""), (71, "no address", "<p>some words</p>"), (72, "http://a.de/x", None)]
    for name, data in (("documents", rows), ("benchmark", items), ("labels", labels), ("pages", pages)):
        spark.createDataFrame(pad(data), TABLES[name]).repartition(3).write.parquet(f"{d}/{name}.parquet")
    return str(d)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{d}/{name}.parquet")
    return str(d)
