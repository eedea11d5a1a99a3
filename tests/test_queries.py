"""Every registered query of the library against its SQL, on the smallest tables."""

import duckdb
import pytest

from lodestone.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(frame):
    """Rows as sorted text, floats to six places."""

    def one(v):
        if isinstance(v, float):
            return f"{v:.6f}"
        return str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)

    cols = sorted(frame.columns)
    rows = frame[cols].astype(object).where(frame[cols].notna(), None)
    return cols, sorted(map(str, (tuple(map(one, r)) for r in rows.itertuples(index=False, name=None))))


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, small, duck, name):
    assert canon(QUERIES[name](spark, small).toPandas()) == canon(duck.sql(ORACLES[name]).df())


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


@pytest.mark.parametrize("name", ["content_key_dedup", "rrf_two_track", "keep_best", "hybrid_whole_texts"])
def test_empty_and_missing_texts_against_sql(spark, tmp_path, name):
    """The empty text is a content like any other, and rows without a text have no key."""
    texts = [None, "", "one two", None, "", "one two three", "x" * 250, "x" * 201]
    rows = [(20 * k, t, "ab"[k % 2] if k != 3 else None, [float(k), 1.0]) for k, t in enumerate(texts)]
    whole = spark.createDataFrame(rows, "id long, text string, source string, embedding array<float>").coalesce(1)
    whole.selectExpr("id doc_id", "text", "source").write.parquet(f"{tmp_path}/documents.parquet")
    whole.selectExpr("id vec_id", "embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert canon(QUERIES[name](spark, str(tmp_path)).toPandas()) == canon(con.sql(ORACLES[name]).df())


def test_every_document_asks_for_similar_texts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert QUERIES["similar_texts"](spark, small).select("query_id").distinct().count() == docs.where("text <> ''").count()
