"""The given tables, and the search batches that queries use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import CONTENT_CHARS
from ..operators.common import spread
from ..operators.fulltext import TextIndex
from ..sources.shared import new_folder

_indexes: dict[tuple[str, str], TextIndex] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the documents, in as many tasks as there are cores at least, for work that takes long for each text."""
    return spread(table(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text"))))


def item_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth benchmark item as a full-text query."""
    return table(spark, sf_dir, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def hybrid_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth document that has a vector (vec_id = doc_id): its first 60 characters and its vector."""
    docs = table(spark, sf_dir, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 60).alias("query"))
    return docs.join(vector_queries(spark, sf_dir), "query_id")


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, raw_text, source) of the documents with the first CONTENT_CHARS characters only, by which contents are told apart."""
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, CONTENT_CHARS).alias("raw_text"), "source")


def document_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The full-text index of the documents: built by the first query of an application that asks for it, read by all later ones."""
    name = spark.sparkContext.applicationId, sf_dir
    if name not in _indexes:
        index = TextIndex(spark, new_folder(spark, "documents-index"), "doc_id")
        index.add(table(spark, sf_dir, "documents"))
        _indexes[name] = index
    return _indexes[name]
