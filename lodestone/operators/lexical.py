"""Full-text search: BM25 over tokenised text, as one DataFrame plan for a batch of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .common import BROADCAST_ROWS, small

K1, B = 1.2, 0.75


def postings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, tf, doc_len): a row for each distinct term of each row."""
    words = docs.select(key, tokens(F.col(text)).alias("words"))
    words = words.select(key, F.explode("words").alias("term"), F.size("words").cast("long").alias("doc_len"))
    return words.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("doc_len").alias("doc_len"))


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: n_docs, total_len, avg_len."""
    n = F.size(tokens(F.col(text)))
    return docs.agg(F.count("*").alias("n_docs"), F.sum(n.cast("long")).alias("total_len"), F.avg(n.cast("double")).alias("avg_len"))


def bm25(docs: DataFrame, queries: DataFrame, key: str, k: int = 10, text: str = "text", where: str | None = None) -> DataFrame:
    """queries: query_id, query -> query_id, key, score, rank (from 1); ties go to the lower key.

    Only rows that hold a term of some query leave their task, with one count for each of these terms: texts are matched
    against the distinct query terms before anything is shuffled, so that common words of no query cost nothing. The rows
    that ``where`` keeps are the corpus, statistics included.
    """
    if where:
        docs = docs.where(where)
    wanted = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    words = tokens(F.col(text))
    lens = docs.select(key, words.alias("words"), F.size(words).cast("long").alias("doc_len"))
    stats = docs.agg(F.count("*").alias("n_docs"), F.avg(F.size(words).cast("double")).alias("avg_len"))
    terms = wanted.select("term").distinct()
    few = terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hits = lens.select(key, "doc_len", F.explode("words").alias("term")).join(F.broadcast(terms) if few else terms, "term")
    tf = hits.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("doc_len").alias("doc_len"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    # Of the query terms df has a row each at most, so their number bounds it too.
    rows = tf.join(F.broadcast(df) if few else df, "term").crossJoin(F.broadcast(stats))  # one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len")))
    scored = rows.withColumn("part", part).join(small(wanted), "term").groupBy("query_id", key).agg(F.round(F.sum("part"), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def normalised(score):
    """A raw full-text score on the scale of the other tracks."""
    return F.when(score > 0, F.least(F.lit(1.0), score / 10)).otherwise(F.lit(0.1))


def idf_table(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(term, df, idf) of every term."""
    n = docs.count()
    df = postings(docs, key, text).groupBy("term").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.log(F.lit(1.0) + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def idf_by(docs: DataFrame, key: str, by: str, text: str = "text") -> DataFrame:
    """(by, term, df, idf) of every term in the rows of each value of ``by``, null among them."""
    words = docs.select(by, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    df = words.groupBy(by, "term").agg(F.count("*").alias("df"))
    n = docs.groupBy(F.col(by).alias("__by")).agg(F.count("*").alias("n_docs"))
    out = df.join(small(n), F.col(by).eqNullSafe(F.col("__by"))).drop("__by")
    return out.select(by, "term", "df", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
