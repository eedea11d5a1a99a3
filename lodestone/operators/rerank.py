"""Reranking: scores by a hook, a threshold with a guaranteed minimum, and a registry of rerankers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens, value

THRESHOLD, MIN_KEEP = 0.4, 3


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def overlap_score(query: Column, text: Column) -> Column:
    """The default reranker: a sigmoid of the share of query terms that the text holds. A stand-in without a model."""
    q = F.array_distinct(tokens(query))
    both = F.size(F.array_intersect(q, tokens(text)))
    return F.round(sigmoid(F.lit(6.0) * both / F.greatest(F.size(q), F.lit(1)) - F.lit(3.0)), 6)


def rerank(hits: DataFrame, score: Column, top_k: int = 5, threshold: float = THRESHOLD, min_keep: int = MIN_KEEP) -> DataFrame:
    """hits: query_id, seq, raw_text, score -> original_score, rerank_score, rank.

    Rows without text go. What reaches the threshold stays; if fewer than ``min_keep`` do, the best ``min_keep`` stay
    instead; then the first ``top_k``.
    """
    h = hits.where(value(F.col("raw_text")).isNotNull()).withColumn("rerank_score", score).withColumnRenamed("score", "original_score")
    q = Window.partitionBy("query_id")
    h = h.withColumn("n_ok", F.count_if(F.col("rerank_score") >= threshold).over(q))
    h = h.withColumn("rank", F.row_number().over(q.orderBy(F.desc("rerank_score"), "seq")).cast("long"))
    keep = F.when(F.col("n_ok") < min_keep, F.col("rank") <= min_keep).otherwise(F.col("rerank_score") >= threshold)
    return h.where(keep & (F.col("rank") <= top_k)).drop("n_ok")


#: Rerankers by name: (query, text) columns to a score column. A model is a pandas UDF of this shape.
RERANKERS: dict[str, Callable[[Column, Column], Column]] = {"overlap": overlap_score}


def register(name: str, scorer: Callable[[Column, Column], Column]) -> None:
    RERANKERS[name] = scorer


def create(name: str) -> Callable[[Column, Column], Column]:
    if name not in RERANKERS:
        raise ValueError(f"unknown reranker {name!r}; there are {sorted(RERANKERS)}")
    return RERANKERS[name]


def from_config(config: dict) -> Callable[[Column, Column], Column]:
    return create(config.get("reranker", {}).get("name", "overlap"))
