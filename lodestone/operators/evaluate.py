"""Retrieval evaluation: hit rate, reciprocal rank, latency, bands; rubric scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def judged(golden: DataFrame, results: DataFrame) -> DataFrame:
    """golden: query_id, expected_id, expected_source; results: query_id, rank, id, source -> query_id, hit_rank (NULL: none).

    A result is a hit by equal id, or if its source, which must not be empty, is the expected one or a part of the id.
    """
    both = golden.join(results, "query_id", "left")
    src = F.coalesce("source", F.lit(""))
    hit = (F.col("id") == F.col("expected_id")) | ((src != "") & ((src == F.col("expected_source")) | F.col("expected_id").contains(src)))
    return both.groupBy("query_id").agg(F.min(F.when(hit, F.col("rank"))).alias("hit_rank"))


def summary(judgements: DataFrame) -> DataFrame:
    """One row: n_queries, n_hits, hit_rate, mrr."""
    return judgements.agg(
        F.count("*").alias("n_queries"),
        F.count("hit_rank").alias("n_hits"),
        F.round(F.avg(F.col("hit_rank").isNotNull().cast("double")), 6).alias("hit_rate"),
        F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("hit_rank"), F.lit(0.0))), 6).alias("mrr"),
    )


def band(x: Column, good: float, fair: float) -> Column:
    return F.when(x > good, "good").when(x > fair, "fair").otherwise("poor")


def latency_band(ms: Column) -> Column:
    return F.when(ms < 500, "good").when(ms < 1000, "fair").otherwise("poor")


def latency(rows: DataFrame, ms: str, ok: Column) -> DataFrame:
    """One row: n, success_rate, min_ms, max_ms, avg_ms."""
    n = F.count("*")
    return rows.agg(n.alias("n"), F.round(F.try_divide(F.count_if(ok).cast("double"), n), 6).alias("success_rate"), F.round(F.min(ms), 6).alias("min_ms"), F.round(F.max(ms), 6).alias("max_ms"), F.round(F.avg(ms), 6).alias("avg_ms"))


def rubric(rows: DataFrame, key: str, criteria: dict[str, tuple[Column, float]]) -> DataFrame:
    """Composite score by key: the mean over rows of the weights of the criteria that hold."""
    total = F.lit(0.0)
    for cond, weight in criteria.values():
        total = total + F.when(cond, weight).otherwise(0.0)
    return rows.groupBy(key).agg(F.round(F.avg(total), 6).alias("score"), F.count("*").alias("n"))
