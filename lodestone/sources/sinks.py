"""Sinks: notes, alerts, histories, JSON answers, evaluation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import bullets, safe_name
from ..operators.classify import severity

#: Marks of an alert's level.
ICONS = {"info": "i", "warning": "!", "error": "x"}


def note_texts(rows: DataFrame) -> DataFrame:
    """rows: title, url, tags array, points array, body -> (file_name, content) of Markdown notes with front matter."""
    quoted = F.concat(F.lit('"'), F.regexp_replace("title", '["\\\\]', ""), F.lit('"'))
    head = F.concat(F.lit("---\ntitle: "), quoted, F.lit("\nsource: "), F.coalesce("url", F.lit("")), F.lit("\ntags: ["), F.array_join("tags", ", "), F.lit("]\n---\n"))
    content = F.concat(head, F.lit("# "), F.col("title"), F.lit("\n\n"), bullets(F.col("points")), F.lit("\n\n"), F.coalesce("body", F.lit("")), F.lit("\n"))
    return rows.select(F.concat(safe_name(F.col("title")), F.lit(".md")).alias("file_name"), content.alias("content"))


def alerts(batches: DataFrame) -> DataFrame:
    """batches: job, failed, succeeded -> an alert for each that had failures."""
    level = severity(F.col("failed"), F.col("succeeded"))
    icon = F.create_map(*[F.lit(x) for kv in ICONS.items() for x in kv])[F.col("level")]
    text = F.format_string("%s: %d of %d failed", F.col("job"), F.col("failed"), F.col("failed") + F.col("succeeded"))
    return batches.withColumn("level", level).where("level is not null").select("job", "level", icon.alias("icon"), text.alias("message"))


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def answers(hits: DataFrame, chars: int = 500) -> DataFrame:
    """hits: query_id, rank, id, source, raw_text, score, maybe rerank_score -> one JSON text for each query."""
    score = F.coalesce("rerank_score", "score") if "rerank_score" in hits.columns else F.col("score")
    hit = F.struct("rank", "id", "source", F.substring("raw_text", 1, chars).alias("text"), F.bround(score, 4).alias("score"))
    return hits.groupBy("query_id").agg(F.to_json(F.array_sort(F.collect_list(hit))).alias("json"))


def report(summary: DataFrame) -> str:
    """A one-row evaluation summary as Markdown."""
    r = summary.first().asDict()
    return "# Retrieval report\n\n| Metric | Value |\n|-|-|\n" + "".join(f"| {k} | {v} |\n" for k, v in r.items())
