"""Cited, budgeted context and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import file_name

SEPARATOR = "\n\n---\n\n"
CUT = "\n[cut]"
EMPTY = "(nothing relevant was found)"
TEMPLATES = {
    "default": "Answer from the passages below and cite them by number.\n\n{context}\n\n{extra}\n\nQuestion: {query}\n",
    "summary": "Summarise what the passages say about the question.\n\n{context}\n\n{extra}\n\nQuestion: {query}\n",
}


def register(name: str, template: str) -> None:
    """Add a template, a text with {query}, {context} and {extra}, or replace one."""
    if "{query}" not in template or "{context}" not in template:
        raise ValueError("a template has {query} and {context}")
    TEMPLATES[name] = template


def citation(source: Column, chunk_type: Column, page: Column) -> Column:
    """Name of the source, with page and kind of chunk where there are any."""
    kind = F.when(F.coalesce(chunk_type, F.lit("text")) != "text", F.concat(F.lit(" "), chunk_type)).otherwise("")
    name = file_name(F.coalesce(source, F.lit("")))
    return F.when(page > 0, F.concat(name, F.lit(" p."), page.cast("string"), kind)).otherwise(F.concat(name, kind))


def part(rank: Column, label: Column, text: Column) -> Column:
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] "), label, F.lit("\n"), text)


def budgeted(parts: DataFrame, max_tokens: int, separator: str = SEPARATOR) -> DataFrame:
    """parts: query_id, rank, part -> query_id, context, n_used, n_all: whole parts while they fit, in order of rank.

    The running length counts a separator for each part. If all fit without the last separator, all are taken. If not even
    the first fits, it is cut hard and marked.
    """
    budget = int(max_tokens * 1.5)
    running = F.sum(F.length("part") + len(separator)).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    p = parts.withColumn("total", running).withColumn("all", F.sum(F.length("part") + len(separator)).over(Window.partitionBy("query_id")) - len(separator))
    p = p.withColumn("fits", (F.col("all") <= budget) | (F.col("total") <= budget))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["part"]), separator)
    agg = p.groupBy("query_id").agg(
        text(F.when(F.col("fits"), F.struct("rank", "part"))).alias("whole"), F.count_if("fits").alias("n_used"), F.count("*").alias("n_all"), F.min_by("part", "rank").alias("first")
    )
    hard = F.concat(F.substring("first", 1, max(0, budget - len(CUT))), F.lit(CUT))
    foot = F.when(F.col("n_used") < F.col("n_all"), F.concat(F.lit("\n\n("), F.col("n_used"), F.lit(" of "), F.col("n_all"), F.lit(" passages)"))).otherwise("")
    return agg.select("query_id", F.when(F.col("n_used") > 0, F.concat("whole", foot)).otherwise(hard).alias("context"), "n_used", "n_all")


def build(hits: DataFrame, max_tokens: int = 4000) -> DataFrame:
    """hits: query_id, rank, source, chunk_type, page, raw_text -> context by query."""
    label = citation(F.col("source"), F.col("chunk_type"), F.col("page"))
    return budgeted(hits.select("query_id", "rank", part(F.col("rank"), label, F.col("raw_text")).alias("part")), max_tokens)


def render(queries: DataFrame, contexts: DataFrame, template: str = "default", extra: str = "") -> DataFrame:
    """queries: query_id, query -> prompt; unknown templates are the default one."""
    text = TEMPLATES.get(template, TEMPLATES["default"])
    both = queries.join(contexts, "query_id", "left")
    prompt = F.lit(text.replace("{extra}", extra))
    prompt = F.replace(prompt, F.lit("{context}"), F.coalesce("context", F.lit(EMPTY)))
    return both.select("query_id", F.replace(prompt, F.lit("{query}"), F.col("query")).alias("prompt"))


def context_budget(max_tokens: int, template: str, query: str, extra: str = "") -> int:
    """Tokens left for passages."""
    estimate = lambda s: int(len(s) / 1.5)
    return max(0, max_tokens - estimate(TEMPLATES.get(template, TEMPLATES["default"])) - estimate(query) - estimate(extra) - 100)
