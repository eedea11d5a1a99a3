"""One object for the usual work: index notes, search, build context and prompts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import context, fusion, ingest, lexical, rerank, vector
from .operators.fulltext import TextIndex
from .sources import files
from .streaming.ingest import SnapshotTable


@dataclass
class Settings:
    vector_top_k: int = 15
    fts_top_k: int = 10
    rerank_top_k: int = 5
    threshold: float = rerank.THRESHOLD
    max_tokens: int = 4000
    dim: int = 64
    reranker: str = "overlap"


class Library:
    """A chunk table in a folder, with batches of queries (query_id, query) as input of every search.

    ``embed`` turns (rows, key, text) into (key, vector); ``rewrite`` turns a query column into an array of query columns'
    texts, the query itself by default.
    """

    def __init__(self, spark: SparkSession, path: str, settings: Settings | None = None, embed: Callable | None = None, rewrite: Callable[[Column], Column] | None = None):
        self.spark, self.settings, self.table = spark, settings or Settings(), SnapshotTable(spark, path)
        self.text = TextIndex(spark, f"{path.rstrip('/')}/text-index", "key")
        self.embed = embed or (lambda rows, key, text: vector.hashed_embeddings(rows, key, text, self.settings.dim))
        self.rewrite = rewrite or (lambda q: F.array(q))

    def chunks(self) -> DataFrame:
        rows = self.table.current()[1]
        return files.chunk_table(self.spark, f"{self.table.path}/none") if rows is None else rows

    def index(self, root: str, skip_dirs: list[str] | None = None, prefix: str = "") -> None:
        """Replace the chunks of every note below ``root``; notes of other folders stay."""
        self.table.upsert(ingest.chunk_rows(files.markdown(self.spark, root, skip_dirs), prefix, dim=self.settings.dim))

    def add(self, rows: DataFrame) -> None:
        """Append rows (id, text and any other columns of the chunk table); nothing is rewritten."""
        self.table.append(ingest.completed(rows, self.settings.dim))

    def clear(self) -> None:
        """Leave no chunk; earlier versions can be read until a vacuum."""
        self.table.clear()

    def count(self) -> int:
        return self.chunks().count()

    def _tracks(self, queries: DataFrame, where: str | None, tracks: tuple[str, ...]) -> DataFrame:
        s, rows = self.settings, self.chunks()
        keyed = rows.withColumn("key", F.xxhash64("id"))
        asked = queries.select("query_id", F.posexplode(self.rewrite(F.col("query"))).alias("rewrite", "query"))
        asked = asked.withColumn("ask", F.xxhash64("query_id", "rewrite"))
        parts = []
        if "vector" in tracks:
            q = self.embed(asked, "ask", "query").select(F.col("ask").alias("query_id"), F.col("vector").alias("query_vector"))
            near = vector.knn(keyed, q, "key", "vector", s.vector_top_k, where=where)
            parts.append(near.select("query_id", "key", "score", "rank", F.lit("vector").alias("track")))
        if "fts" in tracks:
            words = asked.select(F.col("ask").alias("query_id"), "query")
            if where is None:
                # Kept on disk and brought to the table's version; what a filter keeps is a corpus with statistics of its own.
                self.text.follow(self.table, F.xxhash64("id"), "raw_text")
                text = self.text.search(words, s.fts_top_k)
            else:
                text = lexical.bm25(keyed, words, "key", s.fts_top_k, "raw_text", where)
            parts.append(text.select("query_id", "key", lexical.normalised(F.col("score")).alias("score"), "rank", F.lit("fts").alias("track")))
        hits = None
        for p in parts:
            hits = p if hits is None else hits.unionByName(p)
        hits = hits.withColumnRenamed("query_id", "ask").join(asked.select("ask", "query_id", "rewrite"), "ask").drop("ask")
        order = F.row_number().over(fusion.Window.partitionBy("query_id").orderBy("rewrite", F.desc("track"), "rank")).cast("long")
        return hits.withColumn("seq", order).join(keyed.drop("text", "vector", "tokenized_text"), "key")

    def search(self, queries: DataFrame, top_k: int | None = None, where: str | None = None, use_rerank: bool = True, tracks: tuple[str, ...] = ("vector", "fts")) -> DataFrame:
        """query_id, rank, id, source, raw_text, chunk_type, page, score (and rerank_score) of the best chunks."""
        k = top_k or self.settings.rerank_top_k
        fused = fusion.rrf(self._tracks(queries, where, tracks))
        about = self.chunks().select("id", "chunk_type", "page", "h1", "h2", "filename")
        if not use_rerank:
            return fused.where(F.col("rank") <= k).withColumnRenamed("rrf", "score").drop("key").join(about, "id")
        scorer = rerank.create(self.settings.reranker)
        rows = fused.withColumnRenamed("rank", "seq").withColumnRenamed("rrf", "score").drop("key").join(queries.select("query_id", "query"), "query_id")
        best = rerank.rerank(rows, scorer(F.col("query"), F.col("raw_text")), k, self.settings.threshold)
        return best.drop("query", "seq").withColumnRenamed("original_score", "score").join(about, "id")

    def context(self, queries: DataFrame, **kw) -> DataFrame:
        return context.build(self.search(queries, **kw), self.settings.max_tokens)

    def prompt(self, queries: DataFrame, template: str = "default", extra: str = "", **kw) -> DataFrame:
        return context.render(queries, self.context(queries, **kw), template, extra)
