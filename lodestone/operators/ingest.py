"""From Markdown notes to rows of the chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import split as S
from ..functions import text as T
from ..schema import CHUNKS, DEFAULTS
from .classify import VIDEO_MARKERS, isolated
from .vector import hashed_embedding


def notes(files: DataFrame) -> DataFrame:
    """files: source, filename, content -> these with body, category, tags, rag, kind of the front matter."""
    f = files.withColumn("fm", T.frontmatter(F.col("content")))
    yaml = F.coalesce(F.col("fm.yaml"), F.lit(""))
    flag = F.lower(T.yaml_field(yaml, "rag"))
    return f.select(
        "source", "filename", F.col("fm.body").alias("body"),
        T.yaml_field(yaml, "category").alias("category"), F.coalesce(T.yaml_list(yaml, "tags"), F.array().cast("array<string>")).alias("tags"),
        F.when(flag == "true", True).when(flag == "false", False).alias("rag"), T.yaml_field(yaml, "type").alias("kind"),
    )


def chunk_rows(files: DataFrame, prefix: str = "", markers: list[str] | None = None, max_tokens: int = 480, least: int = 100, dim: int = 64) -> DataFrame:
    """Rows of the chunk table for all notes that aren't isolated. Ids are prefix + source + '#' + position in the file."""
    n = notes(files).where(~isolated(F.col("rag"), F.col("kind"), F.col("body"), F.col("filename"), VIDEO_MARKERS if markers is None else markers))
    c = n.select("source", "filename", "category", "tags", F.posexplode(S.chunks(F.col("body"), F.col("filename"), S.max_chars(max_tokens), least)).alias("pos", "c"))
    head = S.prefix(F.col("filename"), F.col("c.h1"), F.col("c.h2"), F.col("category"), F.col("tags"))
    rows = c.select(
        F.concat(F.lit(prefix), "source", F.lit("#"), F.col("pos").cast("string")).alias("id"), F.concat_ws("\n\n", head, "c.body").alias("text"), F.col("c.body").alias("raw_text"),
        "source", "filename", F.col("c.h1").alias("h1"), F.col("c.h2").alias("h2"), F.coalesce("category", F.lit("")).alias("category"), F.array_join("tags", ", ").alias("tags"),
        F.length("c.body").alias("char_count"), T.tokenized(F.col("c.body")).alias("tokenized_text"),
        F.lit("text").alias("chunk_type"), F.lit(0).alias("page"), F.lit("").alias("timestamp"), F.lit("").alias("figure_path"),
    )
    return rows.withColumn("vector", hashed_embedding(F.col("text"), dim)).select(*CHUNKS.names)


def completed(rows: DataFrame, dim: int = 64) -> DataFrame:
    """Rows of the chunk table from what there is of them (id, text at least): other columns have their defaults, tokens and vector are worked
    out where they are missing."""
    have = {n: F.col(n) if n in rows.columns else F.lit(None) for n in CHUNKS.names}
    out = rows.select(*[have[f.name].cast(f.dataType).alias(f.name) for f in CHUNKS.fields])
    out = out.fillna(DEFAULTS).withColumn("raw_text", F.coalesce("raw_text", "text")).withColumn("char_count", F.coalesce("char_count", F.length("raw_text")))
    out = out.withColumn("tokenized_text", F.coalesce(T.value(F.col("tokenized_text")), T.tokenized(F.col("raw_text"))))
    return out.withColumn("vector", F.coalesce("vector", hashed_embedding(F.col("text"), dim))).select(*CHUNKS.names)


def figure_rows(described: DataFrame, dim: int = 64) -> DataFrame:
    """described: source, page, description, kind ('figure', 'table', 'frame'), figure_path -> rows of the chunk table.

    Descriptions come from a hook; pages are 1-based.
    """
    name = T.stem(F.col("source"))
    rows = described.where(T.value(F.col("description")).isNotNull()).select(
        F.concat_ws("#", "source", F.col("kind"), F.col("page").cast("string"), F.md5("description")).alias("id"), F.col("description").alias("text"), F.col("description").alias("raw_text"),
        "source", name.alias("filename"), name.alias("h1"), F.lit("").alias("h2"), F.lit("").alias("category"), F.lit("").alias("tags"), F.length("description").alias("char_count"),
        T.tokenized(F.col("description")).alias("tokenized_text"), F.col("kind").alias("chunk_type"), F.col("page").cast("int").alias("page"), F.lit("").alias("timestamp"), "figure_path",
    )
    return rows.withColumn("vector", hashed_embedding(F.col("text"), dim)).select(*CHUNKS.names)


def page_rows(pages: DataFrame, most: int = 2000, overlap: int = 200, dim: int = 64) -> DataFrame:
    """pages: source, page, text of a parser -> rows of the chunk table."""
    name = T.stem(F.col("source"))
    rows = page_texts(pages, most, overlap).select(
        F.concat_ws("#", "source", F.lit("p"), F.col("page").cast("string"), F.col("pos").cast("string")).alias("id"), "text", F.col("text").alias("raw_text"), "source", name.alias("filename"),
        name.alias("h1"), F.lit("").alias("h2"), F.lit("").alias("category"), F.lit("").alias("tags"), F.length("text").alias("char_count"), T.tokenized(F.col("text")).alias("tokenized_text"),
        F.lit("text").alias("chunk_type"), F.col("page").cast("int").alias("page"), F.lit("").alias("timestamp"), F.lit("").alias("figure_path"),
    )
    return rows.withColumn("vector", hashed_embedding(F.col("text"), dim)).select(*CHUNKS.names)


def document_rows(pages: DataFrame, described: DataFrame, **kw) -> DataFrame:
    """Texts of pages and descriptions of figures as rows of one chunk table."""
    return page_rows(pages, **kw).unionByName(figure_rows(described, kw.get("dim", 64)))


def in_page_order(described: DataFrame, by: str, page: str = "page", *then: str) -> DataFrame:
    """Descriptions with their place (from 0) by page in each file; those of a page stay in the order of ``then``."""
    return described.withColumn("place", (F.row_number().over(Window.partitionBy(by).orderBy(F.col(page).asc_nulls_last(), *then)) - 1).cast("long"))


def recognised(lines: DataFrame, by: list[str], pos: str = "pos") -> DataFrame:
    """lines: by, pos, text, confidence of a recogniser -> by, text (lines in their order), confidence (their mean), n_lines."""
    row = F.struct(pos, "text")
    out = lines.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("r"), F.avg("confidence").alias("confidence"), F.count("*").alias("n_lines"))  # of one page each
    return out.select(*by, F.array_join(F.transform("r", lambda x: x["text"]), "\n").alias("text"), "confidence", "n_lines")


def page_texts(pages: DataFrame, most: int = 2000, overlap: int = 200) -> DataFrame:
    """pages: source, page, text of a parser -> (source, page, pos, text): cleaned and cut into overlapping windows."""
    p = pages.withColumn("text", T.clean(F.coalesce("text", F.lit("")))).where("text <> ''")
    return p.select("source", "page", F.posexplode(S.sliding(F.col("text"), most, overlap)).alias("pos", "text"))
