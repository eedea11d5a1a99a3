"""File sources: Markdown trees, work lists, JSON collections, recent files, parser hooks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_name, stem
from ..operators.classify import skipped_path
from ..schema import CHUNKS


def chunk_table(spark: SparkSession, path: str) -> DataFrame:
    """The stored chunk table; empty if there is none yet."""
    hadoop = spark.read.schema(CHUNKS).option("ignoreMissingFiles", True)
    try:
        return hadoop.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], CHUNKS)
        raise


def markdown(spark: SparkSession, root: str, skip_dirs: list[str] | None = None) -> DataFrame:
    """source, filename, content, modified of every Markdown file below ``root``, or of the one file that it names, that isn't hidden or skipped."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    path = F.regexp_replace("path", r"^file:/+", "/")
    rows = raw.select(path.alias("source"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("modified"))
    return rows.where(~skipped_path(F.col("source"), skip_dirs or [])).withColumn("filename", stem(F.col("source")))


def recent(files: DataFrame, days: int, now=None) -> DataFrame:
    """Files changed in the last days: title and the first 1000 characters."""
    since = (F.current_timestamp() if now is None else F.lit(now)) - F.make_dt_interval(F.lit(days))
    return files.where(F.col("modified") >= since).select("source", F.col("filename").alias("title"), F.substring("content", 1, 1000).alias("head"))


def work_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("source")).where("source <> ''")


def papers(spark: SparkSession, glob: str) -> DataFrame:
    """Rows of JSON files that hold an array ``papers``; arxiv_id is the tail of the address."""
    schema = "papers array<struct<title:string,url:string,authors:array<string>,published:string,summary:string,score:double>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(glob).select(F.explode("papers").alias("p"), F.col("_metadata.file_modification_time").alias("ingested"))
    return rows.select(file_name(F.col("p.url")).alias("arxiv_id"), "p.*", F.array_join("p.authors", ", ").alias("author_names"), "ingested")


def output_dirs(paths: DataFrame, indexed: DataFrame) -> DataFrame:
    """Folders named name_timestamp with their Markdown: name, ts, status indexed or pending."""
    p = paths.select("source", F.regexp_extract("source", r"([^/]*)_(\d{10})/[^/]*\.md$", 1).alias("name"), F.regexp_extract("source", r"_(\d{10})/[^/]*\.md$", 1).alias("ts"))
    p = p.where("name <> ''").withColumn("ts", F.col("ts").cast("long"))
    return p.join(indexed.select("source").distinct().withColumn("there", F.lit(True)), "source", "left").select("source", "name", "ts", F.when(F.col("there"), "indexed").otherwise("pending").alias("status"))


def parsed(files: DataFrame, parser: Callable[[bytes, str], list[dict]], schema: str, reason: str | None = None) -> DataFrame:
    """Binary files through a parser hook (PDF, PPTX, EPUB, OCR): the rows of each file, with its path as ``source``.

    The hook runs in the executors, one file at a time. ``schema`` is that of its rows. With ``reason`` a file that it can't read is a row
    of nulls with the reason in a column of that name, which is null in others' rows; without, the job fails.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"]):
                try:
                    rows = [{"source": path, **r} for r in parser(content, path)]
                except Exception as e:  # a hook of any kind
                    if reason is None:
                        raise
                    rows = [{"source": path, reason: f"{type(e).__name__}: {e}"}]
                yield pd.DataFrame(rows, columns=names, dtype=object)

    kinds = f"source string, {schema}" + (f", `{reason}` string" if reason else "")
    names = files.sparkSession.createDataFrame([], kinds).columns
    return files.select("path", "content").mapInPandas(run, kinds)


def observed(rows: DataFrame, job: str, reason: str = "reason") -> tuple[DataFrame, Callable[[], DataFrame]]:
    """``parsed`` rows, and what gives (job, failed, succeeded) for ``sinks.alerts`` once an action has run over them: the counts are taken
    in passing, without another scan."""
    seen = Observation(job)
    bad = F.col(reason).isNotNull()
    counted = rows.observe(seen, F.count_if(bad).alias("failed"), F.count_if(~bad).alias("succeeded"))
    return counted, lambda: rows.sparkSession.createDataFrame([(job, seen.get["failed"], seen.get["succeeded"])], "job string, failed long, succeeded long")


def sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows chosen by a hash: the same ones in every run."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}"))), key).limit(n)
