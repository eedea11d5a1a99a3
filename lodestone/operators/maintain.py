"""Corpus maintenance: what is missing, stale or double; deletes and upserts as rewrites; schema evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stem
from .common import small


def missing(files: DataFrame, indexed: DataFrame, key: str = "source") -> DataFrame:
    """Files that the index doesn't have."""
    return files.join(indexed.select(key).distinct(), key, "left_anti")


def stale(indexed: DataFrame, files: DataFrame, root: str = "", key: str = "source") -> DataFrame:
    """Indexed keys under ``root`` whose file is gone."""
    return indexed.where(F.col(key).startswith(root)).select(key).distinct().join(files.select(key), key, "left_anti")


def duplicates(rows: DataFrame, key: str = "id") -> DataFrame:
    """Keys that occur more than once: key, n."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_summary(rows: DataFrame, key: str = "id") -> DataFrame:
    """One row: how many keys are double, and how many rows too many there are."""
    return duplicates(rows, key).agg(F.count("*").alias("n_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_surplus"))


def first_of_content(rows: DataFrame, content: str, key: str) -> DataFrame:
    """Rows whose content, text or bytes, no row of a lower key has; content is told apart by its SHA-256. Keys can repeat."""
    marked = rows.withColumn("__digest", F.sha2(F.col(content).cast("binary"), 256))
    first = marked.where(F.col("__digest").isNotNull()).groupBy("__digest").agg(F.min(key).alias(key))
    return marked.join(first, ["__digest", key], "left_semi").drop("__digest")


def companions(files: DataFrame, others: DataFrame, path: str = "path") -> DataFrame:
    """(path, companion): of each file the first among ``others`` that has its name but for the ending."""
    names = others.select(stem(F.col(path)).alias("__stem"), F.col(path).alias("companion")).groupBy("__stem").agg(F.min("companion").alias("companion"))
    return files.select(path, stem(F.col(path)).alias("__stem")).join(names, "__stem").select(path, "companion")


def nearest_companions(files: DataFrame, others: DataFrame, path: str = "path") -> DataFrame:
    """(path, companion): of each file the one among ``others`` with its name but for the ending; the one beside it first, else the first
    by path anywhere."""
    folder = lambda c: F.regexp_replace(c, r"[^/]*$", "")
    there = others.select(stem(F.col(path)).alias("__stem"), folder(F.col(path)).alias("__folder"), F.col(path).alias("companion"))
    beside = there.groupBy("__stem", "__folder").agg(F.min("companion").alias("beside"))
    anywhere = there.groupBy("__stem").agg(F.min("companion").alias("anywhere"))
    named = files.select(path, stem(F.col(path)).alias("__stem"), folder(F.col(path)).alias("__folder"))
    out = named.join(anywhere, "__stem").join(beside, ["__stem", "__folder"], "left")
    return out.select(path, F.coalesce("beside", "anywhere").alias("companion"))


def sources_of_duplicates(rows: DataFrame, key: str = "id", source: str = "source") -> DataFrame:
    return rows.join(duplicates(rows, key).select(key), key, "left_semi").select(source).distinct()


def delete(rows: DataFrame, keys: DataFrame, key: str = "source") -> DataFrame:
    """Rows whose key is not among ``keys``: one anti-join, whatever their number."""
    return rows.join(small(keys.select(key).distinct()), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str = "source") -> DataFrame:
    """All rows of a key are replaced by its new rows."""
    return delete(old, new, key).unionByName(new, allowMissingColumns=True)


def last_write(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """For each key the row that was written last; of rows alike in ``order`` the one that is greatest by all its columns, which are
    compared in their order (columns that have no order, maps, left out)."""
    others = [f.name for f in rows.schema.fields if f.name not in order and "map<" not in f.dataType.simpleString()]
    order = (*order, *others)
    best = F.max_by(F.struct(*[F.col(c) for c in rows.columns]), F.struct(*[F.col(c) for c in order]))
    return rows.groupBy(F.col(key).alias("__key")).agg(best.alias("row")).select("row.*")


def flag(rows: DataFrame, keys: DataFrame, key: str, column: str, value) -> DataFrame:
    """Set ``column`` where the key is among ``keys``."""
    hit = keys.select(F.col(key)).distinct().withColumn("__hit", F.lit(True))
    return rows.join(small(hit), key, "left").withColumn(column, F.when(F.col("__hit"), F.lit(value)).otherwise(F.col(column))).drop("__hit")


def evolve(rows: DataFrame, defaults: dict) -> DataFrame:
    """Add columns that are missing, and fill what is NULL, with defaults."""
    add = {c: F.lit(v) for c, v in defaults.items() if c not in rows.columns}
    have = {c: v for c, v in defaults.items() if c in rows.columns}
    return rows.withColumns(add).fillna(have) if have else rows.withColumns(add)


def filled_share(rows: DataFrame, column: str) -> DataFrame:
    """One row: n_rows, n_filled, share of rows with a value."""
    n, f = F.count("*"), F.count_if(F.coalesce(F.col(column).cast("string"), F.lit("")) != "")
    return rows.agg(n.alias("n_rows"), f.alias("n_filled"), F.round(F.try_divide(f.cast("double"), n), 6).alias("share"))


def versioned(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """Names made unique: the second of a name is name_v2, and so on."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return rows.withColumn("version", n.cast("long")).withColumn("saved_name", F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_v"), n.cast("string"))))


def compact(rows: DataFrame, path: str, files: int) -> None:
    """Rewrite as so many files, into a folder that isn't being read."""
    rows.repartition(files).write.mode("overwrite").parquet(path)


def table_size(rows: DataFrame) -> DataFrame:
    """One row about the files of a file-based table: n_files, n_bytes."""
    f = rows.select("_metadata.file_path", "_metadata.file_size").distinct()
    return f.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("n_bytes"))
