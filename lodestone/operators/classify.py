"""Rules: isolation filters, keyword classification, image filters, triage states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bracketed

#: Technical words of the topic filter, and what marks a body as a video's transcript. Both are defaults.
TOPICS = ("AI", "LLM", "GPT", "DeepSeek", "模型", "架构", "芯片", "GPU", "开源", "智能", "机器人", "Agent")
VIDEO_MARKERS = ("type: video_distill", "## 📹 原始信息", "asr_source:", "[📹 原始信息]", "video_duration:", "platform: 抖音", "platform: B站")


def holds_any(c: Column, words: tuple[str, ...] | list[str]) -> Column:
    """Whether the lower-cased text holds one of the words."""
    low, out = F.lower(F.coalesce(c, F.lit(""))), F.lit(False)
    for w in words:
        out = out | low.contains(w.lower())
    return out


def isolated(rag: Column, kind: Column, body: Column, filename: Column, markers: list[str] | tuple[str, ...] = VIDEO_MARKERS, kinds: tuple[str, ...] = ("video_distill",), prefix: str = "VIDEO_") -> Column:
    """Whether a note stays out of the index.

    An explicit false flag keeps it out, an explicit true one in; else its kind, a marker in its body or its file name's
    prefix keep it out.
    """
    marked = F.coalesce(kind.isin(*kinds), F.lit(False))
    for m in markers:
        marked = marked | F.coalesce(body.contains(m), F.lit(False))
    return rag.eqNullSafe(F.lit(False)) | (~rag.eqNullSafe(F.lit(True)) & (marked | F.coalesce(filename.startswith(prefix), F.lit(False))))


def skipped_path(path: Column, dirs: list[str]) -> Column:
    """Hidden names, and paths that hold one of ``dirs`` anywhere."""
    out = F.element_at(F.split(path, "/"), -1).rlike(r"^[._]") | path.contains("/.obsidian/")
    for d in dirs:
        out = out | path.contains(d)
    return out


def has_part(path: Column, parts: list[str]) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(p) for p in parts]))


def image_filter(width: Column, height: Column, least_area: int = 10_000, ratio: tuple[float, float] = (0.05, 20.0)) -> Column:
    """struct<keep, reason>."""
    r = width.cast("double") / F.nullif(height, F.lit(0))
    reason = F.when(width * height < least_area, "too small").when(r.isNull() | (r < ratio[0]) | (r > ratio[1]), "odd shape").otherwise("")
    return F.struct((reason == "").alias("keep"), reason.alias("reason"))


def classify(rows: DataFrame, key: str, tags: str, folders: DataFrame) -> DataFrame:
    """rows: key, tags array; folders: folder, folder_order, keyword, keyword_order -> (key, folder) of those that match.

    A tag matches a keyword that it holds or that holds it, case aside; the first tag wins, then the first folder and
    keyword. Empty tags match nothing. Keywords are few by nature: they are counted and sent to the rows.
    """
    t = rows.select(key, F.posexplode(tags).alias("tag_order", "tag")).where(F.trim("tag") != "")
    low = F.lower("tag")
    words = folders.select("folder", "folder_order", "keyword_order", F.lower("keyword").alias("keyword"))
    if words.count() > 10_000:
        raise ValueError("keywords are meant to be few")
    hit = t.join(F.broadcast(words), low.contains(F.col("keyword")) | F.col("keyword").contains(low))
    best = F.min_by("folder", F.struct("tag_order", "folder_order", "keyword_order"))
    return hit.groupBy(key).agg(best.alias("folder"))


#: Fixed value: how much of a body is looked at for keywords.
BODY_CHARS = 2000


def filed(rows: DataFrame, key: str, tags: str, title: str, body: str, folders: DataFrame, prefixes: dict[str, str], default: str) -> DataFrame:
    """(key, folder, by) of every row: the folder of its tags and of bracketed words of its title, as ``classify`` has it; else of the first
    keyword, by folder and keyword order, in the first BODY_CHARS characters of its body; else of its title's prefix; else ``default``."""
    marks = F.concat(F.coalesce(F.col(tags), F.array().cast("array<string>")), F.coalesce(bracketed(F.col(title)), F.array().cast("array<string>")))
    by_tag = classify(rows.select(key, marks.alias("marks")), key, "marks", folders).withColumnRenamed("folder", "of_tags")
    words = folders.select("folder", "folder_order", "keyword_order", F.lower("keyword").alias("keyword"))
    heads = rows.select(key, F.lower(F.substring(body, 1, BODY_CHARS)).alias("head"))
    held = heads.join(F.broadcast(words), F.col("head").contains(F.col("keyword")))  # few by nature, counted by classify
    by_body = held.groupBy(key).agg(F.min_by("folder", F.struct("folder_order", "keyword_order")).alias("of_body"))
    of_title = F.lit(None).cast("string")
    for start, folder in reversed(prefixes.items()):
        of_title = F.when(F.col(title).startswith(start), folder).otherwise(of_title)
    out = rows.select(key, of_title.alias("of_title")).join(by_tag, key, "left").join(by_body, key, "left")
    by = F.when(F.col("of_tags").isNotNull(), "tags").when(F.col("of_body").isNotNull(), "body").when(F.col("of_title").isNotNull(), "title").otherwise("default")
    return out.select(key, F.coalesce("of_tags", "of_body", "of_title", F.lit(default)).alias("folder"), by.alias("by"))


def holding(names: DataFrame, rows: DataFrame, name: str, column: str) -> DataFrame:
    """(name, found): whether some row's column holds the name. Names are few by nature: they are counted and sent to the rows, each task
    answers once for a name."""
    names = names.select(name).distinct()
    if names.count() > 10_000:
        raise ValueError("names are meant to be few")
    found = rows.select(column).join(F.broadcast(names), F.col(column).contains(F.col(name))).select(name).distinct()
    return names.join(F.broadcast(found.withColumn("found", F.lit(True))), name, "left").select(name, F.coalesce("found", F.lit(False)).alias("found"))


def triage(indexed: Column, analyzed: Column, folder: Column, exists_there: Column) -> Column:
    """State of a note: need_process, duplicate, moved or skip."""
    done = F.coalesce(indexed, F.lit(False)) | F.coalesce(analyzed, F.lit(False))
    return F.when(~done, "need_process").when(folder.isNull(), "skip").when(exists_there, "duplicate").otherwise("moved")


def newest(rows: DataFrame, by: str, n: int, *order) -> DataFrame:
    """The first n rows of each key in an order."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).where(F.col("rn") <= n)


def severity(failed: Column, succeeded: Column) -> Column:
    """Of a batch's alert: NULL without failures."""
    return F.when(failed == 0, F.lit(None)).when(failed < succeeded, "warning").otherwise("error")
