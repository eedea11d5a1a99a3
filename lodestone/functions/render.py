"""Structured replies and documents as text: tables, slides, sections, names, weeks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bullets, json_block, strip, value


def markdown_table(headers: Column, rows: Column) -> Column:
    """A Markdown table of an array of headers and an array of rows."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | ", ""), F.lit(" |"))
    rule = line(F.transform(headers, lambda _: F.lit("---")))
    return F.array_join(F.concat(F.array(line(headers), rule), F.transform(rows, line)), "\n")


REPLY = "type string, description string, headers array<string>, rows array<array<string>>, insights array<string>, confidence double"


#: The kinds of an image that a plain reply may name, and its labels of kind and description.
KINDS, KIND_LABEL, DESCRIPTION_LABEL = ("chart", "table", "diagram", "photo", "other"), "类型", "描述"


def described(reply: Column) -> Column:
    """struct<type, description, text, confidence> of a vision model's reply.

    A JSON object in a fenced block gives its fields (0.95); a table in it becomes Markdown, with insights as bullets. Else kind
    and description are sought by their labels, where a known kind gives 0.9, and else all of it is the description (0.7).
    """
    j = F.from_json(F.regexp_extract(reply, r"(?s)```json\s*(.*?)\s*```", 1), REPLY)
    ok = F.regexp_like(reply, F.lit(r"(?s)```json\s*\{.*?\}\s*```")) & F.coalesce(*[j[k].cast("string") for k in ("type", "description", "headers", "rows", "insights", "confidence")]).isNotNull()
    found = F.lower(F.regexp_extract(reply, rf"(?U){KIND_LABEL}[：:]\s*(\w+)", 1))
    kind = F.when(found.isin(*KINDS), found)
    named = F.when(F.regexp_like(reply, F.lit(rf"(?sU){DESCRIPTION_LABEL}[：:]\s*.+")), strip(F.regexp_extract(reply, rf"(?s){DESCRIPTION_LABEL}[：:](.+)$", 1)))
    table = F.when(F.size(F.coalesce(j["headers"], F.array().cast("array<string>"))) > 0, markdown_table(j["headers"], F.coalesce(j["rows"], F.array().cast("array<array<string>>"))))
    points = F.when(F.size(F.coalesce(j["insights"], F.array().cast("array<string>"))) > 0, bullets(j["insights"]))
    description = F.when(ok, F.coalesce(j["description"], reply)).otherwise(F.coalesce(named, reply))
    return F.struct(
        F.when(ok, F.coalesce(j["type"], F.lit("other"))).otherwise(F.coalesce(kind, F.lit("other"))).alias("type"),
        description.alias("description"),
        F.concat_ws("\n\n", description, F.when(ok, table), F.when(ok, points)).alias("text"),
        F.when(ok, 0.95).when(kind.isNotNull(), 0.9).otherwise(0.7).alias("confidence"),
    )


ANSWER = "answer string, sources array<string>, confidence double"


def answered(reply: Column) -> Column:
    """struct<answer, sources, confidence> of a searching model's reply: a JSON object's fields, by default the reply's first 300
    characters, none and 0.9; a reply without one is its own answer, with 0.5."""
    j = F.from_json(json_block(reply), ANSWER)
    ok = F.coalesce(j["answer"], j["sources"].cast("string"), j["confidence"].cast("string")).isNotNull()
    start = F.substring(F.coalesce(reply, F.lit("")), 1, 300)
    return F.struct(
        F.when(ok, F.coalesce(j["answer"], start)).otherwise(F.coalesce(value(start), F.lit("搜索失败"))).alias("answer"),
        F.when(ok, F.coalesce(j["sources"], F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("sources"),
        F.when(ok, F.coalesce(j["confidence"], F.lit(0.9))).otherwise(0.5).alias("confidence"),
    )


SUMMARY = "problem string, method string, contributions array<string>, concepts array<string>, conclusion string"


def summary(reply: Column) -> Column:
    """A summary card of a model's reply: missing fields are empty, lists have five entries at most."""
    j = F.from_json(json_block(reply), SUMMARY)
    text = lambda k: F.coalesce(j[k], F.lit("")).alias(k)
    some = lambda k: F.slice(F.coalesce(j[k], F.array().cast("array<string>")), 1, 5).alias(k)
    return F.struct(text("problem"), text("method"), some("contributions"), some("concepts"), text("conclusion"))


def slides_markdown(slides: Column) -> Column:
    """array<struct<slide_num, title, content array, images array, notes>> as Markdown."""

    def one(s):
        head = F.concat(F.lit("## "), s["slide_num"].cast("string"), F.when(F.coalesce(s["title"], F.lit("")) != "", F.concat(F.lit(". "), s["title"])).otherwise(""))
        images = F.when(F.size(s["images"]) > 0, F.array_join(F.transform(s["images"], lambda p: F.concat(F.lit("![]("), p, F.lit(")"))), "\n"))
        notes = F.when(F.coalesce(s["notes"], F.lit("")) != "", F.concat(F.lit("> "), F.replace(s["notes"], F.lit("\n"), F.lit("\n> "))))
        return F.concat_ws("\n\n", head, F.when(F.size(s["content"]) > 0, F.array_join(s["content"], "\n")), images, notes)

    return F.array_join(F.transform(slides, one), "\n\n")


def sections(**parts: Column) -> Column:
    """Named parts one below the other, those without text left out."""
    return F.concat_ws("\n\n", *[F.when(value(c).isNotNull(), F.concat(F.lit(f"[{k}]\n"), c)) for k, c in parts.items()])


def linked_pdf(note: Column) -> Column:
    """Path of the PDF that a note links to by a file:// address, decoded; a plus sign stays one."""
    raw = F.regexp_extract(note, r"file://([^\s)>\"]+)", 1)
    path = F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    return F.when(F.lower(path).endswith(".pdf"), path)


#: The title of a note without one, and the label of its date.
NO_TITLE, INGESTED = "未知标题", "入库时间"


def note_field(note: Column, name: str) -> Column:
    """A front matter field, in double quotes or up to white space; '' if it isn't there."""
    quoted, plain = rf'(?m)^{name}:\s*"([^"]*)"', rf"(?m)^{name}:\s*(\S+)"
    return F.when(F.regexp_like(note, F.lit(quoted)), F.regexp_extract(note, quoted, 1)).otherwise(F.regexp_extract(note, plain, 1))


def note_title(note: Column) -> Column:
    """The quoted title of the front matter, else the first heading of level one."""
    return F.coalesce(value(F.regexp_extract(note, r'(?m)^title:\s*"([^"]+)"', 1)), value(F.regexp_extract(note, r"(?m)^#\s+(.+)$", 1)), F.lit(NO_TITLE))


def note_date(note: Column) -> Column:
    return F.regexp_extract(note, INGESTED + r"[：:]\s*`?(\d{4}-\d{2}-\d{2})", 1)


def image_page(name: Column) -> Column:
    """Page in an image's file name, NULL if there is none."""
    return F.try_to_number(value(F.regexp_extract(F.lower(name), r"page[_-]?(\d{1,9})", 1)), F.lit("999999999")).cast("int")


def image_name(prefix: Column, page: Column, index: Column, ext: Column) -> Column:
    return F.format_string("%s_p%03d_%03d.%s", prefix, page, index, ext)


def year_week(ts: Column) -> Column:
    """Year and week, weeks starting on Mondays and the days before the first Monday being week 00."""
    week = F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7)
    return F.format_string("%d-%02d", F.year(ts), week.cast("int"))
