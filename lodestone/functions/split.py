"""The Markdown splitter as folds over arrays: headings, paragraphs, packing, hard cuts and merges stay inside the plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

CHUNK = "struct<h1:string,h2:string,body:string>"


def max_chars(tokens: int = 480) -> int:
    return int(tokens / 1.5)


def by_headings(content: Column, title: Column) -> Column:
    """array<struct<h1,h2,body>>: lines between "# " and "## " headings with the headings above; empty sections go."""
    state = f"struct<h1:string,h2:string,lines:array<string>,out:array<{CHUNK}>>"
    start = F.struct(title.alias("h1"), F.lit("").alias("h2"), F.array().cast("array<string>").alias("lines"), F.array().cast(f"array<{CHUNK}>").alias("out")).cast(state)
    close = lambda a: F.concat(a["out"], F.array(F.struct(a["h1"].alias("h1"), a["h2"].alias("h2"), F.array_join(a["lines"], "\n").alias("body"))))

    def step(a, line):
        one, two = line.startswith("# "), line.startswith("## ")
        return F.struct(
            F.when(one, strip(F.substring(line, F.lit(3), F.length(line)))).otherwise(a["h1"]).alias("h1"),
            F.when(one, "").when(two, strip(F.substring(line, F.lit(4), F.length(line)))).otherwise(a["h2"]).alias("h2"),
            F.when(one | two, F.array().cast("array<string>")).otherwise(F.concat(a["lines"], F.array(line))).alias("lines"),
            F.when(one | two, close(a)).otherwise(a["out"]).alias("out"),
        ).cast(state)

    sections = F.aggregate(F.split(content, "\n"), start, step, close)
    trimmed = F.transform(sections, lambda s: F.struct(s["h1"].alias("h1"), s["h2"].alias("h2"), strip(s["body"]).alias("body")))
    return F.filter(trimmed, lambda s: s["body"] != "")


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), strip), lambda p: p != "")


#: The marks after which a hard cut may fall.
CUT_AFTER = "。！？；.!?;"


def hard_cuts(text: Column, most: int, back: int = 20) -> Column:
    """Pieces of ``most`` characters at most, cut after the last mark of the final ``back`` characters if there is one."""
    state = "struct<at:int,out:array<string>>"
    rounds = F.sequence(F.lit(0), F.ceil(F.length(text) / F.lit(most - back)).cast("int"))

    def step(a, _):
        piece = F.substring(text, a["at"] + 1, F.lit(most))
        full = a["at"] + most < F.length(text)
        tail = F.substring(piece, F.lit(most - back + 1), F.lit(back))
        after = F.length(F.regexp_extract(tail, f"(?s)^(.*[{CUT_AFTER}])", 1))
        size = F.when(full & (after > 0), F.lit(most - back) + after).otherwise(F.length(piece))
        done = a["at"] >= F.length(text)
        return F.struct(
            F.when(done, a["at"]).otherwise(a["at"] + size).cast("int").alias("at"),
            F.when(done, a["out"]).otherwise(F.concat(a["out"], F.array(strip(F.substring(piece, F.lit(1), size))))).alias("out"),
        ).cast(state)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")).cast(state)
    return F.aggregate(rounds, start, step, lambda a: a["out"])


def packed(parts: Column, most: int, sep: str = "\n\n", cut: bool = True) -> Column:
    """Greedy packing: a part that would take the buffer above ``most`` starts a new one; longer parts are cut hard, or with
    ``cut`` off are a buffer of their own."""
    state = "struct<buf:array<string>,len:int,out:array<string>>"
    empty = F.array().cast("array<string>")
    flush = lambda a: F.when(F.size(a["buf"]) > 0, F.concat(a["out"], F.array(F.array_join(a["buf"], sep)))).otherwise(a["out"])

    def step(a, p):
        n = F.length(p)
        over, long = (a["len"] + n > most) & (F.size(a["buf"]) > 0), (n > most) & F.lit(cut)
        return F.struct(
            F.when(long, empty).when(over, F.array(p)).otherwise(F.concat(a["buf"], F.array(p))).alias("buf"),
            F.when(long, 0).when(over, n).otherwise(a["len"] + n).cast("int").alias("len"),
            F.when(long, F.concat(flush(a), hard_cuts(p, most))).when(over, flush(a)).otherwise(a["out"]).alias("out"),
        ).cast(state)

    start = F.struct(empty.alias("buf"), F.lit(0).alias("len"), empty.alias("out")).cast(state)
    return F.aggregate(parts, start, step, flush)


def merged_short(chunks: Column, least: int, may: Callable[[Column], Column] = lambda _: F.lit(True)) -> Column:
    """A chunk under ``least`` characters joins the one before it if their headings agree and it may."""
    arr = f"array<{CHUNK}>"

    def step(out, c):
        last = F.try_element_at(out, F.lit(-1))
        join = (F.size(out) > 0) & may(c) & (F.length(c["body"]) < least) & (last["h1"] == c["h1"]) & (last["h2"] == c["h2"])
        one = F.struct(last["h1"].alias("h1"), last["h2"].alias("h2"), F.concat_ws("\n\n", last["body"], c["body"]).alias("body"))
        return F.when(join, F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(one))).otherwise(F.concat(out, F.array(F.struct(c["h1"].alias("h1"), c["h2"].alias("h2"), c["body"].alias("body"))))).cast(arr)

    return F.aggregate(chunks, F.array().cast(arr), step)


#: Fixed value: the body of a chunk without text.
BLANK = "(空)"


def chunks(content: Column, title: Column, most: int = max_chars(), least: int = 100) -> Column:
    """The whole splitter: headings; a text that is one section too long in all is taken by paragraphs instead, under its title;
    what is still too long is cut; of the rest short ones join the chunk before. Pieces of a cut section join nothing."""
    one = lambda h1, h2, body, whole: F.struct(h1.alias("h1"), h2.alias("h2"), body.alias("body"), F.lit(whole).alias("whole"))
    plain = F.transform(packed(paragraphs(content), most, cut=False), lambda b: F.struct(title.alias("h1"), F.lit("").alias("h2"), b.alias("body")))
    # An array of one binds the sections, which are then worked out once.
    sections = F.flatten(F.transform(F.array(by_headings(content, title)), lambda s: F.when((F.size(s) == 1) & (F.length(F.get(s, 0)["body"]) > most), plain).otherwise(s)))
    pieces = lambda s: F.transform(packed(paragraphs(s["body"]), most), lambda b: one(s["h1"], s["h2"], F.when(b == "", BLANK).otherwise(b), False))
    cut = F.flatten(F.transform(sections, lambda s: F.when(F.length(s["body"]) <= most, F.array(one(s["h1"], s["h2"], s["body"], True))).otherwise(pieces(s))))
    return merged_short(cut, least, lambda c: c["whole"])


def prefix(filename: Column, h1: Column, h2: Column, category: Column, tags: Column) -> Column:
    """What a chunk's text starts with: where it is from, its headings, category and first three tags."""
    # The labels of source, chapter, section, category and tags.
    some = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    return F.concat_ws(" | ", F.concat(F.lit("来源: "), filename), F.when(h1 != filename, some("章节: ", h1)), some("小节: ", h2), some("分类: ", category), some("标签: ", F.array_join(F.slice(tags, 1, 3), ", ")))


def sliding(text: Column, most: int = 2000, overlap: int = 200) -> Column:
    """Overlapping windows, cut after the last full stop beyond the middle if there is one."""
    if not 0 <= overlap < most // 2:
        raise ValueError("overlap must be under half of most")
    state = "struct<at:int,out:array<string>,done:boolean>"

    def step(a, _):
        piece = F.substring(text, a["at"] + 1, F.lit(most))
        last = a["at"] + most >= F.length(text)
        stop = F.length(F.regexp_extract(piece, r"(?s)^(.*[。？！.])", 1))
        size = F.when(~last & (stop > most // 2), stop).otherwise(F.length(piece))
        return F.struct(
            F.when(a["done"], a["at"]).otherwise(a["at"] + size - overlap).cast("int").alias("at"),
            F.when(a["done"], a["out"]).otherwise(F.concat(a["out"], F.array(F.substring(piece, F.lit(1), size)))).alias("out"),
            (a["done"] | last).alias("done"),
        ).cast(state)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"), (F.length(text) == 0).alias("done")).cast(state)
    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.length(text) / F.lit(most // 2 - overlap)).cast("int")), start, step, lambda a: a["out"])
