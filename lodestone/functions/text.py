"""Text functions as columns: JVM-side, inside the plan. NULL and '' mean the same: no value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)^\s+|\s+$"
#: Characters of a text by which contents are told apart.
CONTENT_CHARS = 200


def value(c: Column) -> Column:
    """'' as NULL."""
    return F.when(c != "", c)


def strip(c: Column) -> Column:
    """Without white space at the ends, Unicode's included."""
    return F.regexp_replace(c, SPACE, "")


def tokens(c: Column, cjk_bigrams: bool = False) -> Column:
    """Lower-cased runs of letters and digits; with ``cjk_bigrams`` runs of Han characters as overlapping pairs."""
    words = F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    if not cjk_bigrams:
        return words
    pairs = lambda w: F.when(
        w.rlike(r"^\p{IsHan}{2,}$"), F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, 2))
    ).otherwise(F.array(w))
    return F.flatten(F.transform(words, pairs))


def tokenized(c: Column) -> Column:
    return F.array_join(tokens(c), " ")


def clean(c: Column) -> Column:
    """Runs of three or more line feeds to two, runs of blanks to one, stripped."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r" {2,}", " "))


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(F.coalesce(c, F.lit(""))) / F.lit(1.5)).cast("int")


def content_key(raw_text: Column, text: Column, source: Column, track: Column) -> Column:
    """MD5 of the first CONTENT_CHARS characters, of source and track where there is no text."""
    body = F.coalesce(value(raw_text), value(text))
    return F.when(body.isNotNull(), F.md5(F.substring(body, 1, CONTENT_CHARS))).otherwise(F.md5(F.concat_ws(":", F.coalesce(source, F.lit("")), F.coalesce(track, F.lit("unknown")))))


def head_key(text: Column) -> Column:
    """MD5 of the first CONTENT_CHARS characters as SQL has it: the empty text is a content like any other, no text has no key."""
    return F.md5(F.substring(text, 1, CONTENT_CHARS))


#: Elements whose content is not text, each on its own as RE2 has no back-references.
DROPPED_ELEMENTS = ("script", "style", "nav", "header", "footer")
#: The named characters of HTML that are decoded, & last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def html_lines(c: Column) -> Column:
    """Text of HTML: a line for each text node, stripped; lines of one character go."""
    for e in DROPPED_ELEMENTS:
        c = F.regexp_replace(c, rf"(?is)<{e}\b[^>]*>.*?</{e}\s*>", "\n")
    c = F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", "\n"), r"<[^>]*>", "\n")
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: F.length(x) > 1), "\n")


def html_tables(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?is)(<table[^>]*>.*?</table>)"), F.lit(1))


def is_scanned(c: Column) -> Column:
    """Whether little is left of a page's Markdown without its images."""
    image = r"!\[[^\]]*\]\([^)]*\)"
    return (F.regexp_count(c, F.lit(image)) > 0) & (F.length(strip(F.regexp_replace(c, image, ""))) < 0.2 * F.length(c))


#: What may part the pages of an OCR result, tried in this order.
PAGE_BREAKS = (r"\n---+\s*Page\s*\d+\s*---+\n", r"\n---+\s*第\s*\d+\s*页\s*---+\n", r"\n##\s*Page\s*\d+\s*\n", r"\n##\s*第\s*\d+\s*页\s*\n", r"\n\\\\newpage\n")


def ocr_pages(c: Column) -> Column:
    """Pages, stripped, by the first separator that is there; a text without one is one page as it is, a blank one none."""
    pages = F.when(strip(c) != "", F.array(c)).otherwise(F.array().cast("array<string>"))
    for sep in reversed(PAGE_BREAKS):
        parts = F.filter(F.transform(F.split(c, "(?iU)" + sep), strip), lambda x: x != "")
        pages = F.when(F.regexp_like(c, F.lit("(?iU)" + sep)), parts).otherwise(pages)
    return pages


def overlaid(left: Column, right: Column) -> Column:
    """Two maps in one; where both have a key, the right one's value stays. A NULL map is an empty one."""
    return F.when(left.isNull(), right).when(right.isNull(), left).otherwise(F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right))


#: What marks a note as a paper, in the first PAPER_HEAD characters, which begin with front matter.
PAPER_MARKS, PAPER_HEAD = ("arxiv.org", "arxiv_id", "type: paper"), 1024


def is_paper(c: Column) -> Column:
    head, marked = F.substring(F.coalesce(c, F.lit("")), 1, PAPER_HEAD), F.lit(False)
    for m in PAPER_MARKS:
        marked = marked | head.contains(m)
    return head.startswith("---") & marked


def frontmatter(c: Column) -> Column:
    """struct<yaml, body>: the block up to the first '---' after the opening one; without one all is body."""
    end = F.locate("---", c, 4)
    there = c.startswith("---") & (end > 0)
    return F.struct(
        F.when(there, F.substring(c, F.lit(4), end - 4)).alias("yaml"),
        F.when(there, strip(F.substring(c, end + 3, F.length(c)))).otherwise(c).alias("body"),
    )


def frontmatter_parts(c: Column) -> Column:
    """struct<yaml, body>: a text that starts with '---' is cut at its first two '---', the body as it is; without both all is body."""
    parts = F.split(c, "---", 3)
    there = c.startswith("---") & (F.size(parts) == 3)
    return F.struct(F.when(there, F.get(parts, 1)).alias("yaml"), F.when(there, F.get(parts, 2)).otherwise(c).alias("body"))


def yaml_field(yaml: Column, key: str) -> Column:
    """A scalar of a flat YAML block, unquoted; NULL if it isn't there."""
    return value(F.regexp_extract(yaml, rf"(?m)^{key}:[ \t]*[\"']?(.*?)[\"']?[ \t]*$", 1))


def yaml_list(yaml: Column, key: str) -> Column:
    """A list of a flat YAML block, as [a, b] or as lines "- a"; a scalar is a list of one."""
    flow = F.regexp_extract(yaml, rf"(?m)^{key}:[ \t]*\[(.*?)\]", 1)
    block = F.regexp_extract(yaml, rf"(?m)^{key}:[ \t]*\n((?:[ \t]*-[ \t].*(?:\n|$))+)", 1)
    one = yaml_field(yaml, key)
    parts = F.when(flow != "", F.split(flow, ",")).when(block != "", F.split(F.regexp_replace(block, r"(?m)^[ \t]*-[ \t]*", ""), "\n")).when(one.isNotNull(), F.array(one))
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(strip(x), r"^[\"']|[\"']$", "")), lambda x: x != "")


def bracketed(c: Column) -> Column:
    """Keywords in round brackets, full-width ones too."""
    return F.regexp_extract_all(c, F.lit(r"[（(]([^）)]+)[）)]"), F.lit(1))


def file_name(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def stem(c: Column) -> Column:
    return F.regexp_replace(file_name(c), r"\.[^.]*$", "")


def safe_name(c: Column) -> Column:
    """Letters, digits, blanks, '-' and '_' only."""
    return strip(F.regexp_replace(c, r"[^\p{L}\p{N} _-]", ""))


def json_block(c: Column) -> Column:
    """JSON in a model's reply: of a fenced block, else from the first brace to the last."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    loose = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.coalesce(value(fenced), value(loose))


def json_strings(c: Column) -> Column:
    """A list of strings in a model's reply; NULL if there is none."""
    return F.from_json(F.regexp_extract(c, r"(?s)(\[.*\])", 1), "array<string>")


def bullets(items: Column, form: str = "- %s", none: str = "- (none)") -> Column:
    lines = F.transform(items, lambda x: F.format_string(form, x))
    return F.when(F.size(F.coalesce(items, F.array().cast("array<string>"))) > 0, F.array_join(lines, "\n")).otherwise(none)


def escape_sql(s: str) -> str:
    """A value for use inside quotes of a predicate string."""
    return s.replace("'", "''")


def short_id(c: Column, prefix: str, n: int) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.md5(c), 1, n))


def cache_key(query: Column, count: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lower(F.trim(query)), count.cast("string")))
