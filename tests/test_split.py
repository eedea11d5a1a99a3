"""The splitter's folds against plain Python."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import split as S
from lodestone.functions import text as T


def run(spark, column, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["x"] for r in df.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def py_hard(text, most, back=20):
    out, at = [], 0
    while at < len(text):
        piece = text[at : at + most]
        if at + most < len(text):
            cut = max(piece.rfind(m, most - back) for m in S.CUT_AFTER)
            if cut >= 0:
                piece = piece[: cut + 1]
        out.append(piece.strip())
        at += len(piece)
    return out


def py_pack(parts, most):
    out, buf, n = [], [], 0
    for p in parts:
        if len(p) > most:
            if buf:
                out.append("\n\n".join(buf))
            buf, n = [], 0
            out += py_hard(p, most)
        elif n + len(p) > most and buf:
            out.append("\n\n".join(buf))
            buf, n = [p], len(p)
        else:
            buf.append(p)
            n += len(p)
    return out + (["\n\n".join(buf)] if buf else [])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab.! \n。", max_size=160), min_size=1, max_size=12))
def test_packing_and_cuts(spark, texts):
    parts = [[p.strip() for p in re.split(r"\n\s*\n", t) if p.strip()] for t in texts]
    assert run(spark, S.paragraphs, *texts) == parts
    assert run(spark, lambda c: S.packed(S.paragraphs(c), 40), *texts) == [py_pack(p, 40) for p in parts]
    assert run(spark, lambda c: S.hard_cuts(c, 40), *texts) == [py_hard(t, 40) for t in texts]


def test_sections_with_headings(spark):
    note = "intro\n# One\ntext a\n## Sub\ntext b\n\nmore\n# Two\n## Empty\n"
    got = run(spark, lambda c: S.by_headings(c, F.lit("note")), note)[0]
    assert [tuple(s) for s in got] == [("note", "", "intro"), ("One", "", "text a"), ("One", "Sub", "text b\n\nmore")]


def test_one_heading_and_two_below_make_three_chunks(spark):
    body = "x" * 150
    got = run(spark, lambda c: S.chunks(c, F.lit("n")), f"# A\n{body}\n## B\n{body}\n## C\n{body}")[0]
    assert [(c["h1"], c["h2"]) for c in got] == [("A", ""), ("A", "B"), ("A", "C")]


def test_short_chunks_join_the_one_before(spark):
    got = run(spark, lambda c: S.merged_short(S.by_headings(c, F.lit("n")), 10), "# A\nlong enough text\n# A\nshort\n# B\nshort")[0]
    assert [c["body"] for c in got] == ["long enough text\n\nshort", "short"]


def test_one_long_section_goes_by_paragraphs(spark):
    """Its title is the file's then, and headings are text; a paragraph that is too long by itself is cut."""
    paras = ["# A", "p" * 200, "q" * 200, "short", "r" * 700]
    got = run(spark, lambda c: S.chunks(c, F.lit("n")), "\n\n".join(paras))[0]
    assert [(c["h1"], c["h2"]) for c in got] == [("n", "")] * len(got)
    assert [c["body"] for c in got] == ["# A\n\n" + "p" * 200, "q" * 200 + "\n\nshort", "r" * 320, "r" * 320, "r" * 60]


def test_pieces_of_a_cut_section_join_nothing(spark):
    """A short section joins what is before; the short last piece of a long one stays."""
    long = "x" * 300 + "\n\n" + "y" * 50
    got = run(spark, lambda c: S.chunks(c, F.lit("n")), f"# A\n{long}\n# A\nshort\n# B\nalone\n# B\n{'z' * 330}")[0]
    assert [(c["h1"], c["body"]) for c in got] == [("A", "x" * 300), ("A", "y" * 50 + "\n\nshort"), ("B", "alone"), ("B", "z" * 320), ("B", "z" * 10)]


def test_blank_pieces_have_a_mark(spark):
    got = run(spark, lambda c: S.chunks(c, F.lit("n")), "# A\n" + "a" * 320 + " " * 320 + "b\n# B\nc")[0]
    assert [c["body"] for c in got] == ["a" * 320, S.BLANK, "b", "c"]


def test_papers_and_overlays(spark):
    assert run(spark, T.is_paper, "---\narxiv_id: 1", "arxiv.org", "---" + " " * 1100 + "arxiv.org", "---\ntype: paper\n---", None) == [True, False, False, True, False]
    maps = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3, "c": 4}), (None, {"a": 1}), ({"a": 1}, None), ({}, {})], "l map<string,int>, r map<string,int>")
    assert [r[0] for r in maps.select(T.overlaid(F.col("l"), F.col("r"))).collect()] == [{"a": 1, "b": 3, "c": 4}, {"a": 1}, {"a": 1}, {}]


def test_long_text_is_cut(spark):
    got = run(spark, lambda c: S.chunks(c, F.lit("n")), "# A\n" + "A sentence of some words. " * 200)[0]
    assert len(got) > 1 and max(len(c["body"]) for c in got) <= 1.5 * S.max_chars()


def test_sliding_windows_cover_the_text(spark):
    text = "".join(f"Sentence number {i}. " for i in range(400))
    got = run(spark, S.sliding, text, "", "short")
    assert got[1] == [] and got[2] == ["short"]
    rest = got[0][0]
    for a, b in zip(got[0], got[0][1:]):
        assert a[-200:] == b[:200]
        rest += b[200:]
    assert rest == text
    with pytest.raises(ValueError):
        S.sliding(F.col("t"), 100, 50)


def test_frontmatter(spark):
    notes = ["---\ncategory: AI\ntags: [a, \"b c\"]\nrag: false\n---\n body ", "---\ntags:\n  - x\n  - y\n---\nz", "no block", "--- open"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(notes)], "i int, t string").select("i", T.frontmatter(F.col("t")).alias("f"))
    rows = df.select("i", "f.body", T.yaml_field(F.col("f.yaml"), "category").alias("c"), T.yaml_list(F.col("f.yaml"), "tags").alias("tags"), T.yaml_field(F.col("f.yaml"), "rag").alias("rag")).orderBy("i").collect()
    assert [r["body"] for r in rows] == ["body", "z", "no block", "--- open"]
    assert rows[0]["c"] == "AI" and rows[0]["rag"] == "false"
    assert [r["tags"] for r in rows] == [["a", "b c"], ["x", "y"], None, None]


def test_replies(spark):
    got = run(spark, lambda c: F.struct(T.json_block(c).alias("b"), T.json_strings(c).alias("s")), 'say ```json\n{"a": 1}\n``` so', 'x {"b": 2} y', '["p", "q"]', "none")
    assert [r["b"] for r in got] == ['{"a": 1}', '{"b": 2}', None, None] and got[2]["s"] == ["p", "q"]


def test_tables_pages_and_scans(spark):
    assert run(spark, T.html_tables, "a <table x><tr></tr></table> b <TABLE>c</TABLE>") == [["<table x><tr></tr></table>", "<TABLE>c</TABLE>"]]
    texts = ["a\n--- page 1 ---\nb\n-- Page 2 ---\n c", "a\n---- 第 3 页 ---\n\n---第4页---\nb", "a\n## page 9 \nb\n## 第 1 页\nc", "a\n## 第1页\nb", "a\n\\\\newpage\nb", " one\n-----\n", " \n"]
    want = [["a", "b\n-- Page 2 ---\n c"], ["a", "b"], ["a", "b\n## 第 1 页\nc"], ["a", "b"], ["a", "b"], [" one\n-----\n"], []]
    assert run(spark, T.ocr_pages, *texts) == want
    assert run(spark, T.is_scanned, "![](a.png)" * 9, "text " * 50) == [True, False]


def test_names_and_keywords(spark):
    assert run(spark, T.bracketed, "A (b) c（d）") == [["b", "d"]]
    assert run(spark, T.safe_name, "a/b: c-d_é!") == ["ab c-dé".replace("dé", "d_é")]
    assert run(spark, lambda c: T.tokens(c, True), "机器学习 with AI2") == [["机器", "器学", "学习", "with", "ai2"]]
    assert T.escape_sql("it's") == "it''s"
