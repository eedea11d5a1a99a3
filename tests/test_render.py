"""Replies, slides and names as text."""

import datetime

from pyspark.sql import functions as F

from lodestone.functions import render as R


def one(spark, column, *values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r["x"] for r in df.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def test_replies(spark):
    fenced = '```json\n{"type": "table", "description": "d", "headers": ["a", "b"], "rows": [["1", null]], "insights": ["x"]}\n```'
    got = one(spark, R.described, fenced, "类型: Chart\n描述：bars\nand more ", "plain words", '{"type": "photo", "description": "bare"}', "类型：picture\n描述: p", '```json\n{"broken": \n```', '```json\n{"insights": []}\n```')
    assert [r["type"] for r in got] == ["table", "chart", "other", "other", "other", "other", "other"]
    assert [r["confidence"] for r in got] == [0.95, 0.9, 0.7, 0.7, 0.7, 0.7, 0.95]
    assert got[0]["text"] == "d\n\n| a | b |\n| --- | --- |\n| 1 |  |\n\n- x" and got[1]["description"] == "bars\nand more" and got[4]["description"] == "p"


def test_answers(spark):
    got = one(spark, R.answered, '```json\n{"answer": "a", "sources": ["s"]}\n```', 'so: {"confidence": 0.2}', "x" * 400, "")
    assert [(r["answer"], r["sources"], r["confidence"]) for r in got] == [("a", ["s"], 0.9), ('so: {"confidence": 0.2}', [], 0.2), ("x" * 300, [], 0.5), ("搜索失败", [], 0.5)]


def test_summary_defaults(spark):
    got = one(spark, R.summary, '{"problem": "p", "concepts": ["1", "2", "3", "4", "5", "6"]}', "nothing")
    assert got[0]["problem"] == "p" and got[0]["concepts"] == list("12345") and got[0]["method"] == "" and got[1]["contributions"] == []


def test_slides(spark):
    kind = "array<struct<slide_num:int,title:string,content:array<string>,images:array<string>,notes:string>>"
    got = one(spark, R.slides_markdown, [(1, "T", ["a", "b"], ["i.png"], "n1\nn2"), (2, "", [], [], None)], kind=kind)[0]
    assert got == "## 1. T\n\na\nb\n\n![](i.png)\n\n> n1\n> n2\n\n## 2"


def test_names(spark):
    assert one(spark, R.linked_pdf, "see [x](file:///a%20b/c+d.PDF) now", "file:///a.txt", "") == ["/a b/c+d.PDF", None, None]
    assert one(spark, R.image_page, "x/Page_12.png", "page-3", "none.png") == [12, 3, None]
    assert one(spark, lambda c: R.image_name(c, F.lit(3), F.lit(12), F.lit("png")), "p") == ["p_p003_012.png"]
    assert one(spark, lambda c: R.sections(ocr=c, image=F.lit("y")), "x", None) == ["[ocr]\nx\n\n[image]\ny", "[image]\ny"]


def test_weeks(spark):
    days = [datetime.datetime(2023, 12, 28) + datetime.timedelta(days=k) for k in range(0, 400, 3)]
    assert one(spark, R.year_week, *days, kind="timestamp") == [d.strftime("%Y-%W") for d in days]
