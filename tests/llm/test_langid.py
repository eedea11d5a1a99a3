"""Operator 10: languages with few documents, and texts of a few letters."""

import numpy as np

from lodestone.llm import langid


def docs_of(spark, rows):
    return spark.createDataFrame([(k, *r, "src0") for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string")


def test_rare_language_is_learnt_and_kept(spark):
    many = [(f"the words of number {k} are here and there", "en") for k in range(3000)]
    rare = [("slova jsou tady a tam a všude kolem", "cs")] * 2
    docs = docs_of(spark, many + rare)
    langs, _ = langid.train(docs, 20)
    assert langs == ["cs", "en"]
    same = spark.createDataFrame([(None, "slova jsou tady", "cs")] * 500, "doc_id long, text string, lang string")
    assert langid.train(same, 1)[0] == ["cs"]


def test_every_text_with_a_letter_has_a_gram():
    texts = ["OK!", "a", "", "12 !", "中", "7b", "..", "ab cd"]
    raw = [t.encode() for t in texts]
    buf, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    g, (cut, upto), ok = langid._grams(buf, off)
    assert (np.diff(upto) > 0).tolist() == [True, True, False, False, True, True, False, True]
    for k, r in enumerate(raw):
        if r:
            alone, _, fine = langid._grams(np.frombuffer(r, np.uint8), np.array([0, len(r)]))
            assert alone[fine].tolist() == g[cut[k] : cut[k + 1]][ok[cut[k] : cut[k + 1]]].tolist()


def test_stage_keeps_texts_of_a_few_letters(spark):
    docs = docs_of(spark, [(f"the words of number {k} are here and there", "en") for k in range(50)] + [("OK!", "en"), ("a", "en"), ("中", "en"), ("12 !", "en")])
    left = {r["doc_id"] for r in langid.stage(spark, docs, "").collect()}
    assert left & set(range(50, 54)) == {50, 51, 52}
