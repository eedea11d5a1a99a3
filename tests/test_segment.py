"""Dictionary segmentation against all segmentations of short runs."""

import itertools
import math
import random

from lodestone.operators import segment


def plain_words(run, freq, search):
    total = sum(freq.values())
    best = None
    for cuts in itertools.product([0, 1], repeat=len(run) - 1):
        words, start = [], 0
        for k, c in enumerate([*cuts, 1]):
            if c:
                words.append(run[start : k + 1])
                start = k + 1
        if all(w in freq or len(w) == 1 for w in words):
            # Summed from the right, as probabilities of rests.
            score = 0.0
            for w in reversed(words):
                score = math.log(freq[w] / total) + score if w in freq else math.log(1 / total) + score
            mark = (score, [len(w) for w in words])
            if best is None or mark > best[0]:
                best = mark, words
    out = []
    for w in best[1]:
        for n in (2, 3) if search else ():
            if len(w) > n:
                out += [w[k : k + n] for k in range(len(w) - n + 1) if w[k : k + n] in freq]
        out.append(w)
    return out


def test_best_path_is_the_best_of_all(spark):
    rng = random.Random(4)
    freq = {"".join(rng.choices("abcd", k=rng.randrange(1, 6))): rng.randrange(1, 200) for _ in range(60)}
    runs = sorted({"".join(rng.choices("abcde", k=rng.randrange(1, 11))) for _ in range(120)})
    words = [(w, n) for w, n in freq.items() if w != "ab"] + ([("ab", 1), ("ab", freq["ab"] - 1)] if freq.get("ab", 0) > 1 else [("ab", 3)])
    freq["ab"] = freq["ab"] if freq.get("ab", 0) > 1 else 3
    dictionary = spark.createDataFrame([*words, ("", 5), ("zz", 0)], "word string, freq long")
    for search in (True, False):
        got = {r["run"]: r["words"] for r in segment.segmented_runs(spark.createDataFrame([(r,) for r in [*runs, *runs[:5], ""]], "run string"), dictionary, search).collect()}
        assert got == {r: plain_words(r, freq, search) for r in runs}


def test_texts_with_han_and_other_words(spark):
    dictionary = spark.createDataFrame([("中国", 50), ("中国人", 20), ("人民", 40), ("国人", 5), ("银行", 30), ("中国人民银行", 60)], "word string, freq long")
    rows = [(1, "The 中国人民银行 of 2024, 新人民"), (2, None), (3, ""), (None, "Only words"), (4, "人民人民")]
    got = {r["id"]: r["words"] for r in segment.segmented(spark.createDataFrame(rows, "id long, text string"), "id", "text", dictionary).collect()}
    assert got[1] == ["the", "中国", "国人", "人民", "银行", "中国人", "中国人民银行", "of", "2024", "新", "人民"]
    assert got[2] == got[3] == [] and got[None] == ["only", "words"] and got[4] == ["人民", "人民"]


def test_without_a_dictionary(spark):
    none = spark.createDataFrame([], "word string, freq long")
    got = segment.segmented(spark.createDataFrame([(1, "中国x")], "id long, text string"), "id", "text", none).first()
    assert got["words"] == ["中", "国", "x"]
