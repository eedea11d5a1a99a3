"""The piece tokenizer against the library, and shards that are read with nothing but their folder."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from lodestone.llm import tokenids
from lodestone.llm.textarrays import text_chunks

PARTS = list("abzABZ09 \t\n\r\x0b.,;:!?'\"-_|<>()$%&*éßÉÖ×÷ñçµªº¼²ÀÿŸĀįİıſΣσς中文あ…—̸́=Kǅ😀\x1c\x85\x00") + ["'s", "'re", "don't", " the ", "word,", "é,", "×,", "<|endoftext|>", "<|ENDOFTEXT|>", "ﬁ"]


def encoded(path, texts):
    t, out = tokenids.tokenizer(path), []
    for _, _, buf, off in text_chunks(pa.array(texts, pa.string())):
        ids, n = t.encode(buf, off, 2)
        out += np.split(ids, np.cumsum(n)[:-1])
    return [x.tolist() for x in out]


@pytest.mark.parametrize("name, by_piece", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_same_ids_as_the_library(name, by_piece):
    path, pick = public_tokenizers.path(name), random.Random(7)
    texts = ["".join(pick.choice(PARTS) for _ in range(pick.randint(0, 30))) for _ in range(3000)]
    texts += [x for x in texts if "<|" not in x] + [None, "", " ", "  ", ".", ".a", "a.", "é" * 50_000, "long words " * 200_000]
    t = tokenids.tokenizer(path)
    assert t.by_piece == by_piece
    want = [e.ids + [2] for e in t.tokenizer.encode_batch_fast([x or "" for x in texts], add_special_tokens=False)]
    assert encoded(path, texts) == want


def test_forgotten_pieces_change_nothing(monkeypatch):
    texts = [f"some word{chr(97 + k % 26)}{chr(97 + k // 26)} and, more" for k in range(300)]
    path = tokenids.default_path()
    want = encoded(path, texts)
    monkeypatch.setattr(tokenids, "REMEMBERED", 10)
    assert [x for t in texts for x in encoded(path, [t])] == want


def test_shards_are_read_from_their_folder_alone(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    path, folder = tokenids.default_path(), f"file://{tmp_path}/corpus"
    tokens = tokenids.token_rows(docs, path).cache()
    tokenids.write_shards(tokens, tokenids.FrequencyTable(tokenids.counts(tokens, path)), path, 2, folder)
    want = {r["doc_id"]: zlib.crc32(np.frombuffer(bytes(r["ids"]), "<u2").astype("<u4").tobytes()) for r in tokens.collect()}
    tokens.unpersist()
    about = spark.read.parquet(f"{folder}/table").first()
    assert about["tokenizer"] == "word_bpe_49k.json" and about["end_id"] == 2 and sum(about["frequencies"]) == 1 << about["bits"]
    rows = tokenids.read_shards(spark.newSession(), folder).orderBy("doc_id").collect()
    assert {r["doc_id"]: r["ids_crc32"] for r in rows} == want
    assert [r["start"] for r in rows] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in rows])[:-1]]).tolist()
