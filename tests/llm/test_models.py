"""Codecs by round trips, classifiers by held-out accuracy, the pipeline by its stages' decisions."""

import random
import re
import unicodedata
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import jpegcodec, langid, media, rans, suffixdedup, toxicity
from lodestone.llm.common import shared_dir
from lodestone.llm.queries import ORACLES, QUERIES


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 70), max_size=200), max_size=4), st.integers(0, 3))
def test_rans_round_trip(streams, many):
    streams = [np.array(s * 10**many, np.uint32) for s in streams]
    table = rans.FrequencyTable(np.bincount(np.concatenate([*streams, np.zeros(1, np.uint32)]), minlength=71), 12)
    assert table.freq.sum() == 1 << 12
    for s, blocks in zip(streams, rans.encode(streams, table)):
        assert np.concatenate([np.zeros(0, np.uint32), *rans.decode(blocks, table)]).tolist() == s.tolist()


def test_rans_finds_damage():
    table = rans.FrequencyTable(np.ones(50))
    block = bytearray(rans.encode([np.arange(5000) % 50], table)[0][0])
    block[-3] ^= 4
    with pytest.raises(ValueError):
        rans.decode([bytes(block)], table)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.binary(max_size=9000), min_size=1, max_size=4))
def test_avi_round_trip(texts):
    buf = np.frombuffer(b"".join(texts), np.uint8)
    files = media.store_texts(buf, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
    for t, (frames, meta) in zip(texts, media.samples_of(files)):
        assert meta["bytes"] == len(t) and np.concatenate(frames).tobytes()[: len(t)] == t


def test_step_by_step_decoder_agrees():
    raw = random.Random(1).randbytes(64 * 20)
    buf = np.frombuffer(raw, np.uint8)
    frame = jpegcodec.Frame(media.parse_avi(media.store_texts(buf, np.array([0, len(raw)]))[0])[0][0])
    bits = jpegcodec._Bits(bytes(frame.scan).replace(b"\xff\x00", b"\xff"))
    assert (frame._lossless(bits) == frame.grey()).all()


def test_baseline_frame():
    """A grey 8 by 8 baseline frame with one coefficient, written by hand: flat blocks of 128 + 10."""
    q = b"\xff\xdb\x00\x43\x00" + bytes([8] * 64)
    dc = b"\xff\xc4\x00\x14\x00" + bytes([1] + [0] * 15) + bytes([4])  # code 0: four bits follow
    ac = b"\xff\xc4\x00\x14\x10" + bytes([1] + [0] * 15) + bytes([0])  # code 0: end of block
    sof = b"\xff\xc0\x00\x0b\x08\x00\x08\x00\x08\x01\x01\x11\x00"
    sos = b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00"
    scan = bytes([0b01010_0_11])  # DC: size 4, value 10; end of block; ones
    frame = jpegcodec.Frame(b"\xff\xd8" + q + dc + ac + sof + sos + scan + b"\xff\xd9")
    assert (frame.grey() == 128 + 10).all()


def test_shots_and_clips(spark):
    dark, light = np.zeros((8, 64), np.uint8), np.full((8, 64), 250, np.uint8)
    assert media.shots([dark] * 12 + [light] * 12)[0] == [0, 12]
    assert media.shots([dark] * 5)[0] == [0] and media.shots([])[0] == []
    text = ("a" * 64 * 64) * 10 + ("\xff" * 32 * 64) * 10
    df = media.store(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"))
    clips = media.clip_rows(df.unionByName(spark.createDataFrame([(3, None)], "doc_id long, media binary"))).orderBy("doc_id", "clip").collect()
    assert [(r["doc_id"], r["start_ms"], r["end_ms"]) for r in clips] == [(1, 0.0, 400.0), (1, 400.0, 800.0), (2, 0.0, 40.0)]


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        media.parse_avi(b"RIFF\0\0\0\0WAVE")


def test_shared_folder():
    """The setting comes first, then the context's own; a cluster without either is an error."""

    def session(master, setting=None, own=None):
        context = SimpleNamespace(master=master, getConf=lambda: {"spark.checkpoint.dir": setting} if setting else {}, getCheckpointDir=lambda: own)
        return SimpleNamespace(sparkContext=context)

    assert shared_dir(session("spark://a:1", "hdfs://x/", "hdfs://y")) == "hdfs://x" and shared_dir(session("spark://a:1", None, "hdfs://y")) == "hdfs://y"
    assert shared_dir(session("local[2]")).startswith("file://")
    with pytest.raises(RuntimeError):
        shared_dir(session("spark://a:1"))


def test_op4_held_out(spark):
    d = "/root/testdata/sf0.01"
    out = QUERIES["op4_toxicity_nbsvm"](spark, d)
    both = out.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in both.doc_id]).all()
    assert ((both.score >= 0.7) == (both.predicted == 1)).all() and both.score.between(0, 1).all()
    held = both[both.held_out]
    hits = (held.predicted == 1) & (held.toxic == 1)
    assert hits.sum() / max(1, (held.predicted == 1).sum()) >= 0.9 and hits.sum() / (held.toxic == 1).sum() >= 0.6


def test_op4_reads_no_held_out_label(spark, small, tmp_path):
    """Turning the held-out labels round changes no score; equal texts have equal scores."""
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    turned = labels.selectExpr("doc_id", "quality", "if(pmod(crc32(cast(doc_id as string)), 3) = 1, 1 - toxic, toxic) as toxic")
    both = [{(r["doc_id"], r["score"]) for r in toxicity.score(docs, *toxicity.train_model(docs, x)).collect()} for x in (labels, turned)]
    assert both[0] == both[1]


def test_op4_features_are_characters():
    """Hashed n-grams of code points against plain Python, letters of more than one byte included; case aside."""
    texts = ["Straße ÀÉÎ, 12 ñandú!", "机器学习与深度学习 model", "नमस्ते दुनिया", "😀😀😀😀 ok", "", "É"]
    raw = [t.encode() for t in texts]
    buf, off = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    doc, bucket = toxicity._all_features(buf, off)
    for i, t in enumerate(texts):
        low = "".join(c.lower() if ord(c) > 0xFFFF or unicodedata.category(c)[0] in "LM" else " " for c in t)
        low = re.sub(" +", " ", " " + low)
        grams = {low[k : k + n] for n in toxicity.SIZES for k in range(len(low) - n + 1)}
        hashes = set()
        for g in grams:
            h = sum(ord(c) * toxicity._BASE ** k for k, c in enumerate(g)) + len(g)
            hashes.add(int(toxicity.mix64(np.array([h % (1 << 64)], np.uint64))[0] >> np.uint64(64 - toxicity.BITS)))
        assert set(bucket[doc == i].tolist()) == hashes


def test_op4_fit_against_a_dense_one(spark, monkeypatch):
    """The fit by passes over a table comes to the least loss that Newton's steps come to, with the penalty that is best on the fold left out; weights count."""
    rng = np.random.default_rng(3)
    x = rng.random((400, 12)) < 0.3
    scale = rng.normal(size=12)
    y = (x @ (scale * rng.normal(size=12)) + rng.normal(size=400) > 0).astype(float)
    times, fold = rng.integers(1, 4, 400), rng.integers(0, 5, 400)
    rows = spark.createDataFrame([(int(y[i]), int(times[i]), int(fold[i]), np.flatnonzero(x[i]).tolist()) for i in range(400)], "y int, n long, fold int, k array<int>").repartition(3)
    monkeypatch.setattr(toxicity, "PENALTIES", [10.0, 1e-3, 1e-2])
    w, b = toxicity.fit(rows, scale)
    dense = np.c_[x * scale, np.ones(400)]

    def loss(v, of, penalty):
        z = dense[of] @ v
        return ((np.logaddexp(0, z) - y[of] * z) * times[of]).sum() / times[of].sum() + penalty / 2 * (v[:-1] @ v[:-1])

    def newton(of, penalty):
        at, ridge, d, t = np.zeros(13), penalty * np.r_[np.ones(12), 0], dense[of], times[of]
        for _ in range(60):
            p = 1 / (1 + np.exp(-d @ at))
            at = at - np.linalg.solve((d * (t * p * (1 - p))[:, None]).T @ d / t.sum() + np.diag(ridge + 1e-9), d.T @ ((p - y[of]) * t) / t.sum() + ridge * at)
        return at

    best = min(toxicity.PENALTIES, key=lambda q: loss(newton(fold != 0, q), fold == 0, 0))
    every = np.ones(400, bool)
    least = loss(newton(every, best), every, best)
    assert least <= loss(np.append(w, b), every, best) < least + 1e-4


def test_op4_labels_count_as_often_as_they_come(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    some = labels.where("not doc_id <=> 3 and pmod(crc32(cast(doc_id as string)), 3) <> 1")
    thrice = some.unionByName(some).unionByName(some)
    rows = {r["doc_id"]: r for r in toxicity.training_rows(docs, thrice).collect()}
    assert len(rows) == some.join(docs, "doc_id", "left_semi").count() and {r["n"] for r in rows.values()} == {3}


def test_op4_awkward(spark, awkward, rows):
    out = QUERIES["op4_toxicity_nbsvm"](spark, awkward).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)


def test_small_chunks():
    """Chunks with less than a gram in all."""
    for texts in ([], [""], ["a"], ["ab", ""], ["", "abcd"], ["1 2", "a b c"], ["abcde", "x"]):
        raw = [t.encode() for t in texts]
        buf, off = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        doc, bucket = toxicity._all_features(buf, off)
        alone = [toxicity._all_features(np.frombuffer(r, np.uint8), np.array([0, len(r)]))[1].tolist() for r in raw]
        assert [bucket[doc == i].tolist() for i in range(len(raw))] == alone
        g, (cut, upto), ok = langid._grams(buf, off)
        assert len(g) == len(ok) == cut[-1] and upto[-1] == ok.sum()


def test_op10_accuracy(spark, small):
    out = QUERIES["op10_language_id"](spark, small).toPandas()
    docs = out[out.doc_id.notna()]
    assert (docs.declared == docs.language).mean() > 0.97 and docs.rejected.mean() < 0.01


def test_op10_text_outweighs_a_wrong_declaration(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    wrong = docs.where("lang = 'fr' and n_chars > 500").limit(3).selectExpr("doc_id", "text", "'en' as lang", "source", "n_chars")
    out = langid.fuse(langid.document_rows(wrong), *langid.train(docs)).collect()
    assert [r["language"] for r in out] == ["fr"] * 3


def test_op10_priors_decide_where_text_is_short(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.train(docs)
    long = docs.where("lang in ('de', 'fr')").selectExpr("doc_id", "text", "lang as host", "lang as suffix", "cast(null as string) as declared")
    rows = [(-1, "en en", "de", "de", None), (-2, "en en", "fr", "fr", None), (-3, "12 !", "de", "de", "de"), (-4, None, None, None, None)]
    short = spark.createDataFrame(rows, "doc_id long, text string, host string, suffix string, declared string")
    out = {r["doc_id"]: r for r in langid.fuse(long.unionByName(short), *model).where("doc_id < 0").collect()}
    assert (out[-1]["language"], out[-2]["language"]) == ("de", "fr") and out[-3]["rejected"] and out[-4]["rejected"]


def test_op10_awkward(spark, awkward, rows):
    out = QUERIES["op10_language_id"](spark, awkward)
    assert out.where("page_id is not null or doc_id is not null").count() >= len(rows) - 3
    assert {r["doc_id"] for r in out.where("rejected and doc_id is not null").collect()} >= {1000, 1001, 1002, 1005}


def test_merge_sort_orders_suffixes():
    rng = np.random.default_rng(2)
    buf = rng.integers(97, 99, 3000).astype(np.uint8)
    buf[1000:1300] = buf[:300]
    s = suffixdedup.Suffixes(buf)
    at = rng.permutation(2800)[:700]
    group = np.sort(rng.integers(0, 5, 700))
    raw = buf.tobytes().ljust(3200, b"\0")
    order = s.merge_sort(at, group)
    want = sorted(range(700), key=lambda i: (group[i], raw[at[i] : at[i] + 100], i))
    assert order.tolist() == want
    into, same = s.classes(at, group)
    text = lambda i: (group[i], raw[at[i] : at[i] + 100])
    assert [int(i) for i in into] == want and same.tolist() == [k > 0 and text(want[k]) == text(want[k - 1]) for k in range(700)]
    x, y = at[:300], at[300:600]
    agree = [next((k for k in range(100) if raw[i + k] != raw[j + k]), 100) for i, j in zip(x, y)]
    assert s.common(x, y).tolist() == agree


def test_unsorted_suffixes_lose_repeats(monkeypatch):
    """The classes come from the sort: without it like suffixes stay apart."""
    buf = np.random.default_rng(4).integers(97, 123, 3000).astype(np.uint8)
    buf[2000:2500] = buf[:500]
    s = suffixdedup.Suffixes(buf)
    at, group = np.array([0, 5, 2000, 700, 2005, 900]), np.zeros(6, np.int64)
    assert s.classes(at, group)[1].sum() == 2
    monkeypatch.setattr(suffixdedup.Suffixes, "merge_sort", lambda self, x, g: np.arange(len(x)))
    assert s.classes(at, group)[1].sum() == 0


def test_collisions_split_a_class():
    buf = np.frombuffer(b"a" * 100 + b"b" * 100 + b"a" * 100, np.uint8)
    s = suffixdedup.Suffixes(buf)
    order, same = s.without_collisions(np.array([0, 100, 200]), np.arange(3), np.array([False, True, True]))
    assert order.tolist() == [0, 2, 1] and same.tolist() == [False, True, False]


def test_pieces_cover_every_window():
    buf = np.frombuffer(random.Random(3).randbytes(5000), np.uint8)
    off = np.array([0, 50, 50, 2000, 2099, 2199, 5000])
    p = suffixdedup.Pieces(buf, off)
    got = sorted((int(d), int(s) + j) for d, s, n in zip(p.doc, p.start, p.windows) for j in range(n))
    assert got == [(d, i) for d in range(6) for i in range(off[d], off[d + 1] - 99)]


def test_long_texts_come_in_segments():
    text = "".join(random.Random(5).choices("abcdef", k=5_000_000))
    seen = []
    for _, part, off, base in suffixdedup._segments(pa.array(["x", text, "y"])):
        for d in range(len(off) - 1):
            seen += range(base + 0, base + max(0, int(off[d + 1] - off[d]) - 99)) if off[d + 1] - off[d] > 1 else []
    assert seen == list(range(len(text) - 99))


def test_pipeline_stages(spark, awkward, rows):
    import corpus_pipeline

    docs = spark.read.parquet(f"{awkward}/documents.parquet").drop("spans")
    names, columns = [], docs.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, out = docs, stage(spark, docs, awkward)
        assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        names.append((name, before.count(), docs.count()))
    left = {r["doc_id"] for r in docs.collect()}
    assert not left & {1000, 1001, 1002, 1005} and names[1][1] > names[1][2] > 0 and names[2][1] > names[2][2]


def test_near_dedup_keeps_one_row_of_each_group(spark, small):
    from lodestone.llm import simhash

    text = lambda name: " ".join(f"{name}{i}" for i in range(60))
    rows = [(None, text("a")), (None, text("b")), (None, text("c")), (None, text("c")), (7, text("d")), (7, text("e")), (7, text("e")), (8, text("e")), (None, text("e")), (9, text("f"))]
    out = simhash.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), small).collect()
    assert sorted((r["doc_id"] or 0, r["text"][0]) for r in out) == [(0, "a"), (0, "b"), (0, "c"), (7, "d"), (7, "e"), (9, "f")]


@pytest.mark.parametrize("crowd", [1024, 4, 1])
def test_near_copies_against_brute_force(spark, crowd, monkeypatch):
    from lodestone.llm import neardup

    monkeypatch.setattr(neardup, "CROWD", crowd)
    rng, texts = np.random.default_rng(5), ["", " !", "one two", "One, two", "a b " * 20, "a b " * 24]
    for k in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(5, 300)))]
        texts.append(" ".join(base))
        for _ in range(6):
            w = list(base)
            for at in rng.integers(0, len(w), int(rng.integers(0, max(2, len(w) // 25)))):
                w[at] = "new"
            texts.append(", ".join(w).upper())
    texts = sorted(set(texts))
    grams = []
    for t in texts:
        w = re.findall("[a-z0-9]+", t.lower())
        grams.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    root = list(range(len(texts)))

    def top(i):
        return i if root[i] == i else top(root[i])

    close = 0
    for i in range(len(texts)):
        for j in range(i):
            both, union = (grams[i] & grams[j]).total(), (grams[i] | grams[j]).total()
            if both >= 0.8 * union - 1e-9:
                root[top(i)] = top(j)
                close += both < union
    df = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    mine = {r["node"]: r["root"] for r in neardup.roots(df).collect()}
    groups = lambda of: sorted(sorted(i for i in range(len(texts)) if of(i) == r) for r in {of(i) for i in range(len(texts))})
    assert close > 50 and groups(lambda i: mine.get(i, i)) == groups(top)


def test_near_dedup_drops_near_copies(spark, small):
    from lodestone.llm import simhash

    base = [f"word{i}" for i in range(100)]
    rows = [(k, " ".join("other" if i in at else w for i, w in enumerate(base))) for k, at in enumerate([(), (50,), (20, 70), (10, 30, 50, 70, 90)])]
    out = simhash.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), small).collect()
    assert sorted(r["doc_id"] for r in out) == [0, 3]


def test_pipeline_runs(spark, small, empty):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, small).orderBy("start").collect()
    assert out[0]["start"] == 0 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(out, out[1:]))
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_op3_media_that_cannot_be_read(spark):
    import numpy as np

    from lodestone.llm import media

    good = media.store_texts(np.frombuffer(b"some text" * 40, np.uint8), np.array([0, 360]))[0]
    at = good.index(b"\xff\xda")
    plain = good.replace(b"bytes=360", b"wrote=360")
    files = [good, None, b"", b"no film", good[: len(good) // 2], good[: at + 20] + b"\xff" * 9 + good[at + 29 :], plain]
    df = spark.createDataFrame(list(enumerate(map(lambda m: m and bytearray(m), files))), "doc_id long, media binary").coalesce(1)
    out = {r["doc_id"]: r for r in media.digest_rows(df).collect()}
    assert len(out) == len(files) and out[0]["error"] is None and out[0]["n_bytes"] == 360
    assert all(out[k]["error"] and out[k]["payload_sha256"] is None for k in (1, 2, 3, 4))
    assert out[6]["error"] is None and out[6]["n_bytes"] is None and out[6]["payload_bytes"] % 64 == 0
    assert {r["doc_id"] for r in media.clip_rows(df).collect()} >= {0, 6} and 1 not in {r["doc_id"] for r in media.clip_rows(df).collect()}


def test_stages_with_columns_named_like_their_own(spark, small):
    from lodestone.llm import langid, linededup, simhash

    docs = spark.read.parquet(f"{small}/documents.parquet").limit(40)
    odd = docs.selectExpr("*", "1 as __key", "2 as __node", "3 as __n", "4 as __id", "5 as __hash", "map('a', 1) as m", "6 as __lines")
    for f in (lambda d: langid.stage(spark, d, small), lambda d: simhash.stage(spark, d, small), linededup.drop_lines):
        one, two = f(docs), f(odd)
        assert two.columns[: len(odd.columns)] == odd.columns
        assert sorted(r["doc_id"] for r in one.select("doc_id").collect()) == sorted(r["doc_id"] for r in two.collect())
        assert {tuple(r) for r in two.select("__key", "__node", "__n", "__id", "__hash", "__lines").collect()} <= {(1, 2, 3, 4, 5, 6)}


def _one_bin(texts: list[bytes]) -> list[bytes]:
    """All pieces of documents 0, 1, ... as a bin."""
    buf, off = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    p = suffixdedup.Pieces(buf, off)
    cols = {"doc": p.doc, "text_hash": p.doc * 0, "start": p.start - off[p.doc], "lead": p.anchor - p.start, "windows": p.windows}
    raw = buf.tobytes()
    return [suffixdedup._pack(cols, b"".join(raw[i : i + w + suffixdedup.LENGTH - 1] for i, w in zip(p.start.tolist(), p.windows.tolist())))]


@pytest.mark.parametrize("at_once", [1 << 20, 500])
def test_surroundings_of_a_common_line_are_not_sorted(monkeypatch, at_once):
    """Of strings around a line that all documents share only those that some other is like are sorted; turns by distance give the same."""
    rng = np.random.default_rng(3)
    line = bytes(rng.integers(97, 123, 76).astype(np.uint8))
    noise = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8))
    same = noise(60)
    texts = [(same if k % 10 == 0 else noise(60)) + line + (same if k % 15 == 0 else noise(60)) for k in range(150)]
    sizes, merge_sort = [], suffixdedup.Suffixes.merge_sort
    monkeypatch.setattr(suffixdedup, "SORTED_AT_ONCE", at_once)
    monkeypatch.setattr(suffixdedup.Suffixes, "merge_sort", lambda self, at, group: sizes.append(len(at)) or merge_sort(self, at, group))
    got = [set() for _ in texts]
    for doc, _, start, end in zip(*(x.tolist() for x in suffixdedup.repeated_pieces(_one_bin(texts)))):
        got[doc] |= set(range(start, end))
    seen, want, n = {}, [set() for _ in texts], suffixdedup.LENGTH
    for k, t in enumerate(texts):
        for i in range(len(t) - n + 1):
            if seen.setdefault(t[i : i + n], (k, i)) != (k, i):
                want[k] |= set(range(i, i + n))
    assert got == want and 0 < sum(sizes) < sum(len(t) - n + 1 for t in texts) / 4


def test_a_long_buffer_keeps_its_powers(monkeypatch):
    """Powers that are too many to be kept for all are worked out once for a bin's buffer, not at each comparison."""
    from lodestone.llm import textarrays

    s, calls, powers = suffixdedup.Suffixes(np.arange(1000, dtype=np.uint8)), [], textarrays.powers
    monkeypatch.setattr(textarrays, "powers", lambda *a: calls.append(a) or powers(*a))
    assert s.common(np.array([0, 1]), np.array([256, 2])).tolist() == [100, 0] and not calls
