"""Operators 11 to 13 against plain Python, over the awkward tables and with small blocks, chunks and tiles."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from lodestone.llm import bpe, merkle, periods
from lodestone.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


# Operator 11


def plain_tree(hashes):
    """Root, and for each leaf the siblings (left, right) level by level."""
    proofs, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for k, pos in enumerate(at):
            run = level[pos - pos % 3 : pos - pos % 3 + 3]
            proofs[k].append(("".join(run[: pos % 3]), "".join(run[pos % 3 + 1 :])))
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
        at = [pos // 3 for pos in at]
    return level[0], proofs


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, s, g, n, t: sha("".join(map(field, (i, s, g, n, t))))
    by = {}
    for i, t, g, s, n in rows:
        tampered = t.replace("\n", "") if t is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else t
        by.setdefault(s, []).append((i, leaf(i, s, g, n, t), leaf(i, s, g, n, tampered)))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[s] = plain_tree([r[1] for r in by[s]])
    root, above = plain_tree([trees[s][0] for s in sources])
    out = []
    for s, up in zip(sources, above):
        for (i, h, other), proof in zip(by[s], trees[s][1]):
            path, folded = proof + up, other
            for left, right in path:
                folded = sha(left + folded + right)
            out.append((i, h, trees[s][0], root, sha("".join(a + b for a, b in path)), folded, folded == root))
    return ordered(out)


def test_op11_against_plain_python(spark, awkward, rows):
    got = ordered(QUERIES["op11_merkle_manifest"](spark, awkward).collect())
    assert got == plain_manifest([r[:5] for r in rows])
    assert len({r[3] for r in got}) == 1 and any(r[6] for r in got) and not all(r[6] for r in got)


def test_op11_against_sql(spark, awkward):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{awkward}/documents.parquet/*.parquet'")
    assert ordered(con.sql(merkle.ORACLE).fetchall()) == ordered(QUERIES["op11_merkle_manifest"](spark, awkward).collect())


@pytest.mark.parametrize("digits", [1, 2])
def test_manifest_of_many_layers(spark, digits):
    """Blocks of three and nine leaves, trees of 1 to 100 leaves."""
    data = [(f"s{n:03}", k, sha(f"{n} {k}")) for n in (1, 2, 3, 4, 9, 10, 28, 100) for k in range(n)]
    out = merkle.manifest(spark.createDataFrame(data, "source string, doc_id long, h string"), "source", "doc_id", digits=digits)
    got = {(r["source"], r["doc_id"]): (r["subroot"], r["root"], [(s["left"], s["right"]) for s in r["proof"]]) for r in out.collect()}
    names = sorted({s for s, _, _ in data})
    trees = {n: plain_tree([h for s, _, h in data if s == n]) for n in names}
    root, above = plain_tree([trees[n][0] for n in names])
    assert got == {(s, k): (trees[s][0], root, trees[s][1][k] + above[names.index(s)]) for s, k, _ in data}


# Operator 12

LIBRARY_TEXTS = [
    "x" * 3000, " " * 999 + "a", "\n" * 1000 + "'re don't'll " * 300, None, "", "'" * 700 + "re" * 900 + "   \n\n\n  x" * 200,
    "  \u0085 　a\x1c\x1d b" * 90, "😀é中 " * 700 + "ab12" * 200 + "!!!'s" * 400, "<|endoftext|> and more",
]


def by_library(rows):
    v = bpe.Vocabulary.of(*bpe.default_vocabulary())
    out = []
    for i, t in rows:
        ids = v.encoding.encode_ordinary(t or "")
        out.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t or "")))
    return ordered(out)


def test_op12_against_the_library(spark, awkward, rows):
    assert ordered(QUERIES["op12_byte_bpe"](spark, awkward).collect()) == by_library([r[:2] for r in rows])


@pytest.mark.parametrize("chunk,overlap", [(200, 40), (37, 9), (64, 5), (1000, 300)])
def test_chunks_are_stitched(spark, rows, chunk, overlap):
    data = [(r[0], r[1]) for r in rows if r[1] is None or len(r[1]) < 20_000] + list(enumerate(LIBRARY_TEXTS)) + [(1, LIBRARY_TEXTS[0])]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert ordered(bpe.digests(docs, chunk, overlap).collect()) == by_library(data)


def test_most_chunks_agree_and_parts_decode(spark):
    text = "".join(random.Random(1).choices(["word ", "Words'll ", "12 ", "\n\n", "!? ", "é中 "], k=4000))
    docs = spark.createDataFrame([(1, text), (2, "z" * 2000), (3, "short")], "doc_id long, text string")
    parts = bpe.decode(bpe.encode(docs, chunk=500, overlap=60)).collect()
    whole = {i: b"".join(bytes(r["bytes"]) for r in sorted((r for r in parts if r["doc_id"] == i), key=lambda r: r["part"])) for i in (1, 2, 3)}
    assert whole == {1: text.encode(), 2: b"z" * 2000, 3: b"short"}
    count = {i: sum(r["doc_id"] == i for r in parts) for i in (1, 2, 3)}
    assert count[1] == -(-(len(text) - 60) // 500) and count[2] == count[3] == 1


def test_pattern_reads_characters_as_the_library(spark):
    """Both ends of the library's pattern and of the one that cuts chunks see the same classes of characters."""
    v = bpe.Vocabulary.of(*bpe.default_vocabulary())
    for cp in [*range(0x3100), *range(0x10000, 0x10400), 0xFEFF, 0x1F600, 0x20000, 0xE0001]:
        if not 0xD800 <= cp < 0xE000:
            t = f"a{chr(cp)}1 {chr(cp)}b"
            assert v.encode_stretch(t, 0, len(t)) == v.encode(t), hex(cp)


# Operator 13


def plain_runs(x, least=12):
    out = {}
    for p in range(1, len(x) // 2 + 1):
        i = 0
        while i + p < len(x):
            j = i
            while j + p < len(x) and x[j] == x[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                out.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, p, e - s) for (s, e), p in out.items())


def plain_row(i, t):
    w = WORD.findall(t or "")
    n = len(w)
    h = zlib.crc32(str(i).encode())
    if i is not None and n and h % 10 == 0:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
    runs = plain_runs(w)
    dropped = {j for s, p, k in runs for j in range(s + p, s + k)}
    best = min(((-k, s, p) for s, p, k in runs), default=None)
    first = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (i, len(runs), *first, sha("".join(f"{s},{k},{p}\n" for s, p, k in runs)), sha(" ".join(v for j, v in enumerate(w) if j not in dropped)))


def periodic(seed, count, longest):
    rng = random.Random(seed)
    out = [[], [1], [1] * 11, [1] * 12, [1] * 100, [bin(i).count("1") & 1 for i in range(600)], [0, 1] * 40, [*range(50)] * 3 + [1]]
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    out.append(b)
    for _ in range(count):
        kinds, n = rng.choice([1, 2, 3, 50]), rng.randrange(longest)
        x = [rng.randrange(kinds) for _ in range(n)]
        for _ in range(rng.randrange(3) if n > 5 else 0):
            at = rng.randrange(n)
            q = rng.randrange(1, max(2, (n - at) // 2 + 1))
            for i in range(at, min(n, at + q * rng.choice([2, 3, 5]))):
                x[i] = x[at + (i - at) % q]
        out.append(x)
    return out


def test_solve_against_plain_python():
    cases = periodic(5, 200, 200)
    tile = np.concatenate([[0], np.cumsum([len(c) for c in cases])])
    s, e, p = periods.least_periods(*periods.solve(np.concatenate([np.array(c, np.int64) for c in cases]), tile))
    doc = np.searchsorted(tile, s, "right") - 1
    got = sorted((int(d), int(a - tile[d]), int(q), int(b - a)) for d, a, b, q in zip(doc, s, e, p))
    assert got == sorted((k, *r) for k, c in enumerate(cases) for r in plain_runs(c))


def test_wrong_hashes_do_no_harm(monkeypatch):
    """With hashes that are all equal every stretch is taken anew, by words."""
    monkeypatch.setattr(periods.Prefixes, "equal", lambda self, a, p, size: np.ones(len(a), bool))
    for x in periodic(6, 30, 80):
        s, e, p = periods.least_periods(*periods.solve(np.array(x, np.int64), np.array([0, len(x)])))
        assert sorted(zip(s.tolist(), p.tolist(), (e - s).tolist())) == plain_runs(x)


@pytest.mark.parametrize("long,tile", [(1 << 15, 1 << 13), (200, 16), (1000, 64), (0, 200)])
def test_op13_against_plain_python(spark, tmp_path, monkeypatch, rows, long, tile):
    """Whole texts as one tile, and cut into tiles whose fragments are stitched."""
    data = [(r[0], r[1]) for r in rows if r[1] is None or len(r[1]) < 6000] + [(None, "a b " * 30), (7, " \t"), (10**6, "w " * 400), (10**6, "w " * 400)]
    data += [(10**7 + k, " ".join(map(str, x))) for k, x in enumerate(periodic(7, 20, 150))]
    spark.createDataFrame(data, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    find = periods.find_runs
    monkeypatch.setattr(periods, "find_runs", lambda docs: find(docs, long, tile))
    got = ordered(QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect())
    assert got == ordered(plain_row(*r) for r in data) and sum(r[1] > 0 for r in got) > 10


# Mends


def test_damaged_media_are_rows_with_an_error(spark):
    """Files with changed or missing bytes never end a job, and do nothing to the files beside them."""
    from lodestone.llm import media

    rng = random.Random(1)
    texts = [b"", b"hello world " * 40, bytes(range(256)) * 60]
    whole = media.store_texts(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    bad = []
    for _ in range(5000):
        d = bytearray(rng.choice(whole))
        for _ in range(rng.choice([1, 3, 10])):
            d[rng.randrange(min(len(d), 700)) if rng.random() < 0.8 else rng.randrange(len(d))] = rng.randrange(256)
        bad.append(bytes(d[: rng.randrange(len(d))] if rng.random() < 0.1 else d))
    bad.append(whole[1].replace(b"bytes=480", b"bytes=999"))
    for b in bad:
        (frames, meta), (good, _) = media.samples_of([b, whole[1]])
        assert frames or meta["error"]
        assert b"".join(f.astype(np.uint8).tobytes() for f in good)[:480] == texts[1]
    rows = [(k, b) for k, b in enumerate(bad[:400])] + [(1000, whole[2]), (1001, None)]
    frame = spark.createDataFrame(rows, "doc_id long, media binary").repartition(3)
    got = {r["doc_id"]: r for r in media.digest_rows(frame).collect()}
    assert len(got) == 402 and got[1000]["error"] is None and got[1000]["payload_sha256"] == sha(texts[2]) and got[1001]["error"]
    clips = [(r["doc_id"], r["start_ms"], r["end_ms"], r["frames"], r["difference"]) for r in media.clip_rows(frame).collect()]
    assert ordered(clips) == ordered((i, *c) for i, r in got.items() for c in r["clips"] or [])


@pytest.mark.parametrize("bound", [0, 200_000])
@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_join_small(spark, monkeypatch, bound, how):
    """Both ways of the join, with null keys, a hot key and columns named as its own."""
    from lodestone.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", bound)
    rows = [(None if k % 7 == 0 else k % 3, k % 2, k, k, k) for k in range(200)]
    big = spark.createDataFrame(rows, "k long, m long, __k long, __salt long, ____k long").repartition(4)
    small = spark.createDataFrame([(None, 0, "a"), (1, 1, "b"), (2, 0, "c")], "k long, m long, v string")
    find = {(None, 0): "a", (1, 1): "b", (2, 0): "c"}
    want = []
    for r in rows:
        v = find.get(r[:2])
        want += {"left": [(*r, v)], "inner": [(*r, v)] if v else [], "left_semi": [r] if v else [], "left_anti": [] if v else [r]}[how]
    got = common.join_small(big, small, ["k", "m"], how)
    assert ordered(got.collect()) == ordered(want) and got.columns[:5] == big.columns


def test_language_stage_with_odd_columns(spark):
    from lodestone.llm import langid

    rows = [(k, f"the words of number {k} are here and there", "en", "s", 0, "x", 1, 2) for k in range(60)] + [(99, "12 !", "en", "s", 0, "x", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ____key string, __key int, __salt int")
    out = langid.stage(spark, docs, "")
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == set(range(60))
