"""Operators against brute force over the awkward tables."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash

from lodestone.llm import mixing
from lodestone.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def got(spark, name, d):
    key = next(k for k in QUERIES if k.startswith(name + "_"))
    return QUERIES[key](spark, d)


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_op2_against_sql(spark, awkward):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{awkward}/documents.parquet/*.parquet'")
    mine = got(spark, "op2", awkward)
    want = con.sql(f"select {', '.join(mine.columns)} from ({mixing.ORACLE})").fetchall()
    assert in_order(map(tuple, mine.collect())) == in_order(want)


def test_op2_shares(spark, small):
    out = got(spark, "op2", small).toPandas()
    assert (out.taken <= 3 * out["size"]).all()
    by = out.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), size=("size", "sum"), largest=("size", "max"))
    assert (abs(by.target - by.taken) <= by.largest).all() and (by.target <= 3 * by["size"] + 1e-6).all()
    assert math.isclose(by.target.sum(), out["size"].sum())


def test_op3_round_trip(spark, awkward, rows):
    want = []
    for i, t, *_ in rows:
        raw = (t or "").encode()
        size = max(1, -(-len(raw) // 64)) * 64
        p = raw.ljust(size, b"\0")
        want.append((i, len(raw), size, hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    out = got(spark, "op3", awkward)
    assert in_order(map(tuple, out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32").collect())) == in_order(want)
    same = defaultdict(set)
    for r in out.collect():
        same[r["payload_sha256"], r["n_bytes"]].add((r["media_sha256"], r["feature"], r["media_bytes"]))
    assert all(len(v) == 1 for v in same.values())


def test_op6_ids(spark, awkward, rows):
    from tokenizers import Tokenizer

    from lodestone.llm.tokenids import default_path

    tok, start, want = Tokenizer.from_file(default_path()), 0, []
    enc = [(i, struct.pack(f"<{len(x)}I", *x)) for i, x in ((r[0], tok.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in rows)]
    # Rows of the same id are ordered by the bytes of their ids, two each.
    narrow = lambda b: struct.pack(f"<{len(b) // 4}H", *struct.unpack(f"<{len(b) // 4}I", b))
    for i, raw in sorted(enc, key=lambda e: (e[0] is not None, e[0] or 0, narrow(e[1]))):
        want.append((i, start, len(raw) // 4, zlib.crc32(raw)))
        start += len(raw) // 4
    assert in_order(map(tuple, got(spark, "op6", awkward).collect())) == in_order(want)


def test_op7_bytes(spark, awkward, rows):
    seen, want, docs = set(), {}, {}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    key = lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)) if r[1] is not None else 42)
    for r in rows:
        docs[key(r)] = (r[1] or "").encode()
    for k in sorted(docs):
        raw = docs[k]
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for j in range(len(raw)) if gone[j] and (j == 0 or not gone[j - 1]))
        want[k] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, x in zip(raw, gone) if not x)).hexdigest())
    out = got(spark, "op7", awkward).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert in_order(map(tuple, out.collect())) == in_order((r[0], *want[key(r)]) for r in rows)


def fingerprint(t):
    w = WORD.findall(lower(t))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hs) > len(hs))


def components_of(ids, fps):
    up = list(range(len(ids)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                up[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(ids))]


def test_op8_components(spark, awkward, rows):
    fps = [fingerprint(r[1]) for r in rows]
    comp = components_of([r[0] for r in rows], fps)
    want = [(r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, comp)]
    assert in_order(map(tuple, got(spark, "op8", awkward).select("doc_id", "fingerprint", "component_id").collect())) == in_order(want)


@pytest.mark.parametrize("limit", [0, 3, 48])
def test_op8_hot_keys(spark, limit):
    """Links of crowded keys, with and without pairs."""
    import random

    from lodestone.llm import simhash

    rng = random.Random(4)
    fps = []
    for c in (rng.getrandbits(64) for _ in range(6)):
        fps += [c] + [c ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 4]))) for _ in range(40)]
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    mine = {r["fp"]: r["component_id"] for r in simhash.classes(df, pair_limit=limit).collect()}
    assert [mine[f] for f in signed] == components_of(list(range(len(fps))), fps)


def test_op9_base(spark, awkward, rows):
    toks = [WORD.findall(lower(r[1])) + ["\0end"] for r in rows]
    held = [zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 5 == 1 for r in rows]
    c = Counter(w for t, h in zip(toks, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = in_order((r[0], h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 5)) for r, h, t in zip(rows, held, toks))
    out = got(spark, "op9", awkward)
    mine = in_order((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in out.collect())
    assert len(mine) == len(want)
    for a, b in zip(mine, want):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-3
    assert all(r["score"] <= 0 for r in out.collect())


def test_op9_model_beats_words(spark, small):
    out = got(spark, "op9", small).toPandas()
    assert (out.score.sum() > out.base_score.sum()) and out[out.held_out].score.sum() > out[out.held_out].base_score.sum()


def test_op9_filter_counts():
    import numpy as np

    from lodestone.llm import lmscore as L

    assert L.LEVELS[:5].tolist() == [1, 2, 3, 4, 5] and (np.diff(L.LEVELS) > 0).all()
    h = L.mix64(np.arange(1, 200, dtype=np.uint64))
    ids, level, stretch = (h >> np.uint64(24)) & np.uint64(0xFFFFFFFF), np.arange(1, 200) % 6, L.LINE * 8
    bits = np.zeros((256, stretch), bool)
    for x in range(1, 6):
        some = np.flatnonzero(level >= x)
        for probe in L.LogFrequencyFilter.probes(ids[some], x):
            bits[(h[some] >> np.uint64(56)).astype(int), (L.LogFrequencyFilter.line(ids[some], stretch) + probe).astype(int)] = True
    model = L.LogFrequencyFilter(np.packbits(bits, bitorder="little"), 8, stretch)
    found = model.level(h)
    assert (found >= level).all() and (found == level).mean() > 0.98


def trigram_score(t, c, n, v):
    """The model's formula with counts in place of the filter."""
    from lodestone.llm import lmscore as L

    def value(gram):
        return 0.0 if not c[gram] else float(L.VALUES[sum(int(x) <= c[gram] for x in L.LEVELS)])

    total = 0.0
    for k in range(len(t)):
        p = (value((t[k],)) + 0.5) / (n + 0.5 * (v + 1))
        for size, share in ((2, L.BIGRAM), (3, L.TRIGRAM)):
            if k >= size - 1 and value(tuple(t[k - size + 1 : k])) > 0:
                p = share * min(1.0, value(tuple(t[k - size + 1 : k + 1])) / value(tuple(t[k - size + 1 : k]))) + (1 - share) * p
        total += math.log10(min(p, 1.0))
    return total


@pytest.mark.parametrize("block_bytes", [None, 20_000])
def test_op9_score(spark, awkward, rows, block_bytes, monkeypatch):
    """Against a trigram model by exact counts; a false positive of the filter can only add to a count."""
    from lodestone.llm import lmscore as L

    if block_bytes:
        monkeypatch.setattr(L, "BLOCK_BYTES", block_bytes)
    toks = [WORD.findall(lower(r[1])) + ["\0end"] for r in rows]
    held = [zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 5 == 1 for r in rows]
    c = Counter(tuple(t[k : k + n]) for t, h in zip(toks, held) if not h for n in (1, 2, 3) for k in range(len(t) - n + 1))
    n, v = sum(x for g, x in c.items() if len(g) == 1), sum(len(g) == 1 for g in c)
    want = in_order((r[0], len(t), trigram_score(t, c, n, v)) for r, t in zip(rows, toks))
    mine = in_order((r["doc_id"], r["n_tokens"], r["score"]) for r in got(spark, "op9", awkward).collect())
    apart = [abs(a[2] - b[2]) / a[1] for a, b in zip(mine, want)]
    assert [a[:2] for a in mine] == [b[:2] for b in want] and max(apart) < 0.2 and sorted(apart)[len(apart) // 2] < 0.01


def test_op1_lines(spark, awkward, rows):
    support, per = defaultdict(Counter), []
    for r in rows:
        mine = [tuple("<*>" if re.search("[0-9]", w) else w for w in WORD.findall(x)) for x in (r[1] or "").split("\n")]
        per.append(mine)
        for w in set(mine):
            if len(w) >= 2:
                support[len(w), w[:2]].update((p, x) for p, x in enumerate(w) if x != "<*>")
    template = lambda w: (w[:2], tuple(x if x != "<*>" and support[len(w), w[:2]][p, x] >= 10 else "<*>" for p, x in enumerate(w)))
    docs, whole = defaultdict(set), defaultdict(set)
    for r, mine in zip(rows, per):
        for w in mine:
            if len(w) >= 2 and (n := sum(x != "<*>" for x in template(w)[1])) >= 2 and n >= 0.6 * sum(x != "<*>" for x in w):
                docs[template(w)].add(r[1])
            if len(w) >= 8 and "<*>" not in w:
                whole[w].add(r[1])
    want = []
    for r, mine in zip(rows, per):
        drop = [len(w) >= 2 and (len(docs.get(template(w), ())) >= 10 or len(whole.get(w, ())) >= 3) for w in mine]
        kept = "\n".join(x for x, y in zip((r[1] or "").split("\n"), drop) if not y).encode()
        want.append((r[0], sum(bool(w) for w in mine), sum(drop), len(kept), hashlib.sha256(kept).hexdigest()))
    mine = got(spark, "op1", awkward).select("doc_id", "n_lines", "n_dropped", "kept_bytes", "kept_sha256").collect()
    assert in_order(map(tuple, mine)) == in_order(want)
    assert sum(r["n_dropped"] for r in mine) >= 14


def test_op5_matches(spark, awkward, rows):
    items = [tuple(r)[:2] for r in spark.read.parquet(f"{awkward}/benchmark.parquet").select("item_id", "text").collect()]
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    grams = lambda w, g: Counter(tuple(w[k : k + g]) for k in range(len(w) - g + 1))
    want = []
    for i, t in items:
        v = words(t)
        g = min(5, len(v))
        a = grams(v, g) if v else {}
        for r in rows:
            w = words(r[1])
            if not a or len(w) < g or not a.keys() & grams(w, g).keys():
                continue
            n, best = min(len(v), len(w)), 0.0
            for k in range(len(w) - n + 1):
                b = grams(w[k : k + n], g)
                both = sum(min(c, b[s]) for s, c in a.items())
                best = max(best, both / (sum(a.values()) + sum(b.values()) - both))
            if best >= 0.8:
                want.append((r[0], i, round(best, 6)))
    mine = [(r["doc_id"], r["item_id"], r["similarity"]) for r in got(spark, "op5", awkward).collect()]
    assert in_order(mine) == in_order(want) and len(want) > 14


def test_op5_blocks_of_items(spark, awkward):
    from lodestone.llm import decontam

    docs, items = spark.read.parquet(f"{awkward}/documents.parquet"), spark.read.parquet(f"{awkward}/benchmark.parquet")
    assert in_order(map(tuple, decontam.contaminated(docs, items, 7).collect())) == in_order(map(tuple, decontam.contaminated(docs, items).collect()))


def test_op5_near_copies(spark):
    import pyarrow as pa

    from lodestone.llm.decontam import ItemIndex

    item = " ".join(f"word{i}" for i in range(60))
    changed = item.replace("word30", "other")
    index = ItemIndex([(1, item)])
    docs = ["before " * 30 + item.upper() + " after" * 9, "x " + changed, "y " * 500, " ".join(item.split()[:30]), "!!! ".join(item.split())]
    assert sorted({r for r, *_ in index.search(pa.array(docs))}) == [0, 1, 4]


def test_op5_multi_index_finds_all_within_the_radius():
    import numpy as np

    from lodestone.llm import decontam as D

    rng = np.random.default_rng(3)
    items = rng.integers(0, 1 << 63, 8, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 24)), replace=False)) for _ in range(4000)]
    fps = items[rng.integers(0, 8, 4000)] ^ np.array(flips, np.uint64)
    window, item = D.MultiIndex(items, np.arange(8)).find(fps, D.blocks_of(fps))
    apart = np.bitwise_count(fps[:, None] ^ items[None])
    assert sorted(zip(window.tolist(), item.tolist())) == sorted(zip(*(x.tolist() for x in np.nonzero(apart <= D.RADIUS))))


def test_op5_matches_come_from_the_fingerprints(small, monkeypatch):
    import numpy as np
    import pyarrow.parquet as pq

    from lodestone.llm import decontam as D

    docs, items = (pq.read_table(f"{small}/{n}.parquet") for n in ("documents", "benchmark"))
    rows = list(zip(items["item_id"].to_pylist(), items["text"].to_pylist()))
    assert list(D.ItemIndex(rows).search(docs["text"]))
    index = D.ItemIndex(rows)
    index.build()
    monkeypatch.setattr(D, "fingerprints", lambda sums, width: np.full(max(0, len(sums) - width), (1 << 64) - 1, np.uint64))
    assert not list(index.search(docs["text"]))


def test_op1_lines_of_few_documents(spark):
    """A long line of three different texts goes, one of two stays, and so does every line of a text that only has copies; short ones with fields go."""
    from lodestone.llm.linededup import drop_lines

    passage, pair = " ".join(f"word{chr(97 + k % 26)}{'x' * (k // 26)}" for k in range(60)), "a line of two texts that nobody else in here has"
    rows = [(k, f"own {chr(97 + k)} text\n{passage}\n" + (pair if k < 2 else "")) for k in range(3)] + [(10 + k, "only copies of this one line with eight words or more") for k in range(12)]
    rows += [(30 + k, f"Page {k} of 40\nbody {chr(97 + k)}{chr(98 + k)}") for k in range(10)]
    out = {r["doc_id"]: r["text"] for r in drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(passage not in out[k] and f"own {chr(97 + k)} text" in out[k] for k in range(3)) and pair in out[0]
    assert all(out[10 + k].startswith("only copies") for k in range(12))
    assert all(out[30 + k] == f"body {chr(97 + k)}{chr(98 + k)}" for k in range(10))


def test_op9_routed_scores_are_the_same(spark, awkward, monkeypatch):
    """Questions sent to the filter's bins and a filter sent to everyone give equal scores."""
    from lodestone.llm import lmscore as L

    one = in_order(map(tuple, got(spark, "op9", awkward).collect()))
    monkeypatch.setattr(L, "BLOCK_BYTES", 0)
    monkeypatch.setattr(L, "CHUNK", 50_000)
    two = in_order(map(tuple, got(spark, "op9", awkward).collect()))
    assert [a[:5] for a in one] == [a[:5] for a in two] and all(abs(a[-1] - b[-1]) < 1e-6 for a, b in zip(one, two))


def test_op5_fingerprints_keep_their_room(monkeypatch):
    """Windows are added up in room that is kept, wide ones and more than fit as well; each is the SimHash of its shingles."""
    import numpy as np

    from lodestone.llm import decontam

    monkeypatch.setattr(decontam, "ROOM", 50)
    monkeypatch.setattr(decontam, "_room", {})
    h = np.random.default_rng(1).integers(0, 1 << 63, 120, dtype=np.uint64)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(int)
    for kind in (100, 1 << 15):
        sums = decontam.bit_sums(h, kind)
        for width in (3, 90, 118):
            want = [sum(1 << b for b in np.flatnonzero(bits[i : i + width].sum(0) > width // 2).tolist()) for i in range(121 - width)]
            assert decontam.fingerprints(sums, width).tolist() == want
    assert len(decontam._room) == 2


def test_op5_search_in_small_chunks(small):
    """The pipeline's stage has fewer bytes of text at once; what it finds is the same."""
    import pyarrow.parquet as pq

    from lodestone.llm import decontam

    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{small}/benchmark.parquet").to_pylist()]
    texts = pq.read_table(f"{small}/documents.parquet", columns=["text"]).column(0)
    index = decontam.ItemIndex(items)
    assert decontam.STAGE_BYTES < decontam.CHUNK_BYTES
    whole = list(index.search(texts))
    assert whole and list(index.search(texts, 1 << 12)) == list(index.search(texts, decontam.STAGE_BYTES)) == whole


def test_a_worker_gives_back_arrows_memory(monkeypatch):
    import pyarrow as pa

    from lodestone.llm import textarrays

    calls = []
    pool = type("Pool", (), {"release_unused": lambda self: calls.append(1)})()
    monkeypatch.setattr(pa, "default_memory_pool", lambda: pool)
    run = textarrays.frugal(lambda batches: (b for b in batches))
    assert list(run(iter([1, 2]))) == [1, 2] and calls == [1]


def test_op5_windows_are_added_up_in_lanes(monkeypatch):
    """A window's 64 sums share numbers; also at a lane's limits, when all hashes agree and at ties each bit is 1 if set in over half."""
    import numpy as np

    from lodestone.llm import decontam

    monkeypatch.setattr(decontam, "_room", {})
    rng = np.random.default_rng(2)
    full = np.uint64((1 << 64) - 1)
    for kind, widths, numbers in ((60, (1, 2, 59, 60), 8), (127, (126, 127), 8), (128, (127, 128), 16), (32767, (2, 32767), 16), (32768, (32768,), 32)):
        for h in (rng.integers(0, 1 << 63, kind + 6, dtype=np.uint64) << np.uint64(1), np.zeros(kind + 6, np.uint64), np.full(kind + 6, full), np.arange(kind + 6, dtype=np.uint64) % np.uint64(2) * full):
            bits = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int64)])
            for width in widths:
                want = np.packbits(2 * (bits[width:] - bits[:-width]) > width, axis=1, bitorder="little").view(np.uint64)[:, 0]
                sums = decontam.bit_sums(h, kind)
                assert sums.nbytes == 2 * 8 * numbers * len(sums) and decontam.fingerprints(sums, width).tolist() == want.tolist()
    # Room for a number a window; it was three bytes for each of 64 bits.
    assert {k: v.nbytes for k, v in decontam._room.items()} == {8: 8 * decontam.ROOM, 16: 8 * decontam.ROOM, 32: 8 * decontam.ROOM}


def test_op5_items_of_narrow_and_wide_windows():
    """Items whose windows need lanes of 8, 16 and 32 bits are found side by side, each in its place."""
    import pyarrow as pa

    from lodestone.llm.decontam import ItemIndex

    text = lambda a, n: " ".join(f"w{a}x{k}" for k in range(n))
    items = [(1, text(1, 60)), (2, text(2, 400)), (3, text(3, 33000)), (4, text(4, 131)), (5, text(5, 132))]
    docs = [f"{text(9, 7)} {t} {text(8, 3)}" for _, t in items] + [" ".join(t for _, t in items)]
    got = {(r, i): (sim, at, n) for r, i, sim, at, n, _ in ItemIndex(items).search(pa.array(docs))}
    sizes = [60, 400, 33000, 131, 132]
    want = {(r, r): (1.0, 7, n) for r, n in enumerate(sizes)} | {(5, i): (1.0, sum(sizes[:i]), n) for i, n in enumerate(sizes)}
    assert got == want


def test_op9_levels_are_looked_up_in_steps(monkeypatch):
    """Levels are those that the filter's bits give one probe after another; no more than STEP n-grams are looked up at once."""
    import numpy as np

    from lodestone.llm import lmscore as L

    rng = np.random.default_rng(4)
    bin_bits, first_bin, bins, stretch = 8, 3, 5, 16 * L.LINE
    bits = rng.integers(0, 256, bins * stretch // 8, np.uint8) | rng.integers(0, 256, bins * stretch // 8, np.uint8)
    h = (rng.integers(first_bin, first_bin + bins, 2500).astype(np.uint64) << np.uint64(64 - bin_bits)) | rng.integers(0, 1 << 56, 2500).astype(np.uint64)
    one = np.unpackbits(bits, bitorder="little").tolist()
    want = []
    for x in h.tolist():
        own = np.array([x >> 32 - bin_bits & 0xFFFFFFFF], np.uint64)
        line = ((x >> 64 - bin_bits) - first_bin) * stretch + int(L.LogFrequencyFilter.line(own, stretch)[0])
        level = 0
        while level < len(L.LEVELS) and all(one[line + int(p[0])] for p in L.LogFrequencyFilter.probes(own, level + 1)):
            level += 1
        want.append(level)
    assert len(set(want)) > 3
    sizes, plain = [], L.LogFrequencyFilter.hashes
    monkeypatch.setattr(L.LogFrequencyFilter, "hashes", staticmethod(lambda ids, level: sizes.append(len(ids)) or plain(ids, level)))
    monkeypatch.setattr(L, "STEP", 700)
    assert L.LogFrequencyFilter(bits, bin_bits, stretch, first_bin).level(h).tolist() == want
    assert max(sizes) == 700
    assert L.LogFrequencyFilter(bits, bin_bits, stretch, first_bin).level(h[:0]).tolist() == []
