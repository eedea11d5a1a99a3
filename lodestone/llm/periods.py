"""Operator 13: runs of words that repeat with a period, found by tiles scaled to the period.

A run is a longest stretch of words whose smallest period q fits at least twice and that has LEAST words or more. Periods are taken by
octaves, P to 2P-1. A document of up to LONG_BYTES is one tile for each octave and is finished in its scan's task. A longer one is
exploded into rows: for each octave tiles of max(TILE, 4P) words plus an overlap of 4P + LEAST (the octaves whose 4P fits TILE
share their tiles), dealt to all tasks and solved independently. A stretch as long as the overlap lies whole in some tile, and
a longer run meets each next tile in more than a period; so fragments, shuffled by document and period, are stitched where they overlap
by a period or more, and give the document's runs exactly.

In a tile, boundaries stand at each multiple of P. A run of period p has one at m with its word m equal to word m + p; for these
pairs the Z-functions of both sides (how far the tile agrees with itself p further on, to the right of m and to the left) are taken
for all boundaries at once, by prefix hashes and bisection, first asking whether either reaches p/2. What they give is verified word by
word. Periods below 8 are compared at each word instead. Of equal stretches the least period counts: a stretch with period q also has the
periods 2q, 3q and so on, and by the theorem of Fine and Wilf it has no others that fit twice.

Words are maximal stretches of other bytes than x20 and x09 to x0D; they are told apart exactly, by a dictionary of their bytes.

Defined cases: a null or empty text, or one of white space, has no words and no runs; repeated rows give repeated results; a null id
stays null; of runs of equal length the first counts as greatest, then the least period; an empty table gives no rows; a very long text is
cut into tiles, and only its list of runs and its own text meet in one task at the end; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table
from .textarrays import Rows, frugal, text_chunks, words

#: Least words of a run.
LEAST = 12
#: Bytes up to which a text is one tile, and words of a longer one's tiles.
LONG_BYTES, TILE = 1 << 15, 1 << 13
#: Periods below this are compared at each word.
DIRECT = 8
#: Two primes below 2**31 and a base for each; a span's hash is a pair.
_PRIMES, _BASES = (2147483647, 2147483629), (1103515245, 695364219)

Batches = Iterator[pa.RecordBatch]
_powers: list[np.ndarray] = []


def _powers_of(n: int) -> list[np.ndarray]:
    """Powers of each base modulo its prime, doubled as needed."""
    global _powers
    if not _powers or len(_powers[0]) < n:
        out = []
        for b, q in zip(_BASES, _PRIMES):
            p = np.ones(1, np.uint64)
            while len(p) < n:
                p = np.concatenate([p, p * np.uint64(pow(b, len(p), q)) % np.uint64(q)])
            out.append(p)
        _powers = out
    return _powers


class Prefixes:
    """Prefix hashes of word numbers; tells equal spans by two residues."""

    def __init__(self, ids: np.ndarray):
        self.powers = _powers_of(len(ids) + 1)
        self.sums = []
        for k, q in enumerate(_PRIMES):
            # A multiplicative hash spreads small numbers; the sum of n values below 2**31 stays below 2**64.
            x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33 - k)
            s = np.zeros(len(ids) + 1, np.uint64)
            np.cumsum(x % np.uint64(q) * self.powers[k][: len(ids)] % np.uint64(q), out=s[1:])
            self.sums.append(s)

    def equal(self, a: np.ndarray, p: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether words [a, a+size) are words [a+p, a+p+size)."""
        out = None
        for s, w, q in zip(self.sums, self.powers, _PRIMES):
            q = np.uint64(q)
            one, two = (s[a + size] - s[a]) % q, (s[a + p + size] - s[a + p]) % q
            same = one * w[p] % q == two
            out = same if out is None else out & same
        return out


def _reach(h: Prefixes, at: np.ndarray, p: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """Z-values: the largest size up to ``most`` so that the words right of ``at`` (or left, ``back``) are those p further on."""
    lo, hi = np.zeros_like(most), most + 1
    while True:
        open_ = np.flatnonzero(hi - lo > 1)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        start = at[open_] - mid if back else at[open_]
        ok = h.equal(start, p[open_], mid)
        lo[open_[ok]] = mid[ok]
        hi[open_[~ok]] = mid[~ok]


def _stretches(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each stretch of so many true values or more."""
    edge = np.diff(np.concatenate([[0], same.view(np.int8), [0]]))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = b - a >= least
    return a[long], b[long]


def solve(ids: np.ndarray, tile: np.ndarray, low: int = 1, high: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the longest stretches with a period in [low, high), inside tiles, that fit twice and have LEAST words.

    ids: word numbers of all tiles, one after another; tile: where each starts, and the end; low: 1 or a power of two from DIRECT on.
    Of equal stretches the least period of each octave is returned.
    """
    n, size = len(ids), np.diff(tile)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    top = int(size.max(initial=0)) // 2 + 1
    top = top if high is None else min(top, high)
    begin, end = np.repeat(tile[:-1], size), np.repeat(tile[1:], size)
    for p in range(max(1, low), min(DIRECT, top)):
        if n <= p:
            break
        same = ids[:-p] == ids[p:]
        same &= end[:-p] == end[p:]
        a, b = _stretches(same, max(LEAST - p, p))
        found.append((a, b + p, np.full(len(a), p)))
    h = None
    octave = max(DIRECT, low)
    i = np.arange(n)
    while octave < top:
        # Word i meets the boundary an octave or two before it: each pair (boundary m, period i - m) once.
        i = i[(i - begin[i] >= octave) & (end[i] - begin[i] >= 2 * octave)]
        m = i - ((i - begin[i]) & (octave - 1)) - octave
        hit = ids[i] == ids[m]
        m, p, e = m[hit], (i - m)[hit], end[i[hit]]
        b = begin[i[hit]]
        if len(m):
            h = h or Prefixes(ids)
            half = (p + 1) // 2
            right, left = m + p + half <= e, m - half >= b
            near = np.zeros(len(m), bool)
            near[right] = h.equal(m[right], p[right], half[right])
            left &= ~near
            near[left] |= h.equal(m[left] - half[left], p[left], half[left])
            m, p, e, b = m[near], p[near], e[near], b[near]
        if len(m):
            forth, back = _reach(h, m, p, e - m - p, False), _reach(h, m, p, m - b, True)
            fits = (forth + back >= p) & (forth + back + p >= LEAST)
            found.append(_verified(ids, (m - back)[fits], (m + p + forth)[fits], p[fits], b[fits], e[fits]))
        octave *= 2
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found))


def _verified(ids: np.ndarray, s: np.ndarray, e: np.ndarray, p: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least period of each stretch, once, each compared word by word; where hashes were wrong the stretch is taken anew, by words."""
    order = np.lexsort((p, e, s))
    s, e, p, low, high = s[order], e[order], p[order], low[order], high[order]
    once = np.ones(len(s), bool)
    once[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    wrong = []
    for k in np.flatnonzero(once).tolist():
        if not np.array_equal(ids[s[k] : e[k] - p[k]], ids[s[k] + p[k] : e[k]]):
            wrong.append((s[k], e[k]))
    out = s[once], e[once], p[once]
    if wrong:
        bad = {*wrong}
        keep = np.array([(a, b) not in bad for a, b in zip(out[0], out[1])], bool)
        parts = [tuple(x[keep] for x in out)]
        for k in [k for k in range(len(s)) if (s[k], e[k]) in bad]:
            same = ids[low[k] : high[k] - p[k]] == ids[low[k] + p[k] : high[k]]
            a, b = _stretches(same, max(int(p[k]), LEAST - int(p[k])))
            parts.append((a + low[k], b + low[k] + p[k], np.full(len(a), p[k])))
        out = tuple(np.concatenate(x) for x in zip(*parts))
    return out


def _numbered(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, the same for equal words only."""
    size = ends - starts
    off = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    source = np.arange(int(off[-1])) - np.repeat(off[:-1] - starts, size)
    col = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(buf[source])])
    return col.dictionary_encode().indices.to_numpy().astype(np.int64)


def least_periods(s: np.ndarray, e: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equal stretches the one of least period, by start, then period."""
    order = np.lexsort((p, e, s))
    s, e, p = s[order], e[order], p[order]
    once = np.ones(len(s), bool)
    once[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    s, e, p = s[once], e[once], p[once]
    order = np.lexsort((p, s))
    return s[order], e[order], p[order]


def collapsed(text: bytes, starts: np.ndarray, ends: np.ndarray, runs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    depth = np.zeros(len(starts) + 1, np.int64)
    np.add.at(depth, runs[0] + runs[2], 1)
    np.add.at(depth, runs[1], -1)
    keep = np.cumsum(depth[:-1]) == 0
    return b" ".join([text[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist())])


OUT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _as_list(runs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[dict]:
    return [{"start": a, "length": b - a, "period": q} for a, b, q in zip(*(x.tolist() for x in runs))]


def finder(key: str) -> Callable[[Batches], Batches]:
    """Batches (key, text) -> (key, n_words, runs, collapsed), each text one tile."""

    def run(batches: Batches) -> Batches:
        out = None
        for b in batches:
            out = out or Rows((key, b.schema.field(key).type), ("n_words", pa.int64()), ("runs", _RUNS), ("collapsed", pa.binary()))
            names = b.column(key).to_pylist()
            for lo, hi, buf, off in text_chunks(b.column("text")):
                starts, ends, first = words(buf, off)
                s, e, p = least_periods(*solve(_numbered(buf, starts, ends), first))
                doc = np.searchsorted(first, s, "right") - 1
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                raw = buf.tobytes()
                for k in range(hi - lo):
                    mine, w = slice(cut[k], cut[k + 1]), slice(first[k], first[k + 1])
                    runs = s[mine] - first[k], e[mine] - first[k], p[mine]
                    yield from out.add(names[lo + k], int(first[k + 1] - first[k]), _as_list(runs), collapsed(raw, starts[w], ends[w], runs))
        if out:
            yield from out.rest()

    return run


def tiles(n: int, size: int = TILE) -> Iterator[tuple[int, int, int, int]]:
    """(lowest period, end of periods, start, end) of each tile of a document of n words."""
    low, octave = 1, DIRECT
    while 4 * octave * 2 <= size:
        octave *= 2
    while low <= n // 2:
        high = 2 * octave
        step, over = max(size, 4 * octave), 4 * octave + LEAST
        for a in range(0, max(1, n - over), step):
            yield low, high, a, min(n, a + step + over)
        low = octave = high


def _tile_rows(docs: DataFrame, size: int) -> DataFrame:
    """(key, low, high, start, ids): the tiles of each text of (key, text)."""

    @frugal
    def run(batches: Batches) -> Batches:
        out = Rows(("key", pa.binary()), ("low", pa.int64()), ("high", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()))
        for b in batches:
            names = b.column("key").to_pylist()
            for lo, hi, buf, off in text_chunks(b.column("text")):
                starts, ends, first = words(buf, off)
                for k in range(hi - lo):
                    ids = _numbered(buf, starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]]).astype("<u4")
                    for low, high, a, z in tiles(len(ids), size):
                        yield from out.add(names[lo + k], low, high, a, ids[a:z].tobytes())
        yield from out.rest()

    return docs.select("key", "text").mapInArrow(run, "key binary, low long, high long, start long, ids binary")


def fragments(tile_rows: DataFrame) -> DataFrame:
    """(key, period, start, end) of the stretches in each tile, whole documents' places."""

    @frugal
    def run(batches: Batches) -> Batches:
        for b in batches:
            for key, low, high, at, raw in zip(*[c.to_pylist() for c in b.columns]):
                ids = np.frombuffer(raw, "<u4").astype(np.int64)
                s, e, p = solve(ids, np.array([0, len(ids)]), low, high)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(s), pa.binary()), pa.array(p), pa.array(s + at), pa.array(e + at)], ["key", "period", "start", "end"])

    return tile_rows.mapInArrow(run, "key binary, period long, start long, end long")


def stitched(parts: DataFrame) -> DataFrame:
    """(key, start, length, period) of the runs that fragments make: those of a document and period that overlap by the period or more are one."""
    order = Window.partitionBy("key", "period").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("start") > before - F.col("period"), F.lit(True)).cast("int")
    numbered = parts.withColumn("opens", opens).withColumn("no", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = numbered.groupBy("key", "period", "no").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return whole.groupBy("key", "start", "end").agg(F.min("period").alias("period")).select("key", "start", (F.col("end") - F.col("start")).alias("length"), "period")


def _collapsed_long(rows: DataFrame) -> DataFrame:
    """(doc_id, text, runs) -> (doc_id, n_words, runs, collapsed), a row at a time."""

    @frugal
    def run(batches: Batches) -> Batches:
        out = Rows(("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", _RUNS), ("collapsed", pa.binary()))
        for b in batches:
            for i, text, runs in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("runs").to_pylist()):
                buf = np.frombuffer(text.encode(), np.uint8)
                starts, ends, _ = words(buf, np.array([0, len(buf)]))
                s, n, p = (np.array([r[c] for r in runs], np.int64) for c in ("start", "length", "period"))
                yield from out.add(i, len(starts), runs, collapsed(text.encode(), starts, ends, (s, s + n, p)))
        yield from out.rest()

    return rows.select("doc_id", "text", "runs").mapInArrow(run, f"doc_id long, {OUT}")


def find_runs(docs: DataFrame, long: int = LONG_BYTES, tile: int = TILE) -> DataFrame:
    """(doc_id, n_words, runs by start and period, collapsed) of every row of (doc_id, text)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    one = docs.where(F.octet_length("text") <= long).mapInArrow(frugal(finder("doc_id")), f"doc_id long, {OUT}")
    keyed = docs.where(F.octet_length("text") > long).withColumn("key", F.unhex(F.sha2("text", 256)))
    # Copies of a text give the same tiles; one of each goes on.
    spread = _tile_rows(keyed, tile).groupBy("key", "low", "high", "start").agg(F.first("ids").alias("ids"))
    by_place = F.array_sort(F.collect_list(F.struct("start", "period", "length")))
    runs = stitched(fragments(spread)).groupBy("key").agg(by_place.alias("runs"))
    runs = runs.select("key", F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs"))
    whole = keyed.join(runs, "key", "left").withColumn("runs", F.coalesce("runs", F.array().cast("array<struct<start:bigint,length:bigint,period:bigint>>")))
    return one.unionByName(_collapsed_long(whole))


def planted(batches: Batches) -> Batches:
    """Documents that repeat a stretch of their words to the end; where it starts and how long it is comes from the id's hash."""
    for b in batches:
        ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
        for k, (i, t) in enumerate(zip(ids, texts)):
            if not t:
                continue
            raw = t.encode()
            buf = np.frombuffer(raw, np.uint8)
            starts, ends, _ = words(buf, np.array([0, len(buf)]))
            n = len(starts)
            if n:
                g = zlib.crc32(str(i).encode()) // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                at = np.arange(n)
                at[a:] = a + (at[a:] - a) % p
                texts[k] = b" ".join([raw[x:y] for x, y in zip(starts[at].tolist(), ends[at].tolist())]).decode()
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def op13(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chosen = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0, F.lit(False))
    docs = docs.where(~chosen).unionByName(docs.where(chosen).mapInArrow(frugal(planted), "doc_id long, text string"))
    found = find_runs(docs)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    found = found.withColumn("best", best)
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    length = -F.col("best.less")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
