"""Operator 7: exact substring removal by hash-compared suffix sorting.

A byte goes if it is covered by a string of LENGTH bytes that also starts earlier, in a smaller document or before in the
same one. Suffixes are compared by prefix polynomial hashes: a binary search finds how far two of them agree, so that a
comparison takes a logarithmic number of steps whatever the texts; a merge sort of such comparisons brings equal ones
together, sorted neighbours whose common extension has LENGTH bytes are one class, and each class that removes anything is
verified byte by byte (a collision splits it).

One suffix array over 100 TB has no place, so suffixes are dealt out such that equal ones meet. The anchor of a string of
LENGTH bytes is the 32-byte gram of least hash in it; equal strings have equal anchors. Runs of strings with a common
anchor travel together, as one piece of at most 168 bytes, to the bin of their anchor:

1. The anchors' hash slots, each once a task with whether the task saw it again, are shuffled and two bits kept for each of
   2**28 slots: seen once, seen again. This bitmap of 32 MB whatever the input is broadcast. A slot that was seen once holds no
   repeat; the filter loses nothing.
2. Pieces whose anchor was seen again are shuffled by bin, compressed. A piece that a task has sent before, from an
   earlier place, goes without its bytes; so a passage that a third of all rows share travels about once for each task.
3. In each bin suffixes with the same anchor at the same distance are sorted and classed; each piece yields one interval.
   Suffixes that follow each other in document order and agree are one run already; the runs' first suffixes are sorted.
4. Intervals meet their documents again by id and are merged.

Defined cases: a null text is the empty one; texts under LENGTH bytes lose nothing; rows of the same id are ordered by a
hash of their text, and rows alike in both are one document, each gets its result; a null id comes before all others; an
empty table gives an empty result; other columns are not read; a very long text is worked on in overlapping segments. Two
different texts of one id with the same 64-bit hash would be taken for one.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table
from .textarrays import CHUNK_BYTES, frugal, mix64, powers, prefix_hash, span_hash, text_chunks

LENGTH, GRAM = 100, 32
SLOT_BITS, BUCKET_BITS = 28, 10
#: Bytes of pieces that a bin should hold, and strings that are sorted at once.
BIN_BYTES, SORTED_AT_ONCE = 4 << 20, 1 << 20
#: Pieces that a task remembers having sent.
REMEMBERED = 1 << 17
NULL_ID = -(1 << 63)


def _segments(column) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets, place of the first byte in its text). Very long texts come in overlapping segments."""
    for lo, hi, buf, off in text_chunks(column):
        if len(buf) <= 2 * CHUNK_BYTES:
            yield lo, buf, off, 0
            continue
        for at in range(0, len(buf) - LENGTH + 1, CHUNK_BYTES):
            part = buf[at : at + CHUNK_BYTES + LENGTH - 1]
            yield lo, part, np.array([0, len(part)]), at


class Pieces:
    """Runs of windows with a common anchor in one stretch of bytes."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        n = len(buf)
        self.prefix = prefix_hash(buf)
        empty = np.zeros(0, np.int64)
        self.start = self.windows = self.anchor = self.doc = empty
        self.hash = np.zeros(0, np.uint64)
        if n < LENGTH:
            return
        at = np.arange(n - GRAM + 1)
        h = mix64(span_hash(self.prefix, at, at + GRAM))
        key = (h & ~np.uint64((1 << 24) - 1)) | at.astype(np.uint64)
        width, low = LENGTH - GRAM + 1, key
        step = 1
        while 2 * step <= width:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        low = np.minimum(low[: n - LENGTH + 1], low[width - step : width - step + n - LENGTH + 1])
        anchor = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
        # Windows inside one text.
        size = np.diff(off)
        doc = np.repeat(np.arange(len(size)), size)[: n - LENGTH + 1]
        inside = np.arange(n - LENGTH + 1) + LENGTH <= off[1:][doc]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1] | (doc[1:] != doc[:-1])
        self.start = np.flatnonzero(new & inside)
        run = np.cumsum(new & inside) - 1
        self.windows = np.bincount(run[inside], minlength=len(self.start)) if len(self.start) else empty
        self.anchor, self.doc = anchor[self.start], doc[self.start]
        self.hash = mix64(h[self.anchor] ^ np.uint64(0x5851F42D4C957F2D))


def repeat_slots(docs: DataFrame) -> tuple[np.ndarray, int]:
    """The bitmap of slots that were seen more than once, and the number of pieces."""
    rest = SLOT_BITS - BUCKET_BITS

    @frugal
    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, more, total, fresh = np.zeros(0, np.uint32), np.zeros(0, bool), 0, []

        def add_up() -> tuple[np.ndarray, np.ndarray]:
            s = np.concatenate([seen, *fresh])
            order = np.argsort(s, kind="stable")
            s, again = s[order], np.concatenate([more, np.zeros(len(s) - len(more), bool)])[order]
            new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
            again = (np.add.reduceat(again, new, dtype=np.int64) > 0) | (np.diff(np.append(new, len(s))) > 1) if len(s) else again
            return s[new], again

        for b in batches:
            for _, buf, off, _ in _segments(b.column(0)):
                fresh.append((Pieces(buf, off).hash >> np.uint64(64 - SLOT_BITS)).astype(np.uint32))
                total += len(fresh[-1])
            if sum(map(len, fresh)) > 1 << 20:
                (seen, more), fresh = add_up(), []
        seen, more = add_up()
        bucket = (seen >> np.uint32(rest)).astype(np.int64)
        some, cut = np.unique(bucket, return_index=True)
        cut = np.append(cut, len(seen))
        low = seen & np.uint32((1 << rest) - 1) | more.astype(np.uint32) << np.uint32(31)
        blobs = [low[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary()), pa.array([total * (k == 0) for k in range(len(some))], pa.int64())], ["bucket", "slots", "n"])

    @frugal
    def seen_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again, total = {}, {}, {}
        for b in batches:
            for bucket, blob, n in zip(*(c.to_pylist() for c in b.columns)):
                s = np.frombuffer(blob, np.uint32)
                more, s = s >> np.uint32(31) > 0, s & np.uint32((1 << rest) - 1)
                if bucket not in once:
                    once[bucket], again[bucket], total[bucket] = np.zeros(1 << rest, bool), np.zeros(1 << rest, bool), 0
                again[bucket][s[more | once[bucket][s]]] = True
                once[bucket][s] = True
                total[bucket] += n
        keys = sorted(once)
        bits = [np.packbits(again[k], bitorder="little").tobytes() for k in keys]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(bits, pa.binary()), pa.array([total[k] for k in keys], pa.int64())], ["bucket", "bits", "n"])

    rows = docs.select("text").mapInArrow(slots, "bucket int, slots binary, n long").repartition("bucket")
    rows = rows.mapInArrow(seen_again, "bucket int, bits binary, n long").collect()  # 2**BUCKET_BITS rows, 32 MB in all
    bitmap = np.zeros((1 << BUCKET_BITS, 1 << rest >> 3), np.uint8)
    for r in rows:
        bitmap[r["bucket"]] = np.frombuffer(r["bits"], np.uint8)
    return bitmap.ravel(), sum(r["n"] for r in rows)


FIELDS = (("doc", np.int64), ("text_hash", np.int64), ("start", np.int64), ("lead", np.uint8), ("windows", np.uint8))


def _pack(cols: dict, text: bytes) -> bytes:
    raw = b"".join(np.ascontiguousarray(cols[k], t).tobytes() for k, t in FIELDS)
    return struct.pack("<I", len(cols["doc"])) + zstandard.ZstdCompressor(level=1).compress(raw + text)


def _unpack(blob: bytes) -> tuple[dict, bytes]:
    n = struct.unpack_from("<I", blob)[0]
    raw, out, at = zstandard.ZstdDecompressor().decompress(blob[4:]), {}, 0
    for k, t in FIELDS:
        out[k] = np.frombuffer(raw, t, n, at)
        at += n * np.dtype(t).itemsize
    return out, raw[at:]


#: A piece whose lead has this value came without its bytes: all of it is repeated.
COVERED = 255


def pieces_by_bin(docs: DataFrame, bitmap: np.ndarray, bins: int) -> DataFrame:
    """(bin, pieces binary) of all pieces whose anchor was seen again."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sent = shared.value, {}
        for b in batches:
            ids, hashes = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            cols, texts, names = {k: [] for k, _ in FIELDS}, [], []
            bin_of = []
            for lo, buf, off, base in _segments(b.column(2)):
                p = Pieces(buf, off)
                slot = (p.hash >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
                use = np.flatnonzero(bits[slot >> 3] >> (slot & 7) & 1)
                start, doc = p.start[use], p.doc[use]
                cols["doc"].append(ids[lo + doc])
                cols["text_hash"].append(hashes[lo + doc])
                cols["start"].append(start - off[doc] + base)
                cols["lead"].append(p.anchor[use] - start)
                cols["windows"].append(p.windows[use])
                bin_of.append((p.hash[use] & np.uint64(bins - 1)).astype(np.int64))
                end = start + p.windows[use] + LENGTH - 1
                names.append(span_hash(p.prefix, start, end) + (end - start).astype(np.uint64))
                raw = buf.tobytes()
                texts += [raw[i:j] for i, j in zip(start.tolist(), end.tolist())]
            c = {k: np.concatenate([np.zeros(0, t), *v]).astype(t) for (k, t), v in zip(FIELDS, cols.values())}
            names, bin_of = np.concatenate([np.zeros(0, np.uint64), *names]), np.concatenate([np.zeros(0, np.int64), *bin_of])
            # A piece that the task has already sent, from an earlier place, goes without its bytes.
            order = np.lexsort((c["start"], c["text_hash"], c["doc"]))
            covered = []
            for x, name, *place in zip(order.tolist(), names[order].tolist(), *(c[k][order].tolist() for k in ("doc", "text_hash", "start"))):
                was = sent.get(name)
                if was is not None and was[0] < place and was[1] == texts[x]:
                    covered.append(x)
                    texts[x] = b""
                else:
                    sent[name] = place, texts[x]
            c["lead"][covered] = COVERED
            if len(sent) > REMEMBERED:
                sent.clear()
            order = np.argsort(bin_of, kind="stable")
            some, cut = np.unique(bin_of[order], return_index=True)
            blobs = []
            for o in np.split(order, cut[1:]) if len(order) else []:
                blobs.append(_pack({f: v[o] for f, v in c.items()}, b"".join(texts[x] for x in o)))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], ["bin", "pieces"])

    return docs.select("id", "text_hash", "text").mapInArrow(run, "bin int, pieces binary")


class Suffixes:
    """Suffixes of a buffer, compared over LENGTH bytes by prefix hashes."""

    STEPS = [1 << k for k in range(LENGTH.bit_length() - 1, -1, -1)]

    def __init__(self, buf: np.ndarray):
        self.buf = np.concatenate([buf, np.zeros(LENGTH + 8, np.uint8)])
        self.prefix = prefix_hash(self.buf)
        self.inverse = powers(len(self.prefix), True)

    def hash(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return span_hash(self.prefix, x, y, self.inverse)

    def same(self, x: np.ndarray, y: np.ndarray, n: int = LENGTH) -> np.ndarray:
        return self.hash(x, x + n) == self.hash(y, y + n)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many of the first LENGTH bytes agree: all, or by binary search."""
        n = np.where(self.same(x, y), LENGTH, 0)
        open_ = np.flatnonzero(n == 0)
        x, y, k = x[open_], y[open_], np.zeros(len(open_), np.int64)
        for s in self.STEPS:
            fits = np.flatnonzero(k + s < LENGTH)
            a, b = x[fits] + k[fits], y[fits] + k[fits]
            k[fits] += s * (self.hash(a, a + s) == self.hash(b, b + s))
        n[open_] = k
        return n

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the suffix at x comes before that at y."""
        n = self.common(x, y)
        return (n < LENGTH) & (self.buf[x + np.minimum(n, LENGTH - 1)] < self.buf[y + np.minimum(n, LENGTH - 1)])

    def verified(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the LENGTH bytes at x and y are the same bytes."""
        eight = np.ndarray((len(self.buf) - 7,), "<u8", self.buf, strides=(1,))  # the eight bytes from each place on
        ok = np.ones(len(x), bool)
        for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
            ok &= eight[x + k] == eight[y + k]
        return ok

    def merge_sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Stable order of the suffixes within runs of equal group; all runs are merged side by side, level by level."""
        n = len(at)
        if not n:
            return np.zeros(0, np.int64)
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(begin, n))
        base, size = np.repeat(begin, size), np.repeat(size, size)
        order, run = np.arange(n), 1
        while True:
            i = np.flatnonzero(size > run)
            if not len(i):
                return order
            here, k, most = base[i], i - base[i], size[i]
            left = (k // run) % 2 == 0
            lo = np.minimum(np.where(left, k - k % run + run, k - k % run - run), most)
            # Rank in the sibling run: of a left element, the siblings before it; of a right one, those not after it.
            a, b = lo.copy(), np.maximum(np.minimum(lo + run, most), lo)
            while True:
                open_ = np.flatnonzero(a < b)
                if not len(open_):
                    break
                mid = (a[open_] + b[open_]) // 2
                me, other = at[order[i[open_]]], at[order[here[open_] + mid]]
                l = left[open_]
                before = np.empty(len(open_), bool)
                before[l] = self.less(other[l], me[l])
                before[~l] = ~self.less(me[~l], other[~l])
                a[open_] = np.where(before, mid + 1, a[open_])
                b[open_] = np.where(before, b[open_], mid)
            rank = a - lo
            to = i + np.where(left, rank, rank - run)
            order[to] = order[i].copy()
            run *= 2

    def classes(self, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order that brings equal suffixes of a run of equal group together, stable, and whether each is like the one before."""
        tie = np.concatenate([[False], group[1:] == group[:-1]])
        same = tie.copy()
        same[1:] &= self.same(at[1:], at[:-1])
        first = np.flatnonzero(~same)
        many = np.diff(np.append(first, len(at)))
        sorted_ = self.merge_sort(at[first], group[first])
        x, g, n = at[first[sorted_]], group[first[sorted_]], many[sorted_]
        order = np.repeat(first[sorted_] - (np.cumsum(n) - n), n) + np.arange(len(at))
        # Inside a run of like suffixes each is like the one before; where two runs meet the common extension tells.
        met = np.zeros(len(x), bool)
        met[1:] = (g[1:] == g[:-1]) & (self.common(x[1:], x[:-1]) == LENGTH)
        same = np.ones(len(at), bool)
        same[np.cumsum(n) - n] = met
        return self.without_collisions(at, order, same)

    def without_collisions(self, at: np.ndarray, order: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes whose bytes are not all the same are split by their bytes."""
        pair = np.flatnonzero(same)
        wrong = pair[~self.verified(at[order[pair]], at[order[pair - 1]])]
        if len(wrong):
            begin = np.flatnonzero(~same)
            for k in np.unique(np.searchsorted(begin, wrong, "right") - 1).tolist():
                i, j = int(begin[k]), int(begin[k + 1]) if k + 1 < len(begin) else len(at)
                by: dict[bytes, list[int]] = {}
                for o in order[i:j].tolist():
                    by.setdefault(self.buf[at[o] : at[o] + LENGTH].tobytes(), []).append(o)
                order[i:j] = np.concatenate([np.array(v) for v in by.values()])
                same[i:j] = np.concatenate([np.arange(len(v)) > 0 for v in by.values()])
        return order, same


def repeated_pieces(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, text_hash, start, end) of what is repeated in each piece of a bin."""
    parts = [_unpack(x) for x in blobs]
    c = {k: np.concatenate([p[0][k] for p in parts]) for k, _ in FIELDS}
    text = np.frombuffer(b"".join(p[1] for p in parts), np.uint8)
    covered = c["lead"] == COVERED
    out = [(c["doc"][covered], c["text_hash"][covered], c["start"][covered], c["start"][covered] + c["windows"][covered] + LENGTH - 1)]
    windows = c["windows"].astype(np.int64)
    length = np.where(covered, 0, windows + LENGTH - 1)
    at = np.cumsum(length) - length
    live = np.flatnonzero(~covered)
    live = live[np.lexsort((c["start"][live], c["text_hash"][live], c["doc"][live]))]
    s = Suffixes(text)
    place = at[live] + c["lead"][live]
    # Strings with the same anchor at the same distance are looked at together, others in turns: by anchor, and by distance where an anchor
    # has very many pieces.
    low, high = np.full(len(windows), 1 << 30), np.full(len(windows), -1)
    turns = 1 + int(windows[live].sum()) // SORTED_AT_ONCE
    turn = (mix64(s.hash(place, place + GRAM)) >> np.uint64(40)) % np.uint64(turns)
    for k in range(turns):
        some = live[turn == k]
        parts = 1 + int(windows[some].sum()) // (2 * SORTED_AT_ONCE)
        far = np.linspace(0, LENGTH - GRAM + 1, min(parts, LENGTH - GRAM + 1) + 1).astype(np.int64)
        for near, end in zip(far[:-1], far[1:]):
            lead = c["lead"][some].astype(np.int64)
            first, last = np.maximum(0, lead - end + 1), np.minimum(windows[some], lead - near + 1)
            use = np.flatnonzero(first < last)
            _repeated(c, some[use], at, first[use], last[use], s, low, high)
    hit = live[high[live] >= 0]
    # A piece is shorter than two strings, so what goes of it is one stretch.
    out.append((c["doc"][hit], c["text_hash"][hit], c["start"][hit] + low[hit], c["start"][hit] + high[hit] + LENGTH))
    return tuple(np.concatenate(x) for x in zip(*out))


def _repeated(c: dict, live: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, s: Suffixes, low: np.ndarray, high: np.ndarray) -> None:
    """Of the windows first to last of the pieces ``live``, given in document order: low and high take in those that are repeated."""
    if not len(live):
        return
    w, lead, place = last - first, c["lead"][live].astype(np.int64), at[live]
    anchor = mix64(s.hash(place + lead, place + lead + GRAM))
    piece = np.repeat(np.arange(len(live)), w)
    j = np.arange(len(piece)) - np.repeat(np.cumsum(w) - w - first, w)
    suffix = place[piece] + j
    # Equal strings have the same anchor at the same distance.
    key = mix64(anchor[piece] + (lead[piece] - j).astype(np.uint64))
    order = np.argsort(key, kind="stable")
    order = order[_ties(key[order])]
    # Among the surroundings of a common anchor most strings are alone by their hash: they are like no other and are not sorted.
    whole = key[order] ^ s.hash(suffix[order], suffix[order] + LENGTH)
    by_hash = np.argsort(whole, kind="stable")
    order = order[np.sort(by_hash[_ties(whole[by_hash])])]
    if not len(order):
        return
    key = key[order]
    group = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]]))
    into, same = s.classes(suffix[order], group)
    order = order[into]
    pair = np.flatnonzero(same)
    # The first of a class, in document order, stays; so do rows that are that very document again.
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    x, y = order[pair], order[head[pair]]
    own = np.ones(len(pair), bool)
    for k in ("doc", "text_hash"):
        own &= c[k][live[piece[x]]] == c[k][live[piece[y]]]
    own &= c["start"][live[piece[x]]] + j[x] == c["start"][live[piece[y]]] + j[y]
    gone = x[~own]
    np.minimum.at(low, live[piece[gone]], j[gone])
    np.maximum.at(high, live[piece[gone]], j[gone])


def _ties(values: np.ndarray) -> np.ndarray:
    """Places of sorted values that are there more than once."""
    tie = np.concatenate([[False], values[1:] == values[:-1]])[: len(values)]
    return np.flatnonzero(tie | np.append(tie[1:], False)[: len(values)])


def repeated_intervals(pieces: DataFrame) -> DataFrame:
    """(id, text_hash, span): spans as start * 2**32 + end."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []

        def done():
            doc, text_hash, start, end = repeated_pieces(blobs)
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(text_hash), pa.array(start.astype(np.int64) << 32 | end.astype(np.int64))], ["id", "text_hash", "span"])

        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                if k != now:
                    if blobs:
                        yield done()
                    now, blobs = k, []
                blobs.append(x.as_py())
        if blobs:
            yield done()

    return pieces.repartition("bin").sortWithinPartitions("bin").mapInArrow(run, "id long, text_hash long, span long")


def cut_texts(docs: DataFrame, spans: DataFrame, with_text: bool = False) -> DataFrame:
    """Every row with n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes)."""
    per_doc = spans.groupBy("id", "text_hash").agg(F.collect_list("span").alias("spans"))  # of one document each
    rows = docs.join(per_doc, ["id", "text_hash"], "left").select("doc_id", "text", "spans")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, found = b.column(1).to_pylist(), b.column(2).to_pylist()
            out = []
            for t, sp in zip(texts, found):
                raw = (t or "").encode()
                removed = n_spans = 0
                if sp:
                    v = np.sort(np.array(sp, np.int64))
                    s, e = v >> 32, np.maximum.accumulate(v & 0xFFFFFFFF)
                    new = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
                    s, e = s[new], e[np.append(new[1:], len(e)) - 1]
                    removed, n_spans = int((e - s).sum()), len(s)
                    view = memoryview(raw)
                    kept = b"".join(view[i:j] for i, j in zip([0, *e.tolist()], [*s.tolist(), len(raw)]))
                else:
                    kept = raw
                out.append((len(raw), removed, n_spans, hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
            cols = list(zip(*out)) if out else [[]] * (4 + with_text)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *[pa.array(list(x), k) for x, k in zip(cols, kinds)]], names)

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID).cast("long")).alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    bitmap, n = repeat_slots(keyed)
    bins = 1 << max(4, (n * (LENGTH + LENGTH // 3) // BIN_BYTES // 3).bit_length())
    spans = saved(repeated_intervals(pieces_by_bin(keyed, bitmap, bins)), "spans")
    return cut_texts(keyed, spans, with_text)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
