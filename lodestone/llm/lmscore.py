"""Operator 9: language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Counting: the n-grams (n up to ORDER) of all training texts are hashed, sorted and summed in each task, shuffled as packed
runs to the bin of their leading hash bits, and summed there. A count is quantised to a level; the filter holds an n-gram
together with every level up to its own, from a count of one on, so that a count is read back by asking for one level after
another until one is missing. All levels of an n-gram lie in one line of LINE bits. Each bin has its own stretch of the filter,
so no two tasks write the same bits.

The filter grows with the n-grams. Up to BLOCK_BYTES it is broadcast whole. Beyond that the bins stay apart and the questions
travel: each chunk of texts sends its distinct n-grams to their bins, a bin fills its stretch, answers with levels by the same
probes, and the levels meet the chunk's text again. That is two more shuffles in proportion to the texts, whatever the filter's
size, and the same levels. So a text's score does not depend on the size of the corpus but through the counts.

Scoring: P(w | u v) = a c(uvw)/c(uv) + (1-a) (b c(vw)/c(v) + (1-b) P1(w)), where a term whose history is not in the filter
is left out, P1(w) = (c(w)+0.5) / (N+0.5(V+1)), and a count is never taken to be above its history's.

The base score needs exact counts of words: they are summed in another shuffle of packed postings by word hash, whose bins
answer each chunk of documents with its words' part of the sums; nothing is broadcast there. Words are told apart by 64-bit
hashes, and so are texts of one id.

Defined cases: a null or empty text is its end token; a null doc_id has the crc32 of the empty string; rows alike in id and
text get equal results and count in training each; without training rows N and V are 0 and every token is unknown; an
empty table gives an empty result; other columns are not read; a very long text is a chunk of its own.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, saved, table
from .textarrays import LOWER, frugal, mix64, text_chunks, word_hashes, words

ORDER = 3
TRIGRAM, BIGRAM = 0.5, 0.25
BLOCK_BYTES, BITS_PER_ENTRY, PROBES, LINE = 192 << 20, 8, 5, 512
#: N-grams that are looked up at once: what the steps in between hold stays in a core's cache.
STEP = 1 << 14
#: Bytes that a task of a shuffle should read.
TASK_BYTES = 8 << 20
#: Bytes of text that are counted at once, bytes of text for each bin of words, n-grams for each bin of the filter.
CHUNK, WORD_BIN_BYTES, NGRAM_BIN = 4 << 20, 32 << 20, 1 << 20
SCORES = "doc_id long, text_hash long, held boolean, score double"
END = np.uint64(0xD6E8FEB86659FD93)


def _levels() -> np.ndarray:
    """Least count of each level: 1, 2, 3, ... then steps of two fifths."""
    t = [1]
    while t[-1] < 1 << 45:
        t.append(max(t[-1] + 1, t[-1] * 7 // 5))
    return np.array(t, np.int64)


LEVELS = _levels()
#: What a count of each level is taken to be; level 0 is none.
VALUES = np.concatenate([[0.0], (LEVELS[:-1] + LEVELS[1:] - 1) / 2, [LEVELS[-1]]])

_KIND = [np.uint64(0x9E6C63D0876A9A47), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end included, and where each text's start."""
    starts, ends, first = words(buf, off)
    h = word_hashes(LOWER[buf], starts, ends)
    return np.insert(h, first[1:], END), first + np.arange(len(first))


def ngrams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n-gram that ends at each token, and whether its text has one there."""
    out = mix64(h ^ _KIND[n - 1])
    for k in range(1, n):
        out[k:] = mix64(out[k:] * np.uint64(0x9E3779B97F4A7C15) + h[:-k])
    rank = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
    return out, rank >= n - 1


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5)) == 1


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, by byte planes, compressed."""
    raw = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays)
    return struct.pack("<I", len(arrays[0])) + zstandard.ZstdCompressor(level=1).compress(raw)


def _unsqueeze(blob: bytes, *types) -> list[np.ndarray]:
    n = struct.unpack_from("<I", blob)[0]
    raw, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4:]), np.uint8), 0, []
    for t in types:
        size = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).reshape(-1).view(t))
        at += n * size
    return out


def _by_key(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows alike in their first columns."""
    now, rows = None, []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if r[:keys] != now:
                if rows:
                    yield now, rows
                now, rows = r[:keys], []
            rows.append(r)
    if rows:
        yield now, rows


def _out(names: list[str], kinds: list, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names)


def word_sums(docs: DataFrame, bins: int, parts: int) -> tuple[DataFrame, int, int]:
    """docs: doc_id, text_hash, held, text. (doc_id, text_hash, n_tokens, n_known, log_sum), the words' N and V.

    log_sum is of log10(c + 0.5) over words; the end token is left to the caller. Of each word a chunk of texts sends one
    row's worth to the bin of its hash, however often it occurs; what comes back meets the chunk's postings.
    """

    @frugal
    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            held = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, buf, off in text_chunks(b.column(3), CHUNK):
                chunk = task << 32 | seq
                seq += 1
                starts, ends, first = words(buf, off)
                h = word_hashes(LOWER[buf], starts, ends)
                n = np.diff(first)
                doc = np.repeat(np.arange(hi - lo, dtype=np.uint32), n)
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
                tf = np.diff(np.append(new, len(h))).astype(np.uint32)
                h, doc = h[new], doc[new]
                fresh = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                size = np.diff(np.append(fresh, len(h))).astype(np.uint32)
                h = h[fresh]
                trained = np.add.reduceat(tf * ~held[lo:hi][doc], fresh).astype(np.uint32) if len(h) else tf
                some, cut = np.unique(h >> np.uint64(64 - bins.bit_length() + 1), return_index=True)
                rows = [(int(k), chunk, _squeeze(h[i:j], trained[i:j]), None, None) for k, i, j in zip(some, cut, [*cut[1:], len(h)])]
                ids = b.column(0).slice(lo, hi - lo)
                about = _squeeze(np.asarray(ids.fill_null(0), np.int64), np.asarray(b.column(1).slice(lo, hi - lo), np.int64), np.array(ids.is_valid()).astype(np.uint8), n.astype(np.int64))
                rows.append((-1, chunk, about, _squeeze(size), _squeeze(doc, tf)))
                yield _out(["bin", "chunk", "a", "b", "c"], [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()], rows)

    @frugal
    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key,), rows in _by_key(batches, 1):
            heads = [_unsqueeze(r[2], np.uint64, np.uint32) for r in rows]
            distinct, at = np.unique(np.concatenate([h for h, _ in heads]), return_inverse=True)
            c = np.bincount(at, np.concatenate([t for _, t in heads]), minlength=len(distinct)).astype(np.int64)
            out, i = [(key, -1, None, int(c.sum()), int((c > 0).sum()))], 0
            for r, (h, _) in zip(rows, heads):
                out.append((key, r[1], _squeeze(c[at[i : i + len(h)]]), None, None))
                i += len(h)
            yield _out(["bin", "chunk", "a", "n", "v"], [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()], out)

    @frugal
    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_key(batches, 1):
            # The chunk's own row is first, then the counts of its words, in order of their hashes.
            _, _, about, size, posts = rows[0]
            ids, hashes, valid, n = _unsqueeze(about, np.int64, np.int64, np.uint8, np.int64)
            (size,), (doc, tf) = _unsqueeze(size, np.uint32), _unsqueeze(posts, np.uint32, np.uint32)
            c = np.repeat(np.concatenate([np.zeros(0, np.int64), *[_unsqueeze(r[2], np.int64)[0] for r in rows[1:]]]), size)
            log_sum = np.bincount(doc, tf * np.log10(c + 0.5), minlength=len(ids))
            known = np.bincount(doc, tf * (c > 0), minlength=len(ids)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=valid == 0), pa.array(hashes), pa.array(n + 1), pa.array(known), pa.array(log_sum)], ["doc_id", "text_hash", "n_tokens", "n_known", "log_sum"])

    rows = docs.select("doc_id", "text_hash", "held", "text").mapInArrow(postings, "bin long, chunk long, a binary, b binary, c binary")
    rows = saved(rows, "postings")
    sent = rows.where("bin >= 0").select("bin", "chunk", "a").repartition(parts, "bin").sortWithinPartitions("bin", "chunk")
    back = saved(sent.mapInArrow(answers, "bin long, chunk long, a binary, n long, v long"), "counts")
    total = back.where("chunk = -1").agg(F.sum("n"), F.sum("v")).first()
    both = rows.where("bin = -1").unionByName(back.where("chunk >= 0").select("chunk", "bin", "a"), allowMissingColumns=True)
    both = both.select("chunk", "bin", "a", "b", "c").repartition(parts, "chunk").sortWithinPartitions("chunk", "bin")
    sums = both.mapInArrow(together, "doc_id long, text_hash long, n_tokens long, n_known long, log_sum double")
    sums = saved(sums, "word-sums")
    discard(rows, back)
    return sums, total[0] or 0, total[1] or 0


class LogFrequencyFilter:
    """Quantised counts of hashed n-grams, of the bins first_bin, first_bin + 1, ...; bins hold separate stretches of bits."""

    def __init__(self, bits: np.ndarray, bin_bits: int, stretch: int, first_bin: int = 0):
        self.bits, self.bin_bits, self.stretch, self.first_bin = bits, bin_bits, stretch, first_bin

    @staticmethod
    def line(ids: np.ndarray, stretch: int) -> np.ndarray:
        """First bit of the line, inside its bin's stretch, of an n-gram. ids: the 32 hash bits after those of the bin."""
        return (mix64(ids.astype(np.uint64)) & np.uint64(0xFFFFFFFF)) * np.uint64(stretch // LINE) >> np.uint64(32) << np.uint64(9)

    @staticmethod
    def hashes(ids: np.ndarray, level: int) -> np.ndarray:
        return mix64(ids.astype(np.uint64) + np.uint64(level * 0xA0761D6478BD642F % (1 << 64)))

    @staticmethod
    def probes(ids: np.ndarray, level: int) -> list[np.ndarray]:
        """Bits of a level inside the line."""
        a = LogFrequencyFilter.hashes(ids, level)
        return [a >> np.uint64(9 * k) & np.uint64(LINE - 1) for k in range(PROBES)]

    def level(self, h: np.ndarray) -> np.ndarray:
        """Level of each n-gram's count by repeated membership probes; 0: it isn't there."""
        out = np.zeros(len(h), np.uint8)
        for at in range(0, len(h), STEP):
            self._level(h[at : at + STEP], out[at : at + STEP])
        return out

    def _level(self, h: np.ndarray, out: np.ndarray) -> None:
        ids = (h >> np.uint64(32 - self.bin_bits)) & np.uint64(0xFFFFFFFF)
        line = ((h >> np.uint64(64 - self.bin_bits)) - np.uint64(self.first_bin)) * np.uint64(self.stretch) + self.line(ids, self.stretch)
        line >>= np.uint64(3)  # a line begins with a byte
        live, level = np.arange(len(h)), 1
        three, nine, seven, bytes_ = np.uint64(3), np.uint64(9), np.uint8(7), np.uint64(LINE // 8 - 1)
        while len(live) and level <= len(LEVELS):
            # As ``probes`` has them, nine bits of the hash at a time: six for the byte, three for the bit.
            a, found = self.hashes(ids, level), np.uint8(1)
            for _ in range(PROBES):
                at = a >> three
                at &= bytes_
                at += line
                some = self.bits.take(at.view(np.int64), mode="wrap")  # in range: this only spares the check
                some >>= a.astype(np.uint8) & seven
                found = np.bitwise_and(found, some)
                a >>= nine
            still = np.flatnonzero(found)
            live, ids, line = live[still], ids[still], line[still]
            out[live] = level
            level += 1


def ngram_levels(train: DataFrame, bin_bits: int, parts: int) -> DataFrame:
    """(bin, n, ids, entries): n-grams of each bin with their levels, packed, and how many entries of the filter they take."""

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, buf, off in text_chunks(b.column(0), CHUNK):
                h, first = tokens(buf, off)
                rows = []
                for n in range(1, ORDER + 1):
                    g, ok = ngrams(h, first, n)
                    x = np.sort(g[ok] >> np.uint64(32 - bin_bits))
                    if not len(x):
                        continue
                    new = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
                    c = np.diff(np.append(new, len(x))).astype(np.uint32)
                    x = x[new]
                    some, cut = np.unique(x >> np.uint64(32), return_index=True)
                    for k, i, j in zip(some, cut, [*cut[1:], len(x)]):
                        ids = (x[i:j] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                        rows.append((int(k), n, _squeeze(np.diff(ids, prepend=np.uint32(0)), c[i:j])))
                yield _out(["bin", "n", "ids"], [pa.int32(), pa.int32(), pa.binary()], rows)

    @frugal
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (k, n), rows in _by_key(batches, 2):
            parts = [_unsqueeze(r[2], np.uint32, np.uint32) for r in rows]
            ids = np.concatenate([np.cumsum(d, dtype=np.uint32) for d, _ in parts])
            c = np.concatenate([x for _, x in parts]).astype(np.int64)
            order = np.argsort(ids, kind="stable")
            ids, c = ids[order], c[order]
            new = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            ids, c = ids[new], np.add.reduceat(c, new)
            level = np.searchsorted(LEVELS, c, "right").astype(np.uint8)
            # A level takes an entry for each level up to it.
            yield _out(["bin", "n", "ids", "entries"], [pa.int32(), pa.int32(), pa.binary(), pa.int64()], [(k, n, _squeeze(np.diff(ids, prepend=np.uint32(0)), level), int(level.sum(dtype=np.int64)))])

    rows = train.select("text").mapInArrow(count, "bin int, n int, ids binary")
    rows = rows.repartition(parts, "bin").sortWithinPartitions("bin", "n")
    return saved(rows.mapInArrow(add_up, "bin int, n int, ids binary, entries long"), "ngrams")


def stretch_bits(levels: DataFrame, bin_bits: int) -> int:
    """Bits of each bin's stretch. Bins are dealt by hash: they are alike in size, and all get the same."""
    entries = levels.agg(F.sum("entries")).first()[0] or 0
    return max(1, -(-(entries * BITS_PER_ENTRY >> bin_bits) // LINE)) * LINE


def stretch_of(blobs: list[bytes], stretch: int) -> np.ndarray:
    """A bin's stretch of the filter, eight bits a byte, from its packed n-grams and levels."""
    bits = np.zeros(stretch, bool)
    for blob in blobs:
        d, level = _unsqueeze(blob, np.uint32, np.uint8)
        ids = np.cumsum(d, dtype=np.uint32)
        line = LogFrequencyFilter.line(ids, stretch)
        for x in range(1, int(level.max(initial=0)) + 1):
            some = np.flatnonzero(level >= x)
            for probe in LogFrequencyFilter.probes(ids[some], x):
                bits[line[some] + probe] = True
    return np.packbits(bits, bitorder="little")


def whole_filter(levels: DataFrame, bin_bits: int, stretch: int) -> LogFrequencyFilter:
    @frugal
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (k,), rows in _by_key(batches, 1):
            yield _out(["bin", "bits"], [pa.int32(), pa.binary()], [(k, stretch_of([r[2] for r in rows], stretch).tobytes())])

    rows = levels.select("bin", "n", "ids").repartition("bin").sortWithinPartitions("bin", "n").mapInArrow(fill, "bin int, bits binary")
    out = np.zeros((1 << bin_bits, stretch // 8), np.uint8)
    for r in rows.toLocalIterator():  # BLOCK_BYTES at most
        out[r["bin"]] = np.frombuffer(r["bits"], np.uint8)
    return LogFrequencyFilter(out.ravel(), bin_bits, stretch)


def tasks(spark: SparkSession, n_bytes: int) -> int:
    """Partitions for so many bytes: the session's number, or more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // TASK_BYTES)


def possible(shorter: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Where an n-gram can be: both of its shorter n-grams are there too."""
    return ok & (shorter > 0) & (np.concatenate([[0], shorter[:-1]]) > 0)


def probabilities(levels: list[np.ndarray], there: list[np.ndarray], denominator: float) -> np.ndarray:
    """P of each token, given the levels of the n-grams that end there and whether its text has them."""
    levels = list(levels)
    for k in range(1, ORDER):
        levels[k] = np.where(possible(levels[k - 1], there[k]), levels[k], 0)
    one, two, three = (VALUES[x] for x in levels)
    p = (one + 0.5) / denominator
    for share, count, past in ((BIGRAM, two, one), (TRIGRAM, three, two)):
        past = np.where(there[1 if past is one else 2], np.concatenate([[0.0], past[:-1]]), 0.0)
        seen = np.minimum(1.0, np.divide(count, past, out=np.zeros_like(p), where=past > 0))
        p = np.where(past > 0, share * seen + (1 - share) * p, p)
    return np.minimum(p, 1.0)


def broadcast_scores(docs: DataFrame, model: LogFrequencyFilter, denominator: float) -> DataFrame:
    """docs: doc_id, text_hash, held, text -> doc_id, text_hash, held, score; the filter goes to every worker."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, off in text_chunks(b.column(3)):
                h, first = tokens(buf, off)
                grams = [ngrams(h, first, k) for k in range(1, ORDER + 1)]
                levels: list[np.ndarray] = []
                for k, (g, ok) in enumerate(grams):
                    at = np.flatnonzero(possible(levels[k - 1], ok) if k else ok)
                    distinct, back = np.unique(g[at], return_inverse=True)
                    levels.append(np.zeros(len(h), np.uint8))
                    levels[k][at] = shared.value.level(distinct)[back]
                total = np.add.reduceat(np.log10(probabilities(levels, [ok for _, ok in grams], denominator)), first[:-1])
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(lo, hi - lo) for c in range(3)], pa.array(total)], ["doc_id", "text_hash", "held", "score"])

    return docs.select("doc_id", "text_hash", "held", "text").mapInArrow(run, SCORES)


def asked(h: np.ndarray, first: np.ndarray, bin_bits: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct n-grams of a chunk (bin and 32 more hash bits), where each order has one, and which of the distinct each is."""
    grams = [ngrams(h, first, k) for k in range(1, ORDER + 1)]
    distinct, back = np.unique(np.concatenate([g[ok] for g, ok in grams]) >> np.uint64(32 - bin_bits), return_inverse=True)
    return distinct, [ok for _, ok in grams], back


def routed_scores(docs: DataFrame, levels: DataFrame, bin_bits: int, stretch: int, parts: int, denominator: float) -> DataFrame:
    """As ``broadcast_scores``, with the n-grams sent to the bins of the filter instead."""

    @frugal
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            for lo, hi, buf, off in text_chunks(b.column(3), CHUNK):
                chunk = task << 32 | seq
                seq += 1
                x = asked(*tokens(buf, off), bin_bits)[0]
                some, cut = np.unique(x >> np.uint64(32), return_index=True)
                ids = (x & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                rows = [(int(k), chunk, _squeeze(np.diff(ids[i:j], prepend=np.uint32(0))), None) for k, i, j in zip(some, cut, [*cut[1:], len(x)])]
                keys, hashes, held = (b.column(c).slice(lo, hi - lo) for c in range(3))
                valid, held = np.array(keys.is_valid()).astype(np.uint8), np.asarray(held.to_numpy(zero_copy_only=False), np.uint8)
                about = _squeeze(np.asarray(keys.fill_null(0), np.int64), np.asarray(hashes, np.int64), valid, held, np.diff(off).astype(np.int64))
                rows.append((-1, chunk, about, _squeeze(buf[off[0] : off[-1]])))
                yield _out(["bin", "chunk", "a", "b"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()], rows)

    @frugal
    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key,), rows in _by_key(batches, 1):
            # The bin's own n-grams come first.
            f = LogFrequencyFilter(stretch_of([r[2] for r in rows if r[1] < 0], stretch), bin_bits, stretch, key)
            out = []
            for _, chunk, blob in rows:
                if chunk >= 0:
                    ids = np.cumsum(_unsqueeze(blob, np.uint32)[0], dtype=np.uint32).astype(np.uint64)
                    out.append((key, chunk, _squeeze(f.level((ids | np.uint64(key) << np.uint64(32)) << np.uint64(32 - bin_bits)))))
            yield _out(["bin", "chunk", "a"], [pa.int32(), pa.int64(), pa.binary()], out)

    @frugal
    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_key(batches, 1):
            # The chunk's own row is first, then the levels of its n-grams, in their order.
            ids, hashes, valid, held, n = _unsqueeze(rows[0][2], np.int64, np.int64, np.uint8, np.uint8, np.int64)
            h, first = tokens(_unsqueeze(rows[0][3], np.uint8)[0], np.concatenate([[0], np.cumsum(n)]))
            _, there, back = asked(h, first, bin_bits)
            found, at, by_order = np.concatenate([_unsqueeze(r[2], np.uint8)[0] for r in rows[1:]])[back], 0, []
            for ok in there:
                by_order.append(np.zeros(len(h), np.uint8))
                by_order[-1][ok] = found[at : at + ok.sum()]
                at += ok.sum()
            total = np.add.reduceat(np.log10(probabilities(by_order, there, denominator)), first[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=valid == 0), pa.array(hashes), pa.array(held.astype(bool)), pa.array(total)], ["doc_id", "text_hash", "held", "score"])

    rows = saved(docs.select("doc_id", "text_hash", "held", "text").mapInArrow(ask, "bin int, chunk long, a binary, b binary"), "questions")
    own = levels.select("bin", F.lit(-1).cast("long").alias("chunk"), F.col("ids").alias("a"))
    sent = own.unionByName(rows.where("bin >= 0").select("bin", "chunk", "a")).repartition(parts, "bin").sortWithinPartitions("bin", "chunk")
    back = sent.mapInArrow(answers, "bin int, chunk long, a binary")
    both = back.unionByName(rows.where("bin < 0"), allowMissingColumns=True).select("chunk", "bin", "a", "b")
    scored = saved(both.repartition(parts, "chunk").sortWithinPartitions("chunk", "bin").mapInArrow(together, SCORES), "scores")
    discard(rows)
    return scored


def model_scores(docs: DataFrame, n: int, v: int) -> DataFrame:
    """docs: doc_id, text_hash, held, text -> doc_id, text_hash, held, score."""
    bin_bits, parts, denominator = max(8, (n // NGRAM_BIN).bit_length()), tasks(docs.sparkSession, 12 * n), n + 0.5 * (v + 1)
    levels = ngram_levels(docs.where("not held"), bin_bits, parts)
    stretch = stretch_bits(levels, bin_bits)
    if stretch // 8 << bin_bits > BLOCK_BYTES:
        out = routed_scores(docs, levels, bin_bits, stretch, parts, denominator)
    else:
        out = broadcast_scores(docs, whole_filter(levels, bin_bits, stretch), denominator)
    discard(levels)
    return out


def scores(docs: DataFrame) -> DataFrame:
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), held_out(F.col("doc_id")).alias("held"), "text")
    about = keyed.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_if(~F.col("held")).alias("ends")).first()
    bins = 1 << max(4, ((about["bytes"] or 0) // WORD_BIN_BYTES).bit_length())
    sums, n, v = word_sums(keyed, bins, tasks(keyed.sparkSession, about["bytes"] or 0))
    ends = about["ends"]
    n, v = n + ends, v + (ends > 0)
    out = model_scores(keyed, n, v)
    # A row for each document on both sides.
    one = sums.dropDuplicates(["doc_id", "text_hash"]).withColumnRenamed("doc_id", "id")
    out = out.join(one, out["doc_id"].eqNullSafe(one["id"]) & (out["text_hash"] == one["text_hash"]))
    base = F.col("log_sum") + F.lit(float(np.log10(ends + 0.5))) - F.col("n_tokens") * F.lit(float(np.log10(n + 0.5 * (v + 1))))
    return out.select("doc_id", F.col("held").alias("held_out"), "n_tokens", (F.col("n_known") + int(ends > 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
