"""Operator 5: benchmark decontamination by SimHash over item-sized windows, a multi-index and exact verification.

Texts and items are lower-cased and cut into words of letters and digits; a shingle is five words (all of an item that has
fewer). For each size that an item has, every window of so many words of every document gets a 64-bit SimHash of its
shingles, repeats counting: sums of bits run along the text, so that a window costs the same whatever its size. The
multi-index keeps, for each of four blocks of 16 bits, the items whose block is within RADIUS // 4 bits of a value: of two
fingerprints within RADIUS some block is that close, so all of them are found. What is found is verified by the weighted
Jaccard similarity of the two multisets of shingles, at last word by word, and reported from MIN_SIMILARITY on. Nothing but
the fingerprints leads to a candidate.

At a similarity of 0.8 a bit differs with a chance of 0.15 at most, 9.7 of 64 with a deviation of 2.9; measured on near copies
between 0.8 and 0.85 one in a hundred differs in more than RADIUS + 1 bits, hardly any above. The windows beside the best one
are further chances. The work for each word is in proportion to the sizes, and by a small factor to the items.

Items are the stated query set: they are read in blocks of ITEM_BLOCK, each is sent to the executors as text and indexed there
once by each worker, and all documents are searched once for each block.

Defined cases: null or empty texts and items match nothing; items that occur twice are reported twice; of equally similar
windows the first is reported; a document shorter than an item is one window; repeated rows get rows each; an empty table
gives an empty result; other columns are not read by ``contaminated`` and carried through by ``stage`` untouched; a very long
text is worked on whole, in stretches of words.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches, table
from .textarrays import CHUNK_BYTES, frugal, gram_hashes, text_chunks, word_hashes, words

SHINGLE, MIN_SIMILARITY, RADIUS, BLOCKS, BLOCK_BITS = 5, 0.8, 15, 4, 16
ITEM_BLOCK = 2_000
#: Places whose windows of all sizes are worked on at once.
STRETCH = 1 << 15
#: Windows whose bits a worker keeps room for.
ROOM = STRETCH + 1
#: Bytes of text that a worker of the pipeline has at once, which shares its executor with what the stages before have left.
STAGE_BYTES = 1 << 18

#: Bytes between words: ASCII but letters and digits.
BLANK = np.ones(256, bool)
BLANK[48:58] = BLANK[65:91] = BLANK[97:123] = False
BLANK[128:] = False

def _lower(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))


def _lanes(width: int) -> int:
    """Bits of a lane whose sum of up to ``width`` ones and minus ones stays inside."""
    return next(n for n in (8, 16, 32, 64) if width < 1 << n - 1)


def bit_sums(h: np.ndarray, width: int) -> np.ndarray:
    """For each place how many more of the hashes before it have each bit than have not, for windows of up to ``width``.

    The 64 sums lie in the lanes of as many numbers as a lane has bits: lane j of number k is bit k + lane * j. Lanes borrow from each
    other, but the difference of two places is one number whose lanes, with a half of their range added, are all in range. So
    there are two rows: with that half, less one, and without.
    """
    lane = _lanes(width)
    ones = sum(1 << j for j in range(0, 64, lane))
    out = np.zeros((2, lane, len(h) + 1), np.uint64)
    bits = h >> np.arange(lane, dtype=np.uint64)[:, None] & np.uint64(ones)
    bits <<= np.uint64(1)
    bits -= np.uint64(ones)
    np.cumsum(bits, axis=1, out=out[1, :, 1:])
    np.add(out[1], np.uint64(ones * ((1 << lane - 1) - 1)), out=out[0])
    return out.T


_room: dict[int, np.ndarray] = {}


def fingerprints(sums: np.ndarray, width: int) -> np.ndarray:
    """SimHash of each run of ``width`` shingles: a bit is 1 if set in over half of them."""
    n, lane = len(sums) - width, sums.shape[1]
    # A worker asks for this room for each size and stretch, so it keeps it.
    if n <= ROOM:
        if lane not in _room:
            _room[lane] = np.empty(ROOM, np.uint64)
        many = _room[lane][:n]
    else:
        many = np.empty(n, np.uint64)
    half, plain = sums.T
    out, one = np.zeros(n, np.uint64), np.uint64(1)
    # The highest bit of a lane is that of the fingerprint; a number's bits move down by one for each number after it.
    highest = np.uint64(sum(1 << j for j in range(lane - 1, 64, lane)))
    for k in range(lane):
        np.right_shift(out, one, out=out)
        np.subtract(half[k, width:], plain[k, :-width], out=many)
        np.bitwise_and(many, highest, out=many)
        np.bitwise_or(out, many, out=out)
    return out


def near_values() -> np.ndarray:
    """All differences of a block of at most RADIUS // BLOCKS bits."""
    return np.array([sum(1 << i for i in c) for n in range(RADIUS // BLOCKS + 1) for c in combinations(range(BLOCK_BITS), n)], np.int64)


class MultiIndex:
    """Up to eight fingerprints by the values that their blocks can have within the radius: a bit for each item."""

    ITEMS = 8

    def __init__(self, fps: np.ndarray, items: np.ndarray):
        self.fps, self.items = fps, items
        self.near = np.zeros((BLOCKS, 1 << BLOCK_BITS), np.uint8)
        for b, own in enumerate(blocks_of(fps)):
            for k, x in enumerate(own):
                self.near[b, x ^ near_values()] |= np.uint8(1 << k)

    def find(self, fps: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all pairs within RADIUS."""
        # Blocks are in range: "wrap" only spares the check before.
        some, other = np.empty((2, len(fps)), np.uint8)
        self.near[0].take(blocks[0], out=some, mode="wrap")
        for near, block in zip(self.near[1:], blocks[1:]):
            near.take(block, out=other, mode="wrap")
            some |= other
        window = np.flatnonzero(some != 0)
        # A fifth of the windows of five items is left: all items are held against them.
        apart = np.bitwise_count(fps[window] ^ self.fps[:, None])
        k, at = np.divmod(np.flatnonzero(apart <= RADIUS), max(1, len(window)))
        return window[at], self.items[k]


def blocks_of(fps: np.ndarray) -> np.ndarray:
    """A row of each block's values."""
    return np.ascontiguousarray(fps.view(np.uint16).reshape(-1, BLOCKS).T, np.intp)


class ItemIndex:
    """Items by their sizes, each size with its multi-index. It travels as text and is built where it is used."""

    def __init__(self, items: list[tuple[int, str]]):
        self.rows, self.built = items, False

    def __getstate__(self):
        return {"rows": self.rows, "built": False}

    def build(self) -> None:
        self.ids, self.words, self.size, self.grams, own = [], [], [], [], []
        for lo, hi, buf, off in text_chunks(_lower(pa.array([t for _, t in self.rows], pa.string()))):
            starts, ends, first = words(buf, off, BLANK)
            h = word_hashes(buf, starts, ends)
            raw = buf.tobytes()
            for k in range(hi - lo):
                a, b = int(first[k]), int(first[k + 1])
                if a == b:
                    continue
                g = min(SHINGLE, b - a)
                self.ids.append(self.rows[lo + k][0])
                self.words.append([raw[i:j] for i, j in zip(starts[a:b].tolist(), ends[a:b].tolist())])
                self.size.append(b - a)
                self.grams.append(g)
                own.append(gram_hashes(h[a:b], g))
        #: Of each item its distinct shingles and how often it has them.
        self.shingles = [np.unique(x, return_counts=True) for x in own]
        self.fps = np.array([fingerprints(bit_sums(x, len(x)), len(x))[0] for x in own], np.uint64)
        size = np.array(self.size, np.int64)
        #: By shingle length, then by size.
        self.by_size: dict[int, dict[int, list[MultiIndex]]] = {}
        for n in sorted(set(self.size)):
            at = np.flatnonzero(size == n)
            parts = [at[k : k + MultiIndex.ITEMS] for k in range(0, len(at), MultiIndex.ITEMS)]
            self.by_size.setdefault(min(SHINGLE, n), {})[n] = [MultiIndex(self.fps[x], x) for x in parts]
        self.built = True

    def similarity(self, item: int, window: list[bytes]) -> float:
        g = self.grams[item]
        a, b = (Counter(tuple(w[k : k + g]) for k in range(len(w) - g + 1)) for w in (self.words[item], window))
        both = sum(min(n, b[s]) for s, n in a.items())
        return both / (a.total() + b.total() - both)

    def candidates(self, grams: np.ndarray, g: int, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """(documents, first words, items, words) of windows within the radius of an item; grams: of all documents' words."""
        sizes = self.by_size[g]
        count = np.diff(first)
        # Wide windows need wide lanes, and twice the work; narrow ones have sums of their own.
        by_lane: dict[int, dict[int, list[MultiIndex]]] = {}
        for size, parts in sizes.items():
            by_lane.setdefault(_lanes(size - g + 1), {})[size] = parts
        for some in by_lane.values():
            widest = max(some) - g + 1
            step = max(STRETCH, 4 * widest)
            for at in range(0, len(grams), step):
                sums = bit_sums(grams[at : at + step + widest - 1], widest)
                for size, parts in some.items():
                    width = size - g + 1
                    if len(sums) <= width:
                        continue
                    fps = fingerprints(sums[: step + width], width)
                    blocks = blocks_of(fps)
                    for index in parts:
                        window, item = index.find(fps, blocks)
                        if len(window):
                            start = window + at
                            doc = np.searchsorted(first, start, "right") - 1
                            inside = start + size <= first[doc + 1]
                            yield doc[inside], start[inside], item[inside], size
        # Documents that are shorter than an item are one window.
        for size, parts in sizes.items():
            least = math.ceil(MIN_SIMILARITY * (size - g + 1) - 1e-9) + g - 1
            for d in np.flatnonzero((count >= max(least, g)) & (count < size)).tolist():
                whole = grams[first[d] : first[d + 1] - g + 1]
                fp = fingerprints(bit_sums(whole, len(whole)), len(whole))
                for index in parts:
                    _, item = index.find(fp, blocks_of(fp))
                    yield np.full(len(item), d), np.full(len(item), first[d]), item, int(count[d])

    def search(self, column, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, float, int, int, int]]:
        """(row, item, similarity, first word, words, differing bits) of every match."""
        if not self.built:
            self.build()
        for lo, _, buf, off in text_chunks(_lower(column), chunk_bytes):
            starts, ends, first = words(buf, off, BLANK)
            if not len(starts):
                continue
            h = word_hashes(buf, starts, ends)
            for g in self.by_size:
                grams = gram_hashes(h, g)
                for d, item, *hit in self._verified(grams, g, first, buf, starts, ends):
                    yield (lo + d, item, *hit)

    def _verified(self, grams, g, first, buf, starts, ends):
        found = list(self.candidates(grams, g, first))
        if not found:
            return
        doc, start, item = (np.concatenate([f[k] for f in found]) for k in range(3))
        size = np.concatenate([np.full(len(f[0]), f[3]) for f in found])
        order = np.lexsort((start, item, doc))
        doc, start, item, size = doc[order], start[order], item[order], size[order]
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])) if len(doc) else []
        for i, j in zip(new, [*new[1:], len(doc)]):
            x, n = int(item[i]), int(size[i])
            width = n - g + 1
            own, times = self.shingles[x]
            a, b = int(start[i]), int(start[j - 1])
            span = grams[a : b + width]
            k = np.minimum(np.searchsorted(own, span), len(own) - 1)
            k = np.where(own[k] == span, k, len(own))
            sims = []
            for s in start[i:j].tolist():
                both = int(np.minimum(np.bincount(k[s - a : s - a + width], minlength=len(own) + 1)[:-1], times).sum())
                sims.append(both / (int(times.sum()) + width - both))
            for at in np.argsort(-np.array(sims), kind="stable").tolist():
                if sims[at] < MIN_SIMILARITY - 1e-9:
                    break
                s = int(start[i + at])
                window = [bytes(buf[p:q]) for p, q in zip(starts[s : s + n], ends[s : s + n])]
                sim = self.similarity(x, window)
                if sim >= MIN_SIMILARITY:
                    fp = fingerprints(bit_sums(grams[s : s + width], width), width)[0]
                    yield int(doc[i]), x, sim, s - int(first[doc[i]]), n, int(np.bitwise_count(fp ^ self.fps[x]))
                    break


def item_blocks(benchmark: DataFrame, size: int = ITEM_BLOCK) -> Iterator[ItemIndex]:
    block = []
    for r in benchmark.where("text is not null").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        if len(block) == size:
            yield ItemIndex(block)
            block = []
    if block:
        yield ItemIndex(block)


KINDS = "doc_id long, item_id long, similarity double, first_word long, n_words long, differing_bits int"


def contaminated(docs: DataFrame, benchmark: DataFrame, item_block: int = ITEM_BLOCK) -> DataFrame:
    """A row for each document and item that it holds, with the best window."""
    spark, out = docs.sparkSession, None
    for index in item_blocks(benchmark, item_block):
        shared = spark.sparkContext.broadcast(index)

        @frugal
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(0).to_pylist()
                rows = [(ids[r], shared.value.ids[i], round(sim, 6), s, n, d) for r, i, sim, s, n, d in shared.value.search(b.column(1))]
                cols = list(zip(*rows)) if rows else [[]] * 6
                types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], ["doc_id", "item_id", "similarity", "first_word", "n_words", "differing_bits"])

        part = docs.select("doc_id", "text").mapInArrow(run, KINDS)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], KINDS) if out is None else out


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no item of the benchmark."""
    bounded_batches(spark)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    for index in item_blocks(table(spark, sf_dir, "benchmark")):
        shared = spark.sparkContext.broadcast(index)

        @frugal
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                clean[[r for r, *_ in shared.value.search(b.column("text"), STAGE_BYTES)]] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, fields)
    return docs
