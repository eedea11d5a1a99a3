"""Near copies for the pipeline: documents whose five-word shingles have a weighted Jaccard similarity of 0.8 or more.

Words and shingles are those of operator 5. HASHES hash functions take their least value over the multiset of shingles. Texts
are candidates if they share all values of one of BANDS groups of BAND functions; a pair of similarity s is missed with a
chance of (1 - s**BAND)**BANDS, 2e-4 at 0.8. Pairs that agree on fewer than AGREE functions are left out (3e-5 of the pairs at
0.8), the others are verified by the similarity itself, shingles being told apart by 64-bit hashes. Operator 8's fingerprints
find the nearest of these pairs and are taken first (``simhash.near_links``): at 0.8 a pair differs in nine bits of 64, and covering masks for as
many would leave keys of a few bits.

Texts that share a band are a bucket. First each text meets the bucket's centre, the text that the most others meet anywhere,
which joins groups of near copies of any size by one pair for each text. What is left of a bucket goes on only if it is still
of different components: there the functions' values are compared inside a task, pairs that agree are verified at once, those
that agree on most first, and only what connects two components leaves it, at most one pair for each text. A bucket
with more than CROWD texts left is not compared as it is: its texts, which share a passage but are not near copies, get new
buckets by groups of WIDE functions (a pair at 0.8 is missed there with a chance of 3e-3), and those that are crowded even
then are compared in blocks of CROWD, block by block. Equal texts are one node.

Defined cases: null is the empty text; texts without words are alike; fewer than five words are one shingle of all; a very
long text is worked on whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, saved
from .decontam import BLANK, MIN_SIMILARITY, SHINGLE, _lower
from .textarrays import frugal, gram_hashes, mix64, text_chunks, word_hashes, words

HASHES, BANDS, BAND, WIDE, AGREE = 256, 16, 4, 8, 179
#: Texts of a bucket, or of a block of it, that are compared in one task.
CROWD = 1024
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * _STEP) | np.uint64(1)


def shingles(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, cut): a text's shingles, ascending and distinct (the n-th of its kind is one of its own)."""
    for lo, hi, buf, off in text_chunks(_lower(column)):
        starts, ends, first = words(buf, off, BLANK)
        h = word_hashes(buf, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        count = np.diff(first)
        many = np.maximum(count - SHINGLE + 1, 0)
        doc = np.repeat(np.arange(hi - lo), many)
        g = gram_hashes(h, SHINGLE)[np.arange(len(doc)) + np.repeat(first[:-1] - np.cumsum(many) + many, many)]
        short = np.flatnonzero((count > 0) & (count < SHINGLE))
        if len(short):
            doc = np.concatenate([doc, short])
            g = np.concatenate([g, np.array([gram_hashes(h[first[k] : first[k + 1]], int(count[k]))[0] for k in short], np.uint64)])
        order = np.lexsort((g, doc))
        doc, g = doc[order], g[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        nth = np.arange(len(g)) - np.repeat(at, np.diff(np.append(at, len(g))))
        g = mix64(g + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        yield lo, hi, g, np.searchsorted(doc, np.arange(hi - lo + 1))


def sketches(rows: DataFrame) -> DataFrame:
    """(node, bands, wide, least) for (node, text): the keys of both kinds of groups, and a byte of each function's least value."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, g, cut in shingles(b.column(1)):
                some, n = np.flatnonzero(np.diff(cut)), hi - lo
                bands, wide, low = np.zeros((n, BANDS), np.uint64), np.zeros((n, HASHES // WIDE), np.uint64), np.zeros((n, HASHES), np.uint8)
                for k in range(HASHES if len(g) else 0):
                    least = np.minimum.reduceat(g * _FACTORS[k], cut[:-1][some])
                    low[some, k] = mix64(least).astype(np.uint8)
                    for keys, size in ((bands, BAND), (wide, WIDE)):
                        if k // size < keys.shape[1]:
                            keys[some, k // size] = mix64(keys[some, k // size] * _STEP + least)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(x.view(np.int64).ravel())) for x in (bands, wide)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), *lists, pa.array([x.tobytes() for x in low], pa.binary())], ["node", "bands", "wide", "least"])

    return rows.select("node", "text").mapInArrow(run, "node long, bands array<long>, wide array<long>, least binary")


def buckets(nodes: DataFrame, keys: str) -> DataFrame:
    """(t, key, node, size): the keys that a node shares with others."""
    keyed = nodes.select("node", F.posexplode(keys).alias("t", "key"))
    return keyed.join(keyed.groupBy("t", "key").agg(F.count("*").alias("size")).where("size > 1"), ["t", "key"])


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that agree on AGREE hash functions."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, HASHES) for k in (2, 3))
            yield b.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= AGREE))

    one, two = (nodes.select(F.col("node").alias(c), F.col("least").alias(x)) for c, x in (("a", "x"), ("b", "y")))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def is_similar(x: np.ndarray, y: np.ndarray) -> bool:
    """For two texts' shingles, ascending and distinct."""
    if min(len(x), len(y)) < (MIN_SIMILARITY - 1e-9) * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, True))
    return both >= (MIN_SIMILARITY - 1e-9) * (len(x) + len(y) - both)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Of each row; a text that stands in many rows is worked on once."""
    d = column.dictionary_encode()
    each = [np.sort(g[i:j]) for _, _, g, cut in shingles(d.dictionary) for i, j in zip(cut[:-1], cut[1:])]
    return [each[i] for i in d.indices.to_pylist()]


def linked(left: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Similar pairs (a, b) that connect what is similar in each bucket of (t, key, node, root, size), at most one for each text.

    Pairs of different roots that agree on AGREE functions are looked at, those that agree on most first; a pair that others
    have already connected needs no look.
    """
    blocks = F.ceil(F.col("size") / CROWD).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    cut = left.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cut = cut.select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root")
    rows = cut.join(nodes.select("node", "least"), "node").join(texts.select("node", F.coalesce("text", F.lit("")).alias("text")), "node")
    rows = rows.select("t", "key", "i", "j", "own", "node", "root", "least", "text")

    def connect(group: list[tuple]) -> pa.RecordBatch:
        own, node, root = (np.array([r[k] for r in group], np.int64) for k in (4, 5, 6))
        low = np.frombuffer(b"".join(r[7] for r in group), np.uint8).reshape(-1, HASHES)
        crossing, found = group[0][2] != group[0][3], []
        for k in range(len(group)):
            at = np.arange(k + 1, len(group))
            at = at[(root[at] != root[k]) & ((own[at] != own[k]) | (not crossing))]
            agree = (low[at] == low[k]).sum(axis=1)
            use = np.flatnonzero(agree >= AGREE)
            found.append(np.stack([-agree[use], np.full(len(use), k), at[use]]))
        found = np.concatenate(found, axis=1)
        up = {r: r for r in root.tolist()}

        def top(r: int) -> int:
            while up[r] != r:
                up[r] = r = up[up[r]]
            return r

        pairs, sets = [], shingle_sets(pa.array([r[8] for r in group])) if found.shape[1] else []
        for k in np.lexsort(found[::-1]).tolist():
            i, j = int(found[1, k]), int(found[2, k])
            x, y = top(int(root[i])), top(int(root[j]))
            if x != y and is_similar(sets[i], sets[j]):
                up[x] = y
                pairs.append((int(min(node[i], node[j])), int(max(node[i], node[j]))))
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if group and group[0][:4] != r[:4]:
                    yield connect(group)
                    group = []
                group.append(r)
        if group:
            yield connect(group)

    keys = ["t", "key", "i", "j"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts, of (node, text), are similar."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            use = [is_similar(x, y) for x, y in zip(shingle_sets(b.column(2)), shingle_sets(b.column(3)))]
            yield b.select(["a", "b"]).filter(pa.array(use, pa.bool_()))

    text = F.coalesce("text", F.lit(""))
    one, two = (texts.select(F.col("node").alias(c), text.alias(x)) for c, x in (("a", "x"), ("b", "y")))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def mixed(left: DataFrame) -> DataFrame:
    """(t, key, node, root, size): what is left of the buckets that have different roots."""
    both = left.groupBy("t", "key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("size")).where("x <> y")
    return left.select("t", "key", "node", "root").join(both.drop("x", "y"), ["t", "key"])


def roots(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, root) for each node of (node, text) that is similar to another; equal nodes have equal texts; ``known``: links (a, b) found before."""
    nodes = saved(sketches(rows).dropDuplicates(["node"]), "sketches")
    met = saved(buckets(nodes, "bands"), "buckets")
    # Only texts that share a band are read again.
    texts = saved(rows.join(met.select("node").distinct(), "node", "left_semi").select("node", "text").dropDuplicates(["node"]), "texts")
    meets = met.groupBy("node").agg(F.sum("size").alias("meets"))
    centre = met.drop("size").join(meets, "node").groupBy("t", "key").agg(F.max(F.struct("meets", "node")).alias("c"))
    met = met.join(centre.select("t", "key", F.col("c.node").alias("centre")), ["t", "key"]).where("node <> centre")
    met = saved(met.select("t", "key", "node", "centre"), "centres")
    pairs = met.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    found = saved(similar(saved(likely(pairs, nodes), "candidates"), texts), "similar")
    found = found if known is None else found.unionByName(known)
    out = saved(components(found), "roots")

    def rooted(b: DataFrame) -> DataFrame:
        return mixed(b.join(out, "node", "left").withColumn("root", F.coalesce("root", "node")))

    left = saved(rooted(met), "left")
    crowded = left.where(F.col("size") > CROWD).select("node").distinct()
    again = rooted(buckets(nodes.join(crowded, "node", "left_semi"), "wide"))
    both = left.where(F.col("size") <= CROWD).unionByName(again.select(*left.columns).withColumn("t", F.col("t") + BANDS))
    more = saved(linked(both, nodes, texts), "similar")
    if not more.isEmpty():
        out = saved(components(found.unionByName(more)), "roots")
    discard(nodes, texts, met, left)
    return out
