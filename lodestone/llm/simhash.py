"""Operator 8: SimHash near-duplicates through covering locality-sensitive hashing.

Every document has a 64-bit SimHash of its word shingles. 2**(r+1) - 1 structured bit masks cover the radius r: each bit
position has a non-zero vector of r+1 bits, a mask keeps the positions whose vector has an odd product with the mask's
own vector, and any r positions are all left out by some mask. So every pair within the radius agrees on some masked
fingerprint; equal keys are joined and verified by their true distance.

Only distinct fingerprints meet (copies are one row). A key with more than ``pair_limit`` fingerprints is not paired off:
its fingerprints are keyed by what is left when r of the bits outside the mask are cleared, for each choice of those bits.
Fingerprints that then share a key differ in these bits alone, at most 2**r of them, and are linked without a comparison.
This work is in proportion to the fingerprints, whatever their number.

Defined cases: a null or empty text, or one without words, has fingerprint zero and is linked like any other; fewer words
than a shingle make one shingle of all; repeated rows share a fingerprint; a null doc_id is never a component_id unless
all ids of the component are null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, components, discard, saved, table, unused
from .neardup import roots, similar
from .textarrays import LOWER, frugal, text_chunks, words

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Keys with more distinct fingerprints than this go the way without pairs.
PAIR_LIMIT = 48
_LANES = np.uint64(0x0101010101010101)


def _joined(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words with one space between, and where each starts and ends."""
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size + 1)])[:-1] if len(size) else size
    out = np.full(int(size.sum() + len(size)), 32, np.uint8)
    shift = np.repeat(at - starts, size)
    source = np.arange(len(shift)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
    out[source + shift] = low[source]
    return out.tobytes(), at, at + size


def fingerprints(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The SimHash of each text."""
    out = np.zeros(len(column), np.uint64)
    for lo, hi, buf, off in text_chunks(column):
        starts, ends, first = words(buf, off)
        text, at, to = _joined(LOWER[buf], starts, ends)
        count = np.diff(first)
        grams = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
        doc = np.repeat(np.arange(hi - lo), grams)
        rank = np.arange(len(doc)) - np.repeat(np.cumsum(grams) - grams, grams)
        a = first[:-1][doc] + rank
        b = np.minimum(a + shingle, first[1:][doc]) - 1
        view, digest = memoryview(text), xxhash.xxh64_intdigest
        h = np.fromiter((digest(view[i:j], SEED) for i, j in zip(at[a].tolist(), to[b].tolist())), np.uint64, len(a))
        total = np.zeros((hi - lo, 64), np.int64)
        # Eight counters of a byte each in a 64-bit word, for at most 255 shingles of a document at a time.
        cut = np.flatnonzero((rank % 255 == 0))
        for k in range(8 if len(h) else 0):
            sums = np.add.reduceat((h >> np.uint64(k)) & _LANES, cut)
            np.add.at(total[:, k::8], doc[cut], sums.view(np.uint8).reshape(-1, 8))
        bits = 2 * total > grams[:, None]
        out[lo:hi] = np.packbits(bits[:, ::-1], axis=1).view(">u8").ravel()
    return out


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) for every row."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fingerprints(b.column(1)).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks; position i has the vector 1 + i mod (2**(r+1) - 1)."""
    top = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(64) if bin((1 + i % top) & v).count("1") & 1) for v in range(1, top + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(nodes: DataFrame, radius: int = RADIUS, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(a, b) pairs of distinct fingerprints (column fp) that connect all that lie within the radius of each other."""
    all_masks = masks(radius)
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(all_masks)])
    keyed = nodes.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    counts = saved(keyed.groupBy("t", "key").count().where("count > 1"), "buckets")
    small = keyed.join(counts.where(F.col("count") <= pair_limit).select("t", "key"), ["t", "key"])
    other = small.select("t", "key", F.col("fp").alias("b"))
    pairs = small.withColumnRenamed("fp", "a").join(other, ["t", "key"])
    pairs = pairs.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")
    hot = keyed.join(counts.where(F.col("count") > pair_limit).select("t", "key"), ["t", "key"])
    clear = F.lit(None).cast("array<bigint>")
    for t, m in enumerate(all_masks):
        free = [i for i in range(64) if not m >> i & 1]
        clear = F.when(F.col("t") == t, F.array(*[F.lit(_signed(sum(1 << i for i in c))) for c in combinations(free, radius)])).otherwise(clear)
    spread = hot.withColumn("c", F.explode(clear)).select("c", F.col("fp").bitwiseAND(F.bitwise_not(F.col("c"))).alias("rest"), "fp")
    stars = spread.groupBy("c", "rest").agg(F.collect_set("fp").alias("s")).where(F.size("s") > 1)
    stars = stars.select(F.array_min("s").alias("a"), F.explode("s").alias("b")).where("a <> b")
    return pairs.unionByName(stars)


def classes(fps: DataFrame, radius: int = RADIUS, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(fp, component_id, root) for each fingerprint of (doc_id, fp); component_id can be null or shared, root names the component."""
    nodes = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = components(links(nodes.select("fp"), radius, pair_limit))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(ids, "root").select("fp", "component_id", "root")


def op8(spark, sf_dir: str) -> DataFrame:
    fps = saved(with_fingerprint(table(spark, sf_dir, "documents")), "simhash")
    out = fps.join(classes(fps), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_links(rows: DataFrame) -> DataFrame:
    """(a, b) links of (node, text): each text with the least node of its class of fingerprints, where their shingles are similar as well."""
    fps = saved(with_fingerprint(rows.select(F.col("node").alias("doc_id"), "text")).distinct(), "simhash")
    pairs = fps.join(classes(fps), "fp").where("doc_id <> component_id")
    pairs = saved(pairs.select(F.least("doc_id", "component_id").alias("a"), F.greatest("doc_id", "component_id").alias("b")).distinct(), "candidates")
    named = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = saved(rows.join(named, "node", "left_semi").select("node", "text").dropDuplicates(["node"]), "texts")
    out = saved(similar(pairs, texts), "linked")
    discard(texts)
    return out


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the row of least id, null last (of rows alike in id and text, one).

    Copies are linked by the covering masks over their SimHash and verified; ``neardup`` adds what is similar and lies beyond their radius.
    """
    bounded_batches(spark)
    cols = docs.columns
    mark, knode, kid, nth = unused(docs, "__node", "__knode", "__id", "__n")
    marked = docs.withColumn(mark, F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = marked.select(F.col(mark).alias("node"), "text")
    group = roots(rows, near_links(rows))
    ids = marked.select(F.col(mark).alias("node"), "doc_id").join(group, "node", "left")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("m")
    keep = saved(ids.groupBy(F.coalesce("root", "node").alias("root")).agg(first).select(F.col("m.node").alias(knode), F.col("m.doc_id").alias(kid)), "kept")
    kept = marked.join(keep, (F.col(mark) == F.col(knode)) & F.col("doc_id").eqNullSafe(F.col(kid)), "left_semi")
    # Maps have no order: of rows alike in the columns that have one, any is the first.
    other = [f.name for f in docs.schema.fields if f.name not in ("doc_id", "text") and "map<" not in f.dataType.simpleString()]
    n = Window.partitionBy(mark, "doc_id").orderBy("text", *[F.col(f"`{c}`") for c in other])
    return kept.withColumn(nth, F.row_number().over(n)).where(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in cols])
