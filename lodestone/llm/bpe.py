"""Operator 12: byte-level BPE, encoded in overlapping chunks, and decoding.

A text of up to ``chunk`` characters is one chunk: it is encoded where it lies. A longer text is cut into chunks that overlap by
``overlap`` characters; chunks are dealt to all tasks and cut into pre-tokens independently, each from its own start. Where the
boundaries that two neighbours find in their overlap agree, both have come to the same pre-tokens, as a match depends on what is
right of it alone: that is where they are stitched. The first chunk starts where the text does, so by induction each stitch is a
boundary of the whole text. Boundaries less than MARGIN before a chunk's end are not used, since the text after it could change them.
A stretch between two stitches is then one piece of work: its pre-tokens are encoded each by itself. If neighbours don't agree (their
overlap lies inside one pre-token), they and what follows up to the text's end are one stretch, which is cut again from its start.

Encoded texts are rows (…, part, ids): ids as little-endian unsigned 32-bit integers, parts in order. Decoding joins the raw bytes of
the ids, so a part can end inside a character.

Defined cases: null is the empty text, which has one part without ids; long texts of one content are encoded once, whatever their ids;
repeated rows give repeated results; a null doc_id stays null; an empty table gives no rows; other columns are not read. Bytes that
are not UTF-8 count as the replacement character, as in the tokenizer library.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, saved, table
from .textarrays import Rows, frugal

#: Characters of a chunk, and of its overlap with the next.
CHUNK, OVERLAP = 1 << 15, 1 << 8
#: No match of the pattern looks further ahead than this, but for runs, which end at the character that ends them.
MARGIN = 3
#: Pieces that a worker remembers.
REMEMBERED = 400_000

PARTS = "part int, ids binary"

Batches = Iterator[pa.RecordBatch]


class Vocabulary:
    """A rank file and its pattern; one for each worker."""

    _loaded: dict[tuple[str, str], Vocabulary] = {}

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, list[int]] = {}
        self.names = np.empty(max(ranks.values(), default=-1) + 1, object)
        for name, rank in ranks.items():
            self.names[rank] = name

    @classmethod
    def of(cls, path: str, pattern: str) -> Vocabulary:
        if (path, pattern) not in cls._loaded:
            cls._loaded[path, pattern] = cls(path, pattern)
        return cls._loaded[path, pattern]

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def boundaries(self, text: str, start: int = 0) -> list[int]:
        return [m.end() for m in self.pattern.finditer(text, start)]

    def encode_stretch(self, text: str, start: int, end: int) -> list[int]:
        """Ids of text[start:end], both boundaries of pre-tokens; what stands after ``end`` is only looked at."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        out = []
        for m in self.pattern.finditer(text, start):
            if m.start() >= end:
                break
            piece = m.group()
            ids = self.known.get(piece)
            if ids is None:
                ids = self.known[piece] = self.encoding._encode_single_piece(piece)
            out.append(ids)
        return list(chain.from_iterable(out))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.names[ids].tolist())


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def _texts(column: pa.Array) -> Iterator[str]:
    for x in column.cast(pa.binary()).to_pylist():
        yield (x or b"").decode("utf-8", "replace")


def encoder(path: str, pattern: str) -> Callable[[Batches], Batches]:
    """Batches (doc_id, text) of texts of one chunk -> (doc_id, part, ids)."""

    def run(batches: Batches) -> Batches:
        v = Vocabulary.of(path, pattern)
        out = Rows(("doc_id", pa.int64()), ("part", pa.int32()), ("ids", pa.binary()))
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), _texts(b.column(1))):
                yield from out.add(i, 0, _packed(v.encode(t)))
        yield from out.rest()

    return run


def decoder(path: str, pattern: str) -> Callable[[Batches], Batches]:
    """Batches with a column ids -> the same with a column bytes."""

    def run(batches: Batches) -> Batches:
        v = Vocabulary.of(path, pattern)
        for b in batches:
            raw = [v.decode(np.frombuffer(x, "<u4")) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw, pa.binary())], names=[*b.schema.names, "bytes"])

    return run


def digested(key: str) -> Callable[[Batches], Batches]:
    """Batches (key, part, ids, bytes), a key's parts together and in order -> (key, n_tokens, ids_sha256, decoded_sha256).

    One part is hashed after another, so that no text is held whole.
    """

    def run(batches: Batches) -> Batches:
        out, now, n, a, d = None, None, 0, None, None
        for b in batches:
            if out is None:
                out = Rows((key, b.schema.field(key).type), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()))
            for k, part, ids, raw in zip(*[b.column(c).to_pylist() for c in (key, "part", "ids", "bytes")]):
                if part == 0:
                    if a is not None:
                        yield from out.add(now, n, a.hexdigest(), d.hexdigest())
                    now, n, a, d = k, 0, hashlib.sha256(), hashlib.sha256()
                a.update(ids)
                d.update(raw)
                n += len(ids) // 4
        if a is not None:
            yield from out.add(now, n, a.hexdigest(), d.hexdigest())
            yield from out.rest()

    return run


def _after(*steps: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    @frugal
    def run(batches: Batches) -> Batches:
        for s in steps:
            batches = s(batches)
        yield from batches

    return run


def cut(docs: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, no, last, text): the overlapping chunks of each different text; key is its SHA-256."""

    @frugal
    def run(batches: Batches) -> Batches:
        out = Rows(("key", pa.binary()), ("no", pa.int32()), ("last", pa.bool_()), ("text", pa.string()))
        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), _texts(b.column(1))):
                starts = range(0, max(1, len(t) - overlap), chunk)
                for no, s in enumerate(starts):
                    yield from out.add(key, no, no == len(starts) - 1, t[s : s + chunk + overlap])
        yield from out.rest()

    chunks = docs.select(F.unhex(F.sha2("text", 256)).alias("key"), "text").mapInArrow(run, "key binary, no int, last boolean, text string")
    return chunks.groupBy("key", "no").agg(F.first("last").alias("last"), F.first("text").alias("text"))


def _pretokenised(chunks: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """chunks with the boundaries in their overlap with the one before (head) and the one after (tail), counted from that overlap's start."""

    @frugal
    def run(batches: Batches) -> Batches:
        v = Vocabulary.of(path, pattern)
        for b in batches:
            head, tail = [], []
            for last, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                ends = np.array(v.boundaries(t), np.int64)
                sure = ends if last else ends[ends <= len(t) - MARGIN]
                head.append(sure[sure < overlap].tolist())
                tail.append((sure[sure >= chunk] - chunk).tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(head, pa.list_(pa.int32())), pa.array(tail, pa.list_(pa.int32()))], names=[*b.schema.names, "head", "tail"])

    return chunks.select("key", "no", "last", "text").mapInArrow(run, "key binary, no int, last boolean, text string, head array<int>, tail array<int>")


def stitched(pre: DataFrame) -> DataFrame:
    """(key, no, stretch, start, end) of each chunk: start and end are where it meets its neighbours, from the overlaps' starts; null at
    the text's ends, and inside a stretch whose chunks don't agree."""
    order = Window.partitionBy("key").orderBy("no")
    agreed = F.array_min(F.array_intersect(F.lag("tail").over(order), "head"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    met = pre.select("key", "no", agreed.alias("start"))
    # Behind the first place without agreement nothing is known to be a boundary of the whole text.
    lost = F.max((F.col("start").isNull() & (F.col("no") > 0)).cast("int")).over(so_far)
    met = met.withColumn("start", F.when(lost == 0, F.col("start")))
    stretch = F.sum(F.col("start").isNotNull().cast("int")).over(so_far)
    return met.select("key", "no", stretch.cast("int").alias("stretch"), "start", F.lead("start").over(order).alias("end"))


def _encoded_stretches(pre: DataFrame, cuts: DataFrame, path: str, pattern: str, chunk: int) -> DataFrame:
    """(key, part, ids): a part for each stretch."""

    @frugal
    def run(batches: Batches) -> Batches:
        v = Vocabulary.of(path, pattern)
        out = Rows(("key", pa.binary()), ("part", pa.int32()), ("ids", pa.binary()))
        held: list[str] = []
        for b in batches:
            for key, no, stretch, first, start, end, last, t in zip(*[c.to_pylist() for c in b.columns]):
                if first:
                    held, begin = [], start or 0
                closing = last or end is not None
                if not closing:
                    held.append(t[:chunk])
                    continue
                upto = len(t) if end is None else chunk + end
                before = sum(map(len, held))
                yield from out.add(key, stretch, _packed(v.encode_stretch("".join([*held, t]), begin, before + upto)))
        yield from out.rest()

    rows = pre.select("key", "no", "last", "text").join(cuts, ["key", "no"])
    first = (F.col("no") == 0) | F.col("start").isNotNull()
    rows = rows.select("key", "no", "stretch", first.alias("first"), "start", "end", "last", "text").repartition("key", "stretch").sortWithinPartitions("key", "no")
    return rows.mapInArrow(run, "key binary, part int, ids binary")


def encode_long(docs: DataFrame, path: str | None = None, pattern: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, part, ids) of each different text; key is its SHA-256."""
    path, pattern = path or default_vocabulary()[0], pattern or default_vocabulary()[1]
    pre = saved(_pretokenised(cut(docs, chunk, overlap), path, pattern, chunk, overlap), "chunks")
    return _encoded_stretches(pre, stitched(pre), path, pattern, chunk)


def _split(docs: DataFrame, chunk: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    long = F.length("text") > chunk + overlap
    return docs.where(~long), docs.where(long)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, part, ids) of every row of (doc_id, text)."""
    path, pattern = path or default_vocabulary()[0], pattern or default_vocabulary()[1]
    short, long = _split(docs, chunk, overlap)
    one = short.mapInArrow(_after(encoder(path, pattern)), f"doc_id long, {PARTS}")
    keyed = long.select("doc_id", F.unhex(F.sha2("text", 256)).alias("key"))
    return one.unionByName(keyed.join(encode_long(long, path, pattern, chunk, overlap), "key").select("doc_id", "part", "ids"))


def decode(parts: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """parts with a column bytes."""
    path, pattern = path or default_vocabulary()[0], pattern or default_vocabulary()[1]
    kinds = ", ".join(f"`{n}` {t}" for n, t in parts.dtypes)
    return parts.mapInArrow(_after(decoder(path, pattern)), f"{kinds}, bytes binary")


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """What ``encode`` and ``decode`` give for each row, as (doc_id, n_tokens, ids_sha256, decoded_sha256); texts of one chunk take all steps in their scan's task."""
    path, pattern = default_vocabulary()
    short, long = _split(docs, chunk, overlap)
    one = short.mapInArrow(_after(encoder(path, pattern), decoder(path, pattern), digested("doc_id")), f"doc_id long, {DIGEST}")
    parts = encode_long(long, path, pattern, chunk, overlap).repartition("key").sortWithinPartitions("key", "part")
    whole = parts.mapInArrow(_after(decoder(path, pattern), digested("key")), f"key binary, {DIGEST}")
    keyed = long.select("doc_id", F.unhex(F.sha2("text", 256)).alias("key"))
    return one.unionByName(join_small(keyed, saved(whole, "digests"), ["key"]).select(one.columns))


def op12(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
