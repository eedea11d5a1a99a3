"""Operator 1: line dedup by a log-template tree.

A line goes down a tree of fixed depth: by its number of words, then by its first LEAD words. Words with a digit are
variable ("<*>") from the start. In a leaf a word is constant at its place if lines of MIN_DOCS documents have it there,
variable otherwise; what is left is the line's template. A template with MIN_CONSTANT constant words at least, which are
MIN_SHARE of its words without digits at least, is recurring if MIN_DOCS different texts have it. A line without variable
words is a template of its own; with LONG_WORDS words or more it is recurring from REPEAT_DOCS different texts on. The lines
of recurring templates are dropped from all documents. Copies of a text count once, so that a text is not lost because it has
copies: these are for the operators on whole documents.

Leaves that fewer documents reach cannot have such a template; their lines are left out early, by two bitmaps (one for each
bound) of 2**LEAF_BITS leaf slots whose size does not depend on the input. Of lines alike one row travels for each batch, with
the number of documents; all sums combine before they are shuffled. Texts meet their dropped lines by id.

Defined cases: a null or empty text has no lines; lines with fewer than MIN_WORDS words stay; lines end at a line feed, and
white space at their ends and between words does not matter; repeated rows lose the same lines; an empty table gives an empty
result; a very long text is a chunk of its own; other columns are not read by ``dropped_lines`` and carried through by
``drop_lines`` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_small, saved, table, unused
from .textarrays import frugal, mix64, powers, text_chunks, word_hashes, words

LEAD, MIN_WORDS, MIN_DOCS, MIN_SHARE, MIN_CONSTANT = 2, 2, 10, 0.6, 2
LONG_WORDS, REPEAT_DOCS = 8, 3
LEAF_BITS, BUCKET_BITS = 26, 8
VARIABLE = np.uint64(0x2545F4914F6CDD1D)
NULL_ID = -(1 << 63)

_DIGIT = np.zeros(256, np.int32)
_DIGIT[48:58] = 1


class Lines:
    """Lines of MIN_WORDS words or more of a run of texts."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        starts, ends, first = words(buf, off)
        digits = np.concatenate([[0], np.cumsum(_DIGIT[buf])])
        h = np.where(digits[ends] > digits[starts], VARIABLE, word_hashes(buf, starts, ends))
        feed = np.concatenate([[0], np.cumsum(buf == 10)])
        #: Line of each word: line feeds and ends of texts before it.
        doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
        line = feed[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(starts)))
        self.all_lines = np.bincount(doc[at], minlength=len(off) - 1)
        use = size >= MIN_WORDS
        self.at, self.size = at[use], size[use]
        self.doc = doc[self.at]
        self.number = line[self.at] - feed[off[:-1]][self.doc]
        self.words = h
        up = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(len(h)))])
        self.hash = mix64((up[self.at + self.size] - up[self.at]) * powers(len(h) + 1, True)[self.at] + self.size.astype(np.uint64))
        leaf = self.size.astype(np.uint64)
        for k in range(LEAD):
            leaf = mix64(leaf * np.uint64(0x9E3779B97F4A7C15) + h[self.at + k])
        self.leaf = leaf
        variable = np.concatenate([[0], np.cumsum(h == VARIABLE)])
        #: Long lines without variable words.
        self.plain = (self.size >= LONG_WORDS) & (variable[self.at + self.size] == variable[self.at])


def leaf_bitmap(docs: DataFrame) -> np.ndarray:
    """Two bitmaps of leaf slots: those that MIN_DOCS documents reach at least, and those that REPEAT_DOCS do."""
    rest = LEAF_BITS - BUCKET_BITS

    @frugal
    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task adds up its documents by slot and sends each slot once, with a count that stops where it says enough.
        slot, times, fresh = np.zeros(0, np.uint32), np.zeros(0, np.int64), []

        def add_up() -> tuple[np.ndarray, np.ndarray]:
            s = np.concatenate([slot, *fresh])
            n = np.concatenate([times, np.ones(len(s) - len(times), np.int64)])
            order = np.argsort(s, kind="stable")
            s, n = s[order], n[order]
            new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
            return s[new], np.minimum(np.add.reduceat(n, new), MIN_DOCS) if len(s) else n

        for b in batches:
            for _, _, buf, off in text_chunks(b.column(0)):
                x = Lines(buf, off)
                if len(x.doc):
                    fresh.append(np.unique(np.stack([x.doc.astype(np.uint64), x.leaf >> np.uint64(64 - LEAF_BITS)]), axis=1)[1].astype(np.uint32))
            if sum(map(len, fresh)) > 1 << 20:
                (slot, times), fresh = add_up(), []
        slot, times = add_up()
        some, cut = np.unique(slot >> np.uint32(rest), return_index=True)
        cut = np.append(cut, len(slot))
        blobs = [[x[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])] for x in (slot & np.uint32((1 << rest) - 1), times.astype(np.uint8))]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *[pa.array(x, pa.binary()) for x in blobs]], ["bucket", "slots", "times"])

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, np.ndarray] = {}
        for b in batches:
            for bucket, at, times in zip(*(c.to_pylist() for c in b.columns)):
                c = n.setdefault(bucket, np.zeros(1 << rest, np.int32))
                c[np.frombuffer(at, np.uint32)] += np.frombuffer(times, np.uint8)  # a slot once in each row
        keys = sorted(n)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *[pa.array([np.packbits(n[k] >= bound, bitorder="little").tobytes() for k in keys], pa.binary()) for bound in (MIN_DOCS, REPEAT_DOCS)]], ["bucket", "often", "some"])

    rows = docs.select("text").mapInArrow(slots, "bucket int, slots binary, times binary").repartition("bucket").mapInArrow(count, "bucket int, often binary, some binary")
    out = np.zeros((2, 1 << BUCKET_BITS, 1 << rest >> 3), np.uint8)
    for r in rows.toLocalIterator():  # 16 MB in all
        for k in range(2):
            out[k, r["bucket"]] = np.frombuffer(r[k + 1], np.uint8)
    return out.reshape(2, -1)


def _in(bitmap: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    s = (leaf >> np.uint64(64 - LEAF_BITS)).astype(np.int64)
    return (bitmap[s >> 3] >> (s & 7) & 1).astype(bool)


def candidate_lines(keyed: DataFrame, bitmap: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(id, text_hash, line) of lines in leaves that matter, and (line, leaf, n_docs, words, plain) once for each batch; words only where templates can be."""
    shared = keyed.sparkSession.sparkContext.broadcast(bitmap)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "text_hash", "line", "leaf", "n_docs", "words", "plain"]
        for b in batches:
            ids, hashes = np.asarray(b.column(0), np.int64), np.asarray(b.column(1), np.int64)
            seen: dict[int, list] = {}
            for lo, hi, buf, off in text_chunks(b.column(2)):
                x = Lines(buf, off)
                deep = _in(shared.value[0], x.leaf)
                use = np.flatnonzero(deep | x.plain & _in(shared.value[1], x.leaf))
                both = np.unique(np.stack([x.doc[use].astype(np.int64), x.hash[use].view(np.int64)]), axis=1) if len(use) else np.zeros((2, 0), np.int64)
                none = pa.nulls(both.shape[1], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo + both[0]]), pa.array(hashes[lo + both[0]]), pa.array(both[1]), none, none, pa.nulls(len(none), pa.list_(pa.int64())), pa.nulls(len(none), pa.bool_())], names)
                line, first = np.unique(x.hash[use].view(np.int64), return_index=True)
                n = np.unique(both[1], return_counts=True)[1]
                for h, k, c in zip(line.tolist(), use[first].tolist(), n.tolist()):
                    if h in seen:
                        seen[h][1] += c
                    else:
                        seen[h] = [x.leaf[k : k + 1].view(np.int64)[0], c, x.words[x.at[k] : x.at[k] + x.size[k]].view(np.int64) if deep[k] else None, bool(x.plain[k])]
            none = pa.nulls(len(seen), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(list(seen), pa.int64()), *[pa.array([v[k] for v in seen.values()], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_()))]], names)

    rows = keyed.select("id", "text_hash", "text").mapInArrow(run, "id long, text_hash long, line long, leaf long, n_docs long, words array<long>, plain boolean")
    rows = saved(rows, "lines")
    return rows.where("id is not null").select("id", "text_hash", "line"), rows.where("id is null").select("line", "leaf", "n_docs", "words", "plain")


def dropped_lines(keyed: DataFrame) -> DataFrame:
    """(id, text_hash, lines): for each document that loses any, the hashes of its lines with recurring templates."""
    lines, shapes = candidate_lines(keyed, leaf_bitmap(keyed))
    first = [F.first(c).alias(c) for c in ("leaf", "words", "plain")]
    shapes = saved(shapes.groupBy("line").agg(F.sum("n_docs").alias("n_docs"), *first), "shapes")
    variable = int(VARIABLE.view(np.int64))
    at = shapes.select("line", "leaf", "n_docs", F.posexplode("words").alias("place", "word")).where(f"word <> {variable}")
    constant = at.groupBy("leaf", "place", "word").agg(F.sum("n_docs").alias("n")).where(f"n >= {MIN_DOCS}").drop("n")
    kept = join_small(at, saved(constant, "constants"), ["leaf", "place", "word"], "inner").groupBy("line").agg(F.bit_xor(F.xxhash64("place", "word")).alias("template"), F.count("*").alias("n_kept"))
    n_words = F.size(F.filter("words", lambda w: w != variable))
    fixed = shapes.select("line", "leaf", n_words.alias("n_words")).join(kept, "line").where((F.col("n_kept") >= MIN_CONSTANT) & (F.col("n_kept") >= MIN_SHARE * F.col("n_words")))
    fixed = fixed.select("line", F.xxhash64("leaf", "template").alias("template"), F.lit(MIN_DOCS).alias("bound"))
    plain = shapes.where(f"plain and n_docs >= {REPEAT_DOCS}").select("line", F.xxhash64("line", F.lit("plain")).alias("template"), F.lit(REPEAT_DOCS).alias("bound"))
    placed = saved(join_small(lines, saved(fixed.unionByName(plain), "templates"), ["line"], "inner"), "placed")
    recurring = placed.select("template", "bound", "text_hash").distinct().groupBy("template", "bound").count().where("count >= bound").select("template")
    return join_small(placed, saved(recurring, "recurring"), ["template"], "left_semi").groupBy("id", "text_hash").agg(F.collect_set("line").alias("lines"))  # of one document each


def drop_lines(docs: DataFrame) -> DataFrame:
    """The documents without their recurring lines; columns n_lines and n_dropped, which replace any of that name, say how many there were and went."""
    docs = docs.drop("n_lines", "n_dropped")
    cols = docs.columns
    key, mark, gone_lines = unused(docs, "__id", "__hash", "__lines")
    keyed = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID).cast("long")), mark: F.xxhash64("text")})
    gone = dropped_lines(keyed.select(F.col(key).alias("id"), F.col(mark).alias("text_hash"), "text"))
    gone = saved(gone, "dropped").select(F.col("id").alias(key), F.col("text_hash").alias(mark), F.col("lines").alias(gone_lines))
    rows = keyed.join(gone, [key, mark], "left").select(*cols, gone_lines)
    text_at = cols.index("text")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, out, n_lines, n_dropped = b.column(text_at), b.column(text_at).to_pylist(), [0] * b.num_rows, [0] * b.num_rows
            lists = b.column(len(cols))
            flat = np.asarray(lists.flatten(), np.int64)
            many = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0), np.int64)
            first = np.cumsum(many) - many
            for lo, hi, buf, off in text_chunks(text):
                x = Lines(buf, off)
                n_lines[lo:hi] = x.all_lines.tolist()
                cut = np.searchsorted(x.doc, np.arange(hi - lo + 1))
                for k in np.flatnonzero(many[lo:hi]):
                    mine = slice(cut[k], cut[k + 1])
                    hit = np.isin(x.hash[mine].view(np.int64), flat[first[lo + k] : first[lo + k] + many[lo + k]])
                    drop = set(x.number[mine][hit].tolist())
                    out[lo + k] = "\n".join(s for i, s in enumerate(out[lo + k].split("\n")) if i not in drop)
                    n_dropped[lo + k] = len(drop)
            new = [pa.array(out, pa.string()) if i == text_at else b.column(i) for i in range(len(cols))]
            yield pa.RecordBatch.from_arrays([*new, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*cols, "n_lines", "n_dropped"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return rows.mapInArrow(run, f"{fields}, n_lines long, n_dropped long")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("kept_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
