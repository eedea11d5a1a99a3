"""BM25 of a large batch of queries: blocks of documents meet blocks of queries.

DOCS documents are a packed row: their words as 64-bit hashes, each with the documents that have it and how often. Some QUERIES queries are a
row with their terms' hashes and weights. The Cartesian product of the two tables shuffles neither; one pair of rows is in a worker at a time,
and a task gives, for each query, the rows of its documents that can be among the k best. So memory is bounded, and what is shuffled is in
proportion to queries and tasks.

Inside a pair all scores are worked out in single precision: terms that many queries and documents have by a product of matrices, the entries of
the others are added one by one. Documents that can then be among the k best, by a query's k-th best score so far in the task and by how far such a sum
can be off, are scored anew in double precision from their own words. So a pair costs the same whatever the scores are, and little of it is Python.

Defined cases: a query without terms of the index has no rows; of equal scores, as rounded to six places, those of the lower keys stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import saved, setting
from .lexical import B, K1

#: Documents of a block, query terms that a block of queries has about, words of a long document's block.
DOCS, TERMS, WORDS = 8192, 1_500_000, 4_000_000
#: Queries whose scores are held at once, entries that are added to them at once.
QUERIES, ENTRIES = 256, 1 << 16
#: Share of pairs of query and document that have a term from which on it is a row of the matrix, and rows that this has at most.
COMMON, MATRIX = 1 / 384, 1024
#: Share of a query's threshold that its common terms may leave to the exact scores, entries of the others for each document up to which they come first.
LEFT, SPARSE = 0.7, 1.0
#: Words that a document's own list gives in the time of one look at the entries.
LOOKUP = 16
#: Scores are rounded to six places.
MARGIN = 2e-6
PACKED = "keys array<{key}>, terms binary, ends binary, docs binary, tf binary, lens binary"
ASKED = "block long, ids array<{query}>, asked binary, idf binary, code binary, cut binary, least binary"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(keys, words as hashes) to packed rows, all but a task's last as full as DOCS and WORDS let them be."""
    keys, words = [], []
    for b in batches:
        off = np.asarray(b.column(1).offsets, np.int64)
        values = np.asarray(b.column(1).values, np.int64)
        lo, room = 0, (DOCS - sum(map(len, keys)), WORDS - sum(len(v) for v, _ in words))
        while lo < b.num_rows:
            hi = min(lo + room[0], max(lo + (not keys), int(np.searchsorted(off, off[lo] + room[1], "right")) - 1), b.num_rows)
            if hi > lo:
                keys.append(b.column(0).slice(lo, hi - lo))
                words.append((values[off[lo] : off[hi]], np.diff(off[lo : hi + 1])))
            if hi < b.num_rows:
                yield _packed(keys, words)
                keys, words = [], []
            lo, room = hi, (DOCS, WORDS)
    if keys:
        yield _packed(keys, words)


def _packed(keys: list[pa.Array], words: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    lens = np.concatenate([n for _, n in words])
    n = len(lens)
    terms, code = np.unique(np.concatenate([v for v, _ in words]), return_inverse=True)
    both, tf = np.unique(code.astype(np.int64) * n + np.repeat(np.arange(n), lens), return_counts=True)
    term, doc = np.divmod(both, n)
    ends = np.searchsorted(term, np.arange(len(terms) + 1)).astype(np.int64)
    parts = [terms.tobytes(), ends.tobytes(), doc.astype(np.uint16).tobytes(), tf.astype(np.int32).tobytes(), lens.astype(np.int64).tobytes()]
    rows = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.concat_arrays(keys))
    return pa.RecordBatch.from_arrays([rows, *[pa.array([x], pa.binary()) for x in parts]], ["keys", "terms", "ends", "docs", "tf", "lens"])


def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, queries) to packed rows: the distinct terms with their weights, and each query's places among them, those of the least weight first."""
    for b in batches:
        for r in range(b.num_rows):
            queries = b.column(1).slice(r, 1).flatten()
            ids, least, terms = queries.flatten()
            cut = np.asarray(terms.offsets, np.int64)
            idf, h = (np.asarray(x)[cut[0] : cut[-1]] for x in terms.values.flatten())
            asked, first, code = np.unique(h, return_index=True, return_inverse=True)
            least = np.asarray(pc.fill_null(least, -1.0), float)
            parts = [asked.tobytes(), idf[first].tobytes(), code.astype(np.int32).tobytes(), (cut - cut[0]).tobytes(), least.tobytes()]
            rows = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(r, 1), rows, *[pa.array([x], pa.binary()) for x in parts]], ["block", "ids", "asked", "idf", "code", "cut", "least"])


class Block:
    """Documents by term and by document, with each entry's share of a score but for the term's weight."""

    def __init__(self, keys: pa.Array, terms: pa.Buffer, ends: pa.Buffer, docs: pa.Buffer, tf: pa.Buffer, lens: pa.Buffer, avg: float):
        self.keys, self.terms, self.ends = keys, np.frombuffer(terms, np.int64), np.frombuffer(ends, np.int64)
        doc = np.frombuffer(docs, np.uint16)
        n, size = np.frombuffer(tf, np.int32).astype(float), np.frombuffer(lens, np.int64)
        self.docs, self.df = doc.astype(np.int64), np.diff(self.ends)
        self.part = part = n * (K1 + 1) / (n + K1 * (1 - B + B * size[self.docs] / avg))
        self.top = np.maximum.reduceat(part, self.ends[:-1]) if len(part) else np.zeros(0)
        self.by_doc = np.argsort(doc, kind="stable")
        self.doc_ends = np.append(0, np.cumsum(np.bincount(self.docs, minlength=len(size))))
        self.doc_terms = np.repeat(np.arange(len(self.terms)), self.df)[self.by_doc]
        # Entries as one ascending number each.
        self.entries = np.repeat(np.arange(len(self.terms)) * len(size), self.df) + self.docs
        self.place = np.empty(len(keys), np.int64)
        self.place[np.asarray(pc.array_sort_indices(keys, null_placement="at_start"))] = np.arange(len(keys))

    def find(self, asked: np.ndarray, idf: np.ndarray, code: np.ndarray, cut: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(queries, documents, scores) that can be among the k best, of queries with terms asked[code[cut[j] : cut[j + 1]]].

        top: each query's k best scores so far, the least first, -1 where there is none; it is brought up to date.
        """
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        n, n_queries = len(self.keys), len(cut) - 1
        if not len(self.terms):
            return out[0]
        at = np.minimum(np.searchsorted(self.terms, asked), len(self.terms) - 1)
        there = self.terms[at] == asked
        use = np.flatnonzero(there[code])
        at_of = at[code[use]]
        ends = np.searchsorted(use, cut)
        weight = np.zeros(len(self.terms))
        weight[at[there]] = idf[there]
        exact = np.repeat(weight, self.df) * self.part
        value, own_words = exact.astype(np.float32), exact[self.by_doc]
        # What a query's terms can add up to here, from the least weight on. Where some share of the threshold is out of reach without the
        # others, only these others' entries are added up first.
        most = np.append(0.0, np.cumsum((weight * self.top)[at_of]))
        least = top[:, 0].copy()
        size = np.append(0, np.cumsum(self.df[at_of]))
        split = np.searchsorted(most, most[ends[:-1]] + LEFT * np.maximum(least, 0.0), "right") - 1
        split = np.clip(split, ends[:-1], ends[1:])
        left = most[split] - most[ends[:-1]]
        live = (ends[1:] > ends[:-1]) & (most[ends[1:]] - most[ends[:-1]] + 1e-6 >= least - MARGIN)
        few = live & (least > 1e-4) & (size[ends[1:]] - size[split] <= SPARSE * n)
        asks = np.zeros(len(self.terms), bool)

        def add(q: np.ndarray, rows: Iterator[tuple[int, np.ndarray]]) -> None:
            for j, found in rows:
                j = int(q[j])
                terms = at_of[ends[j] : ends[j + 1]]
                found, own = self._best(found, self._exact(found, terms, asks, exact, own_words), top[j])
                out.append((np.full(len(found), j), found, own))

        share = (np.diff(ends) + 8) * 2.0**-23  # a sum of so many positive numbers is off by this share at most
        for q in _chunks(few):
            t, row = _ranges(at_of, split[q], ends[q + 1])
            score = np.zeros((len(q), n), np.float32)
            self._add_rest(score.reshape(-1), t, row * n, value)
            add(q, _above(score, (least[q] - MARGIN - left[q] - 1e-6) * (1 - share[q])))
        many = live & ~few
        # Terms that many of the queries and of the documents have are rows of a matrix.
        mass = np.bincount(_ranges(at_of, ends[:-1][many], ends[1:][many])[0], minlength=len(self.terms)) * self.df
        dense = np.flatnonzero(mass > COMMON * many.sum() * n)
        dense = dense[np.argsort(-mass[dense], kind="stable")[:MATRIX]]
        place = np.full(len(self.terms), -1)
        place[dense] = np.arange(len(dense))
        matrix = np.zeros((len(dense), n), np.float32)
        for i, d in enumerate(dense.tolist()):
            matrix[i, self.docs[self.ends[d] : self.ends[d + 1]]] = value[self.ends[d] : self.ends[d + 1]]
        for q in _chunks(many):
            t, row = _ranges(at_of, ends[q], ends[q + 1])
            common = place[t] >= 0
            has = np.zeros((len(q), len(dense)), np.float32)
            has[row[common], place[t[common]]] = 1
            score = has @ matrix
            self._add_rest(score.reshape(-1), t[~common], row[~common] * n, value)
            floor, new = (least[q] - MARGIN) * (1 - share[q]), np.flatnonzero(least[q] < 0)
            if len(new) and n > top.shape[1]:
                kth = np.partition(score[new], n - top.shape[1], axis=1)[:, n - top.shape[1]]
                floor[new] = (kth * (1 - share[q][new]) - MARGIN) * (1 - share[q][new])
            add(q, _above(score, floor))
        return tuple(np.concatenate(x) for x in zip(*out))

    def _add_rest(self, score: np.ndarray, terms: np.ndarray, base: np.ndarray, value: np.ndarray) -> None:
        """Add the entries of terms, some thousands at once, to rows of scores that begin at base."""
        size = self.df[terms]
        total = np.cumsum(size)
        cut = np.unique(np.concatenate([[0], np.searchsorted(total, np.arange(ENTRIES, total[-1], ENTRIES)), [len(terms)]])) if len(terms) else [0]
        for i, j in zip(cut[:-1], cut[1:]):
            s = size[i:j]
            e = np.arange(s.sum()) + np.repeat(self.ends[terms[i:j]] - np.cumsum(s) + s, s)
            np.add.at(score, self.docs[e] + np.repeat(base[i:j], s), value[e])

    def _exact(self, found: np.ndarray, terms: np.ndarray, asks: np.ndarray, exact: np.ndarray, own_words: np.ndarray) -> np.ndarray:
        """Scores of documents in double precision, from their own words, or from their places among the entries of few terms."""
        begin = self.doc_ends[found]
        size = self.doc_ends[found + 1] - begin
        total = int(size.sum())
        if len(terms) * len(found) * LOOKUP < total:
            want = (terms[:, None] * len(self.keys) + found).reshape(-1)
            x = np.minimum(np.searchsorted(self.entries, want), len(self.entries) - 1)
            return np.where(self.entries[x] == want, exact[x], 0.0).reshape(len(terms), -1).sum(axis=0)
        asks[terms] = True
        first = np.cumsum(size) - size
        e = np.arange(total) + np.repeat(begin - first, size)
        own = np.add.reduceat(own_words[e] * asks[self.doc_terms[e]], first)
        asks[terms] = False
        return own

    def _best(self, found: np.ndarray, own: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of documents with exact scores those that can be among the k best; top is brought up to date."""
        k = len(top)
        top[:] = np.sort(np.concatenate([top, own]))[-k:]
        near = np.flatnonzero(own >= top[0] - MARGIN)
        if len(near) > k:
            # A score halfway between two places is taken as either; Spark rounds it in the end.
            at = self.place[found[near]]
            near = near[np.unique([np.lexsort((at, -np.floor(own[near] * 1e6 + 0.5 + e)))[:k] for e in (-1e-3, 1e-3)])]
        return found[near], own[near]


def _chunks(use: np.ndarray) -> Iterator[np.ndarray]:
    """The places that are set, QUERIES at once."""
    some = np.flatnonzero(use)
    for i in range(0, len(some), QUERIES):
        yield some[i : i + QUERIES]


def _ranges(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[begin : end] one after another, and of which range each is."""
    size = end - begin
    e = np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)
    return values[e], np.repeat(np.arange(len(size)), size)


def _above(score: np.ndarray, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, documents) that reach the row's floor."""
    reached = score >= np.nextafter(np.maximum(floor, 1e-30).astype(np.float32), np.float32(0))[:, None]
    rows, docs = np.divmod(np.flatnonzero(reached.reshape(-1)), score.shape[1])
    some, begin = np.unique(rows, return_index=True)
    yield from zip(some.tolist(), np.split(docs, begin[1:]))


def search(docs: DataFrame, weights: DataFrame, n_docs: int, total_len: int, k: int, floor: DataFrame | None = None) -> DataFrame:
    """docs: key, words; weights: query_id, term, idf -> query_id, key, score: the k best of each query are among them.

    floor: query_id, least: rows of a lower score may be left out.
    """
    spark = docs.sparkSession
    key_type, query_type = docs.schema["key"].dataType.simpleString(), weights.schema["query_id"].dataType.simpleString()
    hashed = docs.select("key", F.transform("words", lambda w: F.xxhash64(w)).alias("words"))
    with setting(spark, ARROW_ROWS, str(DOCS)):
        packed = saved(hashed.mapInArrow(pack, PACKED.format(key=key_type)), "packed", **{"parquet.block.size": 16 << 20})
    weights = weights.select("query_id", "idf", F.xxhash64("term").alias("h"))
    blocks = max(1, -(-weights.count() // TERMS))
    each = weights.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("idf", "h"))).alias("terms"))  # of one query each
    each = each.withColumn("least", F.lit(None).cast("double")) if floor is None else each.join(floor, "query_id", "left")
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")
    asked = each.groupBy(block).agg(F.collect_list(F.struct("query_id", "least", "terms")).alias("queries")).repartition(blocks, "block")
    with setting(spark, ARROW_ROWS, "1"):
        asked = saved(asked.mapInArrow(ask, ASKED.format(query=query_type)), "asked")
    avg = total_len / n_docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: dict[int, np.ndarray] = {}
        docs, has = None, None
        for b in batches:
            for r in range(b.num_rows):
                row = {name: b.column(i)[r : r + 1] for i, name in enumerate(b.schema.names)}
                block, keys, ids = row.pop("block")[0].as_py(), row.pop("keys").flatten(), row.pop("ids").flatten()
                data = {name: x[0].as_buffer() for name, x in row.items()}
                if block not in tops:
                    tops[block] = np.repeat(np.frombuffer(data["least"], float)[:, None], k, axis=1)
                # A block of documents meets all of the partition's blocks of queries before the next one comes.
                parts = [data[c] for c in ("terms", "ends", "docs", "tf", "lens")]
                if docs is None or not (keys.equals(docs.keys) and all(x.equals(y) for x, y in zip(parts, has))):
                    docs, has = Block(keys, *parts, avg), parts
                kinds = (("asked", np.int64), ("idf", float), ("code", np.int32), ("cut", np.int64))
                q, d, s = docs.find(*[np.frombuffer(data[c], t) for c, t in kinds], tops[block])
                if len(q):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), keys.take(pa.array(d)), pa.array(s)], ["query_id", "key", "score"])

    # The weights' blocks are files of their own, and a task of the product has one of them and one part of the documents.
    with setting(spark, ARROW_ROWS, "1"):
        pairs = packed.hint("shuffle_replicate_nl").crossJoin(asked)
        return saved(pairs.mapInArrow(run, f"query_id {query_type}, key {key_type}, score double"), "scanned")
