"""Operator 4: toxicity by a character n-gram linear classifier whose features are scaled by naive Bayes log-count ratios.

Features are hashed n-grams of characters (code points) of lower-cased letters, with one blank for each run of anything else;
a text has a feature or it hasn't. Each is scaled by r = log(P(feature | toxic) / P(feature | clean)) of the labelled
documents; features whose r is within MIN_Z standard errors of zero are left out, so that long texts don't gather noise; that is most
of them (README has figures). A logistic regression over the scaled features is fitted by L-BFGS: the training rows stay in the executors
as a table of feature numbers, a pass over it gives each task's sum of gradients, and the driver holds weights and gradients, whose size is
that of the features, 2**BITS at most. Its L2 penalty is the best of PENALTIES on a fifth of the training rows. Scoring reads every text
whole, in the executors.

Labels come only from rows whose crc32(doc_id as text) modulo 3 is not 1. About TRAIN_ROWS of them, those of small hash, are used.

Defined cases: null and empty texts have no feature and get the score of the intercept; a null doc_id has the crc32 of
the empty string; labels without a document or that are null are not used; a document that is labelled twice counts
twice; without labels of both kinds every score is 0; equal texts get equal scores, so ties stay ties; a very long text is
worked on by itself, whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, saved, table
from .textarrays import frugal, mix64, text_chunks

TRAIN_ROWS = 16_000
SIZES, BITS = (4, 5, 6), 20
SMOOTHING, MIN_Z, THRESHOLD = 0.5, 3.0, 0.7
#: L2 penalties that are tried, folds of the training rows (one tells which is best), most passes of a fit, tasks of a pass.
PENALTIES, FOLDS, PASSES, FIT_TASKS = [1e-4, 1e-3, 1e-2], 5, 40, 6

_BASE = 0x9E3779B97F4A7C15


@functools.cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of each code point below 2**16, where it is one such too, and which are letters or marks of letters."""
    low = np.arange(1 << 16, dtype=np.uint32)
    letter = np.zeros(1 << 16, bool)
    for c in range(1 << 16):
        x = chr(c).lower()
        if len(x) == 1:
            low[c] = ord(x)
        letter[c] = unicodedata.category(x[0])[0] in "LM"
    return low, letter


def _code_points(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts, and the offsets in them."""
    if not (buf >= 128).any():
        return buf.astype(np.uint32), off
    first = np.flatnonzero((buf & 0xC0) != 0x80)
    lead = buf[first]
    size = 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
    code = (lead & np.array([0, 0x7F, 0x1F, 0x0F, 0x07], np.uint8)[size]).astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        code[more] = code[more] << np.uint32(6) | (buf[np.minimum(first[more] + k, len(buf) - 1)] & 0x3F)
    return code, np.searchsorted(first, off)


def _features(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) of each n-gram, repeats included, for each n. A blank is set before every text."""
    code, off = _code_points(buf, off)
    lower, letters = _characters()
    # Characters from 2**16 on are letters without case.
    near = np.minimum(code, 0xFFFF)
    letter = letters[near] | (code > 0xFFFF)
    low = np.where(letter, np.where(code > 0xFFFF, code, lower[near]), 32).astype(np.uint32)
    n = len(off) - 1
    # One blank before the first character of each text, which may be empty.
    padded = np.insert(low, off[:-1], 32)
    is_letter = np.insert(letter, off[:-1], False)
    starts = off[:-1] + np.arange(n)
    # Of a run of anything else the first stays.
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[starts] = True
    at = np.flatnonzero(keep)
    x = padded[at].astype(np.uint64)
    cut = np.append(np.searchsorted(at, starts), len(at))
    doc = np.repeat(np.arange(n), np.diff(cut))
    g, done, scale = np.zeros(len(x), np.uint64), 0, 1
    for size in SIZES:
        for k in range(done, size):
            if k < len(x):
                g[: len(x) - k] += x[k:] * np.uint64(scale)
            scale = scale * _BASE % (1 << 64)
        done = size
        m = len(x) - size + 1
        if m <= 0:
            continue
        same = doc[:m] == doc[size - 1 :]
        yield doc[:m][same], (mix64(g[:m][same] + np.uint64(size)) >> np.uint64(64 - BITS)).astype(np.int64)


def _distinct(doc: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(doc << BITS | bucket)
    return both >> BITS, both & ((1 << BITS) - 1)


def _all_features(buf: np.ndarray, off: np.ndarray, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, bucket); of: the buckets that count."""
    parts = [(d, b) if of is None else (d[of[b]], b[of[b]]) for d, b in _features(buf, off)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _distinct(np.concatenate([d for d, _ in parts]), np.concatenate([b for _, b in parts]))


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(3)) == 1


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, toxic, n) of about so many labelled documents that are not held out; n: how often it has this label."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n"))
    share = rows / max(1, usable.count())
    if share < 1:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id")  # about ``rows`` rows, however often one is labelled


def log_count_ratios(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket r, and whether it is far enough from zero."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, docs = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for b in batches:
            label, times = np.asarray(b.column(1), np.int64), np.asarray(b.column(2), np.int64)
            docs += np.bincount(label, times, minlength=2).astype(np.int64)
            for lo, hi, buf, off in text_chunks(b.column(0)):
                d, k = _all_features(buf, off)
                for y in (0, 1):
                    of = label[lo:hi][d] == y
                    c[y] += np.bincount(k[of], times[lo:hi][d[of]], minlength=1 << BITS).astype(np.int64)
        at = np.flatnonzero(c.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(c[0][at], docs[0])), pa.array(np.append(c[1][at], docs[1]))], ["bucket", "clean", "toxic"])

    counts = train.select("text", "toxic", "n").mapInArrow(run, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = saved(counts, "features")
    n = counts.where("bucket = -1").first()  # this bucket counts documents
    r, used = np.zeros(1 << BITS), np.zeros(1 << BITS, bool)
    if n is None or not n["clean"] or not n["toxic"]:
        return r, used
    a = SMOOTHING
    ratio = F.log((F.col("toxic") + a) / (n["toxic"] + 2 * a)) - F.log((F.col("clean") + a) / (n["clean"] + 2 * a))
    error = F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("clean") + a))
    far = counts.where("bucket >= 0").select("bucket", ratio.alias("r"), error.alias("e")).where(F.abs("r") > MIN_Z * F.col("e"))
    far = far.select(F.col("bucket").cast("int"), "r").toArrow()  # 2**BITS rows at most
    at = np.asarray(far["bucket"])
    r[at], used[at] = np.asarray(far["r"]), True
    return r, used


class Lbfgs:
    """Minimises a smooth convex function whose values and gradients are worked out elsewhere, at ``trial``."""

    def __init__(self, w: np.ndarray, memory: int = 8):
        self.w = self.trial = w
        self.memory, self.pairs, self.f, self.g, self.done = memory, [], None, None, False

    def tell(self, f: float, g: np.ndarray) -> None:
        """Value and gradient at ``trial``: it is taken if it is low enough, else the next one is nearer."""
        if self.f is not None and f > self.f + 1e-4 * self.step * self.slope:
            self.step *= 0.3
            self.done = self.step < 1e-6
        else:
            if self.f is not None:
                s, y = self.trial - self.w, g - self.g
                if s @ y > 1e-12:
                    self.pairs = [*self.pairs, (s, y)][-self.memory :]
                self.done = self.f - f < 1e-7 * max(1.0, abs(f))
            self.w, self.f, self.g = self.trial, f, g
            self.way = -self._times(g)
            self.slope = float(self.way @ g)
            self.step = 1.0 if self.pairs else min(1.0, 1 / (np.linalg.norm(g) + 1e-12))
        self.trial = self.w + self.step * self.way

    def _times(self, g: np.ndarray) -> np.ndarray:
        """The inverse of the curvature that was met so far, times g."""
        g, kept = g.copy(), []
        for s, y in reversed(self.pairs):
            a = s @ g / (s @ y)
            kept.append(a)
            g -= a * y
        if self.pairs:
            s, y = self.pairs[-1]
            g *= s @ y / (y @ y)
        for (s, y), a in zip(self.pairs, reversed(kept)):
            g += s * (a - y @ g / (s @ y))
        return g


def gradients(rows: DataFrame, points: np.ndarray, scale: np.ndarray, fold: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Logistic loss and gradient of each point (weights, then the intercept), summed over rows (y, n, fold, k), and the loss of fold ``fold``,
    which is not among them; and both sets' numbers of rows. A task sends one sum for each point."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((points, scale))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, scale = shared.value
        g, loss, count = np.zeros_like(w), np.zeros((2, len(w))), np.zeros(2)
        for b in batches:
            y, n = np.asarray(b.column(0)).astype(float), np.asarray(b.column(1)).astype(float)
            away = np.asarray(b.column(2)) == (-1 if fold is None else fold)
            size = np.asarray(pa.compute.list_value_length(b.column(3)))
            row, col = np.repeat(np.arange(len(y)), size), b.column(3).flatten().to_numpy()
            val = scale[col]
            count += [n[~away].sum(), n[away].sum()]
            for i in range(len(w)):
                z = np.clip(np.bincount(row, val * w[i][col], minlength=len(y)) + w[i][-1], -40, 40)
                each = n * (np.log1p(np.exp(z)) - y * z)
                loss[:, i] += [each[~away].sum(), each[away].sum()]
                e = np.where(away, 0.0, n * (1 / (1 + np.exp(-z)) - y))
                g[i][:-1] += np.bincount(col, val * e[row], minlength=len(scale))
                g[i][-1] += e.sum()
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in (g, loss, count)], ["g", "loss", "count"])

    got = rows.select("y", "n", "fold", "k").mapInArrow(run, "g binary, loss binary, count binary").collect()  # FIT_TASKS rows
    shared.unpersist()
    g, loss, count = (sum(np.frombuffer(r[c]) for r in got) for c in ("g", "loss", "count"))
    return loss.reshape(2, -1)[0], g.reshape(points.shape), loss.reshape(2, -1)[1], count


def fit(rows: DataFrame, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression with an L2 penalty, which is the one of PENALTIES that is best on fold 0 of the rows."""
    low = [Lbfgs(np.zeros(len(scale) + 1)) for _ in PENALTIES]

    def descend(low: list[Lbfgs], penalties: list[float], fold: int | None) -> np.ndarray:
        """Passes over all rows; the loss of the fold left out at each end."""
        away = np.full(len(low), np.inf)
        for _ in range(PASSES):
            loss, g, other, (n, m) = gradients(rows, np.stack([x.trial for x in low]), scale, fold)
            for i, (x, p) in enumerate(zip(low, penalties)):
                if not x.done:
                    w = np.append(x.trial[:-1], 0.0)
                    before = x.f
                    x.tell(loss[i] / max(n, 1) + p / 2 * (w @ w), g[i] / max(n, 1) + p * w)
                    if before is None or x.f != before:
                        away[i] = other[i] / max(m, 1)
            if all(x.done for x in low):
                break
        return away

    best = int(np.argmin(descend(low, PENALTIES, 0)))
    last = Lbfgs(low[best].w)
    descend([last], [PENALTIES[best]], None)
    return last.w[:-1], float(last.w[-1])


def train_model(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float | None]:
    """Weight of each bucket, and the intercept (None: no labels of both kinds)."""
    train = training_rows(docs, labels)
    r, used = log_count_ratios(train)
    weights = np.zeros(1 << BITS, np.float32)
    index = np.flatnonzero(used)
    shared = docs.sparkSession.sparkContext.broadcast((used, np.cumsum(used, dtype=np.int32) - 1))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, place = shared.value
        for b in batches:
            for lo, hi, buf, off in text_chunks(b.column(0)):
                d, k = _all_features(buf, off, used)
                cut = np.searchsorted(d, np.arange(hi - lo + 1))
                lists = [place[k[i:j]] for i, j in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([b.column(c).slice(lo, hi - lo) for c in (1, 2, 3, 4)] + [pa.array(lists, pa.list_(pa.int32()))], ["y", "n", "fold", "h", "k"])

    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    rows = train.select("text", "toxic", "n", fold.alias("fold"), F.xxhash64("doc_id").alias("h")).mapInArrow(run, "y int, n long, fold int, h long, k array<int>")
    # Dealt and ordered by what is in them, so that sums are the same in every run; copies of a text go to all tasks.
    rows = saved(rows.repartition(FIT_TASKS, "h").sortWithinPartitions("h", "y", "n"), "training-rows")
    kinds = rows.agg(F.min("y"), F.max("y")).first()
    if kinds[0] is None or kinds[0] == kinds[1]:
        return weights, None
    w, b = fit(rows, r[index])
    discard(rows)
    weights[index] = w * r[index]
    return weights, b


def score(docs: DataFrame, weights: np.ndarray, intercept: float | None) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        used = w != 0
        for b in batches:
            for lo, hi, buf, off in text_chunks(b.column(1)):
                d, k = _all_features(buf, off, used)
                z = np.bincount(d, w[k].astype(np.float64), minlength=hi - lo) + (intercept or 0.0)
                p = np.zeros(hi - lo) if intercept is None else 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(p)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, *train_model(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
