"""Operator 10: language identification by Bayesian evidence fusion.

Evidence of a document or page: the likelihood of its text under each language (hashed byte 4-gram models), the language
that its mark-up declares, the suffix of its address, and a prior of its host. The likelihood models are trained on the
``lang`` column of a bounded sample of each language's documents; how far declarations and suffixes can be trusted, and the priors of hosts,
follow from grouped aggregates over all rows: expected language counts by host, smoothed towards those of the host's
suffix, smoothed towards those of all rows. A row's own part is taken out of its host's counts.

A row is rejected (language "und") if no language of the model has a posterior of MIN_POSTERIOR, or if its text is further
from every language than -MIN_GAIN nats a gram below grams drawn evenly, GAIN_WEIGHT even grams being added so that a few
letters alone don't show this. Rows without letters have no text evidence; they are rejected whatever their mark-up says.

Defined cases: null or empty texts are rejected, as are texts without letters; a null host, suffix or declaration is no
evidence, not a value of its own; equal posteriors go to the first language by name; repeated rows get equal answers; an
empty table gives an empty result; without any labelled row every row is rejected; other columns, of whatever name, are
carried through by ``stage`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, join_small, saved, table, unused
from .textarrays import LOWER, frugal, mix64, text_chunks

#: Of each language about so many labelled documents, those of small hash, are what its likelihood model is fitted on.
TRAIN_ROWS = 4000
GRAM, BITS = 4, 16
#: Overlapping grams are not independent: a byte counts as this much evidence, and a whole text as at most CEILING nats.
PER_BYTE, CEILING = 0.25, 60.0
MIN_POSTERIOR, MIN_GAIN, GAIN_WEIGHT = 0.5, -2.0, 8
#: Weights, in rows, of the suffix's prior in a host's and of the overall prior in a suffix's.
HOST_WEIGHT, SUFFIX_WEIGHT, DECLARED_WEIGHT = 20.0, 50.0, 5.0

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def _grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the gram that ends at each kept byte; by text, its first byte and gram (with the ends); which bytes end a gram.

    Runs of other bytes are one blank each, so that punctuation and digits carry no evidence. A text with a letter gets two
    blanks before and one after it, so that it has a gram.
    """
    low = LOWER[buf]
    letter = _LETTER[low]
    low = np.where(letter, low, 32).astype(np.uint8)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    begin = off[:-1][off[:-1] < len(buf)]
    keep[begin] = letter[begin]
    at = np.flatnonzero(keep)
    kept = np.searchsorted(at, off)
    size = np.diff(kept)
    some = size > 0
    after = np.zeros(len(size), np.int64)
    after[some] = letter[at[kept[1:][some] - 1]]
    cut = np.concatenate([[0], np.cumsum(size + 2 * some + after)])
    n = int(cut[-1])
    x = np.full(n, 32, np.uint64)
    x[np.arange(len(at)) + np.repeat(cut[:-1] + 2 - kept[:-1], size)] = low[at]
    g = np.zeros(n, np.uint64)
    for k in range(GRAM if n >= GRAM else 0):
        g[GRAM - 1 :] = (g[GRAM - 1 :] << np.uint64(8)) | x[k : n - GRAM + 1 + k]
    ok = np.ones(n, bool)
    for k in range(GRAM - 1):
        starts = cut[:-1] + k
        ok[starts[starts < cut[1:]]] = False
    return (mix64(g) >> np.uint64(64 - BITS)).astype(np.int64), np.stack([cut, np.concatenate([[0], np.cumsum(ok)])[cut]]), ok


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and the log probability of each bucket in each; the last column is of random letters."""
    labelled = docs.where("lang is not null and text is not null and lang <> ''")
    labelled = labelled.select("lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("__h"))
    quota = labelled.groupBy("lang").agg(F.count("*").alias("__n"), F.min("__h").alias("__least"))
    quota = saved(quota.select("lang", "__least", F.ceil(F.lit(float(rows << 30)) / F.col("__n")).alias("__below")), "quotas")
    labelled = join_small(labelled, quota, ["lang"], "inner")
    # A language of few different rows, each repeated often, can have none below its threshold; it gives the least once.
    least = labelled.where("__h = __least and __least >= __below").select("lang", "text").dropDuplicates()
    labelled = labelled.where("__h < __below").select("lang", "text").unionByName(least)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = np.array(b.column(0).to_pylist(), object)
            for lo, hi, buf, off in text_chunks(b.column(1)):
                g, (cut, _), ok = _grams(buf, off)
                for name in sorted(set(lang[lo:hi])):
                    mine = np.repeat(lang[lo:hi] == name, np.diff(cut)) & ok
                    c = np.bincount(g[mine], minlength=1 << BITS)
                    at = np.flatnonzero(c)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(c[at])], ["lang", "bucket", "n"])

    got = labelled.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = got.toPandas()  # 2**BITS buckets a language at most
    langs = sorted(got["lang"].unique())
    counts = np.zeros((1 << BITS, len(langs)))
    for k, name in enumerate(langs):
        part = got[got["lang"] == name]
        counts[part["bucket"].to_numpy(), k] = part["n"].to_numpy()
    p = (counts + 0.1) / (counts.sum(axis=0) + 0.1 * (1 << BITS)) if langs else counts
    return langs, np.log(p).astype(np.float32) if langs else p.astype(np.float32)


def likelihoods(rows: DataFrame, langs: list[str], logs: np.ndarray) -> DataFrame:
    """Replace ``text`` by ``ll``, a log likelihood for each language relative to uniform grams, and ``grams``."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(logs)
    keep = [c for c in rows.columns if c != "text"]
    uniform = -np.log(1 << BITS)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for lo, hi, buf, off in text_chunks(b.column("text")):
                g, (cut, upto), ok = _grams(buf, off)
                n = np.diff(upto)
                g = g[ok]
                ll = np.zeros((hi - lo, model.shape[1]))
                first = upto[:-1][n > 0]
                if len(first):
                    for k in range(model.shape[1]):
                        ll[n > 0, k] = np.add.reduceat(model[:, k][g].astype(np.float64) - uniform, first)
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c).slice(lo, hi - lo) for c in keep], pa.array(list(ll), pa.list_(pa.float64())), pa.array(n)], [*keep, "ll", "grams"]
                )

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{fields}, ll array<double>, grams long")


def _softmax(x) -> F.Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, w: a + w))


def _sums(col: str, k: int) -> list[F.Column]:
    return [F.sum(F.col(col)[i]).alias(f"n{i}") for i in range(k)]


def fuse(rows: DataFrame, langs: list[str], logs: np.ndarray) -> DataFrame:
    """rows: text, host, suffix, declared and any columns besides -> these without text, with language, posterior, rejected."""
    k = len(langs)
    if not k:
        return rows.drop("text").withColumns({"language": F.lit("und"), "posterior": F.lit(0.0), "rejected": F.lit(True)})
    scored = likelihoods(rows, langs, logs)
    scale = F.least(F.lit(PER_BYTE), F.lit(CEILING) / F.greatest(F.lit(1e-9), F.array_max("ll") - F.array_min("ll")))
    scored = scored.withColumn("ev", F.transform("ll", lambda v: v * scale)).withColumn("text_p", _softmax(F.col("ev")))
    scored = saved(scored, "evidence")
    # Rows without grams say nothing of their host.
    solid = scored.where("grams > 0")
    everything = solid.agg(*_sums("text_p", k)).first()
    total = np.array([everything[i] or 0.0 for i in range(k)]) + 1.0
    overall = F.array(*[F.lit(float(x)) for x in total / total.sum()])

    def counts(*keys: str) -> DataFrame:
        c = solid.where(" and ".join(f"{x} is not null" for x in keys)).groupBy(*keys).agg(*_sums("text_p", k))
        return c.select(*keys, F.array(*[F.col(f"n{i}") for i in range(k)]).alias("n_" + keys[0]))

    hosts, suffixes, words = saved(counts("host"), "hosts"), saved(counts("suffix"), "suffixes"), saved(counts("declared"), "declared")
    out = join_small(join_small(join_small(scored, hosts, ["host"]), suffixes, ["suffix"]), words, ["declared"])
    zero = F.array(*[F.lit(0.0)] * k)
    own = F.when(F.col("grams") > 0, F.col("text_p")).otherwise(zero)
    less = lambda c: F.transform(F.arrays_zip(F.coalesce(c, zero).alias("x"), own.alias("y")), lambda z: F.greatest(F.lit(0.0), z["x"] - z["y"]))
    mass = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)

    def smooth(n, prior, weight: float):
        return F.transform(F.arrays_zip(n.alias("x"), prior.alias("y")), lambda z: (z["x"] + weight * z["y"]) / (mass(n) + weight))

    out = out.withColumns({"hn": F.when(F.col("host").isNull(), zero).otherwise(less(F.col("n_host"))), "sn": F.when(F.col("suffix").isNull(), zero).otherwise(less(F.col("n_suffix")))})
    out = out.withColumn("sp", smooth(F.col("sn"), overall, SUFFIX_WEIGHT))
    out = out.withColumn("hp", smooth(F.col("hn"), F.col("sp"), HOST_WEIGHT))
    # P(declared | language), up to a factor that is the same for all languages.
    dn = F.when(F.col("declared").isNull(), zero).otherwise(less(F.col("n_declared")))
    out = out.withColumn("dn", dn)
    chance = F.transform(F.arrays_zip(F.col("dn").alias("x"), overall.alias("y"), F.array(*[F.lit(float(x)) for x in total]).alias("t")), lambda z: (z["x"] + DECLARED_WEIGHT * z["y"]) / (z["t"] + DECLARED_WEIGHT))
    out = out.withColumn("dp", F.when(F.col("declared").isNull(), F.array(*[F.lit(1.0)] * k)).otherwise(chance))
    logp = F.transform(F.arrays_zip("ev", "hp", "dp"), lambda z: z["ev"] + F.log(z["hp"]) + F.log(z["dp"]))
    out = out.withColumn("post", _softmax(logp))
    best = F.array_max("post")
    name = F.array(*[F.lit(x) for x in langs])[F.array_position("post", best).cast("int") - 1]
    # Grams drawn evenly, as of random letters, are about six nats below this for a language that was trained.
    gain = F.array_max("ll") / (F.col("grams") + GAIN_WEIGHT)
    rejected = (F.col("grams") == 0) | (best < MIN_POSTERIOR) | (gain <= MIN_GAIN)
    drop = ["ll", "ev", "text_p", "n_host", "n_suffix", "n_declared", "hn", "sn", "sp", "hp", "dn", "dp", "post", "grams"]
    out = out.withColumns({"rejected": rejected, "posterior": F.round(best, 6), "language": F.when(rejected, "und").otherwise(name)})
    return out.drop(*drop)


def page_rows(pages: DataFrame) -> DataFrame:
    """page_id, text, host, suffix, declared of raw web pages."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    body = F.regexp_replace("html", r"(?is)<(script|style|nav)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#a-z0-9]+;", " ")
    declared = F.lower(F.regexp_extract("html", r"(?is)<html[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1))
    null = lambda c: F.when(c != "", c)
    return pages.select("page_id", body.alias("text"), null(host).alias("host"), null(F.element_at(F.split(host, r"\."), -1)).alias("suffix"), null(declared).alias("declared"))


def document_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Key, text, host, suffix, declared of documents: the source stands for a host, the lang column is the declaration."""
    return docs.select(key, "text", F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"), F.lower("lang").alias("declared"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = train(docs)
    both = document_rows(docs).withColumn("page_id", F.lit(None).cast("long")).unionByName(page_rows(pages).withColumn("doc_id", F.lit(None).cast("long")))
    return fuse(both, *model).select("doc_id", "page_id", "host", "declared", "language", "posterior", "rejected")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is known."""
    bounded_batches(spark)
    key = F.to_json(F.struct(F.xxhash64("doc_id", "text", "lang", "source"), F.xxhash64("source", "text", F.lit(1), "lang", "doc_id")))
    (name,) = unused(docs, "__key")
    keyed = docs.withColumn(name, key)
    bad = saved(fuse(document_rows(keyed, name), *train(docs)).where("rejected").select(name).distinct(), "rejected")
    return join_small(keyed, bad, [name], "left_anti").select(*docs.columns)
