"""Operator 2: mix sources to target weights by nested hash-threshold histograms.

Words are summed by source and hash bucket; for each source the bucket in which the budget runs out is found and only that
bucket is refined, 12 bits of a 60-bit hash at a time, until it holds one hash value. A document's share then follows from
one comparison of its hash with its source's threshold: nothing is sorted, no document meets another.

Defined cases: a null text has no words; the hash is of id and text, so repeated rows are taken alike and rows whose id is
null are still told apart by text; a null source is a source of its own, last in order; an empty table gives an empty
mix; other columns, of whatever name, are carried through untouched by ``stage``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, join_small, saved, table

#: By rank of the source in code-point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
HASH_BITS, LEVEL_BITS = 60, 12

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def doc_hash(doc_id, text) -> F.Column:
    """60 bits of an MD5 of id and text."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> the same with target: shares by weight of all words, none above max_epochs sizes.

    One row for each source; the two windows order sources, never documents. A source is held at its cap when its share,
    after all sources with a smaller cap for their weight are held at theirs, is still above it.
    """
    rank = Window.orderBy(F.col("source").isNull(), "source")
    w = F.lit(weights[0])
    for i, x in enumerate(weights[1:], 1):
        w = F.when(F.pmod("r", F.lit(len(weights))) == i, x).otherwise(w)
    s = sizes.withColumn("r", F.row_number().over(rank) - 1).withColumn("w", w)
    s = s.withColumn("ratio", (F.col("source_size") * max_epochs).cast("double") / F.col("w"))
    order = Window.orderBy("ratio", "r")
    s = s.withColumns({
        "held": F.coalesce(F.sum(F.col("source_size") * max_epochs).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "left_w": F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        "total": F.sum("source_size").over(Window.partitionBy()),
    })
    s = s.withColumn("level", (F.col("total") - F.col("held")).cast("double") / F.col("left_w"))
    free = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "r")))
    s = s.withColumn("lam", free.over(Window.partitionBy()))
    target = F.least((F.col("source_size") * max_epochs).cast("double"), F.col("lam") * F.col("w"))
    return s.select("source", "source_size", target.alias("target"))


def plan_mix(narrow: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, size, h) rows -> for each source its target, whole epochs and the hash threshold of the extra one."""
    sizes = narrow.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    t = targets(sizes, weights, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = t.withColumn("epochs", epochs).withColumns({
        "left": F.col("target") - F.col("epochs") * F.col("source_size"),
        "prefix": F.lit(0).cast("long"),
        "threshold": F.lit(None).cast("long"),
    })
    state = saved(state, "mix")
    n = state.count()
    for level in range(HASH_BITS // LEVEL_BITS):
        if not state.where("threshold is null").count():
            break
        above, shift = HASH_BITS - LEVEL_BITS * level, HASH_BITS - LEVEL_BITS * (level + 1)
        open_ = state.where("threshold is null").select("source", "prefix")
        rows = join_small(narrow.select("source", "size", "h"), open_, ["source"], "inner", rows=n)
        rows = rows.where(F.shiftright("h", above) == F.col("prefix")).withColumn("bucket", F.shiftright("h", shift))
        hist = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        upto = Window.partitionBy("source").orderBy("bucket")  # at most 4096 buckets a source
        hist = hist.withColumn("cum", F.sum("words").over(upto))
        over = join_small(hist, state.where("threshold is null").select("source", "left"), ["source"], "inner", rows=n).where("cum > left")
        edge = over.groupBy("source").agg(F.min_by(F.struct("bucket", "words", "lo", "hi", (F.col("left") - F.col("cum") + F.col("words")).alias("rest")), "bucket").alias("e"))
        new = join_small(state, edge, ["source"], rows=n)
        # One hash value is left: it is in if that brings the sum nearer. No such bucket: the whole source is in.
        one = F.when(F.col("e").isNull(), F.lit((1 << HASH_BITS) - 1)).when(F.col("e.lo") == F.col("e.hi"), F.col("e.lo") - F.when(F.col("e.words") / 2 <= F.col("e.rest"), 0).otherwise(1))
        was = F.col("threshold").isNotNull()
        state = saved(new.select(
            "source", "source_size", "target", "epochs",
            F.when(was | F.col("e").isNull(), F.col("left")).otherwise(F.col("e.rest")).alias("left"),
            F.when(was | F.col("e").isNull(), F.col("prefix")).otherwise(F.col("e.bucket")).alias("prefix"),
            F.when(was, F.col("threshold")).otherwise(one).alias("threshold"),
        ), "mix")
    return state.select("source", "source_size", "target", "epochs", "threshold")


def apply_mix(docs: DataFrame, plan: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add source_size, target and mix_times (how often the mix takes the row) to rows that have source and h."""
    out = join_small(docs, plan, ["source"])
    extra = (F.col("h") <= F.col("threshold")).cast("long")
    return out.withColumn("mix_times", F.least(F.col("epochs") + extra, F.lit(max_epochs).cast("long"))).drop("epochs", "threshold")


def narrowed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), doc_hash(F.col("doc_id"), F.col("text")).alias("h"))


def op2(spark, sf_dir: str) -> DataFrame:
    narrow = saved(narrowed(table(spark, sf_dir, "documents")), "sizes")
    out = apply_mix(narrow, plan_mix(narrow))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("mix_times")).alias("taken"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it takes it."""
    bounded_batches(spark)
    plan = plan_mix(saved(narrowed(docs), "sizes"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "source", doc_hash(F.col("doc_id"), F.col("text")).alias("h"))
    taken = apply_mix(rows, plan).where("mix_times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_times")))).select("row.*")


ORACLE = r"""
with s as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || '|' || coalesce(text, '')), 1, 15) as bigint) as h
  from documents),
src as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source is null, source) - 1 as r
  from s group by source),
w as (select *, case r % 3 when 0 then 5 when 1 then 2 else 1 end as w from src),
x as (select *, cast(source_size * 3 as double) / w as ratio from w),
y as (
  select *, coalesce(sum(source_size * 3) over (order by ratio, r rows between unbounded preceding and 1 preceding), 0) as held,
         sum(w) over (order by ratio, r rows between current row and unbounded following) as left_w,
         sum(source_size) over () as total from x),
z as (select *, cast(total - held as double) / cast(left_w as double) as level from y),
lam as (select arg_min(level, r2) as lam from (select level, row_number() over (order by ratio, r) as r2 from z where level <= ratio)),
t as (select source, source_size, least(cast(source_size * 3 as double), lam * w) as target from z, lam),
e as (select *, cast(case when source_size > 0 then floor(target / source_size) else 0 end as bigint) as epochs from t),
c as (
  select s.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size as rem,
         sum(s.size) over (partition by s.source order by s.h range between unbounded preceding and current row) as cum,
         sum(s.size) over (partition by s.source, s.h) as peers
  from s join e on s.source is not distinct from e.source)
select doc_id, source, size, source_size, target,
       cast(size * least(3, epochs + case when cum <= rem or cum - peers / 2.0 <= rem then 1 else 0 end) as bigint) as taken
from c
"""
