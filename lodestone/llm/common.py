"""Helpers shared by the training-data operators: shared tables, size-checked joins, links to classes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of more rows than this is never broadcast; the join is then salted instead.
BROADCAST_ROWS = 200_000
#: Rows of text in an Arrow batch.
BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Hand texts to Python in smaller batches than Spark's default, unless the session has a setting of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else what the context's checkpoints were set to.

    A local folder of our own stands in only where all run on one machine; on a cluster without either this raises.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = getattr(shared_dir, "own", None)
        if base is None:
            base = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return base.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it none of the table's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``saved`` wrote, after its last reader."""
    for df in tables:
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def join_small(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", rows: int | None = None, salts: int = 16) -> DataFrame:
    """Null-safe join of ``big`` with a table that has one row for each key.

    ``small`` is counted first: up to BROADCAST_ROWS it is broadcast, beyond that both sides are shuffled on the keys and
    a salt, so that a key with a third of all rows is spread over ``salts`` tasks.
    """
    n = small.count() if rows is None else rows
    named = dict(zip(keys, unused(big, *[f"__{k}" for k in keys])))
    right = small.select(*[F.col(f"`{k}`").alias(named[k]) for k in keys], *[c for c in small.columns if c not in keys])
    same = None
    for k in keys:
        cond = big[f"`{k}`"].eqNullSafe(right[f"`{named[k]}`"])
        same = cond if same is None else same & cond
    if n <= BROADCAST_ROWS:
        return big.join(F.broadcast(right), same, how).drop(*named.values())
    salt, other = unused(big, "__salt", "__salt_r")
    # A hash of the row, so that a task that runs again salts its rows as before. Maps have no hash.
    plain = [F.col(f"`{f.name}`") for f in big.schema.fields if "map<" not in f.dataType.simpleString()]
    left = big.withColumn(salt, F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int"))
    right = right.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    same = left[f"`{salt}`"] == right[f"`{other}`"]
    for k in keys:
        same = same & left[f"`{k}`"].eqNullSafe(right[f"`{named[k]}`"])
    return left.join(right, same, how).drop(salt, other, *named.values())


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Connected components of an edge table (a long, b long): one row (node, root) for each node that has an edge.

    Rounds of contraction: each node joins its neighbour of least priority (a hash of the id, so that chains shrink by a
    constant factor), edges are renamed and made distinct, until none is left. Aggregates combine on the map side, joins
    on a node with very many edges can be split by AQE, and each round's tables are written to the shared folder.
    """
    e = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps: list[DataFrame] = []
    for _ in range(max_rounds):
        if e.isEmpty():
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        key = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
        parent = both.groupBy("a").agg(F.min(key("b")).alias("m")).select(F.col("a").alias("node"), F.least(F.col("m"), key("a"))["n"].alias("up"))
        parent = saved(parent, "parents")
        steps.append(parent)
        pa, pb = parent.select(F.col("node").alias("a"), F.col("up").alias("ua")), parent.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        moved = e.join(pa, "a").join(pb, "b").where("ua <> ub")
        e = saved(moved.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError("components did not converge")
    if not steps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[0].withColumnRenamed("up", "root")
    for s in steps[1:]:
        out = out.join(s.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return out
