"""Joins with a side that is usually small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast. Beyond it the join is left to Spark, whose adaptive plan splits skewed keys.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it was counted to have at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """A table in fewer partitions than there are cores is dealt to all of them; one of more is left as it lies."""
    return df.repartition(*df.columns) if df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism else df
