"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

1. Language ID: documents whose language is unknown go.
2. Near-dedup: one document of each group stays; near copies share 0.8 of their five-word shingles or more.
3. Benchmark decontamination: documents that hold an item of the benchmark go.
4. Mixing: each source gives its share by weight; documents that the mix takes more than once are repeated.
5. Token ids: what is left is tokenised, written as entropy-coded shards and read back.

A failed job can be run again from any stage: a stage reads only what the one before it has written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontam, langid, mixing, simhash, tokenids
from lodestone.llm.common import shared_dir, table

STAGES = [
    ("language_id", langid.stage),
    ("simhash_near_dedup", simhash.stage),
    ("benchmark_decontamination", decontam.stage),
    ("source_mixing", mixing.stage),
    ("token_ids", tokenids.stage),
]

#: SQL has neither the classifier nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, base = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
