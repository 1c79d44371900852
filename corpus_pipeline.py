"""The corpus pipeline: documents in, a deduplicated, decontaminated, mixed and sharded corpus out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the docs of the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docspark.llm import bag_minhash, decontaminate, mixing, shard, toxicity
from docspark.plans.staging import stage, unstage

STAGES = [
    ("toxicity", toxicity.reject_toxic),
    ("near-dedup", bag_minhash.drop_near_duplicates),
    ("decontamination", decontaminate.drop_leaks),
    ("mixing", mixing.curriculum),
    ("sharding", shard.write_order),
]

#: Model training and signatures have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, step) in enumerate(STAGES[:-1]):
        before, docs = docs, stage(step(spark, docs, sf_dir), name)
        if n:
            unstage(before)  # a stage before this one wrote it, and nothing reads it again
    return STAGES[-1][1](spark, docs, sf_dir)
