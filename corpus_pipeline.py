"""Documents to shards in five stages, each written as Parquet and read again by the next.

quality       documents that the quality classifier rejects go
near_dups     of each class of near-duplicate documents (five-word shingles,
              similarity 0.8 or more) the one with the least id stays
decontaminate documents with an eight-word window of any benchmark item go
mix           sources are taken to their target weights, at most three times over
shard         every document gets its shard; the last stage adds the columns
              n_bytes, shard and shard_bytes (with an underscore behind them
              where the documents have such a column)

The first three only ever drop rows, so documents that no rule is against stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _core as core
from tessera.llm import decontamination, mixing, quality, sharding, similarity


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    machine = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = core.fresh(docs.columns, "__score")
    return quality.score(docs, machine, docs.columns, score).where(F.col(score) >= quality.THRESHOLD).drop(score)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similarity.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), most=0)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = core.fresh(docs.columns, "n_bytes", "shard", "shard_bytes")
    placed = sharding.assign(docs)
    return placed.select("row.*", *(F.col(x).alias(name) for x, name in zip(("n_bytes", "shard", "shard_bytes"), names, strict=True)))


STAGES = [
    ("quality", quality_stage),
    ("near_dups", near_duplicate_stage),
    ("decontaminate", decontamination_stage),
    ("mix", mixing_stage),
    ("shard", sharding_stage),
]

#: A fitted model decides the first stage, which SQL can't express; tests hold the operators against brute force and the stages against planted rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), core.Scratch(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
