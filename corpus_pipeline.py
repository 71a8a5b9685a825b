"""A training corpus in five stages: toxicity, near-duplicates, decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import mixing, sharding, simhash, toxicity, winnow
from skein.plans.storage import drop, save


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold (see ``toxicity.drop_toxic``): empty texts are scored too, rows without an id or repeated ones each by themselves."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (see ``simhash.keep_one``): empty texts are one group, rows without an id stay."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item (see ``winnow.clean``): empty texts share none, an empty benchmark keeps all."""
    return winnow.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in order of training position (see ``mixing.mixed``): empty texts are never taken, a null source is a source."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot (see ``sharding.sharded``); columns of these names are replaced."""
    return sharding.sharded(docs)


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: A network's scores and XXH64 fingerprints are beyond SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; a stage's table is deleted once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        done = save(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
