"""Corpus preparation in five stages: language, near copies, benchmark leaks, mixture, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkforge.llm import bagminhash, decontam, langid, mixing, sharding
from linkforge.llm.common import materialize


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; the filters come from the stage's own labelled rows."""
    return langid.drop_unknown(docs, langid.learn(docs))


def keep_first_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate class."""
    return bagminhash.drop_copies(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark table."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the amounts that the sources' target weights give."""
    return mixing.mixed_documents(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with n_bytes, depth and shard."""
    return sharding.shards(docs)


STAGES = [
    ("language_id", keep_known_language),
    ("near_dedup", keep_first_of_copies),
    ("decontaminate", keep_uncontaminated),
    ("mix", mix_sources),
    ("shard", deal_shards),
]

#: SQL can express neither learned filters nor hashed draws; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
