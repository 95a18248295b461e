"""From raw documents to a sharded training corpus: quality rules, near duplicates, benchmark decontamination, mixing, sharding.

Defined results of all stages: a null text has no words, fails the base rules and leaves with the first stage, as empty and blank ones do; a null id is a document like any other; rows equal
in id and text are one document to the near-duplicate stage, which keeps one of them, and rows that share an id with different texts are judged apart; other columns, whatever
their names, are handed on by all stages but the last; an empty table of documents gives no rows, and without labels or benchmark items a stage uses its base rules or keeps all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaero.llm import decontaminate, mixing, ngram_join, ring_shards, rule_lists
from quaero.llm.common import ready_to_checkpoint


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the list learned from the labelled ones among them. Labels with a null id or quality are not used; without any the base rules decide."""
    return rule_lists.accepted(docs, rule_lists.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a similarity of 0.8 or more. Documents without a word are linked with none and stay."""
    return ngram_join.one_of_each(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less than a twentieth of whose words stand in windows of benchmark items. Items without a word have no window; documents without one stay."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as their source's target weight takes them. A null source is one of its own, last; ties of hash keys are ordered by id and text."""
    return mixing.materialise(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard and place in it; of repeated rows each gets a place."""
    return ring_shards.shard_documents(docs, 8).withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixture),
    ("sharding", sharding),
]

#: Hashes of several stages have no counterpart in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is cut from its lineage in the shared checkpoint folder."""
    ready_to_checkpoint(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).checkpoint()
    return STAGES[-1][1](spark, docs, sf_dir)
