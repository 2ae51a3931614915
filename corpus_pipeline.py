"""A corpus pipeline of five stages: toxicity, near duplicates, benchmark decontamination, mixing and sharding.

Each stage is called with the rows that its predecessor kept. All but the last return the columns of ``documents``.
Whatever a column holds (nulls, empty and very long texts, repeated rows, names that operators use inside), a stage
treats it as its operator says; an empty table passes through all of them.
Stages 1 to 3 filter or cut; stage 4 repeats documents of domains that are short of their target and drops none; stage 5
assigns every row to a shard.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parley.llm import decontaminate, jaccard, mixing, sharding, toxicity
from parley.llm.tables import new_folder, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine doesn't call toxic."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of sets of five-word shingles that are alike by 80 % or more, the one with the smallest doc_id."""
    return jaccard.without_copies(docs, size=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their benchmark passages; documents mostly made of them go."""
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated at their fitted rates, each at least once."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"), least=1.0)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and place of every row."""
    return sharding.shard(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("jaccard", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Trained and iterative stages can't be written in SQL; tests compare each stage with a brute-force version on its own input,
#: and run() row by row with the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
