"""The registered queries of the training-data operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import decontaminate, filter_audit, jaccard, language_model, licenses, line_dedup, mixing, oracles, phrases, quality, secrets, sharding, substrings, toxicity
from parley.llm.tables import table


def op1_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op4_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = language_model.scores(table(spark, sf_dir, "documents"))
    return scores.withColumns({"score": F.round("score", 4), "mean_score": F.round("mean_score", 6)})


def op5_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_jaccard_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("node", "label")


def op7_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, sf_dir, "documents"))


QUERIES = (
    op1_quality_llr,
    op2_secret_ledger,
    op3_license_scan,
    op4_stupid_backoff,
    op5_soft_mixing,
    op6_jaccard_trie,
    op7_toxicity_fm,
    op8_virtual_slots,
    op9_suffix_automaton,
    op10_suffix_dedup,
    op11_filter_audit,
    op12_phrase_mining,
    op13_line_dedup,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op2_secret_ledger": secrets.ORACLE_SQL, "op4_stupid_backoff": oracles.BACKOFF, "op6_jaccard_trie": oracles.JACCARD, "op9_suffix_automaton": oracles.DECONTAMINATION, "op10_suffix_dedup": oracles.SUBSTRINGS,
            "op11_filter_audit": filter_audit.ORACLE_SQL, "op12_phrase_mining": phrases.ORACLE_SQL, "op13_line_dedup": line_dedup.ORACLE_SQL}
