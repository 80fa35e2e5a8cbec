"""The operators over their whole tables, as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm import backoff_lm, conversation_repair, decontaminate, html_wrapper, importance, licenses, mixing, near_dedup, ngram_llr, quality_qda, repeated_text, secret_scan, toxicity_knn
from logspark.llm.common import documents, table


def quality_held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 4 == 2


def op1_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.scores(documents(spark, sf_dir))


def op2_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_qda.quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"), quality_held_out)


def op3_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = lambda doc_id: F.crc32(doc_id.cast("string")) % 3 == 1
    return toxicity_knn.toxicity_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"), held_out)


def op4_benchmark_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op5_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.main_texts(table(spark, sf_dir, "pages"))


def op6_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(secret_scan.secrets(documents(spark, sf_dir)))


def op7_mixing_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(*mixing.mix(documents(spark, sf_dir))).drop("row")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op9_ngram_likelihood_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted are the documents labelled as of high quality."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return ngram_llr.quality_rules(documents(spark, sf_dir), trusted)


def op10_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_text.repeated_text(documents(spark, sf_dir)).drop("spans")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired(table(spark, sf_dir, "conversations"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_backoff_scores,
        op2_quality_discriminant,
        op3_toxicity_neighbours,
        op4_benchmark_alignment,
        op5_wrapper_extraction,
        op6_secret_ownership,
        op7_mixing_tree,
        op8_minhash_near_dedup,
        op9_ngram_likelihood_ratio,
        op10_license_digests,
        op11_suffix_dedup,
        op12_conversation_repair,
        op13_importance_resampling,
    )
}
ORACLE: dict[str, str] = {
    "op10_license_digests": licenses.duckdb_sql(),
    "op11_suffix_dedup": repeated_text.duckdb_sql(),
    "op12_conversation_repair": conversation_repair.duckdb_sql(),
    "op13_importance_resampling": importance.duckdb_sql(),
}
