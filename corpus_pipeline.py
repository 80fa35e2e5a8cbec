"""From raw documents to a mixed training corpus: five stages, each on what the one before it kept.

Stages judge row by row, also where ``doc_id`` is null or repeats. Empty tables give empty results of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm import decontaminate, mixing, near_dedup, quality_qda, secret_scan
from logspark.llm.common import documents, flag_among, numbered, save_and_read, table
from logspark.llm.queries import quality_held_out

#: Word shingles in common of near duplicates, percent; the query op8 has a contract of its own. A pair at 0.8 misses all bands with probability
#: (1 - 0.8**6)**48, below 1e-6.
PERCENT, BANDS = 80, 48


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality_qda.keep_good(docs, table(spark, sf_dir, "labels"), quality_held_out)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the least id (null last). Rows without words are no copies.

    Only rows that may be copies meet the list of copies; all others stay where they are.
    """
    rows = numbered(docs, "near")
    found = near_dedup.near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text"), PERCENT, BANDS).select(F.col("doc_id").alias("__row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "__row").alias("order")
    group = rows.select("__row", order).join(found, "__row").groupBy("component_id")
    least = group.agg(F.min("order").alias("least"), F.count("*").alias("n")).where("n > 1").select("component_id", F.col("least.__row").alias("first"))
    copies = save_and_read(found.join(least, "component_id").where("__row <> first").select("__row"), "near-copies")
    rows = flag_among(rows, "__row", copies, "__copy")
    kept = rows.where("not __copy").unionByName(rows.where("__copy").join(copies, "__row", "left_anti"))
    return kept.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; live-looking credentials are replaced."""
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    sized, goals, taken = mixing.mix(docs)
    return mixing.taken_words(sized, goals, taken).drop("row")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixture", mixture),
]
#: Not expressible in SQL: the fit, the signatures and the alignments.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = save_and_read(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
