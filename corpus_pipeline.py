"""A training-data pipeline: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from requill.llm import bpe, decontam, neardup, rules, secrets
from requill.llm.common import cut, numbered
from requill.llm.queries import table, vocabulary_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules reject go, those without words among them; a verdict stays with its row, whatever the id."""
    return rules.kept_documents(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: that of the least doc_id, and of equal ids the first; null ids come last.

    Rows are told apart by a number of their own, so repeats of a row go too and
    rows without an id are looked at like others. Rows without words stay.
    """
    rows = numbered(docs.select(*COLUMNS), "row")
    groups = neardup.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("row").alias("c"))
    first = groups.join(rows.select("row", "doc_id"), "row").groupBy("group").agg(F.min(order)["c"].alias("row"))
    return rows.join(first, "row", "left_semi").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go; those with a few words of it stay whole."""
    return decontam.clean_documents(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked, and n_chars follows the new text."""
    masked = secrets.redact(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, beside what identifies and checks them; lang and source have served by now, as they chose nothing."""
    return bpe.encode_decode(docs, vocabulary_path(), with_ids=True).drop("decoded")


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("secret_scan", secret_scan), ("bpe", encode)]

#: SQL can't say these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is checkpointed, so that none is computed twice."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
