"""The registered queries of this subpackage and, where SQL can say them, their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from requill.llm import bpe, compaction, decontam, grades, lengths, neardup, rules, secrets, substrings, urls
from requill.llm.common import workspace

#: The url rules of the contract, by verdict.
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Where public vocabulary files lie unless REQUILL_TOKENIZERS names another folder.
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    folder = os.environ.get("REQUILL_TOKENIZERS")
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grade_column():
    """0 for toxic, 1 for low quality, 2 for good."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13, percent=5)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.compacted(table(spark, sf_dir, "documents"), workspace(spark))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), window=35)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.length_histogram(lengths.token_lengths(table(spark, sf_dir, "documents"), vocabulary_path()))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary_path())


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grades.grade_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), grade_column(), levels=3, keep_level=2, threshold=0.4)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), urls.rules_frame(spark, URL_RULES))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_secret_scan, op2_minhash_near_dedup, op3_decontamination, op4_sharding, op5_substring_dedup, op6_token_counts, op7_bpe, op8_quality_classifier, op9_url_filter, op10_quality_rules)
    return {f.__name__: f for f in found}


OP9_SQL = r"""
WITH parsed AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
rules(verdict, host_rule, path_rule) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (
  SELECT p.page_id, p.host, p.path, r.host_rule || r.path_rule AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host_rule || r.path_rule) DESC NULLS LAST) AS n
  FROM parsed p LEFT JOIN rules r ON (p.host = r.host_rule OR ends_with(p.host, '.' || r.host_rule)) AND starts_with(p.path, r.path_rule))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE n = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_url_filter": OP9_SQL}
