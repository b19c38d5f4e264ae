"""URL filters by host-suffix and path-prefix expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of the digest that the join goes by.
PREFIX = 8
#: Rules that are broadcast at most; more are joined by a shuffle, each in SALTS copies.
FEW_RULES, SALTS = 100_000, 16


def rules_frame(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """(verdict, rule) rows, a rule being its host followed by its path, such as ``example.net/en/``."""
    return spark.createDataFrame(list(rules), "verdict string, rule string")


def _expressions(forms: list[tuple[int, int, int]]) -> Column:
    """What rules of each form may equal, given ``labels`` and ``slashes`` of a url's host and path.

    A form: labels of the host, slashes of the path, and its characters if it doesn't end in a slash.
    """
    path = F.col("path")

    def one(form: tuple[int, int, int]) -> Column:
        n, k, size = form
        suffix = F.array_join(F.slice("labels", -n, n), ".")
        if size:
            there, prefix = F.length(path) >= size, F.substring(path, 1, size)
        else:
            there, prefix = F.col("slashes") >= k, F.concat(F.substring_index(path, "/", k), F.lit("/"))
        return F.when((F.size("labels") >= n) & there, F.concat(suffix, prefix))

    return F.array_compact(F.array(*map(one, forms)))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", digits: int = PREFIX) -> DataFrame:
    """Judge every url: page_id, host, path, rule and verdict.

    Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end,
    A-Z lower-cased; path: from there up to ``?``, ``#`` or the end; both empty
    for a null url or one without ``://``. A rule fits its host and all
    subdomains if the path starts with its path. The longest fitting rule wins,
    of equally long ones that with the longer host, then block before allow;
    without any, rule is null and the verdict is ``default``. One row per input
    row: repeated rows and null ids stay. Rules without a host, path or verdict
    fit nothing. Extra columns are ignored.

    Each distinct (page_id, url) is expanded into host suffixes with path
    prefixes, of just those numbers of labels and slashes (or characters, where
    a rule's path doesn't end in a slash) that some rule has: work per url
    grows with its length times the number of forms, which come to the driver.
    Expressions meet rules on the first ``digits`` of their SHA-256 alone; then
    the full digest confirms, and precedence decides.
    """
    known = rules.select(F.col("verdict").cast("string").alias("verdict"), F.col("rule").cast("string").alias("rule")).dropna().where("rule LIKE '_%/%' AND rule NOT LIKE '/%'").distinct()
    known = known.withColumn("host_length", F.instr("rule", "/") - 1)
    labels = F.size(F.split(F.substring_index("rule", "/", 1), r"\."))
    slashes = F.when(F.col("rule").endswith("/"), F.length("rule") - F.length(F.replace(F.col("rule"), F.lit("/"), F.lit("")))).otherwise(0)
    size = F.when(slashes == 0, F.length("rule") - F.col("host_length")).otherwise(0)
    shapes = known.groupBy(labels.alias("labels"), slashes.alias("slashes"), size.alias("size")).count().collect()
    forms, n_rules = sorted((r["labels"], r["slashes"], r["size"]) for r in shapes), sum(r["count"] for r in shapes)

    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    form = "(?s)^.*?://([^/?#]*)([^?#]*)"
    found = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url")).groupBy("page_id", "url").agg(F.count("*").alias("copies"))
    found = found.select("page_id", "url", "copies", F.translate(F.regexp_extract("url", form, 1), UPPER, LOWER).alias("host"), F.regexp_extract("url", form, 2).alias("path"))
    if not forms:
        best = found.withColumn("best", F.lit(None).cast("struct<d:string,c:string>"))
    else:
        own, slashes = found.columns, F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit("")))
        expanded = found.withColumn("labels", F.split("host", r"\.")).withColumn("slashes", slashes).select(*own, F.explode_outer(_expressions(forms)).alias("expression"))
        digest = F.sha2(F.col("expression"), 256)
        expanded = expanded.select(*own, digest.alias("digest"), F.substring(digest, 1, digits).alias("short"))
        whole = F.struct(F.length("rule").alias("a"), F.col("host_length").alias("b"), F.col("verdict").alias("c"), F.col("rule").alias("d"), F.sha2("rule", 256).alias("digest"))
        listed = known.groupBy(F.substring(F.sha2("rule", 256), 1, digits).alias("short")).agg(F.collect_list(whole).alias("rules"))
        if n_rules <= FEW_RULES:
            met = expanded.join(F.broadcast(listed), "short", "left")
        else:
            salted = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            met = expanded.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int")).join(salted, ["short", "salt"], "left")
        confirmed = F.array_max(F.filter("rules", lambda r: r["digest"] == F.col("digest")))
        best = met.groupBy("page_id", "url", "copies").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.max(confirmed).alias("best"))
    rows = best.select("page_id", "host", "path", F.col("best.d").alias("rule"), F.coalesce("best.c", F.lit(default)).alias("verdict"), "copies")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copy", "copies")
