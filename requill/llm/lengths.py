"""Exact token counts: a histogram of encoded lengths and its suffix sums."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from requill.llm.bpe import Coder, vocabulary_text
from requill.llm.common import cut, texts

#: Neighbouring lengths are summed in strips of this width, so that no window holds the whole histogram.
STRIP = 256


def token_lengths(documents: DataFrame, vocabulary: str) -> DataFrame:
    """(n_tokens) of every text by the forced-boundary encoder; a null text has 0. One row per input row."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary_text(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            text = batch.column(1)
            n = [coder.count(text[i].as_py() or "") for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return texts(documents).mapInArrow(run, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """One row per distinct length: n_tokens, n_docs, n_docs_from, n_tokens_from, truncated_total, quantile.

    ``n_docs_from`` and ``n_tokens_from`` are suffix sums: the documents of at
    least this length and their tokens. ``truncated_total`` is what remains of
    the corpus if every document is cut at this length: the tokens of shorter
    ones plus the length times ``n_docs_from``; ``quantile`` is the share of
    documents that this length isn't below. Null lengths count as 0; an empty
    table gives no rows. Documents meet only as counts by length (pre-aggregated
    before the shuffle), and sums run within strips of lengths; what lies above
    a strip is the sum of the strips above it. Those totals come to the driver:
    the longest length divided by STRIP of them, whatever the number of documents.
    """
    n = F.coalesce(F.col(length).cast("long"), F.lit(0))
    # Strips and lengths both read the histogram, which is small; the texts are encoded once.
    histogram = cut(lengths.select(n.alias("n_tokens")).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))).withColumn("strip", F.floor(F.col("n_tokens") / STRIP))
    tokens = F.col("n_docs") * F.col("n_tokens")
    strips = sorted((r["strip"], r["docs"], r["tokens"]) for r in histogram.groupBy("strip").agg(F.sum("n_docs").alias("docs"), F.sum(tokens).alias("tokens")).collect())
    above, docs, total = [], 0, 0
    for strip, more_docs, more_tokens in reversed(strips):
        above.append((strip, docs, total))
        docs, total = docs + more_docs, total + more_tokens
    spark = lengths.sparkSession
    above = spark.createDataFrame(above, "strip long, docs_above long, tokens_above long")
    within = Window.partitionBy("strip").orderBy(F.desc("n_tokens"))
    rows = histogram.withColumn("docs_in", F.sum("n_docs").over(within)).withColumn("tokens_in", F.sum(tokens).over(within))
    rows = rows.join(F.broadcast(above), "strip")
    docs_from, tokens_from = F.col("docs_in") + F.col("docs_above"), F.col("tokens_in") + F.col("tokens_above")
    return rows.select(
        "n_tokens",
        "n_docs",
        docs_from.alias("n_docs_from"),
        tokens_from.alias("n_tokens_from"),
        (F.lit(total) - tokens_from + F.col("n_tokens") * docs_from).alias("truncated_total"),
        ((F.lit(docs) - docs_from + F.col("n_docs")) / F.lit(max(docs, 1))).alias("quantile"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """One row: limit, n_tokens in all, kept after cutting at ``limit``, docs_cut. Zeros for an empty histogram.

    Read off the suffix sums: the tokens from the shortest length on, less those
    from the first length over the limit on, for which the limit itself counts.
    """
    first = F.min(F.struct("n_tokens", "n_docs_from", "n_tokens_from"))
    longer = F.min(F.when(F.col("n_tokens") > limit, F.struct("n_tokens", "n_docs_from", "n_tokens_from")))
    rows = histogram.agg(first.alias("all"), longer.alias("longer"))
    value = lambda x: F.coalesce(F.col(x), F.lit(0))
    kept = value("all.n_tokens_from") - value("longer.n_tokens_from") + F.lit(limit) * value("longer.n_docs_from")
    return rows.select(F.lit(limit).alias("limit"), value("all.n_tokens_from").alias("n_tokens"), kept.alias("kept"), value("longer.n_docs_from").alias("docs_cut"))


def length_quantile(histogram: DataFrame, q: float) -> DataFrame:
    """One row: q and the least length that at least the share ``q`` of documents doesn't exceed (null for none)."""
    return histogram.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens")).withColumn("q", F.lit(q))
