"""Exact length histogram: documents by encoded length, and suffix sums over it.

One partial aggregation turns documents into (length, documents, tokens). Suffix sums over the distinct lengths then
answer, for every context limit L that is a length: how many documents and tokens lie above it, how many tokens are left
when each document is cut to L, and which share of documents fits. A limit between two lengths reads the next smaller
length's row. Suffix sums run inside blocks of lengths, with the totals of the blocks above added, so no task gets more
lengths than a block has and the block totals stay few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.arrays import slices
from tallyspark.llm.byte_bpe import Encoder
from tallyspark.llm.byte_codec import vocabulary
from tallyspark.plans.lineage import cut
from tallyspark.sources.tables import spread

BLOCK = 4096  # lengths whose suffix sums are made together


def lengths(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``length`` and ``n_docs``, summed per task already; null and empty texts have length 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(path))
        for _, data, texts in slices(batches, "text"):
            length, n = np.unique(np.diff(encoder(data, texts)[1]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(n)], names=["length", "n_docs"])

    return spread(docs.select(F.col(text).cast("string").alias("text"))).mapInArrow(run, "length long, n_docs long")


def histogram(found: DataFrame) -> DataFrame:
    """Per distinct length: its documents and tokens, and the suffix sums. An empty table gives no rows.

    ``docs_from``/``tokens_from`` count documents of at least this length; ``docs_over`` those longer;
    ``truncated_tokens`` is the corpus total with each document cut to this length; ``rank_to`` is the number of
    documents of at most this length, so the quantile q is the smallest length with ``rank_to >= q * total_docs``.
    """
    one = cut(found.groupBy("length").agg(F.sum("n_docs").alias("n_docs")).withColumn("block", F.floor(F.col("length") / BLOCK)))
    one = one.withColumn("n_tokens", F.col("length") * F.col("n_docs"))
    totals = one.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    totals = totals.select(
        "block",
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"),
        F.sum("d").over(every).alias("total_docs"),
        F.sum("t").over(every).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        one.join(totals, "block")
        .withColumn("docs_from", F.sum("n_docs").over(inside) + F.col("d_above"))
        .withColumn("tokens_from", F.sum("n_tokens").over(inside) + F.col("t_above"))
        .withColumn("docs_over", F.col("docs_from") - F.col("n_docs"))
        .withColumn("truncated_tokens", F.col("total_tokens") - F.col("tokens_from") + F.col("length") * F.col("docs_from"))
        .withColumn("rank_to", F.col("total_docs") - F.col("docs_over"))
        .select("length", "n_docs", "n_tokens", "docs_from", "tokens_from", "docs_over", "truncated_tokens", "rank_to", "total_docs", "total_tokens")
    )


def at_limits(table: DataFrame, limits: list[int]) -> DataFrame:
    """For each given context limit: documents that fit, documents cut, and tokens kept; read off the histogram alone."""
    fits = F.col("length") <= F.col("context")
    return (
        table.withColumn("context", F.explode(F.array(*[F.lit(int(x)) for x in limits])))
        .groupBy("context")
        .agg(
            F.sum(F.when(fits, F.col("n_docs")).otherwise(0)).alias("docs_fit"),
            F.sum(F.when(fits, 0).otherwise(F.col("n_docs"))).alias("docs_cut"),
            F.sum(F.least("length", "context") * F.col("n_docs")).alias("tokens_kept"),
        )
    )


def quantile(table: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least the share ``q`` of documents doesn't exceed."""
    return table.filter(F.col("rank_to") >= q * F.col("total_docs")).agg(F.min("length").alias("length"))
