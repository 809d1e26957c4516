"""Exact length histogram of encoded documents, and what it answers for every context limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import settle

#: Lengths per block of the two-level suffix sums.
BLOCK = 256


def histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """n_tokens and n_docs: one row per distinct length. Partial counts are taken before the shuffle, so a hot length is no hot
    task; the histogram is written once, as every answer reads it more than once."""
    rows = lengths.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))
    return settle(rows, "lengths")


def limits(hist: DataFrame) -> DataFrame:
    """For each length L as a context limit: documents of at least and of more than L tokens, all tokens
    in documents of at least L, total tokens when each document is cut at L, and the quantile that L is.

    Suffix sums in two levels: within a block of lengths, and over the blocks (one row for each 256 lengths).
    No documents: no rows.
    """
    h = hist.withColumn("_block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("_t", F.col("n_tokens") * F.col("n_docs"))
    up = W.partitionBy("_block").orderBy(F.desc("n_tokens"))
    inner = h.withColumn("_d", F.sum("n_docs").over(up)).withColumn("_s", F.sum("_t").over(up))
    blocks = h.groupBy("_block").agg(F.sum("n_docs").alias("_bd"), F.sum("_t").alias("_bs"))
    after = W.orderBy(F.desc("_block")).rowsBetween(W.unboundedPreceding, -1)
    ends = W.orderBy(F.desc("_block")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    blocks = blocks.select("_block", *(F.coalesce(F.sum(a).over(after), F.lit(0)).alias(b) for a, b in (("_bd", "_ad"), ("_bs", "_as"))), F.sum("_bd").over(ends).alias("_n"), F.sum("_bs").over(ends).alias("_all"))
    j = inner.join(blocks, "_block")
    least, tokens = F.col("_d") + F.col("_ad"), F.col("_s") + F.col("_as")
    return j.select(
        "n_tokens", "n_docs", least.alias("docs_at_least"), (least - F.col("n_docs")).alias("docs_cut"), tokens.alias("tokens_at_least"),
        (F.col("_all") - tokens + F.col("n_tokens") * least).alias("truncated_total"), F.col("_all").alias("total_tokens"), F.col("_n").alias("total_docs"),
        ((F.col("_n") - least + F.col("n_docs")) / F.col("_n")).alias("quantile"),
    )


def truncated_total(hist: DataFrame, limit: int) -> DataFrame:
    """One row: documents, tokens, and tokens left when each document is cut at `limit`, for any limit."""
    n = F.col("n_tokens")
    total = lambda x: F.coalesce(F.sum(x * F.col("n_docs")), F.lit(0))
    return hist.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"), total(n).alias("tokens"), total(F.least(n, F.lit(limit))).alias("truncated"))


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """One row, a column q<share> for each share: the least length with that share of documents at or below it."""
    rows = limits(hist)
    return rows.agg(*(F.min(F.when(F.col("quantile") >= s - 1e-12, F.col("n_tokens"))).alias(f"q{s:g}") for s in shares))
