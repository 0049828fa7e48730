"""Distributed ranks, shares and quantiles by value histograms.

Equal values are counted first (with partial counts in each task), so a
value or a group that holds a third of all rows is a few histogram rows. The
histogram is dealt into range blocks; the number of rows before a value is
the blocks' totals before its block plus the counts before it in the block.
Percentile ranks and exact quantiles are read off these numbers; there is no
sketch, no switch on the number of rows, and facts are only ever joined on
(group, value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veeduria.operators.blocks import PART, dealt, joined


def value_counts(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    """(by..., col, count, before, total): per group and distinct value its
    rows, the rows of smaller values, and all rows; null values don't count."""
    by = list(by or [])
    h = dealt(df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("count")), [*by, col])
    totals = h.groupBy(*by, PART).agg(F.sum("count").alias("_n"))
    group = Window.partitionBy(*by)
    up_to = Window.unboundedPreceding, -1
    totals = totals.select(*by, PART, F.coalesce(F.sum("_n").over(group.orderBy(PART).rowsBetween(*up_to)),
                                                 F.lit(0)).alias("_base"), F.sum("_n").over(group).alias("total"))
    in_block = Window.partitionBy(PART, *by).orderBy(col).rowsBetween(*up_to)
    h = h.withColumn("_within", F.coalesce(F.sum("count").over(in_block), F.lit(0)))
    return joined(h, totals, [*by, PART]).select(*by, col, "count", (F.col("_base") + F.col("_within")).alias("before"),
                                                 "total")


def with_percent_rank(df: DataFrame, col: str, by: list[str] | None = None, alias: str = "pct_rank") -> DataFrame:
    """``percent_rank()`` of ``col`` within ``by``: (rank - 1) / (n - 1), 0
    for a group of one. Rows with a null value have a null rank."""
    by = list(by or [])
    v = value_counts(df, col, by)
    rank = F.when(F.col("total") > 1, F.col("before").cast("double") / (F.col("total") - 1).cast("double")).otherwise(0.0)
    return joined(df, v.select(*by, col, rank.alias(alias)), [*by, col], "left")


def exact_quantile(df: DataFrame, col: str, p: float, by: list[str] | None = None, alias: str = "q") -> DataFrame:
    """Exact continuous quantile of ``col`` (as double) per group, as SQL
    ``quantile_cont``: linear between the values of the two ranks around
    (n - 1) p. Without groups one row, null if there is no value."""
    by = list(by or [])
    v = value_counts(df.select(*by, F.col(col).cast("double").alias("_x")), "_x", by)
    h = (F.col("total") - 1).cast("double") * F.lit(float(p))

    def holds(rank):
        return (F.col("before") <= rank) & (rank < F.col("before") + F.col("count"))
    near = v.where(holds(F.floor(h)) | holds(F.ceil(h)))         # one or two rows a group
    picks = (near.groupBy(*by) if by else near).agg(F.min("_x").alias("_a"), F.max("_x").alias("_b"), F.max(h).alias("_h"))
    return picks.select(*by, (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_h") - F.floor("_h"))).alias(alias))


def exact_median(df: DataFrame, col: str, by: list[str] | None = None, alias: str = "median") -> DataFrame:
    return exact_quantile(df, col, 0.5, by, alias)
