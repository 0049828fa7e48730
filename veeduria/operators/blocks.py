"""Range blocks: the common ground of ranks, running sums and as-of joins.

Rows are dealt by ranges of an order (so a hot key is spread over many
blocks, each bounded by the size of a partition) and written once to the
shared folder. Whatever runs along the order is then worked out in two
levels: within a block, and over the blocks' totals, of which there is one
per block and key. No window ever holds all rows of a key.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veeduria.session import reuse

PART = "_part"


def dealt(df: DataFrame, order: list[str], drop: list[str] | None = None) -> DataFrame:
    """``df`` in range blocks of ``order`` (nulls first), written and read
    back without the columns ``drop``, with the block's number in ``_part``.
    Rows that are equal in ``order`` share a block."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in order])
    return reuse(ranges.withColumn(PART, F.spark_partition_id()).drop(*(drop or [])))


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on equal columns where null equals null; ``right`` keeps its
    other columns only."""
    r = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    same: Column = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(r, same, how).drop(*[f"_r_{c}" for c in on])
