"""As-of join: to each row the latest earlier row of another table.

Both tables are united and dealt into range blocks of (id, time), so the rows
of a hot id are spread over many blocks. Within a block the last row of the
other table is carried forward; what a block begins with is the greatest row
of the blocks before it, from one row per block and id, which is put before
the block's own. Nothing is joined, so no id's rows meet in one task, and no
pair that does not count is ever made.

The left rows are moved twice and written once, with all their columns: leave
out what the result does not need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veeduria.operators.blocks import PART, dealt, joined


def asof_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, take: dict[str, str],
              strict: bool = False) -> DataFrame:
    """``left`` with the columns ``take`` (name in ``right`` -> new name) of
    the latest row of ``right`` with the same ``by`` whose time is at or
    before (``strict``: before) the row's own. Of right rows with the same id
    and time the greatest in ``take`` counts. Every left row stays once; the
    new columns are null where nothing comes before it, and for null ids and
    times."""
    other = F.struct(F.col(right_time).alias("t"), *[F.col(c).alias(n) for c, n in take.items()])
    ok = F.col(by).isNotNull()
    types = {f.name: f.dataType for f in left.schema.fields}
    taken = {f.name: f.dataType for f in right.select(other.alias("o")).schema["o"].dataType.fields}
    # the id and time stand beside the row already, unless the other table's types change them there
    same = {c for c, r in ((by, by), (left_time, right_time)) if types[c] == right.schema[r].dataType}
    rest = [c for c in left.columns if c not in same]
    row = F.struct(F.lit(True).alias("_left"), *[F.col(c).alias(c) for c in rest])
    kind = left.select(row.alias("r")).schema["r"].dataType
    # 16 bits are enough to spread rows, and short ones move lighter
    salt = F.shiftright(F.xxhash64(*[F.col(c) for c in left.columns]), 48).cast("short")
    a = left.where(ok & F.col(left_time).isNotNull()).select(
        F.col(by).alias("_id"), F.col(left_time).alias("_t"), F.lit(0 if strict else 1).cast("byte").alias("_side"),
        salt.alias("_salt"), row.alias("_row"))
    b = right.where(ok & F.col(right_time).isNotNull()).select(
        F.col(by).alias("_id"), F.col(right_time).alias("_t"), F.lit(1 if strict else 0).cast("byte").alias("_side"),
        F.lit(0).cast("short").alias("_salt"), F.lit(None).cast(kind).alias("_row"), other.alias("_other"))
    # left rows of the same id and time may lie in several blocks: the salt deals them
    both = dealt(a.unionByName(b, allowMissingColumns=True), ["_id", "_t", "_side", "_salt"], drop=["_salt"])
    # the greatest other row up to here is the latest one, as it starts with its time
    ends = both.where(F.col("_other").isNotNull()).groupBy("_id", PART).agg(F.max("_other").alias("_last"))
    spans = both.select("_id", PART).distinct()
    before = Window.partitionBy("_id").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = joined(spans, ends, ["_id", PART], "left").withColumn("_other", F.max("_last").over(before)).drop("_last")
    first = carried.where(F.col("_other").isNotNull())             # without a time: before all others of its block
    here = Window.partitionBy(PART, "_id").orderBy(F.asc_nulls_first("_t"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = (both.unionByName(first, allowMissingColumns=True)
                .withColumn("_seen", F.max("_other").over(here)).where(F.col("_row").isNotNull()))
    beside = {by: F.col("_id"), left_time: F.col("_t")}
    out = seen.select(*[(beside[c] if c in same else F.col("_row")[c]).alias(c) for c in left.columns],
                      *[F.col("_seen")[n].alias(n) for n in take.values()])
    alone = left.where(~ok | F.col(left_time).isNull()).select(
        *left.columns, *[F.lit(None).cast(taken[n]).alias(n) for n in take.values()])
    return out.unionByName(alone)
