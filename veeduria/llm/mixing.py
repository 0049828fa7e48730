"""Mixing sources to target weights with hash-threshold histograms.

Every document gets a 60-bit hash of its id. A source that must give a
budget of words keeps the documents whose hash lies below a threshold, so
smaller budgets nest in larger ones and reruns agree. The threshold comes
from histograms: words are summed by source and leading hash bits, the
bucket in which the running sum crosses the budget is found, and only that
bucket is summed again by its next bits, until the hash is exhausted. No
document is sorted and none leaves its partition; what moves are at most
``2 ** BITS`` sums per source, level and task.

Budgets: the sources, in code point order with the null source last, have
weights that repeat. They share ``share`` times all words in proportion; a
target stops at ``max_repeat`` times its source's words and the excess goes
to the others by weight. That end state is ``min(cap, weight * level)`` with
one common level, which one running sum over the sources finds.

A budget above a source's own words takes every document once (or more) and
the rest of the budget by threshold. The document at the threshold is taken
if that brings the sum nearer to the budget.

Defined results: a null text or one without words has size 0 and takes 0
words; a null source is a source of its own, last in order; null ids are
hashed by their text; rows that share id and text share the hash and are
taken or left together; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veeduria.llm.common import n_words
from veeduria.session import reuse

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEAT = 2
BITS = 12
HASH_BITS = 60


def row_hash(doc_id: Column, text: Column) -> Column:
    key = F.coalesce(doc_id.cast("string"), text, F.lit(""))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """Narrow table of the documents: id, source, size in words, hash."""
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"),
                       row_hash(F.col("doc_id"), F.col("text")).alias("h"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target): one row per source."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("rank", rank).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    left = budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", left / weight_left)
    free = F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level"))
    s = s.withColumn("common", F.first(free, ignorenulls=True).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return s.select("source", "source_size",
                    F.coalesce(F.least("cap", F.col("weight") * F.col("common")), F.col("cap")).alias("target"))


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source: how often each document is taken whole (``whole``), the
    hash below which it is taken once more (``cut``) and whether the
    documents at ``cut`` are (``at_cut``)."""
    goal = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = goals.withColumn("whole", goal.cast("long")).select(
        "source", "source_size", "target", "whole",
        (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"), F.lit(0).cast("long").alias("cut"))
    narrow = sizes.where(F.col("size") > 0).select(F.col("source").alias("src"), "size", "h")
    for level in range(HASH_BITS // BITS):
        shift = HASH_BITS - BITS * (level + 1)
        here = narrow.join(state.select(F.col("source").alias("s"), F.col("cut").alias("prefix")),
                           F.col("src").eqNullSafe(F.col("s"))
                           & (F.shiftright("h", shift + BITS) == F.col("prefix")))
        hist = here.groupBy("src", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("part"))
        upto = F.sum("part").over(Window.partitionBy("src").orderBy("bucket")
                                  .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        hist = hist.withColumn("upto", upto)
        crossing = (hist.join(state.select(F.col("source").alias("s"), F.col("rest").alias("r")),
                              F.col("src").eqNullSafe(F.col("s")))
                        .where((F.col("upto") >= F.col("r")) & (F.col("upto") - F.col("part") < F.col("r")))
                        .select("src", "bucket", "part", (F.col("r") - (F.col("upto") - F.col("part"))).alias("r2")))
        state = (state.drop("part").join(crossing, F.col("source").eqNullSafe(F.col("src")))
                      .select("source", "source_size", "target", "whole",
                              F.col("r2").alias("rest"), F.col("bucket").alias("cut"), "part"))
        # a few sums per source: written, so that the next level's plan stays small
        state = reuse(state)
    return state.select("source", "cut", (F.col("part") <= 2 * F.col("rest")).alias("at_cut"))


def plan_mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE,
             max_repeat: float = MAX_REPEAT) -> tuple[DataFrame, DataFrame]:
    """(narrow table, one row per source with target, ``whole``, ``cut``)."""
    sizes = reuse(measured(docs))
    goals = reuse(targets(sizes, weights, share, max_repeat))
    cuts = thresholds(sizes, goals).select(F.col("source").alias("s"), "cut", "at_cut")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = reuse(goals.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left")
                      .select("source", "source_size", "target", whole.cast("long").alias("whole"), "cut", "at_cut"))
    return sizes, plan


def copies(h: Column, whole: Column, cut: Column, at_cut: Column) -> Column:
    more = F.coalesce((h < cut) | ((h == cut) & at_cut), F.lit(False))
    return whole + more.cast("long")


def mix_report(docs: DataFrame, **kw) -> DataFrame:
    """Per document: size, source_size, target, and the words taken."""
    sizes, plan = plan_mix(docs, **kw)
    p = plan.withColumnRenamed("source", "s")
    return (sizes.join(p, F.col("source").eqNullSafe(F.col("s")))
                 .select("doc_id", "size", "source_size", "target",
                         (F.col("size") * copies(F.col("h"), F.col("whole"), F.col("cut"), F.col("at_cut"))).alias("taken")))


def mix(docs: DataFrame, **kw) -> DataFrame:
    """The mixed documents: rows of ``docs``, repeated as the mix takes them,
    with the columns of ``docs`` only. Documents without a word are taken as
    often as every document of their source is taken whole."""
    _, plan = plan_mix(docs, **kw)
    p = plan.select(*[F.col(c).alias(f"_mix_{c}") for c in ("source", "whole", "cut", "at_cut")])
    n = copies(row_hash(docs["doc_id"], docs["text"]), F.col("_mix_whole"), F.col("_mix_cut"), F.col("_mix_at_cut"))
    taken = (docs.join(p, docs["source"].eqNullSafe(F.col("_mix_source")))
                 .select(*[docs[c] for c in docs.columns], n.cast("int").alias("_mix_n")).where("_mix_n > 0"))
    return taken.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col("_mix_n"))).alias("_mix_i")).drop("_mix_i")


#: DuckDB: the same rule with a running sum over all documents by hash.
SQL = r"""
WITH d AS (
  SELECT doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, sum(size) AS source_size,
    [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, 2.0 * source_size AS cap,
    (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER w, 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM s WINDOW w AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, cap, weight,
    (SELECT min_by(level, cap / weight) FROM r WHERE cap / weight > level) AS common FROM r),
g AS (SELECT source, source_size, coalesce(least(cap, weight * common), cap) AS target FROM t),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM g),
c AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(d.size) OVER (PARTITION BY d.source, d.h) AS part
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target,
  CAST(size * (whole + CASE WHEN upto < rest OR (upto - part < rest AND part <= 2 * (rest - (upto - part))) THEN 1 ELSE 0 END)
    AS BIGINT) AS taken
FROM c
"""
