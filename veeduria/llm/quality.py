"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each document is measured by built-in functions only. Two base rules are
fixed (too few words, too many repeated words). The other rules compare a
measure with a threshold of the document's language and source, learned from
the documents that pass the base rules. A sketch is a histogram: the count of
each bin of a measure per group, with partial aggregation (so a hot source is
summed in every task before anything moves). Bins have a fixed width up to
``TOP`` of them, then a fixed relative width; sketches merge by adding counts,
in any order with the same result. The quartiles are read from them, each the
lower end of its bin, and the threshold is the upper quartile plus ``SPREAD``
times the distance between the quartiles, at least ``LEAST`` above the upper
quartile. A group of clean documents thus loses none for a tiny spread.

Few rows, or a group of which a quarter is junk, would set a threshold that
keeps the junk. The sketches are therefore also merged per language and over
all. Threshold and median of a group of n rows count n parts, those of the
next wider group ``PRIOR`` parts; and a threshold may exceed the wider one by
``MARGIN`` at most, beyond the distance of the medians. A source of code, whose
median is high, thus keeps its own threshold. A group of which half is junk
can't be told from such a source.

Repeated windows are found by 64-bit hashes of the five words.

Defined results: a null text or one without words has counts 0, fails the
base rules and is not kept; a group in which every row fails them has no
threshold; null language and null source are values of
their own; each row is judged by itself, repeated rows alike; an empty table
gives an empty result. Columns other than doc_id, text, lang and source are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veeduria.llm.common import SPACES, words
from veeduria.session import reuse

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SPREAD = 3.0
#: Measure: least distance of the threshold from the upper quartile.
LEAST = {"symbol_share": 0.05, "dup_line_share": 0.4, "capital_share": 0.5, "word_length": 7.0}
#: Measure: bins to one unit; and bits that a bin's number keeps.
SCALE = {"symbol_share": 4096, "dup_line_share": 4096, "capital_share": 4096, "word_length": 64}
TOP_BITS = 12
TOP = 1 << TOP_BITS
PRIOR = 5
#: Measure: what a threshold may exceed the wider group's by, beyond the distance of the medians.
MARGIN = {"symbol_share": 0.05, "dup_line_share": 0.1, "capital_share": 0.05, "word_length": 2.0}


def measured(docs: DataFrame) -> DataFrame:
    """The base counts of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.col("n_words")
    lines = F.filter(F.split(F.col("t"), "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    x = (docs.select("doc_id", "lang", "source", text.alias("t"), words(F.col("text")).alias("w"))
             .withColumn("n_words", F.size("w").cast("long")).withColumn("lines", lines))

    def window(word: Column, i: Column) -> Column:
        return F.xxhash64(word, *[F.get(F.col("w"), i + j) for j in range(1, WINDOW)])

    starts = F.slice(F.col("w"), F.lit(1), F.greatest(F.lit(0), F.size("w") - (WINDOW - 1)))
    x = x.withColumn("keys", F.transform(starts, window))
    repeats = F.size(F.array_distinct("keys")) < F.size("keys")
    x = x.withColumn("sorted", F.when(repeats, F.sort_array(F.transform("keys", lambda k, i: F.struct(
        k.alias("k"), i.alias("i"))))))
    s = F.col("sorted")
    twice = F.filter(s, lambda e, j: F.coalesce(
        (j > 0) & (F.get(s, F.greatest(j - 1, F.lit(0)))["k"] == e["k"]), F.lit(False))
        | F.coalesce(F.get(s, j + 1)["k"] == e["k"], F.lit(False)))
    x = x.withColumn("places", F.sort_array(F.transform(twice, lambda e: e["i"])))
    p = F.col("places")
    covered = F.aggregate(
        F.transform(p, lambda at, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - at, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda a, b: a + b)

    def matches(pattern: str) -> Column:
        return (F.length("t") - F.length(F.regexp_replace("t", pattern, ""))).cast("long")

    return x.select(
        "doc_id", "lang", "source", "n_words",
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        matches(SYMBOLS).alias("n_symbols"), matches("[A-Z]").alias("n_capitals"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        ).withColumn("base_failed", (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n))


def shares(m: DataFrame) -> DataFrame:
    """Adds the measures that thresholds apply to."""
    def ratio(a, b):
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return (m.withColumn("symbol_share", ratio("n_symbols", "word_chars"))
             .withColumn("dup_line_share", ratio("n_dup_lines", "n_lines"))
             .withColumn("capital_share", ratio("n_capitals", "word_chars"))
             .withColumn("word_length", ratio("word_chars", "n_words")))


def bin_of(c: str) -> Column:
    """Number of the bin of a measure: whole units of its scale, of which
    the leading ``TOP_BITS`` bits are kept."""
    v = F.floor(F.col(c) * SCALE[c]).cast("long")
    low = F.pow(F.lit(2.0), F.length(F.bin(v)) - TOP_BITS).cast("long")
    return F.when(v < TOP, v).otherwise(v - v % low)


def sketches(m: DataFrame) -> DataFrame:
    """(lang, source, measure, bin, n) of the rows that pass the base rules;
    sketches of other batches are added by ``merged``."""
    each = F.array(*[F.struct(F.lit(c).alias("measure"), bin_of(c).alias("bin")) for c in LEAST])
    return (m.where("not base_failed").select("lang", "source", F.inline(each))
             .groupBy("lang", "source", "measure", "bin").agg(F.count(F.lit(1)).alias("n")))


def merged(sk: DataFrame, *keys: str) -> DataFrame:
    """Sketches by ``keys``: of wider groups, or of several batches."""
    return sk.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))


def _of_measure(values: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for c in LEAST for x in (c, float(values[c]))]), F.col("measure"))


def fences(sk: DataFrame, *keys: str, spread: float = SPREAD) -> DataFrame:
    """Rows, fence and median per group and measure. The window of a group
    holds its bins, not its rows."""
    group = Window.partitionBy(*keys, "measure")
    x = (sk.withColumn("upto", F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
           .withColumn("total", F.sum("n").over(group)))

    def quartile(k: int) -> Column:
        return F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("bin"))) / _of_measure(SCALE)
    q = x.groupBy(*keys, "measure").agg(F.max("total").alias("n"), quartile(1).alias("low"), quartile(2).alias("mid"),
                                        quartile(3).alias("high"))
    fence = F.col("high") + F.greatest(_of_measure(LEAST), spread * (F.col("high") - F.col("low")))
    return q.select(*keys, "measure", "n", fence.alias("fence"), "mid")


def bounded(n: Column, own: tuple[Column, Column], wide: tuple[Column, Column]) -> tuple[Column, Column]:
    """Fence and median of a group of n rows, given those of the wider one."""
    fence, mid = ((n * a + PRIOR * b) / (n + PRIOR) for a, b in zip(own, wide))
    return F.least(fence, wide[0] + F.greatest(F.lit(0.0), mid - wide[1]) + _of_measure(MARGIN)), mid


def thresholds(sk: DataFrame, spread: float = SPREAD) -> DataFrame:
    """One row per language and source: the threshold of each measure."""
    def named(level: DataFrame, prefix: str) -> DataFrame:
        return level.select(*[F.col(c).alias(f"{prefix}_{c}") for c in level.columns])

    every = named(fences(merged(sk), spread=spread), "all")            # one row per measure
    langs = named(fences(merged(sk, "lang"), "lang", spread=spread), "of")
    x = (fences(sk, "lang", "source", spread=spread)
         .join(langs, F.col("lang").eqNullSafe(F.col("of_lang")) & (F.col("measure") == F.col("of_measure")))
         .join(F.broadcast(every), F.col("measure") == F.col("all_measure")))
    wide = bounded(F.col("of_n"), (F.col("of_fence"), F.col("of_mid")), (F.col("all_fence"), F.col("all_mid")))
    limit = bounded(F.col("n"), (F.col("fence"), F.col("mid")), wide)[0]
    return (x.withColumn("limit", limit).groupBy(F.col("lang").alias("_lang"), F.col("source").alias("_source"))
             .agg(*[F.max(F.when(F.col("measure") == c, F.col("limit"))).alias(f"max_{c}") for c in LEAST]))


def judge(docs: DataFrame) -> DataFrame:
    """Per document: base counts, base_failed, kept, and the rules broken."""
    m = reuse(shares(measured(docs)))
    limits = reuse(thresholds(reuse(sketches(m))))     # one row per group: its size on disk decides the join
    x = m.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    broken = F.array_compact(F.array(*[F.when(F.col(c) > F.col(f"max_{c}"), F.lit(c)) for c in LEAST]))
    return (x.withColumn("broken", broken)
             .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                     (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"),
                     F.array_join("broken", ",").alias("broken")))


#: DuckDB: the base counts; the verdict depends on sketches and is tested apart.
BASE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i+4]) AS n FROM i),
c AS (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS c FROM k WHERE n > 1),
r AS (SELECT doc_id, sum(c) AS n_repeat_words FROM c GROUP BY doc_id),
l AS (SELECT doc_id, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM d)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  len(w) < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * len(w) AS base_failed
FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)
"""
