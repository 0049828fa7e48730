"""Cloned texts (XC): exact copies and near copies of whole texts.

Exact: texts with the same normalised content share a SHA-256 digest; one
aggregate per digest gives the group (a digest shared by a third of all
documents is still one aggregate key with partial counts, and the join back
is left to AQE's skew handling).

Near: an exact set-similarity join of word 5-shingles in built-ins. Equal
texts are one class from the start. Shingles are ordered by their frequency
over all classes, rarest first; two sets that are near enough share a shingle
among the first few of each (prefix filter), at places that leave room for
the overlap they need (position filter), and have similar sizes. A shingle's
bucket is first compared with its smallest member only; after that a group of
copies of one text is one component, and only pairs of different components
in buckets with several are left. Every candidate is verified on the whole
sets (shingles by 64-bit hashes); the groups are the connected components of
all that pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veeduria.operators.graph import connected_components
from veeduria.session import reuse

_SPACE_RUN = "[\\t\\n\\x0B\\f\\r ]+"


def normalized(text: str | Column) -> Column:
    """Whitespace runs collapsed to one blank, ends trimmed."""
    t = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(t, _SPACE_RUN, " "))


def exact_clones(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, grupo, n): documents whose normalised text occurs at least twice;
    ``grupo`` is the smallest id with that text."""
    h = df.select(F.col(id_col).alias("id"), F.sha2(normalized(text_col), 256).alias("h")) \
          .where(F.col("h").isNotNull())
    g = h.groupBy("h").agg(F.min("id").alias("grupo"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2)
    return h.join(g, "h").select(F.col("id").alias(id_col), "grupo", "n")


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t): normalised lower-case texts. Texts without words and rows
    without an id are left out."""
    t = df.select(F.col(id_col).alias("id"), F.lower(normalized(text_col)).alias("t"))
    return t.where(F.col("id").isNotNull() & (F.col("t") != ""))


def _sets(texts: DataFrame, k: int = 5) -> DataFrame:
    """(id, n, hs): the distinct hashed word k-shingles of each whole text,
    sorted; a text shorter than k words is one shingle. A shingle's hash is
    that of its words' hashes, so no text is put together per shingle."""
    # the word array is a column first: referenced inside the lambda as an
    # expression it would be re-split for every shingle (quadratic)
    words = texts.select("id", F.transform(F.split("t", " "), lambda x: F.xxhash64(x)).alias("w"))
    w, n = F.col("w"), F.size("w")
    sh = F.when(n <= k, F.array(F.xxhash64(w))).otherwise(
        F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(F.slice(w, i + 1, k))))
    return words.select("id", F.sort_array(F.array_distinct(sh)).alias("hs")).select("id", F.size("hs").alias("n"), "hs")


def shingle_sets(df: DataFrame, id_col: str, text_col: str, k: int = 5) -> DataFrame:
    """(id, n, hs): the shingle set of each text that has a word."""
    return _sets(_texts(df, id_col, text_col), k)


def near_clones(df: DataFrame, id_col: str, text_col: str, percent: int = 75, k: int = 5) -> DataFrame:
    """(id, grupo, n): documents linked, directly or through others, to
    another one, the smallest id of their group and the group's size. Two
    documents link when 100 |A and B| >= percent |A or B| for their shingle
    sets. Exact: every link between different texts lies within a group."""
    texts = _texts(df, id_col, text_col).withColumn("key", F.sha2("t", 256))
    keys = reuse(texts.select("id", "key"))
    # equal texts are one class, whose smallest id stands for it
    classes = reuse(keys.groupBy("key").agg(F.min("id").alias("rep")))
    chosen = classes.groupBy(F.col("rep").alias("id")).agg(F.min("key").alias("key"))
    reps = reuse(texts.join(chosen, ["id", "key"], "left_semi").dropDuplicates(["id", "key"]).select("id", "t"))
    prefix = reuse(_prefixes(_sets(reps, k), percent))
    # first the smallest member of each bucket against the others: a group of
    # copies of one text is one component after this, and its buckets are done
    centre = (prefix.groupBy("h").agg(F.min(F.struct("id", "n", "pos")).alias("m"), F.count(F.lit(1)).alias("c")).where("c > 1")
                    .select("h", *[F.col(f"m.{c}").alias(f"{c}2") for c in ("id", "n", "pos")]))
    star = prefix.join(centre, "h").where((F.col("id") != F.col("id2")) & _may_link(percent))
    links = reuse(_verified(star, reps, percent, k))
    cc = reuse(connected_components(links, "a", "b"))
    placed = prefix.join(cc.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id"))
    placed = reuse(placed.select("h", "id", "n", "pos", "comp"))
    # then pairs of different components, in buckets that hold several
    mixed = placed.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("h")
    left = placed.join(mixed, "h", "left_semi")
    right = left.select("h", *[F.col(c).alias(f"{c}2") for c in ("id", "n", "pos", "comp")])
    pairs = left.join(right, "h").where(
        (F.col("comp") != F.col("comp2")) & (F.struct("n", "id") < F.struct(F.col("n2"), F.col("id2"))) & _may_link(percent))
    more = reuse(_verified(pairs, reps, percent, k))
    groups = reuse(connected_components(links.unionByName(more), "a", "b"))
    of = (keys.join(classes, "key").select("id", "rep")
              .join(groups.withColumnRenamed("node", "rep"), "rep", "left")
              .select("id", F.coalesce("component", "rep").alias("grupo")))
    sizes = of.groupBy("grupo").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return of.join(sizes, "grupo").select(F.col("id").alias(id_col), "grupo", "n")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(h, id, n, pos): of each set, rarest shingles first, those of which two
    linked sets must share one: the first n - ceil(percent n / 100) + 1. A
    shingle of one set alone finds nothing; it takes its place and is left
    out, so only shared shingles are gathered. The sets are dealt by shingle
    once, to be counted and kept by the same move."""
    # sets are never empty; of an inner explode Catalyst would infer a filter
    # on them, and push it below the word array, into the lambda
    every = sets.select("id", "n", F.explode_outer("hs").alias("h"))
    every = every.withColumn("f", F.count(F.lit(1)).over(Window.partitionBy("h")))
    shared = (every.where("f > 1").groupBy("id", "n")
                   .agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("s")))
    place = F.col("n") - F.size("s") + F.col("p")
    return (shared.select("id", "n", "s", F.posexplode("s").alias("p", "x")).withColumn("pos", place)
                  .where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)))
                  .select("x.h", "id", "n", "pos"))


def _may_link(percent: int) -> Column:
    """Whether the places of a shingle in two sets (n, pos and n2, pos2), and
    their sizes, leave room for the overlap that a link needs."""
    need = F.ceil((F.col("n") + F.col("n2")) * percent / F.lit(100 + percent))
    return ((100 * F.least("n", "n2") >= percent * F.greatest("n", "n2"))
            & (F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2")) >= need))


SIEVE = 1 << 20


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, k: int) -> DataFrame:
    """(a, b): those pairs (id, id2) whose whole sets are near enough. Sets are
    made again for the texts in a pair alone, so that no other set moves: a
    sieve of at most ``SIEVE`` hashes of ids, broadcast, takes out most of the
    other texts where they are read, an exact join the rest."""
    pairs = reuse(pairs.select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct())
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    hole = F.pmod(F.xxhash64("id"), F.lit(SIEVE))
    sieve = F.broadcast(ids.select(hole.alias("_hole")).distinct())
    # written: a filter that Catalyst infers on the sets would go below the word array
    sets = reuse(_sets(texts.join(sieve, hole == F.col("_hole"), "left_semi").join(ids, "id", "left_semi"), k))
    a, b = [sets.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("hs").alias(f"hs_{x}")) for x in "ab"]
    both = F.size(F.array_intersect("hs_a", "hs_b"))
    near = 100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))
    return pairs.join(a, "a").join(b, "b").withColumn("both", both).where(near).select("a", "b")
