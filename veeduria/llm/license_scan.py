"""License scan by diagonal voting.

Templates (short base phrases and longer license sentences) are cut into
rolling word 3-grams with their positions; this table has a fixed size. All
rolling 3-grams of all documents are looked up in it: those that are no
template's go where they are made, by a list of the templates' 3-grams, the
others are joined to the table on their hash, and the words are compared, so
a vote is never due to a hash collision. A vote of a document position p for
a template position t lies on diagonal p - t. Votes are summed by diagonal;
neighbouring diagonals of a template (words put in or left out) are merged.

Every merged span of a license sentence is then verified word by word: it
may be ``allowed_edits`` words put in, lost or replaced away from the template
(a quarter of its words, if most 3-grams voted) and not much longer. Related
licenses differ in few words, so edits of these are not allowed: a span needs
all words of ``TELLING`` that its template has, and holds none of the others.
"lesser" put into a sentence of the GPL makes it the LGPL's, or nobody's. A
base phrase needs all its 3-grams on one diagonal: then its words stand there
consecutively, at the diagonal's number.

Letters A-Z are lowered, others stay. ``lower`` would also turn the Kelvin
sign into k and a dotted capital I into i, so these two are replaced before
by letters that no template has.

Defined results: a null text counts as empty and has no place; rows that
share id and text share their result; null ids are matched by their text; a
text shorter than three words has no place; an empty table gives an empty
result. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 3
BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
MERGE = 3                    # diagonals this close are one occurrence
MIN_SHARE = 0.75             # of a template's 3-grams: with these, a quarter of its words may be edited
SLACK = 2                    # the ends of a compared span may be off by this
MAX_STRETCH = 1.5            # a span may be this much longer than its template

# Base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Sentences of well-known license texts.
SENTENCES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files", "mit"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", "bsd"),
    ("may be used to endorse or promote products derived from this software without specific prior written permission",
     "bsd-3"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu lesser general public license version 2 1", "lgpl-2.1"),
    ("licensed under the gnu lesser general public license version 3", "lgpl-3"),
    ("licensed under the gnu affero general public license version 3", "agpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
     "license", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
     "public license", "lgpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general "
     "public license", "agpl"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-2"),
    ("made available under the terms of the eclipse public license", "epl"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("licensed under a creative commons attribution noderivatives 4 0 international license", "cc-by-nd"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under a creative commons attribution noncommercial sharealike 4 0 international license", "cc-by-nc-sa"),
    ("licensed under a creative commons attribution noncommercial noderivatives 4 0 international license", "cc-by-nc-nd"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by nc sa 4 0", "cc-by-nc-sa"),
    ("licensed under cc by nc nd 4 0", "cc-by-nc-nd"),
)


#: Words that tell licenses apart: a span has all of its template and no other.
TELLING = frozenset("apache gnu lesser affero mozilla eclipse attribution sharealike noderivatives noncommercial nc nd sa "
                    "1 2 3".split())
_CODES = {w: chr(0x100 + i) for i, w in enumerate(sorted({w for x in SENTENCES for w in x[0].split()} | TELLING))}
_LONGEST = max(len(x[0].split()) for x in SENTENCES)
#: Words kept with a vote, to compare: before it those of a whole template,
#: behind it those of the longest span.
BEFORE = _LONGEST + SLACK
AROUND = BEFORE + int((1 + MAX_STRETCH) * _LONGEST) + SLACK


def allowed_edits(size):
    return F.greatest(F.lit(1), F.floor(size / 8))


def template_grams(spark: SparkSession) -> DataFrame:
    """(template, label, is_base, size, t, tgram, tcode, telling, foreign):
    fixed size; tcode has a character for each word of a sentence, telling and
    foreign are the words that a span must and must not hold."""
    rows = []
    for n, (phrase, label, base) in enumerate([(*x, True) for x in BASE] + [(*x, False) for x in SENTENCES]):
        w = phrase.split()
        code = "" if base else "".join(_CODES[x] for x in w)
        telling = sorted(_CODES[x] for x in TELLING & set(w))
        foreign = sorted(_CODES[x] for x in TELLING - set(w))
        rows += [(n, label, base, len(w), i, " ".join(w[i:i + K]), code, telling, foreign) for i in range(len(w) - K + 1)]
    return spark.createDataFrame(rows, "template int, label string, is_base boolean, size int, t int, tgram string, "
                                       "tcode string, telling array<string>, foreign array<string>")


def scan_words(text: Column) -> Column:
    """Lower-cased words of letters, digits and non-ASCII characters."""
    t = F.coalesce(text, F.lit(""))
    t = F.lower(F.replace(F.replace(t, F.lit("\u212a"), F.lit("\u0138")), F.lit("\u0130"), F.lit("\u0131")))
    return F.array_remove(F.split(t, BREAK), "")


def votes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, template..., p, t, near): 3-grams that are a
    template's, with the words around them."""
    x = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), scan_words(F.col("text")).alias("w"))
    gram = F.transform("w", lambda a, i: F.struct(
        i.alias("p"), F.concat_ws(" ", a, F.get(F.col("w"), i + 1), F.get(F.col("w"), i + 2)).alias("gram")))
    grams = sorted({" ".join(w[i:i + K]) for w in (x[0].split() for x in (*BASE, *SENTENCES)) for i in range(len(w) - K + 1)})
    gram = F.transform(F.filter(gram, lambda g: g["gram"].isin(grams)), lambda g: F.struct(
        g["p"].alias("p"), g["gram"].alias("gram"),
        F.slice(F.col("w"), F.greatest(F.lit(1), g["p"] + 1 - BEFORE), F.lit(AROUND)).alias("near")))
    # outer: for a plain explode Catalyst infers a filter on the array and would
    # evaluate it, word list included, a second time below
    x = x.select("doc_id", "text_hash", gram.alias("g")).select("doc_id", "text_hash", F.explode_outer("g").alias("g"))
    x = x.select("doc_id", "text_hash", "g.p", "g.gram", "g.near", F.xxhash64("g.gram").alias("h"))
    templates = F.broadcast(template_grams(docs.sparkSession).withColumn("th", F.xxhash64("tgram")))
    return (x.join(templates, (F.col("h") == F.col("th")) & (F.col("gram") == F.col("tgram")))
             .select("doc_id", "text_hash", "template", "label", "is_base", "size", "tcode", "telling", "foreign", "p", "t",
                     "near"))


def edits() -> Column:
    """The fewest words put in, lost or replaced between a merged span and its
    template, where the span has the words that tell the license and none of
    others; null where it hasn't."""
    codes = F.create_map(*[F.lit(x) for pair in _CODES.items() for x in pair])
    text = F.array_join(F.transform(F.col("near"), lambda w: F.coalesce(F.element_at(codes, w), F.lit("~"))), "")
    begin = F.col("first") - F.col("t_first") - F.greatest(F.lit(0), F.col("first") - BEFORE)
    n = F.col("last") - F.col("first") + 1 + F.col("t_first") + F.col("size") - K - F.col("t_last")

    def part(left, right):
        at = F.greatest(F.lit(0), begin + left)
        return F.substr(text, at + 1, F.greatest(F.lit(0), begin + n + right - at))

    off = range(-SLACK, SLACK + 1)
    tries = F.array(*[part(F.lit(i), F.lit(j)) for i in off for j in off])
    right = F.filter(tries, lambda x: F.forall(F.col("telling"), lambda k: F.instr(x, k) > 0)
                     & ~F.exists(F.col("foreign"), lambda k: F.instr(x, k) > 0))
    return F.array_min(F.transform(right, lambda x: F.levenshtein(x, F.col("tcode"))))


def spans(docs: DataFrame) -> DataFrame:
    """Verified places: doc_id, text_hash, label, is_base, first, last (word
    numbers), score."""
    key = ["doc_id", "text_hash", "template", "label", "is_base", "size", "tcode", "telling", "foreign"]
    diagonals = (votes(docs).groupBy(*key, (F.col("p") - F.col("t")).alias("diagonal"))
                 .agg(F.collect_set("t").alias("ts"), F.min("p").alias("first"), F.max("p").alias("last"),
                      F.min(F.struct("p", "t", "near")).alias("head"), F.max(F.struct("p", "t")).alias("tail")))
    order = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    # a base phrase is exact, so each diagonal is a place of its own
    new = F.when(F.col("is_base") | F.lag("diagonal").over(order).isNull()
                 | (F.col("diagonal") - F.lag("diagonal").over(order) > MERGE), 1).otherwise(0)
    merged = (diagonals.withColumn("new", new)
              .withColumn("place", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
              .groupBy(*key, "place")
              .agg(F.size(F.array_distinct(F.flatten(F.collect_list("ts")))).alias("n"),
                   F.min("first").alias("first"), (F.max("last") + K - 1).alias("last"),
                   F.min("head").alias("head"), F.max("tail").alias("tail"))
              .withColumns({"near": F.col("head.near"), "t_first": F.col("head.t"), "t_last": F.col("tail.t")}))
    share = F.col("n") / (F.col("size") - (K - 1))
    length = F.col("last") - F.col("first") + 1
    few = F.col("n") >= F.greatest(F.lit(2), F.col("size") - (K - 1) - K * allowed_edits(F.col("size")))
    most = F.greatest(F.when(few, allowed_edits(F.col("size"))).otherwise(-1),
                      F.when(share >= MIN_SHARE, F.floor((1 - MIN_SHARE) * F.col("size"))).otherwise(-1))
    good = F.when(F.col("is_base"), share == 1).otherwise(
        (length <= MAX_STRETCH * F.col("size")) & (most >= 0) & F.coalesce(edits() <= most, F.lit(False)))
    return merged.where(good).select("doc_id", "text_hash", "label", "is_base", "first", "last", share.alias("score"))


def scan(docs: DataFrame) -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels,
    labels, score."""
    base = F.col("is_base")

    def joined(c):
        return F.array_join(F.sort_array(F.collect_set(c)), ",")

    found = (spans(docs).groupBy(F.col("doc_id").alias("_id"), "text_hash")
             .agg(F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"),
                  F.max(F.when(base, F.col("first"))).alias("last_word"),
                  joined(F.when(base, F.col("label"))).alias("base_labels"), joined("label").alias("labels"),
                  F.max("score").alias("score")))
    every = docs.select("doc_id", F.xxhash64("text").alias("_hash"),
                        F.size(scan_words(F.col("text"))).cast("long").alias("n_words"))
    return (every.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("text_hash")), "left")
                 .select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
                         F.col("first_word").cast("long").alias("first_word"),
                         F.col("last_word").cast("long").alias("last_word"),
                         F.coalesce("base_labels", F.lit("")).alias("base_labels"),
                         F.coalesce("labels", F.lit("")).alias("labels"),
                         F.coalesce("score", F.lit(0.0)).cast("double").alias("score")))


def base_places(text: str | None) -> list[tuple[int, str]]:
    """Plain reading of the base rule for tests: (start, label)."""
    import re

    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)
    return [(i, label) for phrase, label in BASE for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
