"""SimHash fingerprints and the search within a Hamming radius.

Terms are lower-cased words and pairs of neighbouring words. Each distinct
term has a 64-bit hash and votes on every bit, plus or minus its weight
``1 + ln(count in the text)``; the signs of the sums are the fingerprint. A
text without words has fingerprint 0.

The search uses permuted block tables: the 64 bits are cut into ``blocks``
blocks; within radius r at most r blocks differ, so two fingerprints agree
in all blocks of at least one choice of ``blocks - r``. Each choice is one
table whose key is the fingerprint masked to the chosen blocks. Distinct
fingerprints are joined on (table, key) and compared by their Hamming
distance. The number of blocks grows with the number of fingerprints, so
that a key has about as many values as there are fingerprints; no bucket is
capped.

Defined results: a null text counts as empty; null ids come first in the
order of documents, equal ids are ordered by text; the document after the
last is the first, so a single document is its own next one; an empty table
gives an empty result. Columns other than ``doc_id`` and ``text`` are not
read.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veeduria.llm.common import partitions, tidy
from veeduria.session import reuse

BITS = 64
RADIUS = 3
_MASK = (1 << 64) - 1


class Hasher:
    """64-bit word hashes, remembered between texts."""

    def __init__(self, keep: int = 400_000):
        self.known: dict[str, int] = {}
        self.keep = keep

    def __call__(self, words: list[str]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        known = self.known
        if len(known) > self.keep:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def simhash(text: str | None, hasher: Hasher) -> int:
    """The fingerprint of a whole text as an unsigned 64-bit integer."""
    words = (text or "").lower().split()
    if not words:
        return 0
    h = hasher(words)
    with np.errstate(over="ignore"):
        pairs = mixed(h[:-1] * np.uint64(3) + h[1:] * np.uint64(0x9E3779B97F4A7C15))
    terms, counts = np.unique(np.concatenate([h, pairs]), return_counts=True)
    weights = (1 + np.log(counts)).astype(np.float32)
    votes = np.zeros(BITS, np.float64)
    for i in range(0, len(terms), 16_384):
        bits = np.unpackbits(terms[i:i + 16_384].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += weights[i:i + 16_384] @ bits.astype(np.float32)
    return int.from_bytes(np.packbits(2 * votes > weights.sum(dtype=np.float64)).tobytes(), "big")


def edited(text: str, following: str) -> str:
    """``text`` with its second half replaced by the head of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def likeness(a: int, b: int) -> float:
    return 1 - (a ^ b).bit_count() / BITS


FINGERPRINTS = ("doc_id long, n_chars long, edited_sha256 string, fp long, edited_fp long, next_fp long, "
                "first_id long, first_text string, last_text string")


def _row(doc_id, text: str, fp: int, following: str, next_fp: int, hasher: Hasher) -> tuple:
    e = edited(text, following)
    return (doc_id, len(text), hashlib.sha256(e.encode()).hexdigest(), fp, simhash(e, hasher), next_fp)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(),
             pa.string()]
    names = [c.split()[0] for c in FINGERPRINTS.split(", ")]
    rows = [(*r[:3], *(x if x is None else _signed(x) for x in r[3:6]), *r[6:]) for r in rows]
    cols = list(zip(*rows)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256 and the fingerprints of
    the text (``fp``), of its edited text and of the next document.

    One shuffle deals the documents by ranges of their id; within a range the
    next document is the next row. The last row of a range needs the first
    one of the next range: each task hands on these two texts, one row per
    task, and they are paired afterwards."""
    def run(batches):
        hasher = Hasher()
        first = held = None                     # (id, text, fp)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                now = (doc_id, text or "", simhash(text, hasher))
                first = first or now
                if held:
                    rows.append((*_row(*held, now[1], now[2], hasher), None, None, None))
                held = now
            yield _batch(rows)
        if held:
            yield _batch([(held[0], None, None, held[2], None, first[2], first[0], first[1], held[1])])

    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                   .repartitionByRange(partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first())
                   .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()))
    made = reuse(ordered.mapInArrow(tidy(run), FINGERPRINTS))

    order = Window.orderBy(F.col("first_id").asc_nulls_first(), F.col("doc_id").asc_nulls_first())
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = made.where("n_chars is null").select("doc_id", F.col("last_text").alias("text"), "fp", *[
        F.coalesce(F.lead(c).over(order), F.first(c).over(whole)).alias(n)
        for c, n in (("first_text", "following"), ("next_fp", "next_fp"))])

    def finish(batches):
        hasher = Hasher()
        for b in batches:
            yield _batch([(*_row(d, t, fp & _MASK, f, nf & _MASK, hasher), None, None, None)
                          for d, t, fp, f, nf in zip(*[c.to_pylist() for c in b.columns])])

    columns = ["doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp"]
    return (made.where("n_chars is not null").select(*columns)
                .unionByName(reuse(edges.mapInArrow(tidy(finish), FINGERPRINTS).select(*columns))))


def blocks_for(n: int, radius: int) -> int:
    """Fewest blocks whose table keys have at least as many values as there
    are fingerprints."""
    blocks = radius + 1
    while blocks < 2 * radius + 4 and (blocks - radius) * BITS // blocks < max(n, 1).bit_length():
        blocks += 1
    return blocks


def table_masks(blocks: int, radius: int) -> list[int]:
    """Bit mask of each table: one for each choice of ``blocks - radius``."""
    edge = [BITS * i // blocks for i in range(blocks + 1)]
    single = [((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in range(blocks)]
    return [sum(c) for c in combinations(single, blocks - radius)]


def near(queries: DataFrame, fingerprints: DataFrame, radius: int = RADIUS, n: int | None = None) -> DataFrame:
    """All pairs (q, fp, distance) of distinct fingerprints of ``queries``
    and ``fingerprints`` (column ``fp``) at Hamming distance ``radius`` or
    less, by the permuted block tables."""
    f = fingerprints.select("fp").distinct()
    masks = table_masks(blocks_for(f.count() if n is None else n, radius), radius)
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(masks)])

    def keyed(df, name):
        x = df.select(F.col("fp").alias(name), F.explode(tables).alias("k"))
        return x.select(name, F.col("k.t").alias("t"), F.col(name).bitwiseAND(F.col("k.mask")).alias("key"))

    hits = keyed(queries.select("fp").distinct(), "q").join(keyed(f, "fp"), ["t", "key"])
    distance = F.bit_count(F.col("q").bitwiseXOR(F.col("fp")))
    return hits.select("q", "fp", distance.alias("distance")).where(F.col("distance") <= radius).distinct()


def report(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Fingerprints with their likeness, and for every document whose id is
    divisible by 20 the number of other documents within ``radius``."""
    fps = reuse(fingerprint_pairs(docs))
    classes = reuse(fps.groupBy("fp").agg(F.count(F.lit(1)).alias("n")))
    found = near(fps.where("doc_id % 20 = 0"), classes, radius)
    counts = (found.join(classes, "fp").groupBy(F.col("q").alias("_q"))
                   .agg((F.sum("n") - 1).alias("_near")))

    def shown(c):
        return F.lpad(F.lower(F.hex(c)), 16, "0")

    def alike(c):
        return 1 - F.bit_count(F.col("fp").bitwiseXOR(F.col(c))) / float(BITS)

    return (fps.join(counts, F.col("fp") == F.col("_q"), "left")
               .select("doc_id", "n_chars", "edited_sha256", shown("fp").alias("fingerprint"),
                       shown("edited_fp").alias("edited_fingerprint"), alike("edited_fp").alias("near_edited"),
                       alike("next_fp").alias("near_next"),
                       F.when(F.col("doc_id") % 20 == 0, F.col("_near")).alias("n_near")))
