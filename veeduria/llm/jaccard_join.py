"""Exact n-gram Jaccard join with signature trees.

A document's set holds the 64-bit hashes of its distinct 5-word shingles.
Documents with equal sets are one class (compared by 128 bits of the set and
its size). Two classes link at Jaccard 0.75 or more. No link is estimated:

1. Count filter. A link needs three quarters of a set's shingles in another
   document, so a document with fewer recurring shingles is out. This takes
   one scan and no row per shingle (``recurring``).
2. Prefix filter over the classes that are left. Shingles are ordered by how
   many classes have them; linked classes share one of the rarest
   ``n - ceil(0.75 n) + 1``. Classes that share one are put into the same
   cluster (connected components), so every link lies within a cluster.
3. Signature trees within each cluster. A node holds the OR of its members'
   token bitmaps and the range of their sizes; the root pair is expanded
   down to members, and a pair of nodes is dropped when the sizes do not fit
   or the common bits do not allow the overlap needed. Members that pass are
   compared exactly. Members that are already connected need no comparison,
   so a dense group costs about one comparison per member, and only a
   spanning forest of the links leaves the task. A cluster beyond
   ``BLOCK_SHINGLES``, or of very unequal sizes, is cut into blocks of
   neighbouring sizes and each pair of blocks that can have links is a task of
   its own; so a long text does not widen the bitmaps of short ones.
4. The components of the forests, named by their smallest document id.

Defined results: a null text counts as empty; a document without words has
an empty set and is linked with nothing; with fewer than five words the
whole sequence is its one shingle; null ids take part, but never name a
component (null if it has no other id); repeated rows are copies like any
other; an empty table gives an empty result. Columns other than ``doc_id``
and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veeduria.llm.common import tidy, tidy_group
from veeduria.llm.fingerprints import Hasher, mixed
from veeduria.llm.recurring import mark_recurring
from veeduria.operators.graph import connected_components
from veeduria.session import drop_written, reuse

WORDS = 5
PERCENT = 75
BLOCK_SHINGLES = 4_000_000
WIDE = 16
BITMAP = 1024
FAN_OUT = 16


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes."""
    with np.errstate(over="ignore"):
        out = h[:len(h) - k + 1].copy()
        for j in range(1, k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[j:len(h) - k + 1 + j]
        return mixed(out)


def shingles(text: str | None, hasher: Hasher) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    h = hasher((text or "").encode().lower().split())
    return np.unique(rolling(h, min(WORDS, len(h)))) if len(h) else h


def linked(n_common: int, n_a: int, n_b: int, percent: int = PERCENT) -> bool:
    return 100 * n_common >= percent * (n_a + n_b - n_common)


def identity(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def candidates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per document: id, hash of the text, set size, class (c1, c2), and
    whether enough of its shingles recur (``maybe``)."""
    hasher = Hasher()       # one per task: sent empty, dropped with the task

    def hashes(doc_id, text_key, text):
        s = shingles(text, hasher)
        return s, (doc_id, text_key, len(s), *identity(s))

    def finish(meta, mask):
        n = meta[2]
        return [(*meta, bool(n) and 100 * int(mask.sum()) >= percent * n)]

    return mark_recurring(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text"), "text"), hashes,
                          finish, "doc_id long, text_key long, n_shingles long, c1 long, c2 long, maybe boolean")


MAP_BITS = 1 << 24


def id_bitmap(rows: DataFrame) -> np.ndarray:
    """Bitmap of ``MAP_BITS`` bits of the rows' hashes ``h``: 2 MB at most,
    whatever the number of rows."""
    bit = (F.pmod("h", F.lit(MAP_BITS)) + 1).alias("bit")
    got = (rows.select(bit).groupBy(F.bitmap_bucket_number("bit").alias("k"))
               .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("m")).collect())
    out = np.zeros((MAP_BITS // 32_768 + 2, 4096), np.uint8)
    for r in got:
        out[r["k"]] = np.frombuffer(r["m"], np.uint8)
    return np.unpackbits(out[1:].reshape(-1), bitorder="little")


def sets_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Shingle sets (c1, c2, n, tokens) of the classes' first documents.

    Texts are not shuffled: the scan skips the documents whose id is not in
    a bitmap of the first documents' ids, and the sets that a shared bit lets
    through are dropped by their class. A text that several documents of a
    task share is emitted once."""
    bits = np.packbits(id_bitmap(classes.select(F.xxhash64(F.col("rep").cast("long")).alias("h"))))

    def run(batches):
        known, hasher = np.unpackbits(bits), Hasher()
        seen = set()
        for b in batches:
            rows = []
            for h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if known[h]:
                    s = shingles(text, hasher)
                    key = identity(s)
                    if key not in seen:
                        seen.add(key)
                        rows.append((*key, len(s), s.view(np.int64)))
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))],
                names=["c1", "c2", "n", "tokens"])
    texts = docs.select(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(MAP_BITS)).alias("h"), "text")
    return texts.mapInArrow(tidy(run), "c1 long, c2 long, n long, tokens array<long>").join(
        classes.select("c1", "c2"), ["c1", "c2"], "left_semi")


def clusters(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(c1, cluster): classes that share a prefix shingle are together."""
    occ = sets.select("c1", F.explode_outer("tokens").alias("token"))
    # counted before the rows meet, and written: a join of two plain
    # shuffles, of which a hot shingle's rows can be split
    often = reuse(occ.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    shared = (occ.join(often, "token").groupBy("c1").agg(F.sort_array(F.collect_set(F.struct("df", "token"))).alias("t"))
                 .join(sets.groupBy("c1").agg(F.first("n").alias("n")), "c1"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    take = prefix - (F.col("n") - F.size("t"))      # the shingles of no other class come first
    head = (shared.withColumn("take", take.cast("int")).where("take > 0")
                  .select("c1", F.explode_outer(F.slice(F.col("t"), F.lit(1), F.col("take"))).alias("t"))
                  .select("c1", "t.token"))
    head = reuse(head)
    lead = reuse(head.groupBy("token").agg(F.min("c1").alias("lead"), F.count(F.lit(1)).alias("k"))
                     .where("k > 1").drop("k"))
    edges = head.join(lead, "token").where("c1 <> lead").select("c1", "lead").distinct()
    found = connected_components(edges, "c1", "lead")
    for t in (often, head, lead):
        drop_written(t)
    return found.select(F.col("node").alias("c1"), F.col("component").alias("cluster"))


class Tree:
    """Signature tree over sets sorted by size: level 0 are the members."""

    def __init__(self, sets: list[np.ndarray], bits: int = BITMAP):
        self.sets = sets
        n = np.array([len(s) for s in sets], np.int64)
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        for i, s in enumerate(sets):
            at = np.unique((s >> np.uint64(20)) % np.uint64(bits)).astype(np.int64)
            np.bitwise_or.at(maps[i], at // 64, np.uint64(1) << (at % 64).astype(np.uint64))
        # shingles beyond one per set bit may add to an overlap unseen
        hidden = n - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        self.levels = [(maps, n, n, hidden)]
        while len(self.levels[-1][0]) > 1:
            m, lo, hi, hid = self.levels[-1]
            at = np.arange(0, len(m), FAN_OUT)
            self.levels.append((np.bitwise_or.reduceat(m, at, axis=0), np.minimum.reduceat(lo, at),
                                np.maximum.reduceat(hi, at), np.maximum.reduceat(hid, at)))

    def children(self, level: int, i: int) -> np.ndarray:
        return np.arange(i * FAN_OUT, min((i + 1) * FAN_OUT, len(self.levels[level - 1][0])))

    def members(self, level: int, i: int) -> slice:
        return slice(i * FAN_OUT ** level, min((i + 1) * FAN_OUT ** level, len(self.sets)))


def possible(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of nodes i of level a and j of level b can hold a link."""
    (ma, lo_a, hi_a, hid_a), (mb, lo_b, hi_b, hid_b) = ([x[k] for x in lv] for lv, k in ((a, i), (b, j)))
    common = np.bitwise_count(ma[:, None, :] & mb[None, :, :]).sum(axis=2, dtype=np.int64)
    most = np.minimum(common + np.minimum(hid_a[:, None], hid_b[None, :]), np.minimum(hi_a[:, None], hi_b[None, :]))
    return (100 + percent) * most >= percent * (lo_a[:, None] + lo_b[None, :])


def forest(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Spanning forest of the links among ``left`` and, where given, ``right``
    (numbered after ``left``), by dual traversal."""
    sets = left if right is None else left + right
    label = np.arange(len(sets))
    parts = {i: [i] for i in range(len(sets))}
    bits = max(BITMAP, 1 << (2 * max(map(len, sets), default=1)).bit_length())
    links: list[tuple[int, int]] = []

    def join(x: int, y: int):
        """The smaller part takes the label of the larger."""
        small, large = sorted((int(x), int(y)), key=lambda k: len(parts[k]))
        moved = parts.pop(small)
        label[moved] = large
        parts[large] += moved

    def traverse(a: Tree, off_a: int, b: Tree, off_b: int):
        top = (len(a.levels) - 1, 0, len(b.levels) - 1, 0)
        stack = [top] if a.sets and b.sets else []
        while stack:
            la, i, lb, j = stack.pop()
            x, y = a.members(la, i), b.members(lb, j)
            seen = np.concatenate([label[off_a + x.start:off_a + x.stop], label[off_b + y.start:off_b + y.stop]])
            if seen.min() == seen.max() and (len(seen) > 1):
                continue
            ca = a.children(la, i) if la else np.array([i])
            cb = b.children(lb, j) if lb else np.array([j])
            down_a, down_b = max(la - 1, 0), max(lb - 1, 0)
            ok = possible(a.levels[down_a], ca, b.levels[down_b], cb, percent)
            for p, q in np.argwhere(ok):
                u, v = int(ca[p]), int(cb[q])
                if a is b and down_a == down_b and u > v:
                    continue
                if down_a or down_b:
                    stack.append((down_a, u, down_b, v))
                elif label[off_a + u] != label[off_b + v]:
                    s, t = a.sets[u], b.sets[v]
                    if linked(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t), percent):
                        links.append((off_a + u, off_b + v))
                        join(label[off_a + u], label[off_b + v])

    one = Tree(left, bits)
    traverse(one, 0, one, 0)
    if right is not None:
        other = Tree(right, bits)
        traverse(other, len(left), other, len(left))
        traverse(one, 0, other, len(left))
    return links


def blocks(sets: DataFrame, cluster: DataFrame, percent: int = PERCENT, block: int = BLOCK_SHINGLES) -> DataFrame:
    """(c1, c2, n, cluster, block). A cluster is one block while it has at
    most ``block`` shingles and its trees' bitmaps, as wide as its largest
    set asks for, stay within ``WIDE`` times as many bits. Beyond, it is cut
    into bands in which sizes grow by ``100 / percent`` at most, and a band
    into parts of about ``block`` shingles by the hash of the class: sums per
    band decide, no window holds a cluster. Block numbers grow with the
    band."""
    sized = sets.select("c1", "c2", "n").distinct().join(cluster, "c1")
    growth = max(math.log(100 / percent), 0.01)
    band = F.floor(F.log(F.col("n").cast("double")) / growth)
    sized = reuse(sized.withColumn("band", band))
    bands = sized.groupBy("cluster", "band").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("k"), F.max("n").alias("top"))
    whole = (bands.groupBy("cluster").agg(F.sum("all").alias("all"), F.sum("k").alias("k"), F.max("top").alias("top"))
                  .select("cluster", ((F.col("all") <= block) & (F.col("k") * F.col("top") <= WIDE * block)).alias("whole")))
    cut = reuse(bands.join(whole, "cluster").where("not whole")
                     .select("cluster", "band", F.ceil(F.col("all") / block).alias("parts")))
    part = F.pmod(F.xxhash64("c1", "c2"), F.col("parts"))
    return (sized.join(cut, ["cluster", "band"], "left")
                 .select("c1", "c2", "n", "cluster",
                         F.when(F.col("parts").isNull(), F.lit(-1)).otherwise(F.shiftleft(F.col("band"), 32) + part).alias("block")))


def links(sets: DataFrame, cluster: DataFrame, percent: int = PERCENT, block: int = BLOCK_SHINGLES) -> DataFrame:
    """(a, b): spanning forests of the links within all clusters."""
    sized = reuse(blocks(sets, cluster, percent, block))
    ranges = sized.groupBy("cluster", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    other = ranges.select(F.col("cluster").alias("k2"), F.col("block").alias("right"), F.col("lo").alias("lo2"),
                          F.col("hi").alias("hi2"))
    # sizes grow with the band: a pair of blocks can link if the first one's
    # largest set is long enough for the second one's smallest
    pairs = (ranges.withColumnRenamed("block", "left")
                   .join(other, (F.col("cluster") == F.col("k2")) & (F.col("left") <= F.col("right")))
                   .where(100 * F.col("hi") >= percent * F.col("lo2")))
    # a block with a partner is compared within itself there
    alone = Window.partitionBy("cluster", "left")
    pairs = (pairs.withColumn("partners", F.max("right").over(alone))
                  .where((F.col("left") < F.col("right")) | (F.col("partners") == F.col("left"))).select("cluster", "left", "right"))
    sides = pairs.select("cluster", "left", "right", F.explode(F.array_distinct(F.array("left", "right"))).alias("block"))
    # narrow rows first: the sets move once to their class and once to their task
    places = reuse(sized.select("c1", "c2", "cluster", "block").join(sides, ["cluster", "block"]))
    placed = sets.select("c1", "c2", "tokens").join(places, ["c1", "c2"])

    def run(table: pa.Table) -> pa.Table:
        rows = {}
        for c1, c2, tokens, blk, lf in zip(*[table[c].to_pylist() for c in ("c1", "c2", "tokens", "block", "left")]):
            rows[c1, c2] = (len(tokens), c1, c2, blk == lf, np.array(tokens, np.int64).view(np.uint64))
        order = sorted(rows.values(), key=lambda r: r[:3])
        first, second = ([r for r in order if r[3] is side] for side in (True, False))
        names = [r[1] for r in first + second]
        found = forest([r[4] for r in first], [r[4] for r in second] or None, percent)
        return pa.table({"a": pa.array([names[i] for i, _ in found], pa.int64()),
                         "b": pa.array([names[j] for _, j in found], pa.int64())})

    return placed.groupBy("cluster", "left", "right").applyInArrow(tidy_group(run), "a long, b long")


def components(docs: DataFrame, percent: int = PERCENT, block: int = BLOCK_SHINGLES) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, a hash of its text and
    ``label``, the component's number (null for a document without words)."""
    every = reuse(candidates(docs, percent))
    classes = reuse(every.where("maybe").groupBy("c1", "c2").agg(F.min("doc_id").alias("rep")))
    sets = reuse(sets_of(docs, classes))
    found = reuse(links(sets, clusters(sets, percent), percent, block))
    label = connected_components(found, "a", "b").select(F.col("node").alias("c1"), "component")
    named = classes.join(label, "c1", "left").withColumn("label", F.coalesce("component", "c1"))
    names = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.join(names, "label").select(F.col("c1").alias("_c1"), F.col("c2").alias("_c2"), "component_id", "label")
    return (every.join(named, (F.col("c1") == F.col("_c1")) & (F.col("c2") == F.col("_c2"))
                       & (F.col("n_shingles") > 0), "left")
                 .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "text_key",
                         F.when(F.col("n_shingles") > 0, F.coalesce("label", "c1")).alias("label")))


def keep_first(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns: of each component the document
    with the smallest id, and every document without words."""
    c = reuse(components(docs, percent))
    first = c.where("label is not null").groupBy("label").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("f")).select("f.doc_id", "f.text_key")
    bare = c.where("label is null").select("doc_id", "text_key").distinct()
    rows = c.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"), F.max("n_shingles").alias("size"))
    keep = reuse(first.unionByName(bare).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).join(
        rows, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key")))
        .select("_id", "_key", ((F.col("n") > 1) & (F.col("size") > 0)).alias("_repeated")))

    def chosen(k):
        return docs.join(k, docs["doc_id"].cast("long").eqNullSafe(k["_id"])
                         & (F.xxhash64(docs["text"]) == k["_key"]), "left_semi")
    if keep.where("_repeated").isEmpty():
        return chosen(keep)
    # rows equal in id and text are copies too: one of them stays
    return chosen(keep.where("not _repeated")).unionByName(
        chosen(keep.where("_repeated")).dropDuplicates(["doc_id", "text"]))


_WORDS = ("list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          "'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')")

#: The components' first three columns by DuckDB: all pairs that share a
#: shingle are counted, and their links closed over.
SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x AS a, y AS b FROM p JOIN z i ON i.doc_id = x JOIN z j ON j.doc_id = y WHERE 100 * c >= 75 * (i.n + j.n - c)),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, lbl) AS (SELECT a, a FROM l UNION SELECT l.b, r.lbl FROM r JOIN l ON l.a = r.node)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, coalesce(m.lbl, d.doc_id) AS component_id
FROM d LEFT JOIN z USING (doc_id) LEFT JOIN (SELECT node, min(lbl) AS lbl FROM r GROUP BY 1) m ON m.node = d.doc_id"""
