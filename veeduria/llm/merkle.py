"""Merkle manifest of a dataset, with levels kept as concatenated strings.

Each row is a leaf. Leaves are ranked within their language by range
partitions and prefix sums over the partitions' totals. Aligned blocks of
``2 ** LEVELS`` leaves are gathered; a block keeps each of its levels as one
string of 64 hex digits a node, so the parents of a level are the hashes of
its consecutive 128-digit substrings, and the siblings of a node are the
substrings that flank it in its run. The block roots are the leaves of the
next, 256 times smaller, table, and so on until each language has one block;
its root is the language's subroot. The subroots, ranked by language, go
through the same steps to the root.

On the way back a block root's siblings up to the root are appended to those
inside its block, from the top down, so each row gets its whole proof by one
join of blocks. A proof is checked by folding: the leaf is hashed with its
siblings, each on its side, level by level.

All work is built-in expressions. A task holds blocks of 256 nodes, whatever
a language's share of the rows; the driver sees one number a level. Tables
between the steps lie in the shared folder, so a lost executor costs its
tasks only.

Defined results: rows of a language ascend by id, null ids first; rows of
equal id ascend by leaf; rows that are equal in all columns have neighbouring
places; a null id is never tampered with; an empty table gives an empty
result. Columns other than the five of a leaf are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veeduria.llm.common import partitions
from veeduria.session import drop_written, reuse

LEVELS = 8                   # levels in a block: 256 nodes, 16 kB of hex digits
ARITY = 2
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED_EVERY = 7


def sha(c: Column) -> Column:
    return F.sha2(c, 256)


def leaf(*fields: Column) -> Column:
    """Hash of the fields, each ``-`` if null, else its length in bytes, a
    colon and its text."""
    def written(c):
        c = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return sha(F.concat(*map(written, fields)))


def leaves(docs: DataFrame) -> DataFrame:
    """(key, doc_id, digest, tampered): ``key`` orders languages, null first;
    ``tampered`` is the altered row's leaf, null for a row left alone."""
    d = docs.select(*FIELDS)
    altered = F.col("n_chars").cast("decimal(20,0)") + 1
    rest = [F.col(c) for c in ("doc_id", "source", "lang")]
    hit = F.crc32(F.col("doc_id").cast("string")) % TAMPERED_EVERY == 0
    return d.select(F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-")).alias("key"),
                    F.col("doc_id").cast("long").alias("doc_id"),
                    leaf(*(F.col(c) for c in FIELDS)).alias("digest"),
                    F.when(hit, leaf(*rest, altered, F.col("text"))).alias("tampered"))


def ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``pos``, the place (from 0) within ``key``, and ``n``,
    the number of nodes of the key; key and ``order`` name each node alone."""
    sort = [F.col(c).asc_nulls_first() for c in ("key", *order)]
    dealt = reuse(nodes.repartitionByRange(partitions(nodes.sparkSession), *sort).sortWithinPartitions(*sort)
                  .withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    totals = dealt.groupBy("key", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    key = Window.partitionBy("key")
    before = F.sum("_n").over(key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("key", "_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"),
                           F.sum("_n").over(key).alias("n"))
    return (dealt.join(totals, ["key", "_part"])
                 .withColumn("pos", F.col("_before") + F.col("_row") - F.col("_first"))
                 .drop("_part", "_row", "_first", "_before"))


def _part_of(level: Column, start: Column, length: Column) -> Column:
    # of bytes, as a place in a string is found by walking through it
    return F.substring(level.cast("binary"), start + 1, length)


def _parents(level: Column) -> Column:
    runs = F.ceil(F.octet_length(level) / (ARITY * HEX)).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), runs - 1),
                                    lambda i: sha(_part_of(level, i * (ARITY * HEX), F.lit(ARITY * HEX)))), "")


def _upto(n: Column) -> Column:
    """1 to n; nothing for 0, where ``sequence`` would count down."""
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def blocks(nodes: DataFrame) -> DataFrame:
    """(key, blk, n, rows, levels): aligned blocks of nodes, ``levels[0]``
    the digests of their nodes and the last one their root."""
    payload = [c for c in nodes.columns if c not in ("key", "pos", "n", "digest")]
    size = 1 << LEVELS
    b = (nodes.groupBy("key", F.floor(F.col("pos") / size).alias("blk"), "n")
              .agg(F.sort_array(F.collect_list(F.struct("pos", "digest", *payload))).alias("rows")))
    # levels up to one node: of the whole tree if it is within this block
    depth = F.when(F.col("n") <= 1, 0).when(F.col("n") > size, LEVELS).otherwise(F.length(F.bin(F.col("n") - 1)))
    start = F.array(F.array_join(F.transform("rows", lambda r: r["digest"]), ""))
    levels = F.aggregate(_upto(depth.cast("int")), start,
                         lambda done, _: F.concat(done, F.array(_parents(F.element_at(done, -1)))))
    return b.select("key", "blk", "n", "rows", levels.alias("levels"))


def tree(nodes: DataFrame) -> list[DataFrame]:
    """The block tables of every key's tree, from its nodes (key, pos, n,
    digest and others) to one block; each is written once."""
    tables = [reuse(blocks(nodes))]
    size = 1 << LEVELS
    while (tables[-1].agg(F.max("n")).first()[0] or 0) > size:
        up = tables[-1].select("key", F.col("blk").alias("pos"), F.ceil(F.col("n") / size).alias("n"),
                               F.element_at("levels", -1).alias("digest"))
        tables.append(reuse(blocks(up)))
    return tables


def roots(tables: list[DataFrame]) -> DataFrame:
    return tables[-1].select("key", F.element_at("levels", -1).alias("digest"))


def _opened(table: DataFrame, above: DataFrame) -> DataFrame:
    """The nodes of a block table, each with the siblings and sides of its
    whole path: those within the block, then those of ``above``."""
    payload = [f.name for f in table.schema["rows"].dataType.elementType.fields]
    beyond = [c for c in above.columns if c not in ("key", "blk", "siblings", "sides")]

    def path(r):
        at = r["pos"] % (1 << LEVELS)
        depth = _upto(F.size("levels") - 1)

        def flanks(l):
            level = F.element_at("levels", l)
            place = F.floor(at / F.pow(F.lit(ARITY), l - 1)).cast("int")
            within = place % ARITY
            return (_part_of(level, (place - within) * HEX, within * HEX),
                    _part_of(level, (place + 1) * HEX, (ARITY - 1 - within) * HEX))

        def sibling(l):
            left, right = flanks(l)
            return F.concat(left, right).cast("string")

        def side(l):
            left, right = flanks(l)
            return F.when(F.octet_length(left) > 0, "l").when(F.octet_length(right) > 0, "r").otherwise("-")
        return F.struct(*[r[c].alias(c) for c in payload],
                        F.concat(F.array_join(F.transform(depth, sibling), ""), F.col("siblings")).alias("siblings"),
                        F.concat(F.array_join(F.transform(depth, side), ""), F.col("sides")).alias("sides"))

    # outer: a plain explode would have its input evaluated a second time by an inferred filter
    return (table.join(above, ["key", "blk"])
                 .select("key", *beyond, F.explode_outer(F.transform("rows", path)).alias("_node"))
                 .select("key", *beyond, "_node.*"))


def paths(tables: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves of a tree with their whole paths; ``above`` has for each
    key the siblings and sides beyond the tree's root, and what to carry."""
    above = above.withColumn("blk", F.lit(0).cast("long"))
    for table in reversed(tables[1:]):
        above = _opened(table, above).withColumnRenamed("pos", "blk").drop("digest")
    return _opened(tables[0], above)


def folded(start: Column, siblings: Column, sides: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    def step(s, i):
        h, side, at = s["h"], F.substring(sides, i, F.lit(1)), s["at"]
        other = F.substring(siblings, at + 1, F.lit(HEX))
        return F.struct(sha(F.when(side == "l", F.concat(other, h)).when(side == "r", F.concat(h, other)).otherwise(h)
                            ).alias("h"),
                        (at + F.when(side == "-", 0).otherwise(HEX)).alias("at"))
    return F.aggregate(_upto(F.length(sides)), F.struct(start.alias("h"), F.lit(0).alias("at")), step, lambda s: s["h"])


def manifest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root,
    verified."""
    # written first: ranges are sampled, which would hash all texts twice; rows that are equal get a number
    hashed = reuse(leaves(docs).withColumn("_tie", F.monotonically_increasing_id()))
    placed = ranked(hashed, ["doc_id", "digest", "_tie"]).drop("_tie")
    langs = tree(placed)
    drop_written(hashed)
    drop_written(placed)
    top = tree(ranked(roots(langs).withColumns({"lang": F.col("key"), "key": F.lit("")}), ["lang"]))
    start = top[-1].select("key", F.element_at("levels", -1).alias("root"), F.lit("").alias("siblings"),
                           F.lit("").alias("sides"))
    subroots = paths(top, start).select(F.col("lang").alias("key"), F.col("digest").alias("subroot"), "root",
                                        "siblings", "sides")
    rows = paths(langs, subroots)
    fold = folded(F.coalesce("tampered", "digest"), F.col("siblings"), F.col("sides"))
    return (rows.withColumn("folded_root", fold)
                .select("doc_id", F.col("digest").alias("leaf"), "subroot", "root",
                        sha(F.col("siblings")).alias("proof_sha256"), "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified")))


_CRC32 = """xor(list_reduce(flatten(list_transform(range(1, length({s}) + 1),
    lambda i: [ascii(substr({s}, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END, 4294967295), 4294967295)"""


def _written(c: str) -> str:
    return f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')"


def _leaf(*fields: str) -> str:
    return f"sha256({' || '.join(map(_written, fields))})"


#: The same rows by DuckDB: each tree as lists of digests, a fold by rows.
SQL = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS key, {_leaf(*FIELDS)} AS digest,
         CASE WHEN {_CRC32.format(s="doc_id::VARCHAR")} % {TAMPERED_EVERY} = 0
              THEN {_leaf("doc_id", "source", "lang", "n_chars + 1", "text")} END AS tampered
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos FROM leaf),
tree(key, lvl, hs) AS (
  SELECT key, 0, list(digest ORDER BY pos) FROM placed GROUP BY key
  UNION ALL
  SELECT key, lvl + 1, list_transform(range(1, len(hs) + 1, 2), lambda i: sha256(hs[i] || coalesce(hs[i + 1], '')))
  FROM tree WHERE len(hs) > 1),
subs AS (SELECT key, lvl, hs[1] AS subroot FROM tree WHERE len(hs) = 1),
ranks AS (SELECT key, lvl, subroot, row_number() OVER (ORDER BY encode(key)) - 1 AS pos FROM subs),
top(lvl, hs) AS (
  SELECT 0, list(subroot ORDER BY pos) FROM ranks HAVING count(*) > 0
  UNION ALL
  SELECT lvl + 1, list_transform(range(1, len(hs) + 1, 2), lambda i: sha256(hs[i] || coalesce(hs[i + 1], '')))
  FROM top WHERE len(hs) > 1),
steps AS (
  SELECT p.key, p.pos AS leaf_pos, t.lvl, p.pos // (2 ** t.lvl)::BIGINT AS pos, t.hs FROM placed p JOIN tree t USING (key)
  WHERE len(t.hs) > 1
  UNION ALL
  SELECT p.key, p.pos, r.lvl + t.lvl, r.pos // (2 ** t.lvl)::BIGINT, t.hs
  FROM placed p JOIN ranks r USING (key), top t WHERE len(t.hs) > 1),
sides AS (
  SELECT key, leaf_pos, list(struct_pack(l := CASE WHEN pos % 2 = 1 THEN hs[pos] ELSE '' END,
                                         r := CASE WHEN pos % 2 = 0 THEN coalesce(hs[pos + 2], '') ELSE '' END)
                             ORDER BY lvl) AS s
  FROM steps GROUP BY key, leaf_pos),
fold(key, pos, h, s, k) AS (
  SELECT p.key, p.pos, coalesce(p.tampered, p.digest), coalesce(s.s, []), 1
  FROM placed p LEFT JOIN sides s ON s.key = p.key AND s.leaf_pos = p.pos
  UNION ALL
  SELECT key, pos, sha256(s[k].l || h || s[k].r), s, k + 1 FROM fold WHERE k <= len(s))
SELECT p.doc_id, p.digest AS leaf, r.subroot, root.h AS root,
       sha256(array_to_string(list_transform(f.s, lambda x: x.l || x.r), '')) AS proof_sha256,
       f.h AS folded_root, f.h = root.h AS verified
FROM placed p JOIN ranks r USING (key) JOIN fold f ON f.key = p.key AND f.pos = p.pos AND f.k > len(f.s),
     (SELECT hs[1] AS h FROM top WHERE len(hs) = 1) root"""
