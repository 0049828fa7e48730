"""Packing documents into fixed windows: bounded-space online best fit.

Each task streams its documents and keeps at most ``open_windows`` windows
open. A document is cut into whole windows and a rest; the rest goes to the
open window that it fits with the least room left. Where it fits none and no
window may be opened, the fullest window is topped up with the head of the
rest (documents may be cut anywhere) and emitted full. Windows still open at
the end of a task, at most ``open_windows`` per task, are merged: their
pieces are laid end to end by running sums and cut at window borders. So all
windows are full but the last one; what a task holds is bounded by its open
windows, and no document is shuffled.

Defined results: a null text counts as empty and has the end id only; null
and repeated ids are packed like any other row; an empty table gives no
piece. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veeduria.llm.common import tidy
from veeduria.llm.tokens import encoder, forgetting, groups
from veeduria.session import reuse

WINDOW = 4096
OPEN_WINDOWS = 16
END_ID = 2
PIECES = ("doc_id long, doc_tokens long, start long, length long, part long, seq long, offset long, "
          "ids_crc32 long, ids binary, closed boolean")


class Packer:
    """Open windows of one task. ``add`` yields the windows it closes; a
    window is a list of (doc_id, doc_tokens, start, ids as bytes)."""

    def __init__(self, size: int = WINDOW, most: int = OPEN_WINDOWS):
        self.size, self.most, self.open = size, most, []      # open: [room, pieces]

    def add(self, doc_id, data: bytes):
        total, start = len(data) // 4, 0
        while total - start >= self.size:
            yield [(doc_id, total, start, data[4 * start:4 * (start + self.size)])]
            start += self.size
        while start < total:
            need = total - start
            fitting = [w for w in self.open if w[0] >= need]
            if fitting:
                w = min(fitting, key=lambda x: x[0])
            elif len(self.open) < self.most:
                w = [self.size, []]
                self.open.append(w)
            else:
                w = min(self.open, key=lambda x: x[0])        # the fullest
                need = w[0]
            w[1].append((doc_id, total, start, data[4 * start:4 * (start + need)]))
            w[0] -= need
            start += need
            if not w[0]:
                self.open = [x for x in self.open if x is not w]
                yield w[1]


def pack(docs: DataFrame, tokenizer: str, drops_space: bool = True, end_id: int = END_ID, window: int = WINDOW,
         open_windows: int = OPEN_WINDOWS, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and with ``with_ids`` the ids as binary."""
    end = end_id.to_bytes(4, "little")

    def run(batches):
        from pyspark import TaskContext

        part, packer, seq = TaskContext.get().partitionId(), Packer(window, open_windows), 0
        rows: list[tuple] = []

        def flush():
            cols = list(zip(*rows)) if rows else [()] * 10
            types = [pa.int64()] * 8 + [pa.binary(), pa.bool_()]
            names = ["doc_id", "doc_tokens", "start", "length", "part", "seq", "offset", "ids_crc32", "ids", "closed"]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
            rows.clear()
            return batch

        def put(pieces, offset, closed):
            for doc_id, total, start, ids in pieces:
                n = len(ids) // 4
                rows.append((doc_id, total, start, n, part, seq, offset, zlib.crc32(ids),
                             ids if with_ids or not closed else None, closed))
                offset += n
            return offset

        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in groups(texts):
                for doc_id, data in zip(ids[lo:hi], encoder(tokenizer, drops_space).encode(texts[lo:hi])):
                    for pieces in packer.add(doc_id, data + end):
                        put(pieces, 0, True)
                        seq += 1
                yield flush()
        offset = 0
        for _, pieces in packer.open:
            offset = put(pieces, offset, False)
        yield flush()

    made = reuse(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        tidy(forgetting(run, tokenizer, drops_space)), PIECES))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    full = (made.where("closed").withColumn("sequence_id", F.shiftleft(F.col("part") + 1, 36) + F.col("seq"))
                .select(*columns))
    return full.unionByName(merged(made.where("not closed"), window).select(*columns))


def merged(left: DataFrame, window: int = WINDOW) -> DataFrame:
    """Leftover pieces, laid end to end by part and place, cut at borders."""
    totals = left.groupBy("part").agg(F.sum("length").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = totals.select(F.col("part").alias("_part"), F.coalesce(before, F.lit(0)).alias("_base"))
    x = (left.join(base, F.col("part") == F.col("_part")).withColumn("at", F.col("_base") + F.col("offset"))
             .withColumn("to", F.col("at") + F.col("length"))
             .withColumn("sequence_id", F.explode(F.sequence(
                 F.floor(F.col("at") / window), F.floor((F.col("to") - 1) / window)))))
    first = F.greatest(F.col("at"), F.col("sequence_id") * window)
    last = F.least(F.col("to"), (F.col("sequence_id") + 1) * window)
    x = x.withColumn("_first", first).withColumn("_n", last - first)
    ids = F.substring("ids", (4 * (F.col("_first") - F.col("at")) + 1).cast("int"), (4 * F.col("_n")).cast("int"))
    return x.select("doc_id", "doc_tokens", (F.col("start") + F.col("_first") - F.col("at")).alias("start"),
                    F.col("_n").alias("length"), "sequence_id",
                    (F.col("_first") - F.col("sequence_id") * window).alias("offset"),
                    ids.alias("ids")).withColumn("ids_crc32", F.crc32("ids"))
