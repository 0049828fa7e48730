"""Token-id output as ORC files, read back by stripes.

Documents are dealt by ranges of their id and sorted within each range, so
the files hold ascending ids, one after the other. Each row has the id, the
number of ids before it in its file, its length and the token ids; ORC
writes the integers run-length encoded, with a row index every ``stride``
rows and Bloom filters on ``doc_id``. Stripes are read in parallel; a lookup
by id skips files, stripes and row groups by their ranges and filters.

The place of a document in the whole stream is the sum of the files before
it (one sum per file) plus its place in the file, so no row is moved for it.

Defined results: a null text counts as empty and has the end id only; null
ids come first; equal ids are ordered by text; rows that are equal in both
are interchangeable; an empty table gives an empty result. Columns other
than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veeduria.llm.common import partitions, tidy
from veeduria.llm.tokens import encoder, groups
from veeduria.session import scratch_table_dir

END_ID = 2
STRIPE_BYTES = 32 << 20
ROW_INDEX_STRIDE = 1000
FILE_SCHEMA = "doc_id long, part int, offset long, n_tokens int, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, drops_space: bool = False, end_id: int = END_ID,
                 stripe_bytes: int = STRIPE_BYTES, stride: int = ROW_INDEX_STRIDE) -> None:
    """Encode every document and write the id files in ascending id order."""
    end = end_id.to_bytes(4, "little")

    def encode(batches):
        from pyspark import TaskContext

        part, offset = TaskContext.get().partitionId(), 0
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for lo, hi in groups(texts):
                data = [x + end for x in encoder(tokenizer, drops_space).encode(texts[lo:hi])]
                lengths = [len(x) // 4 for x in data]
                places, at = [], 0
                for n in lengths:
                    places.append(at)
                    at += n
                values = pa.Array.from_buffers(pa.int32(), at, [None, pa.py_buffer(b"".join(data))])
                lists = pa.ListArray.from_arrays(pa.array([*places, at], pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array([part] * len(data), pa.int32()),
                     pa.array([offset + p for p in places], pa.int64()), pa.array(lengths, pa.int32()), lists],
                    names=["doc_id", "part", "offset", "n_tokens", "ids"])
                offset += at

    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                   .repartitionByRange(partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first())
                   .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()))
    (ordered.mapInArrow(tidy(encode), FILE_SCHEMA).write
        .option("orc.compress", "ZSTD").option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", stride)
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path))


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows of the id files; with ``doc_ids`` only those, by metadata."""
    df = spark.read.schema(FILE_SCHEMA).orc(path)
    return df if doc_ids is None else df.where(F.col("doc_id").isin(doc_ids))


def with_start(tokens: DataFrame) -> DataFrame:
    """Adds ``start``, the number of ids before each document in all files."""
    files = tokens.groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = files.select(F.col("part").alias("_part"), F.coalesce(before, F.lit(0)).alias("_base"))
    return (tokens.join(base, F.col("part") == F.col("_part"))
                  .withColumn("start", F.col("_base") + F.col("offset")).drop("_part", "_base"))


def digest(tokens: DataFrame) -> DataFrame:
    """Per document, from the ids read: place in the file, length, checksum."""
    def run(batches):
        for b in batches:
            lists = b.column(3)
            ends = lists.offsets.to_pylist()
            data = memoryview(lists.values.to_numpy(zero_copy_only=True)).cast("B")
            sums = [zlib.crc32(data[4 * x:4 * y]) for x, y in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2),
                 pa.array([y - x for x, y in zip(ends, ends[1:])], pa.int64()), pa.array(sums, pa.int64())],
                names=["doc_id", "part", "offset", "n_tokens", "ids_crc32"])
    return tokens.select("doc_id", "part", "offset", "ids").mapInArrow(
        tidy(run), "doc_id long, part int, offset long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, **kw) -> DataFrame:
    """Write the id files of ``docs`` to the shared folder, read them back:
    doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = scratch_table_dir(spark, f"token_orc_{uuid.uuid4().hex[:12]}")
    write_tokens(docs, path, tokenizer, **kw)
    files = read_tokens(spark, path)
    base = with_start(files.select("doc_id", "part", "offset", "n_tokens")).where("offset = 0").select(
        F.col("part").alias("_part"), F.col("start").alias("_base"))
    return (digest(files).join(base, F.col("part") == F.col("_part"))
            .select("doc_id", (F.col("_base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"))
