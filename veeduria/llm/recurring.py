"""Which hashes of a corpus occur more than once, found with little traffic.

Each task walks its documents in chunks. Hashes that repeat within a chunk
are known at once; every other hash is sent, as 32 bits of it, to the bucket
that its remaining bits name, packed with the hashes of the same chunk and
bucket in one binary row (places as gaps, in byte planes that compress). A hash that a third of all documents carry
therefore leaves a task once per chunk. The bucket tells which of the sent
hashes came from elsewhere too, and one row per chunk and bucket goes back
to the chunk. Cutting hashes to 32 bits and a bucket can only report too
many as recurring, never too few; callers verify what is reported.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veeduria.llm.common import partitions, tidy, tidy_group

CHUNK_HASHES = 1_000_000
_SENT = "bucket int, chunk long, at binary, cut binary, known binary, meta binary"
_FOUND = "chunk long, at binary, meta binary"


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(cols, fields)],
                                      names=[n for n, _ in fields])


def _gaps(at: np.ndarray) -> bytes:
    """Increasing places as gaps: low bytes first, then the higher planes."""
    gaps = np.diff(at, prepend=np.uint32(0)).astype("<u4")
    width = 2 if not len(gaps) or gaps.max() < 1 << 16 else 4
    return bytes([width]) + np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4)[:, :width].T).tobytes()


def _places(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    gaps = np.zeros((planes.shape[1], 4), np.uint8)
    gaps[:, :data[0]] = planes.T
    return np.cumsum(gaps.reshape(-1).view("<u4"), dtype=np.uint32)


def _packed(meta: list[tuple], sizes: list[int], local: np.ndarray) -> bytes:
    import pickle

    return pickle.dumps((meta, np.array(sizes, np.int64), np.packbits(local).tobytes(), len(local)), protocol=5)


def mark_recurring(docs: DataFrame, hashes: Callable, finish: Callable, schema: str) -> DataFrame:
    """``hashes(row values)`` gives (hash array, meta tuple) of a document;
    ``finish(meta, mask)`` gives the result rows of a document, mask telling
    for each of its hashes whether it occurs again in the corpus."""
    buckets = 4 * partitions(docs.sparkSession)

    def send(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        arrays, meta, total = [], [], 0

        def flush():
            every = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
            values, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
            local = counts[inverse] > 1
            home = (values % np.uint64(buckets)).astype(np.int64)
            cut = (values >> np.uint64(32)).astype("<u4")
            once = np.flatnonzero(counts == 1)
            place = np.zeros(len(values), "<u4")
            place[inverse] = np.arange(len(every), dtype="<u4")       # right where a value is single
            del every, inverse
            rows = []
            many = np.flatnonzero(counts > 1)
            once = once[np.lexsort((place[once], home[once]))]
            many = many[np.argsort(home[many], kind="stable")]
            ids = np.arange(buckets + 1)
            once_at, many_at = np.searchsorted(home[once], ids), np.searchsorted(home[many], ids)
            for b in range(buckets):
                o, m = once[once_at[b]:once_at[b + 1]], many[many_at[b]:many_at[b + 1]]
                if len(o) or len(m):
                    rows.append((b, chunk, _gaps(place[o]), cut[o].tobytes(), cut[m].tobytes(), None))
            rows.append((chunk % buckets, chunk, None, None, None, _packed(meta, [len(a) for a in arrays], local)))
            return _rows(_SENT, rows)

        for batch in batches:
            for values in zip(*[c.to_pylist() for c in batch.columns]):
                a, m = hashes(*values)
                arrays.append(a)
                meta.append(m)
                total += len(a)
                if total >= CHUNK_HASHES:
                    yield flush()
                    arrays, meta, total, chunk = [], [], 0, chunk + 1
        if meta:
            yield flush()

    def compare(table: pa.Table) -> pa.Table:
        out, sent = [], []
        for _, chunk, at, cut, known, meta in zip(*[c.to_pylist() for c in table.columns]):
            if meta is not None:
                out.append((chunk, None, meta))
            else:
                sent.append((chunk, at, np.frombuffer(cut, "<u4"), np.frombuffer(known, "<u4")))
        if sent:
            _, inverse, counts = np.unique(np.concatenate([x for _, _, c, k in sent for x in (c, k, k)]),
                                           return_inverse=True, return_counts=True)
            again, i = counts[inverse] > 1, 0
            for chunk, at, c, k in sent:
                hit = again[i:i + len(c)]
                i += len(c) + 2 * len(k)
                if hit.any():
                    out.append((chunk, _gaps(_places(at)[hit]), None))
        return pa.Table.from_batches([_rows(_FOUND, out)])

    def gather(table: pa.Table) -> pa.Table:
        import pickle

        chunk, at, meta = (c.to_pylist() for c in table.columns)
        metas, sizes, local, n = pickle.loads(next(m for m in meta if m is not None))
        mask = np.unpackbits(np.frombuffer(local, np.uint8), count=n).astype(bool)
        for a in at:
            if a is not None:
                mask[_places(a)] = True
        rows, i = [], 0
        for m, size in zip(metas, sizes):
            rows += finish(m, mask[i:i + size])
            i += size
        return pa.Table.from_pylist([dict(zip(target.names, r)) for r in rows], schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))
    found = docs.mapInArrow(tidy(send), _SENT).groupBy("bucket").applyInArrow(tidy_group(compare), _FOUND)
    return found.groupBy("chunk").applyInArrow(tidy_group(gather), schema)
