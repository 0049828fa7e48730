"""Substring dedup with repeated-phrase automata.

A window is 20 consecutive words. Every word covered by a window whose words
also start earlier in the corpus is removed. The steps:

1. Anchors. In each window the 8-word phrase with the smallest hash (the
   leftmost of equals) is its anchor, so equal windows have equal anchors.
   Anchors that recur are found with one packed row per chunk and bucket
   (``recurring``); windows with other anchors occur once.
2. Passages. For each recurring anchor of a document the words of the windows
   it governs, 32 at most, are a passage. Equal passages within a task are
   confirmed at once: the earliest stays, the others are marked. One row per
   distinct passage leaves the task, to the shard of its anchor, so that a
   passage in a third of all documents is a row per task there. An anchor
   with more than ``CROWD`` such rows (an opening line, the edges of
   boilerplate: a different passage in each document) is crowded.
3. Automata. A shard marks equal passages again. Windows that different
   passages of one anchor share are compiled into an Aho-Corasick automaton
   over word numbers, and all passages of such anchors are streamed through
   it; of each window the earliest place stays, the others are marked.
   Words, not hashes, are compared. Passages of crowded anchors are cut into
   their windows instead: each task keeps the earliest place of a window and
   marks the others, and the windows are dealt by their own hash, so that the
   passages of such an anchor never meet in one task.
4. The marks of each document are gathered (never more than its windows) and
   its text is rewritten.

Documents that have no recurring anchor are not streamed: they can't hold a
confirmed phrase. Matching all texts against all shards would cost the
product of both sizes.

Defined results: a null text has no word; null ids come last in the order;
different texts with one id are ordered by a hash of the text; rows that are
equal in id and text are one document and get the same result; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veeduria.llm.common import partitions, tidy, tidy_group
from veeduria.llm.fingerprints import Hasher
from veeduria.llm.jaccard_join import rolling
from veeduria.llm.recurring import mark_recurring
from veeduria.session import reuse

WINDOW = 20
ANCHOR = 8
HOLD_PASSAGES = 400_000
HOLD_WINDOWS = 200_000
CROWD = 1_000                # rows of one anchor that a shard takes
_PLACES = "shard int, anchor long, passage binary, doc_id long, text_key long, start int, length int"
_WINDOWS = "shard int, window binary, doc_id long, text_key long, start int, length int"
_MARKS = "doc_id long, text_key long, start int, length int"


def anchors(words: list[bytes], hasher: Hasher, window: int = WINDOW, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window) of each anchor, in text order."""
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = rolling(hasher(words), k)
    span = window - k + 1
    at = np.concatenate([np.lib.stride_tricks.sliding_window_view(g[i:i + 65_536 + span - 1], span).argmin(axis=1) + i
                         for i in range(0, len(g) - span + 1, 65_536)]) if span > 1 else np.zeros(len(g), np.int64)
    at = at + np.concatenate([np.arange(min(65_536, len(g) - span + 1 - i)) for i in range(0, len(g) - span + 1, 65_536)])
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return g[at[first]], first, np.r_[first[1:] - 1, len(at) - 1]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching (start, length) ranges as one each."""
    out: list[list[int]] = []
    for start, length in sorted(ranges):
        if out and start <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], start + length - out[-1][0])
        else:
            out.append([start, length])
    return [(a, b) for a, b in out]


class Marks:
    """Ranges to remove, by document."""

    def __init__(self):
        self.by_doc: dict[tuple, list[tuple[int, int]]] = {}

    def add(self, doc: tuple, start: int, length: int):
        self.by_doc.setdefault(doc, []).append((start, length))

    def rows(self) -> list[tuple]:
        return [(*doc, start, length) for doc, ranges in self.by_doc.items() for start, length in merged(ranges)]


def _order(doc: tuple, start: int) -> tuple:
    return (doc[0] is None, doc[0] or 0, doc[1], start)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def recurring_anchors(docs: DataFrame, window: int, k: int) -> DataFrame:
    """(doc_id, text_key, recurs): one bit per anchor, where any recurs."""
    hasher = Hasher()       # one per task: sent empty, dropped with the task

    def hashes(doc_id, text_key, text):
        return anchors((text or "").encode().split(), hasher, window, k)[0], (doc_id, text_key)

    def finish(meta, mask):
        return [(*meta, np.packbits(mask).tobytes())] if mask.any() else []

    return mark_recurring(keyed(docs), hashes, finish, "doc_id long, text_key long, recurs binary")


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(cols, fields)],
                                      names=[n for n, _ in fields])


def passages(docs: DataFrame, marked: DataFrame, window: int, k: int) -> DataFrame:
    """Distinct passages of each task with their earliest place, and under
    shard -1 the ranges of the other places."""
    shards = 4 * partitions(docs.sparkSession)

    def run(batches):
        best: dict[bytes, tuple] = {}
        marks, hasher = Marks(), Hasher()

        def flush():
            rows = [(int(np.uint64(a) % np.uint64(shards)), int(np.uint64(a).view(np.int64)), p, *doc, start, length)
                    for p, (_, a, doc, start, length) in best.items()]
            rows += [(-1, None, None, *r) for r in marks.rows()]
            best.clear()
            marks.by_doc.clear()
            return _batch(_PLACES, rows)

        for b in batches:
            for doc_id, text_key, text, recurs in zip(*[c.to_pylist() for c in b.columns]):
                doc, words = (doc_id, text_key), text.encode().split()
                h, first, last = anchors(words, hasher, window, k)
                for i in np.flatnonzero(np.unpackbits(np.frombuffer(recurs, np.uint8), count=len(h))):
                    start, end = int(first[i]), int(last[i]) + window
                    p, now = b" ".join(words[start:end]), _order(doc, start)
                    old = best.get(p)
                    if old is None or now < old[0]:
                        best[p] = (now, h[i], doc, start, end - start)
                        if old is not None:
                            marks.add(old[2], old[3], old[4])
                    elif now > old[0]:
                        marks.add(doc, start, end - start)
            if len(best) > HOLD_PASSAGES:
                yield flush()
        yield flush()

    x = keyed(docs).join(marked.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "recurs"),
                         F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
    return x.select("doc_id", "text_key", "text", "recurs").mapInArrow(tidy(run), _PLACES)


def automaton(windows: list[tuple[int, ...]]):
    """Aho-Corasick automaton over sequences of word numbers."""
    import ahocorasick

    a = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for i, w in enumerate(windows):
        a.add_word(w, i)
    a.make_automaton()
    return a


def resolve(rows: list[tuple], window: int = WINDOW) -> list[tuple]:
    """Marks of one shard from (anchor, passage, doc_id, text_key, start,
    length) rows."""
    marks = Marks()
    best: dict[bytes, tuple] = {}
    for a, p, doc_id, text_key, start, length in rows:
        doc = (doc_id, text_key)
        now = _order(doc, start)
        old = best.get(p)
        if old is None or now < old[0]:
            best[p] = (now, a, doc, start, length)
            if old is not None:
                marks.add(old[2], old[3], old[4])
        elif now > old[0]:
            marks.add(doc, start, length)
    by_anchor: dict[int, list[tuple]] = {}
    for p, (_, a, doc, start, _) in best.items():
        by_anchor.setdefault(a, []).append((p, doc, start))
    number: dict[bytes, int] = {}
    streams, seen, shared = [], {}, {}
    for group in by_anchor.values():
        if len(group) < 2:
            continue
        for p, doc, start in group:
            s = tuple([number.setdefault(w, len(number)) for w in p.split(b" ")])
            streams.append((s, doc, start))
            for i in range(len(s) - window + 1):
                w = s[i:i + window]
                if seen.setdefault(w, len(streams)) != len(streams):
                    shared.setdefault(w, len(shared))
    if shared:
        a = automaton(list(shared))
        earliest: dict[int, tuple] = {}
        for s, doc, start in streams:
            for end, i in a.iter(s):
                now = (_order(doc, start + end - window + 1), doc)
                old = earliest.get(i)
                if old is not None and old[0] == now[0]:
                    continue
                lose = now if old is not None and old[0] < now[0] else old
                if lose is not now:
                    earliest[i] = now
                if lose is not None:
                    marks.add(lose[1], lose[0][-1], window)
    return marks.rows()


class Firsts:
    """The earliest place of each window; the other places are marked."""

    def __init__(self, window: int):
        self.window = window
        self.best: dict[bytes, tuple] = {}
        self.marks = Marks()

    def add(self, w: bytes, doc: tuple, start: int):
        now = _order(doc, start)
        old = self.best.get(w)
        if old is None or now < old[0]:
            self.best[w] = (now, doc)
            if old is not None:
                self.marks.add(old[1], old[0][-1], self.window)
        elif now > old[0]:
            self.marks.add(doc, start, self.window)


def crowded_anchors(places: DataFrame, crowd: int) -> DataFrame:
    """Anchors with more than ``crowd`` rows: at most rows / crowd of them."""
    return places.where("shard >= 0").groupBy("anchor").count().where(F.col("count") > crowd).select("anchor")


def windows(crowded: DataFrame, window: int) -> DataFrame:
    """Distinct windows of each task with their earliest place, to the shard
    of the window's hash; without a window, the ranges of the other places."""
    shards = 4 * partitions(crowded.sparkSession)

    def run(batches):
        firsts = Firsts(window)

        def flush():
            rows = [(zlib.crc32(w) % shards, w, *doc, now[-1], window) for w, (now, doc) in firsts.best.items()]
            rows += [((r[1] + r[2]) % shards, None, *r) for r in firsts.marks.rows()]
            firsts.__init__(window)
            return _batch(_WINDOWS, rows)

        for b in batches:
            for passage, doc_id, text_key, start in zip(*[c.to_pylist() for c in b.columns]):
                words = passage.split(b" ")
                for i in range(len(words) - window + 1):
                    firsts.add(b" ".join(words[i:i + window]), (doc_id, text_key), start + i)
            if len(firsts.best) > HOLD_WINDOWS:
                yield flush()
        yield flush()

    return crowded.select("passage", "doc_id", "text_key", "start").mapInArrow(tidy(run), _WINDOWS)


def resolve_windows(rows: list[tuple], window: int = WINDOW) -> list[tuple]:
    """Marks of one shard from (window, doc_id, text_key, start, length) rows."""
    firsts = Firsts(window)
    for w, doc_id, text_key, start, length in rows:
        if w is None:
            firsts.marks.add((doc_id, text_key), start, length)
        else:
            firsts.add(w, (doc_id, text_key), start)
    return firsts.marks.rows()


def dealt(places: DataFrame, window: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """The rows that meet by shard: passages, and windows of crowded anchors."""
    many = F.broadcast(reuse(crowded_anchors(places, crowd)))
    sent = places.where("shard >= 0")
    return sent.join(many, "anchor", "left_anti"), windows(sent.join(many, "anchor", "left_semi"), window)


def removals(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR, crowd: int | None = None) -> DataFrame:
    """(doc_id, text_key, ranges) of the documents that lose words."""
    marked = reuse(recurring_anchors(docs, window, k))
    places = reuse(passages(docs, marked, window, k))
    few, many = dealt(places, window, CROWD if crowd is None else crowd)

    def shard(resolved, columns):
        def run(table: pa.Table) -> pa.Table:
            return pa.Table.from_batches([_batch(_MARKS, resolved(list(zip(*[table[c].to_pylist() for c in columns])), window))])
        return tidy_group(run)

    place = ("doc_id", "text_key", "start", "length")
    found = few.groupBy("shard").applyInArrow(shard(resolve, ("anchor", "passage", *place)), _MARKS)
    found = found.unionByName(many.groupBy("shard").applyInArrow(shard(resolve_windows, ("window", *place)), _MARKS))
    every = places.where("shard < 0").select(*place).unionByName(found)
    return every.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "length")).alias("ranges"))


_WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def _mask(n: int, ranges: list[dict] | None) -> np.ndarray:
    gone = np.zeros(n, bool)
    for r in ranges or ():
        gone[r["start"]:r["start"] + r["length"]] = True
    return gone


def with_ranges(docs: DataFrame, window: int, k: int, crowd: int | None = None) -> DataFrame:
    """Columns of ``docs`` and ``_dd_ranges``, the ranges to remove."""
    r = removals(docs, window, k, crowd).select(F.col("doc_id").alias("_dd_id"), F.col("text_key").alias("_dd_key"),
                                         F.col("ranges").alias("_dd_ranges"))
    return docs.join(r, docs["doc_id"].cast("long").eqNullSafe(r["_dd_id"])
                     & (F.xxhash64(docs["text"]) == r["_dd_key"]), "left").drop("_dd_id", "_dd_key")


def report(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR, crowd: int | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    def run(batches):
        for b in batches:
            rows = []
            for doc_id, text, ranges in zip(*[c.to_pylist() for c in b.columns]):
                words = (text or "").encode().split()
                gone = _mask(len(words), ranges)
                n = int(gone.sum())
                kept = b" ".join([w for w, g in zip(words, gone) if not g] if n else words)
                rows.append((doc_id, len(words), n, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"])
    x = with_ranges(docs.select("doc_id", "text"), window, k, crowd)
    return x.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "_dd_ranges").mapInArrow(
        tidy(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """``docs`` with the removed words, and the space after each, cut from
    ``text``; documents that lose every word are left out. A column
    ``n_chars`` follows the text."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def cut(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        out = []
        for text, rs in zip(texts.to_pylist(), ranges.to_pylist()):
            if rs:
                parts = _WORD.findall(text.encode())
                gone = _mask(len(parts), rs)
                text = None if gone.all() else b"".join([p for p, g in zip(parts, gone) if not g]).decode()
            out.append(text)
        return pa.array(out, pa.string())

    x = with_ranges(docs, window, k).withColumn("_dd_text", F.when(
        F.col("_dd_ranges").isNull(), F.col("text")).otherwise(cut("text", "_dd_ranges")))
    x = x.where(F.col("_dd_ranges").isNull() | F.col("_dd_text").isNotNull())
    changed = {"text": F.col("_dd_text")} | ({"n_chars": F.length("_dd_text").cast("long")} if "n_chars" in docs.columns else {})
    kept = [F.when(F.col("_dd_ranges").isNotNull(), changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c)
            for c in docs.columns]
    return x.select(*kept)


_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

#: The report's rows by DuckDB: a window is a repeat if it is not the first of
#: its words by document and place; a word goes if one of the 20 windows that
#: hold it is a repeat.
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
k AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i,
        unnest(list_concat(list_transform(range(1, len(w) - 18), lambda i: md5(array_to_string(w[i:i + 19], ' '))),
                           list_transform(range(0, least(len(w), 19)), lambda i: NULL::VARCHAR))) AS k
      FROM d),
r AS (SELECT doc_id, word, i, CASE WHEN k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1
        THEN 1 ELSE 0 END AS again FROM k),
g AS (SELECT doc_id, word, i, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
      FROM r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(g.n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(g.kept, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept
                  FROM g GROUP BY 1) g USING (doc_id)"""
