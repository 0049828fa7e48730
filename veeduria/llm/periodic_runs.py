"""Periodic runs of words, by recursive frequency splitting.

A run is a stretch of words with smallest period q (words q apart are equal)
of at least ``max(12, 2 q)`` words that no neighbour extends. Every word of a
run stands in it at least twice. So a word that occurs once within the
current segment of a text lies in no run and splits the segment; its parts
are segments of their own, in which further words occur once, until none
does. Each split is looked for from both ends at once, so it costs no more
than the smaller part and a text of n words is split in n log n steps.

Surviving segments are scanned by lag. A run with a period in [s, 2 s) has a
multiple of s within its first period, so for each power of two s only the
multiples of s are compared with the words s to 2 s - 1 behind them: n
comparisons for each s. Equal words are extended to both sides through names
of the blocks of 1, 2, 4, ... words (equal blocks have equal names, so no
comparison can be wrong); a stretch that reaches over two periods is a run.
A multiple of a period gives the same stretch and loses to the smaller one.

Documents are worked on where they lie: nothing is shuffled. Memory is that
of some 2,000,000 characters of texts, or of the longest text if that is
longer, times the logarithm of its longest surviving segment.

Defined results: a null or empty text has no word, no run and the checksums
of nothing; a null id alters no word; repeated rows each give a row; an empty
table gives an empty result. Columns other than ``doc_id`` and ``text`` are
not read.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veeduria.llm.common import tidy
from veeduria.llm.tokens import groups

MIN_WORDS = 12
SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
          "collapsed_sha256 string")


class _Numbers(dict):
    """A number for every word, in order of first sight."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def altered(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words that count: of one id in ten, a stretch is repeated from
    some place to the end."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def segments(words: np.ndarray, min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Stretches [left, right) of at least ``min_words`` words in which every
    word occurs twice or more; each run lies in one of them."""
    n = len(words)
    if n < min_words:
        return []
    order = np.argsort(words, kind="stable")
    same = words[order[1:]] == words[order[:-1]]
    before, after = np.full(n, -1), np.full(n, n)
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    cuts = np.concatenate(([-1], np.flatnonzero((before < 0) & (after >= n)), [n]))
    wide = np.flatnonzero(np.diff(cuts) > min_words)
    todo = [(int(cuts[i]) + 1, int(cuts[i + 1])) for i in wide]
    if not todo:
        return []
    before, after, found = before.tolist(), after.tolist(), []
    while todo:
        left, right = todo.pop()
        i, j = left, right - 1
        while i <= j:
            if before[i] < left and after[i] >= right:
                break
            if before[j] < left and after[j] >= right:
                i = j
                break
            i += 1
            j -= 1
        else:
            found.append((left, right))
            continue
        todo += [x for x in ((left, i), (i + 1, right)) if x[1] - x[0] >= min_words]
    return sorted(found)


def _names(words: np.ndarray) -> list[np.ndarray]:
    """For each power of two k the names of all blocks of k words."""
    out = [np.unique(words, return_inverse=True)[1].astype(np.int32)]
    while 2 << (len(out) - 1) <= len(words):
        a, half = out[-1], 1 << (len(out) - 1)
        pairs = a[:-half].astype(np.int64) * (int(a.max()) + 1) + a[half:]
        out.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))
    return out


def _agree(names: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
    """How many words from i and j (i < j) on, or before them, are equal."""
    n, out = len(names[0]), np.zeros(len(i), np.int64)
    for k in range(len(names) - 1, -1, -1):
        size = 1 << k
        at = np.flatnonzero(i - out >= size if back else j + out + size <= n)
        step = -out[at] - size if back else out[at]
        out[at] += size * (names[k][i[at] + step] == names[k][j[at] + step])
    return out


def lag_scan(words: np.ndarray, min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of one segment."""
    n, names, step = len(words), _names(words), 1
    periods: dict[tuple[int, int], int] = {}
    while step <= n // 2:
        lags = np.arange(step, min(2 * step, n // 2 + 1))
        a = np.repeat(np.arange(0, n, step), len(lags))
        q = np.tile(lags, -(-n // step))
        near = np.flatnonzero(a + q < n)
        near = near[words[a[near]] == words[a[near] + q[near]]]
        a, q = a[near], q[near]
        behind = _agree(names, a, a + q, back=True)
        both = behind + _agree(names, a, a + q, back=False)
        good = np.flatnonzero((both >= q) & (both + q >= min_words))
        start, end, q = (a - behind)[good], (a - behind + both + q)[good], q[good]
        order = np.lexsort((q, end, start))
        for i in order[np.unique((start * (n + 1) + end)[order], return_index=True)[1]].tolist():
            # smaller periods come first: steps ascend, and so do periods within one
            periods.setdefault((int(start[i]), int(end[i])), int(q[i]))
        step *= 2
    return [(s, e, q) for (s, e), q in periods.items()]


def runs(words: np.ndarray, min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    return sorted((left + s, e - s, q) for left, right in segments(words, min_words)
                  for s, e, q in lag_scan(words[left:right], min_words))


def collapse(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: not those behind the first period of a run."""
    change = np.zeros(n + 1, np.int64)
    for s, length, q in found:
        change[s + q] += 1
        change[s + length] -= 1
    return np.cumsum(change[:n]) == 0


def describe(doc_id: int | None, text: bytes | None, numbers: _Numbers) -> tuple:
    """One result row; ``text`` is UTF-8."""
    # bytes are split at the six white space characters of ASCII only
    words = altered(doc_id, (text or b"").split())
    found = runs(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = compress(words, collapse(len(words), found).tolist()) if found else words
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def report(docs: DataFrame) -> DataFrame:
    """Per document: its runs, the longest one, checksums of all runs and of
    the text without the repetitions."""
    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()
            for lo, hi in groups(texts):
                numbers = _Numbers()
                out = [describe(i, t, numbers) for i, t in zip(ids[lo:hi], texts[lo:hi])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.string() if k > 5 else pa.int64()) for k, c in enumerate(zip(*out))],
                    names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), SCHEMA)
