"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space of the word definition: space, tab, line feed, vertical tab,
# form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD_BREAK = "[\\x20\\x09-\\x0D]+"


def has_letter(text: str) -> bool:
    """Whether any character is a letter: digits in raised form or fractions
    are not."""
    return any(map(str.isalpha, text))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; null: no word."""
    t = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WORD_BREAK))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_RELEASED = [0.0]


def release(every_s: float = 2.0) -> None:
    """Hand freed memory back: Python workers outlive their tasks, and what
    they hold counts against the executor. At most once in ``every_s``, as
    small groups end thousands of times a task."""
    import ctypes
    import time

    if time.monotonic() - _RELEASED[0] < every_s:
        return
    _RELEASED[0] = time.monotonic()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable, rows: int = 1000) -> Callable:
    """``run`` over smaller batches of a task, releasing memory at its end."""
    def wrapped(batches):
        try:
            yield from run(b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))
        finally:
            release()
    return wrapped


def tidy_group(run: Callable) -> Callable:
    """``run`` for one group, releasing memory afterwards."""
    def wrapped(table):
        try:
            return run(table)
        finally:
            release()
    return wrapped
