"""String helpers, all built from JVM-side Spark functions (no Python UDF)."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() drops every character for which str.isspace() is
# true; Spark's one-argument trim only drops blanks. The set is derived by
# that rule, so strip() below equals Python's strip() exactly.
WHITESPACE = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Remove leading and trailing whitespace of any kind (tabs, newlines,
    no-break spaces): a character-set trim, no regular expression."""
    return F.trim(col_(c), F.lit(WHITESPACE))


def empty_to_null(c: Column) -> Column:
    """'' -> NULL (``nullif``: the expression is evaluated once)."""
    return F.nullif(c, F.lit(""))


def clean_id(c: str | Column) -> Column:
    """Identity number: strip, keep the text before the first '-' (check
    digit dropped), strip again; empty text becomes NULL, never 'None'."""
    s = F.substring_index(strip(c), "-", 1)
    return empty_to_null(strip(s))


def clean_entity_name(c: str | Column) -> Column:
    """Buyer name: strip, drop trailing '*', upper case."""
    return empty_to_null(F.upper(F.rtrim(strip(c), F.lit("*"))))


def clean_supplier_name(c: str | Column) -> Column:
    """Supplier name: strip, upper case."""
    return empty_to_null(F.upper(strip(c)))


def ilike_any(c: str | Column, patterns: Iterable[str]) -> Column:
    """OR-fold of case-insensitive LIKE patterns (NULL input stays NULL)."""
    cc = col_(c)
    terms = [cc.ilike(p) for p in patterns]
    if not terms:
        return F.lit(False)
    return functools.reduce(operator.or_, terms)


def one_line(c: str | Column) -> Column:
    """Replace line breaks by blanks and strip (dossier text)."""
    return strip(F.regexp_replace(col_(c), r"[\r\n]+", " "))
