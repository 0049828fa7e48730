"""Number-to-text helpers for alert details.

Money stays exact (decimal) until the very end; text pieces are built from
rounded decimals or integers so any SQL engine renders the same string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veeduria.functions.text import col_


def millions(c: str | Column) -> Column:
    """round(value / 1e6) as bigint, from an exact decimal."""
    return F.round(col_(c) / F.lit(1_000_000), 0).cast("bigint")


def billions(c: str | Column, digits: int = 1) -> Column:
    """round(value / 1e9, digits) as double (report unit 'mil millones')."""
    return F.round(col_(c).cast("double") / F.lit(1e9), digits)


def txt(c: str | Column) -> Column:
    """Text of a value; NULL becomes '?' so a detail is never NULL."""
    return F.coalesce(col_(c).cast("string"), F.lit("?"))


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den in double, NULL when den is 0 (no ANSI divide error)."""
    d = col_(den).cast("double")
    return F.when(d != 0, col_(num).cast("double") / d)


def round_txt(c: Column, digits: int) -> Column:
    """Text of round(double, digits)."""
    return txt(F.round(c, digits))


def fixed(c: Column, digits: int) -> Column:
    """Text of a double with ``digits`` decimals, engine-independent.

    Rounds as round(x * 10^d) / 10^d (plain IEEE steps, then a half-up round
    to an integer, which all SQL engines agree on) and prints through a
    decimal, so large values never turn into scientific notation.
    """
    k = float(10 ** digits)
    r = F.round(c * F.lit(k), 0) / F.lit(k)
    return txt(r.cast(f"decimal(38,{digits})"))


def round_half(c: Column, digits: int) -> Column:
    """round(double, digits) as round(x * 10^d) / 10^d: same IEEE steps in
    every engine (a plain round(x, d) differs between engines on values
    such as 1.005)."""
    k = float(10 ** digits)
    return F.round(c * F.lit(k), 0) / F.lit(k)


def bn(c: str | Column, digits: int) -> Column:
    """Value in 'mil millones' (1e9), rounded."""
    return round_half(col_(c).cast("double") / F.lit(1e9), digits)


def mm(c: str | Column, digits: int) -> Column:
    """Value in millions (1e6), rounded."""
    return round_half(col_(c).cast("double") / F.lit(1e6), digits)


def thousands(c: str | Column) -> Column:
    """Text of a whole number with commas between thousands; NULL stays."""
    return F.format_number(col_(c).cast("decimal(38,0)"), 0)


def padded(c: str | Column, width: int) -> Column:
    """Text of a whole number with zeros in front up to ``width`` digits; a
    longer number is not cut."""
    t = col_(c).cast("long").cast("string")
    return F.lpad(t, F.greatest(F.length(t), F.lit(width)), F.lit("0"))
