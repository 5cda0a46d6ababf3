"""Deterministic randomness: numbers, orders and draws from MD5, the same in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_text(*parts: Column | str | int) -> Column:
    """Parts joined by "|"."""
    return F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def order_key(*parts: Column | str | int) -> Column:
    """A hash to shuffle by."""
    return F.md5(hash_text(*parts).cast("binary"))


def number(*parts: Column | str | int) -> Column:
    """60 bits as a whole number."""
    return F.conv(F.substring(order_key(*parts), 1, 15), 16, 10).cast("long")
