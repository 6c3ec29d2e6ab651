"""Percentages with a zero guard, truncation and colour bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def whole_percent(part: Column, whole: Column) -> Column:
    """Truncated, not rounded."""
    return F.floor(percent(part, whole)).cast("bigint")


def band(pct: Column) -> Column:
    return F.when(pct > 75, "success").when(pct > 40, "warning").otherwise("danger")


def money(column: Column) -> Column:
    """Exact decimal sums leave the library as DOUBLE."""
    return column.cast("double")


def shown(column: Column, digits: int) -> Column:
    """Display text with a fixed number of decimals, ties to even."""
    return F.bround(column, digits).cast(f"decimal(20,{digits})").cast("string")
