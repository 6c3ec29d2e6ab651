"""Text expressions: tolerant comparison, labels, fallbacks, truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Equality ignores case, accents and trailing spaces; substring search ignores case and accents.
EQUAL_COLLATION = "UNICODE_CI_AI_RTRIM"
SEARCH_COLLATION = "UNICODE_CI_AI"


def folded(column: Column) -> Column:
    """``column`` compared and grouped without regard to case, accents or trailing spaces."""
    return F.collate(column, EQUAL_COLLATION)


def folds_by_case(column: Column) -> Column:
    """Whether the text is plain ASCII without control characters, so that ``plain_folded`` tells the same apart as ``folded``."""
    return column.rlike(r"^[ -~]*\z")


def plain_folded(column: Column) -> Column:
    return F.lower(F.rtrim(column))


def has_text(column: Column, needle: str | Column, *, wildcards: bool = False) -> Column:
    """Substring test. With ``wildcards`` the characters % and _ in the needle act as in LIKE."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    if wildcards:
        return F.like(F.lower(column), F.lower(F.concat(F.lit("%"), needle, F.lit("%"))))
    return F.contains(F.collate(column, SEARCH_COLLATION), F.collate(needle, SEARCH_COLLATION))


def label(column: Column) -> Column:
    """``food_festival`` becomes ``Food Festival``."""
    return F.initcap(F.replace(column, F.lit("_"), F.lit(" ")))


def shortened(column: Column, size: int) -> Column:
    return F.when(F.length(column) > size, F.concat(F.left(column, F.lit(size)), F.lit("..."))).otherwise(column)


def first_filled(*columns: Column) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def comma_list(column: Column) -> Column:
    return F.when(F.coalesce(column, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(column, ","))
