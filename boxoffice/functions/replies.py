"""Reading JSON objects out of free text replies, and building JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- Fixed values: fallback answers of the reply reader. ----
VERDICT_DEFAULT = "Warning"
VERDICT_NO_OBJECT = "Could not parse AI response."
VERDICT_BROKEN = "AI review failed."
PRICE_DEFAULT = "499"
PRICE_REASON_DEFAULT = "Based on market research."
PRICE_REASON_BROKEN = "Using default pricing suggestion."
# ---- End of fixed values. ----


def json_object(text: Column) -> Column:
    """From the first opening to the last closing brace, across lines; '' when there is none."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def with_fields(rows: DataFrame, text: str) -> DataFrame:
    """Add ``object`` (the braces' text, '' when there are none) and ``fields`` (its entries as a map,
    NULL unless the braces hold exactly one valid object).

    Reading it as a one-element array makes trailing text or a second object an error. The steps are
    columns of their own, so each reply is searched and parsed once.
    """
    found = rows.withColumn("object", json_object(F.col(text)))
    listed = F.from_json(F.concat(F.lit("["), "object", F.lit("]")), "array<map<string,string>>", {"allowSingleQuotes": "false"})
    read = found.withColumn("fields", F.when(F.col("object") != "", listed))
    return read.withColumn("fields", F.when(F.size("fields") == 1, F.col("fields").getItem(0)))


def field_or(fields: Column, name: str, default: Column) -> Column:
    """The field's value when present (even if null), else the default."""
    return F.when(F.map_contains_key(fields, name), fields.getItem(name)).otherwise(default)


def ticket_code(listing_id: Column, key: Column, prefix: str) -> Column:
    """Prefix, listing and six characters that follow from the key."""
    tail = F.upper(F.substring(F.sha2(key.cast("string"), 256), 1, 6))
    return F.concat(F.lit(prefix), listing_id.cast("string"), F.lit("-"), tail)
