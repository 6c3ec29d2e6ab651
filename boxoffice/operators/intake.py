"""Checks on submitted forms: accepted rows and rejects with their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxoffice.schema import REQUIRED_DETAILS
from boxoffice.sources.tables import Tables

DESCRIPTION_LIMIT = 2000


def _errors(*rules: tuple[Column, str]) -> Column:
    """Codes of the rules that are broken."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(code)) for broken, code in rules]))


def _blank(name: str) -> Column:
    return F.coalesce(F.trim(name), F.lit("")) == ""


def review_intake(forms: DataFrame) -> DataFrame:
    """Reviews with trimmed text and a whole rating of 1..5, or the reason for the reject."""
    rating = F.expr("try_cast(trim(rating) AS INT)")
    errors = _errors((F.coalesce(~rating.between(1, 5), F.lit(True)), "rating"))
    return forms.select(
        "listing_id", "user_id", rating.cast("bigint").alias("rating"), F.trim("review_text").alias("review_text"), "created_at",
        errors.alias("errors")).withColumn("accepted", F.size("errors") == 0).withColumn("errors", F.array_join("errors", ","))


def listing_intake(forms: DataFrame) -> DataFrame:
    """Listings need title, type and start; descriptions have at most 2,000 characters."""
    errors = _errors(
        (_blank("title"), "title"), (_blank("type"), "type"), (_blank("date_start"), "date_start"),
        (F.length("description") > DESCRIPTION_LIMIT, "description"))
    start = F.expr("try_cast(replace(date_start, 'T', ' ') AS TIMESTAMP_NTZ)")
    return forms.select(
        "form_id", F.trim("title").alias("title"), "type", start.alias("date_start"), errors.alias("errors"),
    ).withColumn("accepted", F.size("errors") == 0).withColumn("errors", F.array_join("errors", ","))


def clean_pairs(frame: DataFrame, value: str) -> DataFrame:
    """Drop key/value rows with a blank value and trim the others."""
    return frame.filter(~_blank(value)).withColumn(value, F.trim(value))


def booking_checks(forms: DataFrame) -> DataFrame:
    """Registration forms: a phone number has ten digits, the quantity is 1..5."""
    quantity = F.expr("try_cast(qty AS INT)")
    errors = _errors(
        (~F.coalesce(F.col("phone"), F.lit("")).rlike(r"^\d{10}$"), "phone"),
        (F.coalesce(~quantity.between(1, 5), F.lit(True)), "qty"))
    return forms.select("registration_id", F.array_join(errors, ",").alias("errors"), (F.size(errors) == 0).alias("accepted"))


def missing_details(t: Tables, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """Required detail fields, by listing type, that a listing does not have."""
    wanted = t.spark.createDataFrame(list(rules or REQUIRED_DETAILS), "type string, field_key string")
    # The rule table is written in the call: a few rows.
    due = t.listings.select(F.col("id").alias("listing_id"), "type").join(F.broadcast(wanted), "type")
    have = clean_pairs(t.listing_details, "field_value").select("listing_id", "field_key")
    return due.join(have, ["listing_id", "field_key"], "left_anti").select("listing_id", "type", "field_key")
